import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import folds as WF
from tidemark.operators import joins as JN
from tidemark.operators import models as ML
from tidemark.operators import stats as ST
from tidemark.operators import uncertainty as UN
from tidemark.operators import validate as VAL

SETS = {"heat": ["heat"], "both": ["heat", "rain"]}


def harvests(spark, n=22, seed=1, effect=-0.08, keys="ab"):
    rng = np.random.default_rng(seed)
    rows = []
    for k in keys:
        for y in range(n):
            heat, rain = rng.normal(), rng.normal()
            rows.append((k, y + 1, float(heat), float(rain), float((5 + 0.1 * y) * (1 + effect * heat + 0.02 * rng.normal()))))
    return rows, spark.createDataFrame(rows, "k string, h long, heat double, rain double, yield double")


def reference_forecast(train, x, cols):
    h = np.array([r[1] for r in train], float)
    y = np.array([r[4] for r in train])
    b, a = np.polyfit(h, y, 1)
    t = y / (a + b * h) - 1
    X = np.array([[r[c] for c in cols] for r in train])
    Z = (X - X.mean(0)) / X.std(0)
    w = np.linalg.solve(Z.T @ Z + np.eye(len(cols)), Z.T @ (t - t.mean()))
    z = (np.array([x[c] for c in cols]) - X.mean(0)) / X.std(0)
    return a + b * x[1], t.mean() + z @ w


def test_expanding_forecasts_equal_a_direct_refit(spark):
    rows, df = harvests(spark)
    got = {(r.k, r.h, r.feature_set): r for r in WF.expanding_predictions(df, ["k"], "h", "yield", SETS, 10).collect()}
    for x in rows:
        train = [r for r in rows if r[0] == x[0] and r[1] < x[1]]
        if len(train) < 10:
            assert (x[0], x[1], "heat") not in got
            continue
        for name, cols in (("heat", [2]), ("both", [2, 3])):
            trend, anomaly = reference_forecast(train, x, cols)
            r = got[(x[0], x[1], name)]
            assert abs(r.trend - trend) < 1e-9 and abs(r.predicted_anomaly - anomaly) < 1e-9


def test_later_harvests_cannot_change_an_earlier_forecast(spark):
    _, df = harvests(spark)
    cut = WF.expanding_predictions(df.filter("h <= 15"), ["k"], "h", "yield", SETS, 10)
    full = WF.expanding_predictions(df, ["k"], "h", "yield", SETS, 10).filter("h <= 15")
    a, b = ({(r.k, r.h, r.feature_set): r.predicted for r in x.collect()} for x in (cut, full))
    assert a.keys() == b.keys() and all(abs(a[q] - b[q]) < 1e-12 for q in a)


def test_planted_effect_scores_and_noise_does_not(spark):
    _, planted = harvests(spark, 40, 3, -0.1)
    _, noise = harvests(spark, 40, 3, 0.0)

    def r2(df):
        p = WF.expanding_predictions(df, ["k"], "h", "yield", {"heat": ["heat"]}, 12)
        return {r.feature_set: r.r2_vs_trend for r in WF.score_predictions(p, ["feature_set"]).collect()}

    a, b = r2(planted), r2(noise)
    assert a["heat"] > 0.5 and b["heat"] < 0.2 and abs(a["trend_only"]) < 1e-12


def test_residual_folds_equal_direct_leave_one_out(spark):
    rows, df = harvests(spark, 13, 5, keys="a")
    got = {(r.h, r.feature_set): r for r in WF.fold_residuals(df, ["k"], "h", "yield", {"heat": ["heat"]}, 10).collect()}
    assert {h for h, _ in got} == {11, 12, 13}
    for h in (11, 13):
        x = rows[h - 1]
        train = rows[: h - 1]
        r = got[(h, "heat")]
        for i, held in enumerate(train):
            inner = [q for q in train if q is not held]
            t0, a0 = reference_forecast(inner, held, [2])
            t1, a1 = reference_forecast(inner, x, [2])
            assert abs(r.signed[i] - (held[4] - t0 * (1 + a0))) < 1e-9 and abs(r.loo_point[i] - t1 * (1 + a1)) < 1e-9
        assert len(r.signed) == len(r.train_anomalies) == h - 1


def test_short_records_have_no_finite_conformal_interval(spark):
    _, df = harvests(spark, 14, 5, keys="a")
    iv = WF.intervals(WF.fold_residuals(df, ["k"], "h", "yield", {"heat": ["heat"]}, 10), ["k", "h", "feature_set"], (0.8, 0.99))
    got = {(r.method, r.nominal_level): r.finite for r in iv.filter("h = 11").collect()}
    assert got[("jackknife_plus", 0.99)] is False and got[("jackknife", 0.99)] is False
    assert got[("jackknife_plus", 0.8)] and got[("gaussian", 0.99)]


def test_drop_one_moments_equal_refits(spark):
    rng = np.random.default_rng(4)
    n = 25
    data = [("a", i, float(x), float(z), float(x - 0.3 * z + e)) for i, (x, z, e) in enumerate(rng.normal(size=(n, 3)))]
    got = ST.horse_race(spark.createDataFrame(data, "k string, y int, f double, p double, a double"), ["k"], "a", "f", "p", "y").first()

    def r2(rows, cols):
        A = np.column_stack([np.ones(len(rows)), *[[r[c] for r in rows] for c in cols]])
        y = np.array([r[4] for r in rows])
        e = y - A @ np.linalg.lstsq(A, y, rcond=None)[0]
        return 1 - e @ e / ((y - y.mean()) @ (y - y.mean()))

    inc = [r2([r for r in data if r is not q], [2, 3]) - r2([r for r in data if r is not q], [3]) for q in data]
    assert abs(got.incremental_min - min(inc)) < 1e-9 and abs(got.incremental_max - max(inc)) < 1e-9
    assert got.load_bearing_year == int(np.argmin(inc)) and abs(got.joint_r2 - r2(data, [2, 3])) < 1e-9


def test_wide_regression_equals_least_squares(spark):
    rng = np.random.default_rng(6)
    X = rng.normal(size=(60, 4))
    y = X @ [1.0, -2.0, 0.0, 0.5] + 3 + rng.normal(size=60)
    df = spark.createDataFrame([("a", *map(float, x), float(v)) for x, v in zip(X, y)], "k string, a double, b double, c double, e double, y double")
    got = ST.ols(df, ["k"], "y", ["a", "b", "c", "e"]).first()
    want = np.linalg.lstsq(np.column_stack([np.ones(60), X]), y, rcond=None)[0]
    assert np.allclose([got.intercept, got.b_a, got.b_b, got.b_c, got.b_e], want)


def test_folds_respect_embargo_and_sizes(spark):
    df = spark.createDataFrame([("a", i) for i in range(120)], "k string, i int")
    f = WF.forward_folds(df, ["k"], "i", 5, 3, min_train=30, min_test=10)
    got = {(r.fold, r.role): (r.a, r.b) for r in f.groupBy("fold", "role").agg(F.min("i").alias("a"), F.max("i").alias("b")).collect()}
    assert got[(2, "train")] == (0, 36) and got[(2, "test")] == (40, 59) and (1, "train") not in got


def test_sealed_year_is_never_returned(spark):
    df = spark.createDataFrame([("a", y) for y in range(2018, 2024)], "k string, y int")
    f = WF.year_folds(df, "y", (2021, 2022), 2018, 2023)
    assert f.filter("y = 2023").count() == 0 and f.filter("role = 'train' AND y >= fold").count() == 0


def test_elastic_net_matches_coordinate_descent(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(80, 2)) * [3.0, 0.5] + 1
    y = X @ [0.4, -1.0] + rng.normal(size=80)
    alpha, l1 = 0.1, 0.5
    Z = (X - X.mean(0)) / X.std(0)
    w, yc = np.zeros(2), y - y.mean()
    for _ in range(500):
        for j in range(2):
            r = yc - Z @ w + Z[:, j] * w[j]
            rho = Z[:, j] @ r / 80
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (Z[:, j] @ Z[:, j] / 80 + alpha * (1 - l1))
    want = y.mean() + Z @ w
    rows = [(1, role, float(a), float(b), float(v)) for role in ("train", "test") for (a, b), v in zip(X, y)]
    df = spark.createDataFrame(rows, "fold int, role string, a double, b double, y double")
    got = ML.fit_enet(df, ["fold"], "y", ["a", "b"], {"off": (0.0, 0.5), "on": (alpha, l1)}).filter("candidate = 'on'")
    assert np.abs(np.sort([r.score for r in got.collect()]) - np.sort(want)).max() < 1e-9


def test_equal_cells_go_to_the_first_listed_candidate(spark):
    rows = [("a", c, place, (-1.0) ** i, 0.01 * (-1) ** i + 0.002 * i, 0.001) for c, place in (("z", 0), ("a", 1)) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, c string, place int, s double, y double, cost double")
    r = WF.choose(df, ["k"], "c", "s", "y", "cost", place="place").first()
    assert (r.c, r.threshold) == ("z", 0.001)
    fixed = WF.choose(df, ["k"], "c", "s", "y", "cost", place="place", fixed=WF.PROBABILITY_THRESHOLDS).first()
    assert (fixed.c, fixed.threshold) == ("z", 0.0)


def test_choice_sees_training_rows_only(spark):
    rng = random.Random(4)
    base = [("a", 1, "train" if i < 150 else "test", i, rng.gauss(0, 1), rng.gauss(0, 1), 0.001) for i in range(180)]
    other = [(*r[:4], r[4], 99.0, r[6]) if r[2] == "test" else r for r in base]
    picks = []
    for rows in (base, other):
        df = spark.createDataFrame(rows, "k string, fold int, role string, d int, x double, y double, cost double")
        chosen = WF.nested_choice(df, ["k", "fold"], "d", "y", ["x"], "cost", {"alpha=1": 1.0, "alpha=100": 100.0})
        r = chosen.first()
        picks.append((r.candidate, r.trades, *(round(x, 9) for x in (r.threshold, r.net, r.sharpe))))
        assert WF.refit_choice(df, chosen, ["k", "fold"], "y", ["x"], {"alpha=1": 1.0, "alpha=100": 100.0}).count() == 30
    assert picks[0] == picks[1]


def test_no_cell_with_enough_trades_means_no_trade(spark):
    df = spark.createDataFrame([("a", "m", 0.0, 0.1, 0.01)] * 20, "k string, c string, s double, y double, cost double")
    r = WF.choose(df, ["k"], "c", "s", "y", "cost").first()
    assert r.threshold == float("inf") and r.trades == 0


def test_duplicate_key_fails_the_job(spark):
    a = spark.createDataFrame([(1, "x")], "i int, a string")
    b = spark.createDataFrame([(1, "y"), (1, "z")], "i int, b string")
    with pytest.raises(PySparkException, match="duplicate key"):
        JN.checked_join(a, b, ["i"]).collect()
    assert JN.checked_join(b, a, ["i"]).count() == 2


def ledger(spark, nets):
    day = dt.date(2024, 1, 1)
    rows = [("a", day + dt.timedelta(days=7 * i), 2024, 1, n, n, 1, 0.0) for i, n in enumerate(nets)]
    return spark.createDataFrame(rows, "k string, d date, year int, fold int, net double, gross double, signal int, cost double")


def test_metrics_and_gate(spark):
    m = VAL.strategy_metrics(ledger(spark, [0.1, -0.2, 0.1]), ["k"], ["d"])
    r = m.first()
    assert abs(r.max_drawdown + 0.2) < 1e-12 and abs(r.total_net) < 1e-12 and r.trades == 3 and abs(r.hit_rate - 2 / 3) < 1e-12
    g = VAL.gate(m, ["k"], {"enough trades": F.col("trades") >= 30, "drawdown": F.col("max_drawdown") > -0.25, "unknown": F.lit(None).cast("boolean")}).first()
    assert not g.passed and g.failures == "enough trades; unknown"


def test_bootstrap_is_repeatable_and_bounded(spark):
    df = spark.createDataFrame([("a", y, float(y - 2010)) for y in range(2005, 2020)], "k string, y int, v double")
    a, b = (UN.block_bootstrap(df, ["k"], "y", "v", 300, 9).first() for _ in range(2))
    assert a == b and a.p025 < a.median < a.p975 and 0 < a.probability_positive < 1


def test_shift_null_equals_the_sequential_rule(spark):
    rng = random.Random(8)
    rows, day = [], dt.date(2022, 10, 1)
    for _ in range(120):
        day += dt.timedelta(days=rng.randrange(1, 6))
        rows.append(("a", day, day + dt.timedelta(days=rng.randrange(0, 15)), day.year, rng.choice([-1, 0, 1]), rng.gauss(0, 0.02), 0.001))
    df = spark.createDataFrame(rows, "k string, e date, x date, year int, raw int, gross double, cost double")
    got = {r.draw: r.total for r in UN.circular_null(df, ["k"], "e", "year", "raw", "e", "x", "gross", "cost", 40, 3).collect()}
    for draw in range(1, 41):
        last, total = None, 0.0
        for year in sorted({r[3] for r in rows}):
            mine = [r for r in rows if r[3] == year]
            off = int(hashlib.md5(f"3:{draw}:{year}".encode()).hexdigest()[:8], 16) % len(mine)
            for i, (_, e, x, _, _, gross, cost) in enumerate(mine):
                s = mine[(i - off) % len(mine)][4]
                if s and (last is None or e > last):
                    total += s * gross - abs(s) * cost
                    last = x
        assert abs(got[draw] - total) < 1e-12


def test_coefficient_draws_are_weighted_regressions(spark):
    rng = np.random.default_rng(5)
    rows = [("a", i, float(a), float(b), float(a - 2 * b + c)) for i, (a, b, c) in enumerate(rng.normal(size=(12, 3)))]
    got = UN.coef_bootstrap(spark.createDataFrame(rows, "k string, h int, a double, b double, y double"), ["k"], "h", "y", ["a", "b"], 60, 7).first()
    values = []
    for draw in range(1, 61):
        at = [int(hashlib.md5(f"7:{draw}:{s}".encode()).hexdigest()[:8], 16) % 12 for s in range(1, 13)]
        if len(set(at)) >= 4:
            m = np.array([rows[i][2:] for i in at])
            values.append(np.linalg.lstsq(np.column_stack([m[:, :2], np.ones(12)]), m[:, 2], rcond=None)[0][0])
    assert got.draws == len(values) and abs(got.median - np.median(values)) < 1e-9


def test_shift_by_the_whole_year_keeps_totals(spark):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=3 * i), dt.date(2024, 1, 2) + dt.timedelta(days=3 * i), 2024, 1, 0.01, 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, e date, x date, year int, raw int, gross double, cost double")
    null = UN.circular_null(df, ["k"], "e", "year", "raw", "e", "x", "gross", "cost", 5, 1).collect()
    assert len(null) == 5 and all(abs(r.total - 0.2) < 1e-12 for r in null)


def plain_trees(x, y, leaves, trees, rate, l2, min_leaf, test):
    """Boosted trees grown on rows, leaf by leaf; every value of a regressor is a bin. Returns test scores and losses."""
    base = y.mean()
    score, out, losses = np.full(len(y), base), np.full(len(test), base), []
    for _ in range(trees):
        r = y - score
        parts = [(np.arange(len(y)), np.arange(len(test)))]

        def best(rows):
            found = []
            for j in range(x.shape[1]):
                for cut in np.unique(x[rows, j]):
                    left = rows[x[rows, j] <= cut]
                    right = rows[x[rows, j] > cut]
                    if len(left) >= min_leaf and len(right) >= min_leaf:
                        gain = r[left].sum() ** 2 / (len(left) + l2) + r[right].sum() ** 2 / (len(right) + l2) - r[rows].sum() ** 2 / (len(rows) + l2)
                        found.append((gain, j, cut))
            return max(found, key=lambda f: f[0], default=(0, 0, 0))

        while len(parts) < leaves:
            options = [best(rows) for rows, _ in parts]
            at = max(range(len(parts)), key=lambda i: options[i][0])
            gain, j, cut = options[at]
            if gain <= 1e-12:
                break
            rows, asked = parts[at]
            parts[at] = rows[x[rows, j] <= cut], asked[test[asked, j] <= cut]
            parts.append((rows[x[rows, j] > cut], asked[test[asked, j] > cut]))
        for rows, asked in parts:
            step = rate * r[rows].sum() / (len(rows) + l2)
            score[rows] += step
            out[asked] += step
        losses.append(((y - score) ** 2).sum())
    return out, losses


def boosted_frame(spark, n=160, seed=3, levels=7):
    rng = np.random.default_rng(seed)
    rows = []
    for fold in (1, 2):
        for i in range(n):
            a, b = (float(v) for v in rng.integers(0, levels, 2))
            rows.append((fold, i, "train" if i < n * 3 // 4 else "test", a, b, float(np.sin(a) * (b > 3) + rng.normal() / 5)))
    return rows, spark.createDataFrame(rows, "fold int, i int, role string, a double, b double, y double")


def test_boosted_trees_equal_trees_on_rows(spark):
    rows, df = boosted_frame(spark)
    # more bins than values: every value is a bin of its own
    got = ML.fit_boosted(df, ["fold"], "y", ["a", "b"], {"few": 3, "more": 6}, trees=12, rate=0.3, min_leaf=5, bins=200).collect()
    assert len(got) == 2 * 2 * 40
    for fold in (1, 2):
        train = [r for r in rows if r[0] == fold and r[2] == "train"]
        test = [r for r in rows if r[0] == fold and r[2] == "test"]
        for name, leaves in (("few", 3), ("more", 6)):
            want, losses = plain_trees(np.array([r[3:5] for r in train]), np.array([r[5] for r in train]), leaves, 12, 0.3, 1.0, 5, np.array([r[3:5] for r in test]))
            assert all(b <= a for a, b in zip(losses, losses[1:]))
            have = {r.i: r.score for r in got if r.fold == fold and r.candidate == name}
            assert np.abs(np.array([have[r[1]] for r in test]) - want).max() < 1e-9


def test_training_loss_never_rises():
    rng = np.random.default_rng(5)
    bins = np.stack(np.unravel_index(np.arange(400), (20, 20)), axis=1)
    n = rng.integers(0, 9, 400).astype(float)
    total = n * (np.sin(bins[:, 0]) + rng.normal(size=400))
    trace = []
    ML.grow_trees(n, total, bins, 7, 60, 0.05, 1.0, 20, trace)
    assert len(trace) == 60 and all(b <= a for a, b in zip(trace, trace[1:])) and trace[-1] < trace[0]


def test_boosted_trees_with_holes_repeats_and_nothing_to_learn(spark):
    rows = [(1, "train", None if i % 5 == 0 else float(i % 7), 2.0, None if i % 9 == 0 else 1.0) for i in range(90)] + [(1, "test", None, 9.0, 0.0)] * 2 + [(2, "test", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "fold int, role string, a double, b double, y double")
    got = ML.fit_boosted(df, ["fold"], "y", ["a", "b"], {"x": 7}, trees=5).collect()
    assert [(r.fold, r.score) for r in got] == [(1, 1.0)] * 2
    assert ML.fit_boosted(df.filter("false"), ["fold"], "y", ["a", "b"], {"x": 7}).count() == 0


def test_boosted_trees_of_the_query_test_every_year(spark):
    from tidemark.plans import load
    from tidemark.plans.q_folds import YEARS

    out = load()["wf8_fit_gbt"].run(spark, "/root/testdata/sf0.001").select("fold", "candidate", "score").collect()
    assert sorted({r.fold for r in out}) == list(YEARS) and len({round(r.score, 4) for r in out}) > 50


def logit_gradient(train, theta, c, p):
    """Gradient of the weighted loss and penalty per unit of weight, at coefficients that reproduce the scores."""
    x = np.column_stack([np.ones(len(train)), np.array([r[:p] for r in train])])
    label = np.array([r[p] for r in train])
    seen, counts = np.unique(label, return_counts=True)
    w = np.array([len(train) / (len(seen) * counts[seen == v][0]) for v in label])
    raw = np.exp(x @ theta.T)
    raw[:, [k for k in range(3) if k not in seen]] = 0
    share = raw / raw.sum(axis=1, keepdims=True)
    return (((share - np.eye(3)[label]) * w[:, None]).T @ x + np.c_[np.zeros(3), theta[:, 1:]] / c) / len(train)


def test_logits_end_where_the_gradient_is_zero(spark):
    rng = np.random.default_rng(8)
    rows = []
    for fold in (1, 2):
        for i in range(200):
            a, b = rng.normal(size=2) * [3, 0.2] + 1
            rows.append((fold, "train" if i < 150 else "test", float(a), float(b), float(0.01 * (a - 1) + 0.02 * rng.normal()), 0.001))
    df = spark.createDataFrame(rows, "fold int, role string, a double, b double, y double, cost double")
    got = ML.fit_logits(df, ["fold"], "y", "cost", ["a", "b"], {"weak": 0.1, "strong": 10.0}).collect()
    assert len(got) == 2 * 2 * 50 and all(-1 < r.score < 1 for r in got)
    for fold in (1, 2):
        mine = [r for r in rows if r[0] == fold and r[1] == "train"]
        x = np.array([r[2:4] for r in mine])
        z = (x - x.mean(0)) / x.std(0)
        train = [(*v, 2 if r[4] > 0.0035 else 0 if r[4] < -0.0035 else 1) for v, r in zip(z.tolist(), mine)]
        for name, c in (("weak", 0.1), ("strong", 10.0)):
            theta = np.zeros((3, 3))
            for _ in range(20000):
                g = logit_gradient(train, theta, c, 2)
                theta -= g
                if np.abs(g).max() < 1e-11:
                    break
            for r in [r for r in got if r.fold == fold and r.candidate == name]:
                raw = np.exp(theta @ [1.0, r.a, r.b])
                assert abs(r.score - (raw[2] - raw[0]) / raw.sum()) < 1e-7


def test_logits_without_a_class_or_without_training_rows(spark):
    rows = [(1, "train", float(i), 0.0, 0.02 if i > 4 else -0.02, 0.001) for i in range(12)] + [(1, "test", 9.0, 0.0, 0.0, 0.001), (2, "test", 1.0, 0.0, 0.0, 0.001)]
    df = spark.createDataFrame(rows, "fold int, role string, a double, b double, y double, cost double")
    got = ML.fit_logits(df, ["fold"], "y", "cost", ["a", "b"], {"C=1": 1.0}).collect()
    assert [(r.fold, r.score > 0.3) for r in got] == [(1, True)]
    assert ML.fit_logits(df.filter("false"), ["fold"], "y", "cost", ["a", "b"], {"C=1": 1.0}).count() == 0
