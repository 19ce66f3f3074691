"""Regressions and refits where a regressor does not vary: it gets slope zero and the other one its own fit."""

import hashlib

import numpy as np
import pytest

from tidemark.operators import folds as WF
from tidemark.operators import stats as ST
from tidemark.operators import uncertainty as UN

SCHEMA = "k string, h long, heat double, rain double, yield double"
SETS = {"heat": ["heat"], "weather": ["heat", "rain"]}


def record(heat, n=24, seed=3):
    """Keys a and b: heat as given in a (a constant, or a spike in one year), ordinary in b."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in "ab":
        for h in range(1, n + 1):
            x = heat(h) if k == "a" else float(rng.normal())
            rain = float(rng.normal())
            rows.append((k, h, x, rain, float(50 + 0.3 * h - rain + 0.5 * x + rng.normal())))
    return rows


def fit(y, X, alpha=0.0):
    """Means, slopes and R2 on standardised columns; a column without spread is left at zero."""
    X, y = np.array(X, float), np.array(y, float)
    spread = X.std(0)
    Z = np.where(spread > 1e-12, (X - X.mean(0)) / np.where(spread > 1e-12, spread, 1), 0)
    w = np.linalg.pinv(Z.T @ Z + alpha * np.eye(X.shape[1])) @ Z.T @ (y - y.mean())
    e = y - y.mean() - Z @ w
    return X.mean(0), np.where(spread > 1e-12, w / np.where(spread > 1e-12, spread, 1), 0), e, 1 - e @ e / ((y - y.mean()) @ (y - y.mean()))


@pytest.mark.parametrize("value", [0.0, 0.1])
def test_ols_errors_beside_a_constant(spark, value):
    rows = record(lambda h: value)
    got = {r.k: r for r in ST.ols(spark.createDataFrame(rows, SCHEMA), ["k"], "yield", ["heat", "rain"]).collect()}
    mine = [r for r in rows if r[0] == "a"]
    rain = np.array([r[3] for r in mine])
    _, b, e, r2 = fit([r[4] for r in mine], [[r[3]] for r in mine])
    se = np.sqrt(e @ e / (len(mine) - 3) / ((rain - rain.mean()) @ (rain - rain.mean())))
    assert got["a"].b_heat == 0 and got["a"].se_heat is None and got["a"].t_heat is None
    assert np.allclose([got["a"].b_rain, got["a"].r2, got["a"].se_rain, got["a"].t_rain], [b[0], r2, se, b[0] / se])
    assert got["b"].se_heat > 0 and got["b"].se_rain > 0


@pytest.mark.parametrize("heat", [lambda h: 0.0, lambda h: 0.1, lambda h: 0.3 if h == 5 else 0.0, lambda h: 0.7 if h == 5 else 0.1])
def test_horse_race_with_a_flat_or_spiked_forecast(spark, heat):
    rows = record(heat)
    got = {r.k: r for r in ST.horse_race(spark.createDataFrame(rows, SCHEMA), ["k"], "yield", "heat", "rain", "h").collect()}
    for k in "ab":
        mine = [r for r in rows if r[0] == k]

        def r2(rows, cols):
            return fit([r[4] for r in rows], [[r[c] for c in cols] for r in rows])[3]

        inc = [r2([r for r in mine if r is not q], [2, 3]) - r2([r for r in mine if r is not q], [3]) for q in mine]
        r = got[k]
        want = [r2(mine, [2]), r2(mine, [3]), r2(mine, [2, 3]), fit([q[4] for q in mine], [[q[2]] for q in mine])[1][0], min(inc), max(inc)]
        assert r.load_bearing_year == mine[int(np.argmin(np.round(inc, 10)))][1]
        assert np.allclose([r.forecast_r2, r.price_r2, r.joint_r2, r.beta_alone, r.incremental_min, r.incremental_max], want, atol=1e-9)


@pytest.mark.parametrize("heat", [lambda h: 0.0, lambda h: 0.1, lambda h: 0.3 if h == 5 else 0.0])
def test_draws_where_a_regressor_is_constant(spark, heat):
    rows = record(heat)
    got = {r.k: r for r in UN.coef_bootstrap(spark.createDataFrame(rows, SCHEMA), ["k"], "h", "yield", ["heat", "rain"], 200, 7).collect()}
    for k in "ab":
        mine = [r for r in rows if r[0] == k]
        values = []
        for draw in range(1, 201):
            at = [int(hashlib.md5(f"7:{draw}:{s}".encode()).hexdigest()[:8], 16) % len(mine) for s in range(1, len(mine) + 1)]
            values.append(fit([mine[i][4] for i in at], [mine[i][2:4] for i in at])[1][0])
        q = np.quantile(values, [0.025, 0.5, 0.975])
        assert got[k].draws == 200 and np.allclose([got[k].p025, got[k].median, got[k].p975], q)
        assert got[k].probability_positive == np.mean(np.array(values) > 0)


@pytest.mark.parametrize("heat", [lambda h: 0.0, lambda h: 0.1, lambda h: 0.3 if h == 5 else 0.0])
def test_refits_in_folds_with_a_constant(spark, heat):
    rows = record(heat, n=14)
    df = spark.createDataFrame(rows, SCHEMA)

    def forecast(train, x, cols):
        h, y = np.array([r[1] for r in train], float), np.array([r[4] for r in train])
        b, a = np.polyfit(h, y, 1)
        t = y / (a + b * h) - 1
        mean, w, _, _ = fit(t, [[r[c] for c in cols] for r in train], 1.0)
        return (a + b * x[1]) * (1 + t.mean() + (np.array([x[c] for c in cols]) - mean) @ w)

    by = {(r[0], r[1]): r for r in rows}
    got = WF.expanding_predictions(df, ["k"], "h", "yield", SETS, 8).collect()
    assert len(got) == 2 * 6 * 3
    for r in got:
        train = [q for q in rows if q[0] == r.k and q[1] < r.h]
        cols = {"heat": [2], "weather": [2, 3]}.get(r.feature_set)
        assert cols is None or np.isclose(r.predicted, forecast(train, by[r.k, r.h], cols))
    for r in WF.fold_residuals(df, ["k"], "h", "yield", SETS, 8).collect():
        train = [q for q in rows if q[0] == r.k and q[1] < r.h]
        cols = {"heat": [2], "weather": [2, 3]}[r.feature_set]
        signed = [q[4] - forecast([p for p in train if p is not q], q, cols) for q in train]
        ahead = [forecast([p for p in train if p is not q], by[r.k, r.h], cols) for q in train]
        assert np.allclose(r.signed, signed) and np.allclose(r.loo_point, ahead)
