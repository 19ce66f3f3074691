import datetime as dt
import random

from conftest import d
from tidemark.functions import scalar as S
from tidemark.operators import aggregate as AG
from tidemark.operators import windows as WN


def series(spark, pairs, key="a"):
    return spark.createDataFrame([(key, d(x), v) for x, v in pairs], "k string, d date, v double")


def test_calendar_window_does_not_reach_over_a_gap(spark):
    df = series(spark, [("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-01-04", 4.0), ("2024-01-05", 5.0)])
    got = [x[0] for x in df.select("d", WN.rolling_days(["k"], "d", "v", 2).alias("s")).orderBy("d").select("s").collect()]
    assert got == [None, 3.0, None, 9.0]
    rows = [x[0] for x in df.select("d", WN.rolling_rows(["k"], ["d"], "v", 2, 2).alias("s")).orderBy("d").select("s").collect()]
    assert rows == [None, 3.0, 6.0, 9.0]


def test_prior_year_z_uses_earlier_years_only(spark):
    df = series(spark, [("2001-07-01", 1.0), ("2002-07-01", 3.0), ("2003-07-01", 5.0), ("2004-07-01", 9.0)])
    got = [x[0] for x in df.select("d", WN.prior_year_z(["k"], "d", "v").alias("z")).orderBy("d").select("z").collect()]
    assert got[:2] == [None, None]
    assert abs(got[2] - (5 - 2) / 2**0.5) < 1e-12 and abs(got[3] - (9 - 3) / 2) < 1e-12


def test_zero_spread_gives_no_z(spark):
    df = series(spark, [("2001-07-01", 1.0), ("2002-07-01", 1.0), ("2003-07-01", 5.0)])
    assert [x[0] for x in df.select(WN.prior_year_z(["k"], "d", "v")).collect()] == [None, None, None]


def test_rolling_longest_run_is_clipped_to_the_window(spark):
    rng = random.Random(3)
    flags = [rng.random() < 0.7 for _ in range(60)]
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("a", day + dt.timedelta(days=i), f) for i, f in enumerate(flags)], "k string, d date, f boolean")

    def longest(xs):
        best = run = 0
        for x in xs:
            run = run + 1 if x else 0
            best = max(best, run)
        return best

    want = [None if i < 9 else longest(flags[i - 9: i + 1]) for i in range(60)]
    got = [x.r for x in WN.rolling_longest_run(df, ["k"], "d", "f", 10, "r").orderBy("d").collect()]
    assert got == want


def test_revision_needs_consecutive_days(spark):
    df = series(spark, [("2024-01-01", 1.0), ("2024-01-02", 3.0), ("2024-01-04", 9.0)])
    rev, ok = WN.consecutive_revision(["k"], "d", "v")
    got = [tuple(x) for x in df.select("d", rev.alias("r"), ok.alias("o")).orderBy("d").select("r", "o").collect()]
    assert got == [(None, False), (2.0, True), (None, False)]


def test_equity_survives_a_wipe_out_and_a_sign_change(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([0.1, -2.0, -2.0])] + [("b", i, n) for i, n in enumerate([0.5, -1.0, 0.3])], "k string, i int, n double")
    got = [(x.k, round(x.equity, 9)) for x in WN.drawdown(df, ["k"], ["i"], "n").orderBy("k", "i").collect()]
    assert got == [("a", 1.1), ("a", -1.1), ("a", 1.1), ("b", 1.5), ("b", 0.0), ("b", 0.0)]


def test_deseasonalise_leaves_the_own_year_out(spark):
    df = series(spark, [("2001-07-03", 1.0), ("2002-07-02", 3.0), ("2003-07-01", 8.0)])
    got = {x.d.year: x.o for x in WN.deseasonalise(df, ["k"], "d", "v", "o").collect()}
    assert got == {2001: 1 - 5.5, 2002: 3 - 4.5, 2003: 8 - 2.0}


def test_bucket_is_null_when_edges_coincide(spark):
    df = spark.createDataFrame([("a", 1.0)] * 9 + [("b", float(i)) for i in range(9)], "k string, v double")
    got = WN.quantile_bucket(df, ["k"], "v", [1 / 3, 2 / 3], ["low", "mid", "high"], 6, "q")
    counts = {(x.k, x.q): x["count"] for x in got.groupBy("k", "q").count().collect()}
    assert counts == {("a", None): 9, ("b", "low"): 3, ("b", "mid"): 3, ("b", "high"): 3}


def test_business_days_match_a_day_loop(spark):
    rng = random.Random(5)
    base = dt.date(1965, 1, 1)
    pairs = [(base + dt.timedelta(days=rng.randrange(20000)), rng.randrange(400)) for _ in range(300)]
    rows = [(a, a + dt.timedelta(days=n)) for a, n in pairs]
    df = spark.createDataFrame(rows, "a date, b date")
    got = {(x.a, x.b): x.n for x in df.select("a", "b", S.busdays("a", "b").alias("n")).collect()}
    for a, b in rows:
        assert got[(a, b)] == sum((a + dt.timedelta(days=i)).weekday() < 5 for i in range((b - a).days))


def test_half_covered_window_is_absent_and_no_thermometer_is_not_no_frost(spark):
    days = [dt.date(2023, 10, 1) + dt.timedelta(days=i) for i in range(61)]
    full = [("full", x, 31.0, None, 0.5) for x in days]
    half = [("half", x, 31.0, 1.0, 0.5) for x in days[:40]]
    df = spark.createDataFrame(full + half, "p string, d date, tx double, tn double, r double")
    got = AG.window_measures(df, ["p"], "d", [(10, -1), (11, -1)], tmax="tx", tmin="tn", rain="r", heat=29.0, frost=2.0).collect()
    assert [(x.p, x.crop_year, x.frost_days, x.min_tmin, x.heat_dd, x.dry_days, x.max_dry_spell) for x in got] == [("full", 2024, None, None, 122.0, 61, 61)]


def test_small_states_are_not_outvoted(spark):
    rows = [("A", i, d("2024-01-02"), 0.0) for i in range(9)] + [("B", 0, d("2024-01-02"), 10.0)]
    df = spark.createDataFrame(rows, "s string, c int, d date, v double")
    assert AG.nested_mean(df, ["s", "d"], ["d"], ["v"]).first().v == 5.0


def test_strict_belt_has_no_row_for_an_incomplete_day(spark):
    rows = [("x", 1, d("2024-01-01"), 1.0, d("2024-01-03")), ("x", 2, d("2024-01-01"), 3.0, d("2024-01-04")),
            ("x", 1, d("2024-01-02"), 1.0, d("2024-01-03")), ("x", 2, d("2024-01-02"), 3.0, None)]
    df = spark.createDataFrame(rows, "b string, p int, d date, v double, pub date")
    n = spark.createDataFrame([("x", 2)], "b string, n int")
    got = AG.strict_belt_mean(df, ["b"], "d", ["v"], "pub", n, "n").collect()
    assert [(x.d, x.v, x.pub) for x in got] == [(d("2024-01-01"), 2.0, d("2024-01-04"))]


def test_percentile_rank_leaves_unknown_values_out(spark):
    df = spark.createDataFrame([("a", None), ("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", None)], "k string, v double")
    got = sorted(((r.k, r.v, r.p) for r in WN.pct_rank(df, ["k"], "v", "p").collect()), key=str)
    assert got == sorted([("a", None, None), ("a", 1.0, 1 / 3), ("a", 2.0, 2.5 / 3), ("a", 2.0, 2.5 / 3), ("b", None, None)], key=str)
