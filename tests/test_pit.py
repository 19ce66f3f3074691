import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import d
from tidemark.operators import pit

DAY0 = dt.date(2020, 1, 1)


def random_case(seed):
    rng = random.Random(seed)
    # Key "a" holds most rows; publications repeat and some are missing.
    left = [("a" if rng.random() < 0.6 else rng.choice("bcd"), i, DAY0 + dt.timedelta(days=rng.randrange(400))) for i in range(120)]
    right = [
        ("a" if rng.random() < 0.6 else rng.choice("bc"), None if rng.random() < 0.1 else DAY0 + dt.timedelta(days=rng.randrange(400)), i, float(i))
        for i in range(150)
    ]
    return left, right


def brute(left, right, strict, forward):
    out = {}
    for k, i, cut in left:
        rows = [r for r in right if r[0] == k and r[1] is not None]
        if forward:
            rows = [r for r in rows if (r[1] > cut if strict else r[1] >= cut)]
            hit = min(rows, key=lambda r: (r[1], r[2]), default=None)
        else:
            rows = [r for r in rows if (r[1] < cut if strict else r[1] <= cut)]
            hit = max(rows, key=lambda r: (r[1], r[2]), default=None)
        out[i] = None if hit is None else hit[3]
    return out


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("grid", [False, True])
@pytest.mark.parametrize("bucket", ["week", "year"])
def test_asof_equals_row_wise_search(spark, strict, direction, bucket, grid):
    left, right = random_case(7)
    l = spark.createDataFrame(left, "k string, i int, cut date")
    r = spark.createDataFrame(right, "k string, pub date, seq int, v double")
    got = pit.asof_join(l, r, ["k"], "cut", "pub", ["v"], ["seq"], strict=strict, direction=direction, bucket=bucket, grid=grid)
    assert {x.i: x.v for x in got.collect()} == brute(left, right, strict, direction == "forward")


def test_asof_keeps_every_left_row_and_null_cutoffs(spark):
    l = spark.createDataFrame([("a", 1, d("2020-01-05")), ("a", 2, None), ("z", 3, d("2020-01-05"))], "k string, i int, cut date")
    r = spark.createDataFrame([("a", d("2020-01-01"), 1.0)], "k string, pub date, v double")
    for grid in (False, True):
        got = {x.i: x.v for x in pit.asof_join(l, r, ["k"], "cut", "pub", ["v"], grid=grid).collect()}
        assert got == {1: 1.0, 2: None, 3: None}


def test_peek_admits_exactly_k_days(spark):
    l = spark.createDataFrame([("a", d("2020-01-10"))], "k string, cut date")
    r = spark.createDataFrame([("a", d("2020-01-12"), 1.0), ("a", d("2020-01-13"), 2.0)], "k string, pub date, v double")

    def seen(k):
        return pit.asof_join(l, r, ["k"], "cut", "pub", ["v"], peek_days=k).first().v

    assert [seen(1), seen(2), seen(3)] == [None, 1.0, 2.0]
    with pytest.raises(ValueError):
        pit.asof_join(l, r, ["k"], "cut", "pub", ["v"], peek_days=-1)


def test_missing_publication_is_never_visible(spark):
    df = spark.createDataFrame([(1, d("2020-01-01")), (2, None)], "i int, pub date")
    assert [x.i for x in pit.as_of(df, "pub", F.lit("2030-01-01").cast("date")).collect()] == [1]


def test_weekly_release_rejects_the_wrong_weekday(spark):
    df = spark.createDataFrame([(d("2024-01-02"),), (d("2024-01-03"),)], "m date")
    got = [x[0] for x in df.select(pit.publish_weekly("m", 3, 2)).collect()]
    assert got == [d("2024-01-04"), None]


def test_month_is_final_on_the_seventh_of_the_next(spark):
    df = spark.createDataFrame([(d("2023-12-15"), d("2024-01-06")), (d("2023-12-15"), d("2024-01-07"))], "m date, asked date")
    got = [tuple(x) for x in df.select(pit.month_available("m"), pit.expected_status("m", "asked")).collect()]
    assert got == [(d("2024-01-07"), "prelim"), (d("2024-01-07"), "scaled")]


def test_entry_and_exit_past_the_calendar_are_null(spark):
    days = [("a", d(f"2024-01-{x:02d}")) for x in (2, 3, 5, 8)]
    cal = spark.createDataFrame(days, "k string, s date")
    dec = spark.createDataFrame([("a", d("2024-01-03")), ("a", d("2024-01-05")), ("a", d("2024-01-08"))], "k string, d date")
    got = {x.d: (x.entry_date, x.exit_date) for x in pit.entry_exit(dec, cal, ["k"], "d", "s", 1).collect()}
    assert got == {d("2024-01-03"): (d("2024-01-05"), d("2024-01-08")), d("2024-01-05"): (d("2024-01-08"), None), d("2024-01-08"): (None, None)}


def test_issue_table_ignores_late_rows_and_needs_every_day(spark):
    obs = [("a", d(f"2024-05-{x:02d}"), d("2024-06-01"), float(x)) for x in (1, 2, 3)]
    late = [("b", d("2024-05-01"), d("2024-06-01"), 1.0), ("b", d("2024-05-02"), d("2024-07-01"), 2.0), ("b", d("2024-05-03"), None, 3.0)]
    o = spark.createDataFrame(obs + late, "k string, d date, pub date, v double")
    i = spark.createDataFrame([(2024, d("2024-06-05"), d("2024-05-01"), d("2024-05-03"))], "year int, issue_date date, start date, end date")
    got = {x.k: (x.seen_days, x.late_rows, x.feature) for x in pit.issue_table(o, i, ["k"], "d", "pub", "v").collect()}
    assert got == {"a": (3, 0, 2.0), "b": (1, 2, None)}


def test_stale_decision_becomes_hold(spark):
    df = spark.createDataFrame([("a", d("2024-01-01"), 1), ("b", d("2024-01-09"), -1)], "k string, d date, s int")
    got = {x.k: x.action for x in pit.latest_decision(df, ["k"], "d", "s", F.lit("2024-01-10").cast("date"), 7).collect()}
    assert got == {"a": "HOLD", "b": "SELL"}


def test_unfilled_feature_is_reported_not_dropped(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    got = {x.feature: (x.filled, x.unavailable) for x in pit.feature_catalog(df, {"a": "s", "b": "s"}, []).collect()}
    assert got == {"a": (1, False), "b": (0, True)}


def test_completed_rows_are_strictly_earlier(spark):
    r = spark.createDataFrame([("a", d("2024-01-05")), ("a", d("2024-01-06")), ("a", None)], "k string, e date")
    q = spark.createDataFrame([("a", d("2024-01-05")), ("a", d("2024-01-07"))], "k string, d date")
    got = {x.d: x.train_rows for x in pit.completed_rows(r, "e", q, "d", ["k"]).collect()}
    assert got == {d("2024-01-05"): 0, d("2024-01-07"): 2}


def test_issue_window_may_begin_before_new_year(spark):
    rows = [("a", d(f"{y}-{m:02d}-{x:02d}"), d(f"{y}-{m:02d}-{x:02d}"), 1.0) for y, m, days in ((2023, 12, (30, 31)), (2024, 1, (1, 2))) for x in days]
    o = spark.createDataFrame(rows, "k string, d date, pub date, v double")
    i = spark.createDataFrame([(2024, d("2024-01-05"), d("2023-12-30"), d("2024-01-02"))], "year int, issue_date date, start date, end date")
    r = pit.issue_table(o, i, ["k"], "d", "pub", "v").first()
    assert (r.year, r.expected_days, r.seen_days, r.feature) == (2024, 4, 4, 1.0)


def test_of_two_decisions_on_a_day_the_smaller_counts(spark):
    for rows in ([("a", d("2024-01-09"), 1), ("a", d("2024-01-09"), -1)], [("a", d("2024-01-09"), -1), ("a", d("2024-01-09"), 1)]):
        df = spark.createDataFrame(rows, "k string, d date, s int")
        assert pit.latest_decision(df, ["k"], "d", "s", F.lit("2024-01-10").cast("date"), 7).first().action == "SELL"
