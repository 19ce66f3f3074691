import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import d
from tidemark.operators import events as EV
from tidemark.operators import topk as TK

DAY0 = dt.date(2024, 1, 1)


@pytest.mark.parametrize("seed", range(4))
def test_no_overlap_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in "ab":
        day = DAY0
        for _ in range(80):
            day += dt.timedelta(days=rng.randrange(1, 6))
            rows.append((k, day, day + dt.timedelta(days=rng.randrange(0, 12)), rng.choice([-1, 0, 0, 1])))
    want = {}
    for k in "ab":
        last = None
        for _, e, x, s in sorted(r for r in rows if r[0] == k):
            take = s != 0 and (last is None or e > last)
            want[(k, e)] = s if take else 0
            last = x if take else last
    got = TK.no_overlap(spark.createDataFrame(rows, "k string, e date, x date, s int"), ["k"], "e", "x", "s")
    assert {(r.k, r.e): r.executed for r in got.collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_no_overlap_in_decision_order_with_repeated_entries(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(70):
        e = DAY0 + dt.timedelta(days=4 * i + rng.randrange(0, 9))
        rows.append(("a", i, e, e + dt.timedelta(days=rng.randrange(0, 9)), rng.choice([-1, 0, 1])))
    want, last = {}, None
    for _, i, e, x, s in rows:
        take = s != 0 and (last is None or e > last)
        want[i] = s if take else 0
        last = x if take else last
    got = TK.no_overlap(spark.createDataFrame(rows, "k string, i int, e date, x date, s int"), ["k"], "e", "x", "s", order=["i"])
    assert {r.i: r.executed for r in got.collect()} == want


def test_touching_exit_is_overlap_and_holds_do_not_block(spark):
    rows = [("a", d("2024-01-01"), d("2024-01-05"), 1), ("a", d("2024-01-03"), d("2024-02-01"), 0), ("a", d("2024-01-05"), d("2024-01-09"), 1),
            ("a", d("2024-01-06"), d("2024-01-09"), -1), ("a", None, None, 1)]
    got = TK.no_overlap(spark.createDataFrame(rows, "k string, e date, x date, s int"), ["k"], "e", "x", "s")
    assert {r.e: r.executed for r in got.collect()} == {d("2024-01-01"): 1, d("2024-01-03"): 0, d("2024-01-05"): 0, d("2024-01-06"): -1, None: 0}


@pytest.mark.parametrize("seed", range(3))
def test_thinning_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    idx = sorted(rng.sample(range(400), 90))
    want, nxt = [], 0
    for i in idx:
        if i >= nxt:
            want.append(i)
            nxt = i + 7
    got = TK.thin_rows(spark.createDataFrame([("a", i) for i in idx], "k string, i int"), ["k"], "i", 7)
    assert sorted(r.i for r in got.collect()) == want


@pytest.mark.parametrize("seed", range(3))
def test_decluster_equals_largest_first(spark, seed):
    rng = random.Random(seed)
    days = sorted(rng.sample(range(500), 70))
    rows = [("a", DAY0 + dt.timedelta(days=i), float(rng.randrange(20))) for i in days]
    kept = []
    for _, day, _m in sorted(rows, key=lambda r: (-r[2], r[1])):
        if all(abs((day - k).days) >= 14 for k in kept):
            kept.append(day)
    got = EV.decluster(spark.createDataFrame(rows, "k string, d date, m double"), ["k"], "d", "m", 14)
    assert sorted(r.d for r in got.collect()) == sorted(kept)


def test_five_jumps_in_a_row_are_one_event(spark):
    rows = [("a", DAY0 + dt.timedelta(days=7 * i), float(i)) for i in range(5)]
    got = EV.decluster(spark.createDataFrame(rows, "k string, d date, m double"), ["k"], "d", "m", 42).collect()
    assert [r.m for r in got] == [4.0]


def test_event_window_that_does_not_fit_is_null_not_zero(spark):
    s = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=i), 1.0) for i in range(10)], "k string, d date, v double")
    e = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=4)), ("a", DAY0 + dt.timedelta(days=9)), ("a", DAY0 + dt.timedelta(days=99))], "k string, ev date")
    w = EV.event_windows(e, s, ["k"], "ev", "d", "v", 2, 2)
    got = {r.ev: r.t for r in EV.window_sum(w, ["k"], "ev", 0, 2, "t").collect()}
    assert list(got.values()).count(None) == 2 and got[DAY0 + dt.timedelta(days=4)] == 3.0


def test_placebo_needs_a_large_enough_pool(spark):
    pool = spark.createDataFrame([("a", i, float(i)) for i in range(3)] + [("b", i, float(i)) for i in range(9)], "k string, i int, v double")
    size = spark.createDataFrame([("a", 4), ("b", 9)], "k string, n_events int")
    got = EV.placebo(pool, size, ["k"], "i", "v", "n_events", 5, 1).collect()
    assert {r.k for r in got} == {"b"} and {r["mean"] for r in got} == {4.0}


def test_a_draw_takes_different_days_and_repeats(spark):
    drawn = EV.sample_without(3, "1", 40, 25)
    assert len(set(drawn)) == 25 and min(drawn) >= 0 and max(drawn) < 40 and drawn == EV.sample_without(3, "1", 40, 25)
    counts = [0] * 6
    for i in range(3000):
        for j in EV.sample_without(1, str(i), 6, 2):
            counts[j] += 1
    assert all(900 < c < 1100 for c in counts)


def test_matched_null_refuses_thin_and_empty_strata(spark):
    pool = spark.createDataFrame([("a", 2020, i, float(i)) for i in range(3)], "k string, year int, d int, v double")
    ok = spark.createDataFrame([("a", 2020, 3)], "k string, year int, n int")
    assert {(r["mean"], r.n) for r in EV.matched_null(pool, ok, ["k"], "year", "d", "v", "n", 4, 1).collect()} == {(1.0, 3)}
    for bad in ([("a", 2020, 4)], [("a", 2020, 1), ("a", 2021, 2)]):
        sizes = spark.createDataFrame(bad, "k string, year int, n int")
        with pytest.raises(Exception, match="too few days"):
            EV.matched_null(pool, sizes, ["k"], "year", "d", "v", "n", 4, 1).collect()


def test_a_dense_key_is_one_pass(spark):
    n = 100_000
    rows = spark.range(n).selectExpr("'a' as k", "id as i", "date_add(date'2000-01-01', cast(id div 40 as int)) as e", "1 as s")
    assert TK.thin_rows(rows, ["k"], "i", 12).count() == -(-n // 12)
    held = rows.selectExpr("k", "i", "e", "date_add(e, 3) as x", "s")
    assert TK.no_overlap(held, ["k"], "e", "x", "s", order=["e", "x", "i"]).filter("executed <> 0").count() == n // 40 // 4
    days = spark.range(n).selectExpr("'a' as k", "date_add(date'1800-01-01', cast(id as int)) as d", "cast(id * 7919 % 10007 as double) as m")
    assert EV.decluster(days, ["k"], "d", "m", 14).count() > n // 28


def test_pair_sizes_prefer_fewer_contracts_and_respect_the_budget(spark):
    df = spark.createDataFrame([(100.0, 200.0, 10.0, 10.0)], "a double, b double, ma double, mb double")
    s = df.select(TK.size_pairs("a", "b", 8).alias("s"), TK.size_pairs("a", "b", 8, ("ma", "mb", 20.0)).alias("t"), TK.size_pairs("a", "b", 8, ("ma", "mb", 5.0)).alias("u")).first()
    assert (s.s.qa, s.s.qb) == (2, 1) and (s.t.qa, s.t.qb) == (1, 1) and s.u is None


def test_missing_sharpe_ranks_last(spark):
    df = spark.createDataFrame([("a", "x", None, 9.0), ("a", "y", -3.0, 1.0), ("a", "z", -3.0, 2.0)], "k string, c string, s double, n double")
    assert TK.pick_best(df, ["k"], ["c"], "s", "n").first().c == "z"


def test_matched_pool_excludes_neighbours(spark):
    days = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=i)) for i in range(30)], "k string, d date")
    ev = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=10))], "k string, d date")
    assert EV.matched_pool(days, ev, ["k"], "d", 5).filter(F.abs(F.datediff("d", F.lit(DAY0)) - 10) <= 5).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_buckets_chain_like_one_pass(spark, seed):
    """Long and short holds across many narrow buckets, entries out of order, nulls, repeated rows, a null key."""
    rng = random.Random(seed)
    rows = []
    for k in ("a", "b", None):
        for i in range(150):
            e = rng.choice([None, *range(i, i + 8)]) if rng.random() < 0.9 else i
            x = None if e is None or rng.random() < 0.03 else e + rng.choice([0, 1, 5, 40])
            rows.append((k, i // 2 if i % 7 else None, i, e, x, rng.choice([-1, 0, 1, None])))
    want = {}
    for k in ("a", "b", None):
        last = -(2**63)
        for _, o, i, e, x, s in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, r[1] or 0, r[2])):
            take = e is not None and bool(s) and e > last
            want[k, i] = s if take else 0
            last = (-(2**63) if x is None else x) if take else last
    df = spark.createDataFrame(rows, "k string, o int, i int, e int, x int, s int")
    for width in (1, 3, 1000):
        got = TK.no_overlap(df, ["k"], "e", "x", "s", order=["o", "i"], width=width)
        assert {(r.k, r.i): r.executed for r in got.collect()} == want


def test_step_functions_equal_walking_the_rows():
    rng = random.Random(7)
    for _ in range(300):
        rows = [(rng.choice([None, *range(20)]), rng.choice([None, *range(25)]), rng.random() < 0.7) for _ in range(rng.randrange(9))]
        at, to = TK.steps_of(*map(list, zip(*rows))) if rows else ([], [])
        assert at == sorted(set(at), reverse=True)
        for begin in (TK.NEVER, *range(-1, 26)):
            last = begin
            for e, x, live in rows:
                if e is not None and live and e > last:
                    last = TK.NEVER if x is None else x
            assert TK.through(at, to, begin) == last


def test_a_dense_key_is_spread_over_its_buckets(spark):
    n = 200_000
    rows = spark.range(n).selectExpr("'a' as k", "date_add(date'2000-01-01', cast(id div 50 as int)) as e", "id as i", "1 as s").selectExpr("*", "date_add(e, 6) as x")
    steps = rows.selectExpr("k", "unix_date(e) div 64 as b").groupBy("b").count().collect()
    assert max(r["count"] for r in steps) <= 64 * 50 and len(steps) > 60
    done = TK.no_overlap(rows, ["k"], "e", "x", "s", order=["e", "x", "i"])
    assert done.filter("executed <> 0").count() == -(-n // 50 // 7) and done.count() == n


@pytest.mark.parametrize("seed", range(3))
def test_pair_sizes_equal_the_whole_grid(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        a, b = (rng.choice([1.0, 2.0, 3.0, 7.5, 100.0]) * rng.choice([1, 1, rng.random() + 0.01]) for _ in range(2))
        ma, mb = (float(rng.choice([0, 1, 3, 10, 250])) for _ in range(2))
        rows.append((i, a, b, ma, mb))
    df = spark.createDataFrame(rows, "i int, a double, b double, ma double, mb double")
    for max_q, budget in ((1, None), (8, None), (50, None), (8, 20.0), (50, 333.0)):
        margin = None if budget is None else ("ma", "mb", budget)
        got = {r.i: r.s for r in df.select("i", TK.size_pairs("a", "b", max_q, margin).alias("s")).collect()}
        for i, a, b, ma, mb in rows:
            grid = [
                (abs(a * p - b * q) / (a * p + b * q), p + q, p, q) for p in range(1, max_q + 1) for q in range(1, max_q + 1)
                if budget is None or p * ma + q * mb <= budget
            ]
            assert (None if got[i] is None else tuple(got[i])) == min(grid, default=None)


def test_pair_sizes_of_a_thousand_contracts(spark):
    df = spark.createDataFrame([(355.0, 113.0)], "a double, b double")
    s = df.select(TK.size_pairs("a", "b", 1000).alias("s")).first().s
    assert (s.imbalance, s.qa, s.qb) == (0.0, 113, 355)
