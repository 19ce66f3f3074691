from pyspark.sql import functions as F

from tidemark.operators import aggregate as AG
from tidemark.operators.common import spread_join


def test_spread_join_equals_a_plain_join_on_a_hot_key(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", i) for i in range(5)], "k string, i int")
    totals = rows.groupBy("k").agg(F.sum("i").alias("t"))
    a = sorted(map(tuple, spread_join(rows, totals, ["k"], 8).select("k", "i", "t").collect()))
    assert a == sorted(map(tuple, rows.join(totals, "k").select("k", "i", "t").collect()))


def test_shares_of_a_group_add_up(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", None)], "k string, v double")
    got = sorted((r.k, r.s) for r in AG.share_of_total(df, ["k"], "v", "s").collect() if r.s is not None)
    assert got == [("a", 0.25), ("a", 0.75), ("b", 1.0)]


def test_strict_mean_needs_every_value_and_publication(spark):
    rows = [("b", s, p, m, 1.0 * p, 10) for m in (1, 2, 3, 4) for s, p in (("x", 1), ("x", 2), ("y", 3))]
    rows = [(*r[:4], None, r[5]) if (r[2], r[3]) == (1, 2) else (*r[:5], None) if (r[2], r[3]) == (3, 3) else r for r in rows] + [("b", "y", 9, 4, 99.0, 20)]
    df = spark.createDataFrame(rows, "belt string, state string, point int, m int, v double, pub int")
    got = [(r.m, r.v, r.pub) for r in AG.strict_nested_mean(df, "belt", "state", "point", "m", "v", "pub").orderBy("m").collect()]
    assert got == [(1, 2.25, 10), (4, 2.25, 10)]
