"""The rows of a task do not grow with the input, however well its columns compress."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import common
from tidemark.plans import load


def test_business_days_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "TASK_ROWS", 250, raising=False)
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    orders = [(o, days[o % 30]) for o in range(500)]
    lines = [(o, n, days[o % 30 + n]) for o in range(500) for n in range(8)] + [(3, 1, days[9]), (700, 1, days[9]), (None, 1, days[9])]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = load()["fn15_busdays"].run(spark, str(tmp_path))
    got = df.withColumn("task", F.spark_partition_id()).collect()
    want = {}
    for o, n, ship in lines:
        if o is not None and o < 500:
            start = days[o % 30]
            want[o, n] = want.get((o, n), 0) + sum((start + dt.timedelta(days=i)).weekday() < 5 for i in range((ship - start).days))
    assert {(r.l_orderkey, r.l_linenumber): r.days for r in got} == want and len(got) == len(want)
    sizes = {}
    for r in got:
        sizes[r.task] = sizes.get(r.task, 0) + 1
    assert len(sizes) > 10 and max(sizes.values()) < 2 * 250


def test_an_empty_table_is_one_task(spark):
    df = spark.createDataFrame([], "a long")
    assert common.dealt_by_rows(0, (df, "a"))[0].collect() == []
