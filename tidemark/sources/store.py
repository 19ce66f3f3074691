"""Named tables in one folder, and small result files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """A folder for this application under the one that `spark.checkpoint.dir` names.

    Without one the job fails: executors would write to their own disks and reads would miss files.
    """
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share, or name a root")
    return f"{base.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


class Store:
    """Processed tables by name, overwritten on rebuild.

    Writing is the feature: `write` runs the job at once.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or shared_root(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> str:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(self.path(name))
        return self.path(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def names(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(n[: -len(".parquet")] for n in found if n.endswith(".parquet"))


def write_results(df: DataFrame, path: str, digits: Mapping[str, int]) -> None:
    """Small result table to one CSV with fixed rounding.

    Writing is the feature, so the job runs at once. Callers pass report-sized frames; they are already
    aggregated, so one output task is enough.
    """
    out = df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
