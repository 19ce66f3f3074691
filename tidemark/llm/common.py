"""Helpers of the training-data operators: reading, lineage cuts, bounded chunks, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of words in all contracts.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def row_key(*cols: str) -> list[Column]:
    """Two longs that name a document: its id and a hash of id and content.

    They are never null, so null ids join like any other value, and rows that share an id but not
    a text stay apart. Rows equal in all of `cols` are the same document.
    """
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_k1"),
        F.xxhash64(F.col("doc_id").isNull(), *[F.col(c) for c in cols], *[F.col(c).isNull() for c in cols]).alias("_k2"),
    ]


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names, for tables that cut a lineage.

    A single-process session without one gets a folder of its own; a cluster without one is refused,
    because its executors would not see each other's files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and go on from it.

    What follows neither recomputes `df` nor depends on any executor's disk, and reads only the
    columns it needs. The tables lie beside the session's checkpoints and may go with them.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(side: DataFrame) -> DataFrame:
    """The side, never to be broadcast by Spark's own choice.

    Spark takes an explode for one row a row and a file's bytes for its rows' bytes, so a side with keys
    exploded, or read again from a table where they were, may be many times what it is held for.
    """
    return side.hint("merge")


def release(table: DataFrame) -> None:
    """Remove the files of a table made by `cut` that nothing reads any more, as a loop's next one has been written."""
    sc = table.sparkSession.sparkContext
    folder = shared_folder(table.sparkSession)
    for file in table.inputFiles():
        path = sc._jvm.org.apache.hadoop.fs.Path(file)
        if str(path.getParent().getParent().toUri().getPath()) == str(sc._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath()):
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, False)


def chunks(batches: Iterable[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about `limit` bytes of one string column.

    A row larger than the limit is a slice of its own, so a task holds one slice and one long row.
    """
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(n)
        if begin < batch.num_rows:
            yield batch.slice(begin)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest reachable node.

    Each round every node takes the smallest grandparent label among its neighbours, its parent takes
    it too, and labels skip a level, so chains shrink by halves. All steps are joins and grouped
    minima; the driver sees only the number of labels that changed. Self loops and repeated edges
    are harmless; an empty input gives an empty result.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    first = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("f"))
    if both.isEmpty():
        return first.select("node", F.col("f").alias("component"))
    labels = cut(first)
    while True:
        up = labels.select(F.col("node").alias("f"), F.col("f").alias("g"))
        known = labels.select("node", "f").join(shuffled(up), "f").select("node", "f", "g")
        seen = both.join(shuffled(known.select(F.col("node").alias("v"), F.col("g").alias("gv"))), "v")
        hooked = seen.join(shuffled(labels.select(F.col("node").alias("u"), F.col("f").alias("fu"))), "u")
        was = F.col("f").alias("was")
        none = F.when(F.lit(False), F.col("gv")).alias("was")
        offers = (
            hooked.select(F.col("u").alias("node"), F.col("gv").alias("f"), none)
            .union(hooked.select(F.col("fu").alias("node"), F.col("gv").alias("f"), none))
            .union(known.select("node", F.least("f", "g").alias("f"), was))
        )
        labels = cut(offers.groupBy("node").agg(F.min("f").alias("f"), F.max("was").alias("was")))
        if labels.filter(F.col("f") != F.col("was")).isEmpty():
            return labels.select("node", F.col("f").alias("component"))


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """The rows as one column _row beside `more`, so no column of theirs clashes with an operator's."""
    return docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text"), *more)


def unpacked(df: DataFrame, columns: Sequence[str], text: Column | None = None) -> DataFrame:
    """The columns of the rows again; with a new text, and its length where there is an n_chars."""
    named = df if text is None else df.withColumn("_text", text)
    new = {} if text is None else {"text": F.col("_text"), "n_chars": F.coalesce(F.length("_text").cast("long"), F.lit(0).cast("long"))}
    return named.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in columns])
