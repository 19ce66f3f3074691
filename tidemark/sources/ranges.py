"""Digests of files read as byte ranges: a Python data source and the grouped roots over its rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

CHUNK = 8 << 20
#: Bytes a task reads one after the other, in whole chunks, and bytes it holds at a time.
TASK = 128 << 20
READ = 1 << 20
FAN = 1024
#: 1024 ** 4 chunks of 8 MB are as long as a file can be.
LEVELS = 4


def open_fs(path: str):
    """File system and path of a plain path or a URI (file:, hdfs:, s3:, gs:)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


class Range(InputPartition):
    def __init__(self, path: str, length: int, begin: int, end: int):
        self.path, self.length, self.begin, self.end = path, length, begin, end


class RangeReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], chunk: int):
        self.files, self.chunk = files, chunk

    def partitions(self) -> list[Range]:
        """Runs of whole chunks. chunk 0: each file is one run and one chunk, however long."""
        out = []
        for path, length in self.files:
            step = max(1, TASK // self.chunk) * self.chunk if self.chunk else max(1, length)
            out += [Range(path, length, b, min(b + step, length)) for b in range(0, max(1, length), step)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        system, path = open_fs(part.path)
        with system.open_input_file(path) as file:
            if file.size() != part.length:
                raise OSError(f"{part.path} is {file.size()} bytes long, was listed with {part.length}")
            at = part.begin
            while True:
                end = min(at + self.chunk, part.end) if self.chunk else part.end
                number, begin, digest = (at // self.chunk if self.chunk else 0), at, hashlib.sha256()
                file.seek(at)
                while at < end:
                    piece = file.read(min(READ, end - at))
                    if not piece:
                        raise OSError(f"{part.path} ends at byte {at}, was listed with {part.length}")
                    digest.update(piece)
                    at += len(piece)
                yield part.path, part.length, number, at - begin, digest.hexdigest()
                if at >= part.end:
                    return


class FileRanges(DataSource):
    """Digests of byte ranges of files. Options: `files` (a line `length path` for each) and `chunk` (0: whole files).

    A task streams its range in pieces of 1 MB, so it holds no chunk and no file. A range that is read
    again after a lost executor gives the same row; a file whose length has changed since it was listed
    fails the job.
    """

    @classmethod
    def name(cls) -> str:
        return "file_ranges"

    def schema(self) -> str:
        return "path string, bytes long, chunk long, chunk_bytes long, sha256 string"

    def reader(self, schema: StructType) -> RangeReader:
        listed = [line.split(" ", 1) for line in self.options["files"].split("\n") if line]
        return RangeReader([(path, int(length)) for length, path in listed], int(self.options["chunk"]))


def ranges(spark: SparkSession, files: list[tuple[str, int]], chunk: int) -> DataFrame:
    """path, bytes, chunk (from 0), chunk_bytes, sha256 of every chunk; an empty file is one empty chunk."""
    spark.dataSource.register(FileRanges)
    text = "\n".join(f"{length} {path}" for path, length in files)
    return spark.read.format("file_ranges").option("files", text).option("chunk", str(chunk)).load()


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Paths and lengths of the files of a folder or pattern, empty ones too; their contents are not read.

    Names that begin with _ or . are left out, as by Spark's readers. The driver holds a line for each
    file, as it does for every table that it plans a scan of.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    system = pattern.getFileSystem(conf)
    found = list(system.globStatus(pattern) or [])
    inside = [x for f in found if f.isDirectory() for x in system.listStatus(f.getPath())]
    files = [f for f in [*found, *inside] if f.isFile() and f.getPath().getName()[0] not in "_."]
    if not found:
        raise FileNotFoundError(path)
    return sorted((f.getPath().toString(), f.getLen()) for f in files)


def chunk_roots(chunks: DataFrame) -> DataFrame:
    """path, bytes, chunks and root: every 1024 digests in order become the digest of their lines, four times over.

    No group holds more than 1024 digests, however long a file is.
    """
    level = chunks.select("path", "bytes", F.col("chunk").alias("n"), "sha256", F.lit(1).cast("long").alias("chunks"))
    for _ in range(LEVELS):
        run = F.transform(F.sort_array(F.collect_list(F.struct("n", "sha256"))), lambda s: s["sha256"])
        level = level.groupBy("path", F.floor(F.col("n") / FAN).cast("long").alias("n")).agg(
            F.max("bytes").alias("bytes"), F.sha2(F.array_join(run, "\n"), 256).alias("sha256"), F.sum("chunks").alias("chunks")
        )
    return level.select("path", "bytes", "chunks", F.col("sha256").alias("root"))


def file_digests(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """file (its name), path, bytes, chunks, root of the chunks' digests, and sha256 of the whole file.

    The root is read by ranges side by side. A plain SHA-256 has to go through a file in order: one task
    a file streams it. Ask for `chunk_roots` alone where the files are few and huge.
    """
    if chunk < 1:
        raise ValueError("chunk must be positive")
    files = listed(spark, path)
    whole = ranges(spark, files, 0).select("path", "sha256")
    roots = chunk_roots(ranges(spark, files, chunk))
    return roots.join(whole, "path").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "path", "bytes", "chunks", "root", "sha256")
