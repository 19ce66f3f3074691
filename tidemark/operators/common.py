"""Shared helpers for the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def by(keys: Sequence[str], *order) -> W:
    return W.partitionBy(*keys).orderBy(*order)


def rows_back(keys: Sequence[str], order: Sequence[str], k: int) -> W:
    """Current row and the k-1 rows before it."""
    return by(keys, *order).rowsBetween(-(k - 1), 0)


def days_back(keys: Sequence[str], date: str, k: int) -> W:
    """Current calendar day and the k-1 days before it."""
    return by(keys, F.unix_date(F.col(date))).rangeBetween(-(k - 1), 0)


def guarded(value: Column, present: Column, needed: int) -> Column:
    """A value only where enough observations are present."""
    return F.when(present >= needed, value)


def same(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    return a.join(b, list(on), how)


def single_row(df: DataFrame) -> DataFrame:
    """A global aggregate: exactly one row by construction, so its broadcast is bounded."""
    return F.broadcast(df)


def spread_join(rows: DataFrame, per_key: DataFrame, on: Sequence[str], salts: int = 16) -> DataFrame:
    """Inner join of raw rows to one row per key, with hot keys spread over `salts` tasks.

    The per-key side is an aggregate, so copying it a fixed number of times is cheap; the raw
    side gets a salt from its own content, which a retried task reproduces.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"]).drop("_salt")


def number(df: DataFrame, c: str) -> Column:
    """A date, timestamp or integer column as a long in the same order."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(c)).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(c))
    return F.col(c).cast("long")


def sorted_groups(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows dealt by group and sorted within the tasks (nulls last), with a mark _g that changes where a group does."""
    mark = F.xxhash64(*[F.col(c) for c in group], *[F.col(c).isNull() for c in group])
    dealt = df.withColumn("_g", mark).repartition(*group)
    return dealt.sortWithinPartitions(*group, *[F.col(c).asc_nulls_last() for c in order])


def in_turn(
    df: DataFrame, group: Sequence[str], order: Sequence[str], read: Sequence[str], rule: Callable[[], Callable], out: str, kind: T.DataType
) -> DataFrame:
    """The rows with a column that a sequential rule fills, group by group in `order` (nulls last).

    rule() makes what decides a group: it is called with the values of the columns `read`, row after row, and
    returns the new column's value. A task is one stream over all of its groups and keeps only what the rule
    itself remembers, so many small groups cost no more than their rows.
    """
    names, arrow = [f.name for f in df.schema.fields], to_arrow_type(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, decide = None, None
        for batch in batches:
            columns = dict(zip([*names, "_g"], batch.columns))
            values = []
            for g, *row in zip(columns["_g"].to_pylist(), *[columns[c].to_pylist() for c in read]):
                if decide is None or g != last:
                    last, decide = g, rule()
                values.append(decide(*row))
            yield pa.RecordBatch.from_arrays([*(columns[c] for c in names), pa.array(values, arrow)], [*names, out])

    return sorted_groups(df, group, order).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


def group_by_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str], read: Sequence[str], give: Callable[..., Iterable[tuple]], fields: Sequence[T.StructField]
) -> DataFrame:
    """give(lists of a group's values of the columns `read`, in `order`) as rows of `fields` beside the group's keys.

    Like `in_turn` one stream a task; it holds one group at a time.
    """
    names = [*group, *read]
    schema = T.StructType([*[df.schema[c] for c in group], *fields])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, key, held, rows = None, None, None, []

        def close() -> None:
            rows.extend((*key, *r) for r in give(*held))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for g, *row in zip(columns[-1], *columns[:-1]):
                if held is None or g != last:
                    if held is not None:
                        close()
                    last, key, held = g, row[: len(group)], [[] for _ in read]
                for values, v in zip(held, row[len(group) :]):
                    values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)
            rows.clear()
        if held is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return sorted_groups(df.select(*names, *[c for c in order if c not in names]), group, order).select(*names, "_g").mapInArrow(run, schema)


#: Rows a task holds where each key's rows are sorted, joined and grouped together.
TASK_ROWS = 1 << 18


def dealt_by_rows(rows: int, *sides: tuple[DataFrame, str]) -> list[DataFrame]:
    """The sides dealt by their key over as many tasks as `rows` asks for, so that a task's rows do not grow with the input.

    Adaptive execution merges partitions by their compressed bytes, and a few bytes of keys and dates are many rows.
    """
    tasks = max(1, -(-rows // TASK_ROWS))
    return [df.repartition(tasks, key) for df, key in sides]
