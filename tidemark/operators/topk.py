"""Top-n, greedy thinning and lexicographic choice.

A greedy rule is sequential: whether a row is taken depends on the last one taken. A key's rows are therefore
cut into buckets of its order, and what a bucket does to the last exit is written as a step function, which is
short because different beginnings soon take the same rows. Composing a key's functions in order gives the
last exit at the start of every bucket, and then all buckets are gone through side by side. No task holds more
than a bucket of rows, or the functions of a key.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by, group_by_group, in_turn, number


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """n first rows per key. Spark prunes row_number <= n before the shuffle (group limit)."""
    return df.withColumn("_r", F.row_number().over(by(keys, *order))).filter(F.col("_r") <= n).drop("_r")


def thin_rows(df: DataFrame, keys: Sequence[str], idx: str, horizon: int) -> DataFrame:
    """Rows spaced at least `horizon` positions apart, first one kept. One row per (key, idx)."""
    until = df.withColumn("_x", F.col(idx).cast("long") + (horizon - 1)).withColumn("_s", F.lit(1))
    return no_overlap(until, keys, idx, "_x", "_s", "_keep", width=max(4096, 64 * horizon)).filter("_keep = 1").select(*df.columns)


#: The last exit before anything was taken.
NEVER = -(2**63)
#: Rows without an order go to the last bucket.
LAST = 2**63 - 1


def steps_of(entries: list, exits: list, live: list) -> tuple[list[int], list[int]]:
    """What a bucket makes of the last exit, as (at, to): below at[i], and not below at[i + 1], it becomes to[i].

    At or above at[0] it stays. Rows are gone through backwards: a row sends every last exit below its entry to
    what the rows after it make of its own exit, and hides all steps up to there.
    """
    at, to = [], []
    for e, x, s in zip(reversed(entries), reversed(exits), reversed(live)):
        if e is None or not s:
            continue
        after = through(at, to, NEVER if x is None else x)
        while at and at[-1] <= e:
            at.pop()
            to.pop()
        if not at or to[-1] != after:
            at.append(e)
            to.append(after)
    return at, to


def through(at: list[int], to: list[int], last: int) -> int:
    above = bisect.bisect_left(at, -last, key=lambda a: -a)
    return to[above - 1] if above else last


def no_overlap(
    df: DataFrame, keys: Sequence[str], entry: str, exit: str, signal: str, out: str = "executed", order: Sequence[str] = (), width: int = 64
) -> DataFrame:
    """Signals whose entry is not after the last executed exit become 0; equality is overlap.

    Rows are taken in `order` (entry, exit unless given). A zero signal and a suppressed one do
    not extend the block; a row without an entry is never executed, one without an exit does not block.
    Entries and exits are dates, timestamps or integers. `width` is a bucket's share of the order's first
    column, in days, microseconds or units.
    """
    keys, first = list(keys), list(order) or [entry, exit]
    bucket = F.coalesce(F.floor(number(df, first[0]) / width).cast("long"), F.lit(LAST))
    rows = df.withColumn("_tk_b", bucket).withColumn("_tk_e", number(df, entry)).withColumn("_tk_x", number(df, exit)).withColumn("_tk_live", F.coalesce(F.col(signal) != 0, F.lit(False)))
    longs = T.ArrayType(T.LongType())
    steps = group_by_group(
        rows, [*keys, "_tk_b"], first, ["_tk_e", "_tk_x", "_tk_live"], lambda e, x, s: [steps_of(e, x, s)], [T.StructField("_tk_at", longs), T.StructField("_tk_to", longs)]
    )

    def compose(buckets: list, at: list, to: list) -> Iterator[tuple]:
        last = NEVER
        for b, a, t in zip(buckets, at, to):
            yield b, last
            last = through(a, t, last)

    fields = [T.StructField("_tk_b", T.LongType()), T.StructField("_tk_last", T.LongType())]
    named = steps.withColumnRenamed("_tk_b", "_tk_bucket")
    begins = group_by_group(named, keys, ["_tk_bucket"], ["_tk_bucket", "_tk_at", "_tk_to"], compose, fields)
    begins = begins.withColumnsRenamed({c: f"_tk_k{i}" for i, c in enumerate([*keys, "_tk_b"])})
    same = [F.col(c).eqNullSafe(F.col(f"_tk_k{i}")) for i, c in enumerate([*keys, "_tk_b"])]
    met = rows.join(begins, reduce(Column.__and__, same)).drop(*[f"_tk_k{i}" for i in range(len(keys) + 1)])

    def execute() -> Callable:
        last = None

        def decide(e, x, live, begin) -> bool:
            nonlocal last
            if last is None:
                last = begin
            take = e is not None and live and e > last
            if take:
                last = NEVER if x is None else x
            return take

        return decide

    done = in_turn(met, [*keys, "_tk_b"], first, ["_tk_e", "_tk_x", "_tk_live", "_tk_last"], execute, "_tk_take", T.BooleanType())
    return done.withColumn(out, F.when(F.col("_tk_take"), F.col(signal)).otherwise(F.lit(0).cast(df.schema[signal].dataType))).select(*df.columns, out)


def pick_best(df: DataFrame, keys: Sequence[str], candidate: Sequence[str], sharpe: str, net: str) -> DataFrame:
    """Best candidate per key by Sharpe, then net; a missing Sharpe ranks below everything.

    `candidate` names the columns returned; the first one breaks remaining ties, smallest first.
    """
    low = F.lit(float("-inf"))
    best = F.min_by(
        F.struct(*candidate, sharpe, net),
        F.struct((-F.coalesce(F.col(sharpe), low)), (-F.coalesce(F.col(net), low)), F.col(candidate[0])),
    )
    return df.groupBy(*keys).agg(best.alias("_s")).select(*keys, "_s.*")


def size_pairs(a: str, b: str, max_q: int, margin: tuple[str, str, float] | None = None) -> Column:
    """Smallest-imbalance integer pair of at most max_q each, as struct(imbalance, total, qa, qb).

    Ties go to fewer contracts, then to the smaller first leg. `margin` = (per-unit a, per-unit b,
    budget) removes pairs the budget cannot fund; NULL when none is left. For a given second leg the imbalance
    falls up to the balancing first leg and rises from there, so only the two whole numbers beside it are
    scored, or the last affordable one: two pairs a second leg.
    """
    x, y = F.col(a), F.col(b)

    def legs(j: Column) -> Column:
        most = F.lit(float(max_q))
        if margin is not None:
            ma, mb, budget = F.col(margin[0]), F.col(margin[1]), F.lit(float(margin[2]))
            room = budget - j * mb
            fits = F.floor(room / F.when(ma > 0, ma)).cast("double")
            # the quotient may round up to a leg that the budget does not cover, or down from one that it does
            fits = F.when((fits + 1) * ma + j * mb <= budget, fits + 1).when(fits * ma + j * mb <= budget, fits).otherwise(fits - 1)
            most = F.least(most, F.when(ma > 0, fits).when(j * mb + ma <= budget, most).otherwise(0.0))
        exact = F.when(x != 0, j * y / x)
        down = F.floor(F.greatest(F.lit(0.0), F.least(exact, F.lit(float(max_q))))).cast("double")
        pick = F.transform(F.array(down, down + 1), lambda i: F.greatest(F.lit(1.0), F.least(i, most)))
        return F.when(most >= 1, pick).otherwise(F.array().cast("array<double>"))

    def score(i: Column, j: Column) -> Column:
        na, nb = x * i, y * j
        return F.struct((F.abs(na - nb) / (na + nb)).alias("imbalance"), (i + j).cast("int").alias("total"), i.cast("int").alias("qa"), j.cast("int").alias("qb"))

    second = F.transform(F.sequence(F.lit(1), F.lit(max_q)), lambda j: F.transform(legs(j), lambda i: score(i, j)))
    return F.array_min(F.flatten(second))
