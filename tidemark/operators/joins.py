"""Joins with a stated cardinality, completeness joins and contract selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import busdays

from .common import single_row


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """Equi-join that fails the job when a side that must be unique holds a key twice.

    The check counts repeated keys in its own aggregation and hands the join a single row. The
    join itself stays a plain shuffle of both sides, which adaptive execution can split when
    one key holds a large part of the many side.
    """
    on = list(on)

    def unique(df: DataFrame) -> DataFrame:
        seen = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
        repeated = seen.agg(F.coalesce(F.sum((F.col("_n") > 1).cast("long")), F.lit(0)).alias("_dups"))
        fail = F.raise_error(F.lit(f"duplicate key over {on}")).cast("boolean")
        return df.crossJoin(single_row(repeated)).filter(F.when(F.col("_dups") == 0, F.lit(True)).otherwise(fail)).drop("_dups")

    if validate not in ("one_to_one", "many_to_one", "one_to_many"):
        raise ValueError(validate)
    if validate in ("one_to_one", "one_to_many"):
        left = unique(left)
    if validate in ("one_to_one", "many_to_one"):
        right = unique(right)
    return left.join(right, on, how)


def common_sessions(df: DataFrame, keys: Sequence[str], date: str, root: str, roots: Sequence[str]) -> DataFrame:
    """Dates on which every listed root traded."""
    seen = df.filter(F.col(root).isin(*roots)).groupBy(*keys, date, root).agg(F.lit(1).alias("_1"))
    return seen.groupBy(*keys, date).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(set(roots))).drop("_n")


def attach_by_rank(df: DataFrame, rates: DataFrame, keys: Sequence[str], date: str, expiry: str, contract: str, rank: str) -> DataFrame:
    """Rates by position in the expiry-ordered strip; the whole strip is ranked before any row is dropped.

    A session's strip is a handful of contracts, so the ranking window is small whatever the history.
    """
    w = W.partitionBy(*keys, date).orderBy(expiry, contract)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked.join(rates, [*keys, date, rank], "left")


def match_counters(joined: DataFrame, keys: Sequence[str], rate: str) -> DataFrame:
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("input_rows"), F.count(rate).alias("matched_rows"),
        (F.count(F.lit(1)) - F.count(rate)).alias("unmatched_rows"),
    )


def complete_groups(df: DataFrame, keys: Sequence[str], member: str, expected: DataFrame, on: Sequence[str], n: str) -> DataFrame:
    """Rows of groups whose observed members equal the expected number."""
    size = df.groupBy(*keys, member).agg(F.lit(1).alias("_1")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_have"))
    full = size.join(expected, list(on)).filter(F.col("_have") == F.col(n)).select(*keys)
    return df.join(full, list(keys), "left_semi")


def verify_forecasts(fc: DataFrame, realised: DataFrame, keys: Sequence[str], start: str) -> DataFrame:
    """Forecast rows next to the window they described; NULL where it has not been observed."""
    return fc.join(realised, [*keys, start], "left")


def select_contract(
    panel: DataFrame, decisions: DataFrame, keys: Sequence[str], root: str, date: str, contract: str, expiry: str,
    price: str, entry: str, exit: str, roll: int,
) -> DataFrame:
    """Nearest contract quoted at entry and exit with more than `roll` business days left at exit.

    Each decision asks for its two dates in one equi-join on (root, date); a contract counts
    where both answers came back. The nearest one is a grouped minimum. Decisions without such
    a contract drop out.
    """
    keys = list(keys)
    asks = decisions.select(*keys, root, entry, exit).dropna(subset=[root, entry, exit])
    asks = asks.select("*", F.explode(F.array_distinct(F.array(entry, exit))).alias(date))
    quotes = panel.select(root, date, contract, expiry, F.col(price).alias("_p"))
    j = asks.join(quotes, [root, date]).filter(busdays(exit, expiry) > roll)
    both = j.groupBy(*keys, root, entry, exit, contract, expiry).agg(
        F.max(F.when(F.col(date) == F.col(entry), F.col("_p"))).alias("entry_price"),
        F.max(F.when(F.col(date) == F.col(exit), F.col("_p"))).alias("exit_price"),
    ).filter("entry_price IS NOT NULL AND exit_price IS NOT NULL")
    s = F.struct(contract, expiry, "entry_price", "exit_price")
    return both.groupBy(*keys, root, entry, exit).agg(F.min_by(s, F.struct(expiry, contract)).alias("_s")).select(
        *keys, root, entry, exit, "_s.*"
    )


def label_years(pred: DataFrame, labels: DataFrame, on: Sequence[str]) -> DataFrame:
    """Strata labels next to predictions; a year without a label stays, unlabelled."""
    return pred.join(labels, list(on), "left")


def pair_signals(pred: DataFrame, signals: DataFrame, on: Sequence[str]) -> DataFrame:
    return pred.join(signals, list(on))


def ledger_status(decisions: DataFrame, outcomes: DataFrame, id_col: str, keys: Sequence[str], status: str) -> DataFrame:
    """Pending and resolved decisions by status, with ids registered more than once."""
    ids = decisions.groupBy(*keys, id_col, status).agg(F.count(F.lit(1)).alias("_c"))
    done = outcomes.select(id_col).distinct().withColumn("_done", F.lit(True))
    j = ids.join(done, id_col, "left")
    return j.groupBy(*keys, status).agg(
        F.count(F.lit(1)).alias("decisions"), F.sum(F.col("_done").isNull().cast("long")).alias("pending"),
        F.sum(F.col("_done").isNotNull().cast("long")).alias("resolved"),
        F.sum((F.col("_c") > 1).cast("long")).alias("duplicated"),
    )


def pending(decisions: DataFrame, outcomes: DataFrame, id_col: str) -> DataFrame:
    return decisions.join(outcomes, id_col, "left_anti")
