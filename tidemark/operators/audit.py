"""Data audits: every rule counts its violations and shows a few examples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import busdays

from .common import by

Rule = tuple[str, Column]  # severity, violation predicate


def violations(df: DataFrame, rules: Mapping[str, Rule], example: Column, keep: int = 3) -> DataFrame:
    """Per rule: severity, how many rows break it and the first few examples.

    Rows are tested once for all rules. Counting combines map-side, and the examples are a
    top-n per rule that every task prunes before the shuffle, so a rule broken by most rows
    stays cheap.
    """
    hits = F.filter(
        F.array(*[F.when(F.coalesce(p, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, (sev, p) in rules.items()]),
        lambda x: x.isNotNull(),
    )
    rows = df.select(example.alias("_e"), F.inline(hits))
    counts = rows.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("rows"))
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy("code").orderBy("_e"))).filter(F.col("_r") <= keep)
    shown = first.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_e"))), lambda s: s["_e"]), " ; ").alias("examples"))
    return counts.join(shown, "code").select("severity", "code", "rows", "examples")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Identities held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def check_unique(df: DataFrame, keys: Sequence[str], keep: int = 3) -> DataFrame:
    """How many identities repeat, how many rows they hold, and a sample."""
    d = duplicate_keys(df, keys)
    total = d.agg(F.count(F.lit(1)).alias("identities"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    text = F.concat_ws(" | ", *[F.col(k).cast("string") for k in keys])
    sample = d.select(text.alias("_e")).orderBy("_e").limit(keep).agg(F.array_join(F.array_sort(F.collect_list("_e")), " ; ").alias("examples"))
    return total.crossJoin(F.broadcast(sample))


def inconsistent(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose attribute takes more than one value."""
    g = df.groupBy(key).agg(F.min(value).alias("first_value"), F.max(value).alias("last_value"))
    return g.filter(F.col("first_value") != F.col("last_value"))


def panel_rules(root: str, ticks: Mapping[str, float], letters: Mapping[str, str]) -> dict[str, Rule]:
    """Row-level rules of a dated contract panel (see the schema in the panel query).

    Codes and severities are fixed values that reports rely on.
    """
    prices = ("open_cents", "high_cents", "low_cents", "settle_cents")
    have = F.lit(True)
    for p in prices:
        have = have & F.col(p).isNotNull()
    bad_ohlc = have & ((F.col("high_cents") < F.col("open_cents")) | (F.col("low_cents") > F.col("open_cents")) | (F.col("low_cents") > F.col("high_cents")))
    outside = have & ~bad_ohlc & ((F.col("settle_cents") > F.col("high_cents")) | (F.col("settle_cents") < F.col("low_cents")))
    tick = F.create_map(*[F.lit(x) for kv in ticks.items() for x in kv])
    listed = F.create_map(*[F.lit(x) for kv in letters.items() for x in kv])
    step = F.try_element_at(tick, F.col(root))
    off = F.lit(False)
    for p in prices:
        q = F.col(p) / step
        off = off | (F.abs(q - F.round(q)) > 1e-6)
    letter = F.substring("contract", 2, 1)
    bad_code = ~F.col("contract").startswith(F.col(root)) | (F.length("contract") < 3) | ~F.try_element_at(listed, F.col(root)).contains(letter)
    out: dict[str, Rule] = {
        "INVALID_DATE": ("ERROR", F.col("d").isNull()), "INVALID_EXPIRY": ("ERROR", F.col("expiry").isNull()),
        "UNKNOWN_ROOT": ("ERROR", step.isNull()),
    }
    for p in prices:
        out[f"INVALID_{p.upper()}"] = ("ERROR", F.col(p).isNull() | (F.col(p) <= 0))
    out |= {
        "INVALID_OHLC": ("ERROR", bad_ohlc), "SETTLEMENT_OUTSIDE_RANGE": ("INFO", outside),
        "AFTER_LAST_TRADE": ("ERROR", F.col("d") > F.col("expiry")), "INVALID_CONTRACT_CODE": ("ERROR", bad_code),
        "OFF_TICK_PRICE": ("WARNING", off), "INVALID_VOLUME": ("WARNING", F.col("volume").isNull() | (F.col("volume") < 0)),
        "INVALID_OPEN_INTEREST": ("WARNING", F.col("oi").isNull() | (F.col("oi") < 0)),
        "INVALID_MARGIN": ("BLOCKER", F.col("margin").isNull() | (F.col("margin") <= 0)),
    }
    return out


# Findings for columns that a panel may lack.
OPTIONAL = {"volume": ("WARNING", "MISSING_VOLUME"), "oi": ("WARNING", "MISSING_OPEN_INTEREST"), "margin": ("BLOCKER", "MISSING_MARGIN")}


def audit_panel(
    df: DataFrame, root: str, keys: Sequence[str], rules: Mapping[str, Rule], required_roots: Sequence[str], min_unit: float = 50.0
) -> DataFrame:
    """All findings of a contract panel: row rules, duplicates, conflicting expiries, missing roots, suspect units.

    A panel without volume, open interest or margin is audited all the same; the absent column is one
    finding about all rows, in place of its row rule.
    """
    absent = [c for c in OPTIONAL if c not in df.columns]
    rules = {code: rule for code, rule in rules.items() if code not in [OPTIONAL[c][1].replace("MISSING", "INVALID") for c in absent]}
    everything = df.agg(F.count(F.lit(1)).alias("rows"), F.lit(None).cast("string").alias("examples"))
    text = F.concat_ws(" | ", *[F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys])
    found = violations(df, rules, text)
    dup = duplicate_keys(df, keys).agg(F.sum("rows").alias("rows"), F.min(text).alias("examples"))
    exp = inconsistent(df, "contract", "expiry").agg(F.count(F.lit(1)).alias("rows"), F.min("contract").alias("examples"))
    need = df.agg(F.collect_set(root).alias("_seen"))  # roots are a short list
    missing = need.select(F.explode(F.array_except(F.array(*[F.lit(r) for r in required_roots]), "_seen")).alias("_r")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("_r").alias("examples")
    )
    # The median works on prices folded to distinct values with counts.
    folded = df.groupBy(root, "settle_cents").agg(F.count(F.lit(1)).alias("_f"))
    unit = folded.groupBy(root).agg(F.percentile("settle_cents", F.lit(0.5), F.col("_f")).alias("_m"), F.sum("_f").alias("rows")).filter(F.col("_m") < min_unit)
    unit = unit.agg(F.sum("rows").alias("rows"), F.min(root).alias("examples"))

    def tagged(part: DataFrame, severity: str, code: str) -> DataFrame:
        return part.filter("rows > 0").select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("rows").cast("long").alias("rows"), "examples")

    out = found
    for c in absent:
        out = out.unionByName(tagged(everything, *OPTIONAL[c]))
    for part, sev, code in (
        (dup, "ERROR", "DUPLICATE_ROWS"), (exp, "ERROR", "INCONSISTENT_LAST_TRADE_DATE"), (missing, "ERROR", "MISSING_ROOTS"),
        (unit, "WARNING", "SUSPECT_PRICE_UNIT"),
    ):
        out = out.unionByName(tagged(part, sev, code))
    return out


def session_gaps(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Weekdays without a session between two sessions of a contract."""
    prev = F.lag(date).over(by(keys, date))
    out = df.select(*keys, date).distinct().withColumn("previous", prev).filter("previous IS NOT NULL")
    gap = busdays("previous", date) - 1
    return out.withColumn("missing_days", gap).filter(F.col("missing_days") > 0)


def check_ladder(df: DataFrame, none: str, rungs: Sequence[str], tol: float) -> DataFrame:
    """Rows that break nested coverage: each rung at most the one before, none + first = 100."""
    broken = F.abs(F.col(none) + F.col(rungs[0]) - 100.0) > tol
    for a, b in zip(rungs, rungs[1:]):
        broken = broken | (F.col(b) > F.col(a) + tol)
    return df.filter(broken)


def check_shares(df: DataFrame, keys: Sequence[str], value: str, n: int, aggregate: Column, tol: float = 0.01) -> DataFrame:
    """Groups by verdict: values in 0..100 and summing to 100; only an aggregate group fails for its sum."""
    g = df.groupBy(*keys).agg(
        F.sum(value).alias("total"), F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.max(aggregate.cast("int")).alias("_agg")
    )
    off = (F.col("_n") == n) & (F.abs(F.col("total") - 100.0) > tol)
    status = (
        F.when((F.col("_lo") < 0) | (F.col("_hi") > 100), "out of range").when(off & (F.col("_agg") == 1), "aggregate sum")
        .when(off, "source sum").otherwise("ok")
    )
    return g.select(*keys, "total", status.alias("status"))


def check_frame(df: DataFrame, keys: Sequence[str], date: str, entry: str, exit: str, cost: str, year: str, years: Sequence[int]) -> DataFrame:
    """Violation counts of a model frame's timing and the years it lacks."""
    seen = F.collect_set(year)  # calendar years
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum((F.col(entry) <= F.col(date)).cast("long")).alias("entry_not_after_decision"),
        F.sum((F.col(exit) <= F.col(entry)).cast("long")).alias("exit_not_after_entry"), F.sum((F.col(cost) <= 0).cast("long")).alias("cost_not_positive"),
        F.size(F.array_except(F.array(*[F.lit(y) for y in years]), seen)).alias("missing_years"),
    )


def check_leads(df: DataFrame, product: str, issued: str, start: str, end: str, leads: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Valid windows against the product's configured leads: verdict counts per product."""
    lo = F.create_map(*[F.lit(x) for k, v in leads.items() for x in (k, v[0])])
    hi = F.create_map(*[F.lit(x) for k, v in leads.items() for x in (k, v[1])])
    ok = (F.datediff(start, issued) == F.try_element_at(lo, F.col(product))) & (F.datediff(end, issued) == F.try_element_at(hi, F.col(product)))
    verdict = F.when(ok, "ok").when(F.try_element_at(lo, F.col(product)).isNull(), "unknown product").otherwise("mislabelled")
    return df.groupBy(product, verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("rows"))


def coverage_report(panel: DataFrame, date: str, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Filled and unfilled counts and the filled span of every column, in one pass over the panel."""
    cols = [*features, *targets]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in cols:
        have = F.when(F.col(c).isNotNull(), F.col(date))
        aggs += [F.count(c).alias(f"_n_{c}"), F.min(have).alias(f"_a_{c}"), F.max(have).alias(f"_b_{c}")]
    one = panel.agg(*aggs)
    stack = ", ".join(f"'{c}', '{'feature' if c in features else 'target'}', `_n_{c}`, `_a_{c}`, `_b_{c}`" for c in cols)
    return one.select("_rows", F.expr(f"stack({len(cols)}, {stack}) as (column, kind, filled, first_date, last_date)")).select(
        "column", "kind", "filled", (F.col("_rows") - F.col("filled")).alias("unfilled"), "first_date", "last_date"
    )
