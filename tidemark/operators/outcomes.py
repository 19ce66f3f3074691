"""Dated outcomes of decisions: entry, exit, same-contract prices, sizes, costs and status.

All lookups are equi-joins on (root, date[, contract]); a decision's next sessions come from
the as-of join on the session calendar. Decisions without an outcome stay, with a status.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import div

from .joins import checked_join, select_contract
from .pit import entry_exit
from .topk import no_overlap, size_pairs
from .windows import strip_rank


def pair_sessions(panel: DataFrame, pairs: Mapping[str, tuple[str, str]], root: str, date: str) -> DataFrame:
    """Sessions on which both legs of a pair traded. Pairs are a short configured list."""
    lists = F.array(*[
        F.struct(F.lit(name).alias("pair"), F.lit(r).alias("_r")) for name, legs in pairs.items() for r in legs
    ])
    seen = panel.select(root, date).distinct()
    legs = seen.select(date, root, F.inline(lists)).filter(F.col(root) == F.col("_r"))
    return legs.groupBy("pair", date).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 2").drop("_n")


def trade_cost(qty_near: Column, qty_far: Column, commission: float, ticks: float, tick_value: float) -> Column:
    """Round-trip cost of both legs: commission and slippage on every contract side."""
    return F.lit(2.0) * (qty_near + qty_far) * F.lit(commission + ticks * tick_value)


def cost_rate(price_cents: Column | str, commission: float, ticks: float, tick_value: float, contract_size: float) -> Column:
    """Round-trip cost of one contract per unit of its notional."""
    price = F.col(price_cents) if isinstance(price_cents, str) else price_cents
    return div(F.lit(2.0 * (commission + ticks * tick_value)), price * F.lit(contract_size / 100.0))


def both_legs(
    panel: DataFrame, decisions: DataFrame, pairs: Mapping[str, tuple[str, str]], entry: str, exit: str, price: str, roll: int
) -> DataFrame:
    """Selected contract and prices of the near and far leg per decision; both must exist."""
    legs = F.array(*[
        F.struct(F.lit(p).alias("_p"), F.lit(tag).alias("leg"), F.lit(r).alias("root"))
        for p, (near, far) in pairs.items() for tag, r in (("near", near), ("far", far))
    ])
    d = decisions.select("pair", "date", entry, exit).dropna().select("*", F.inline(legs)).filter("pair = _p").drop("_p")
    c = select_contract(panel, d, ["pair", "date", "leg"], "root", "d", "contract", "expiry", price, entry, exit, roll)

    def of(tag: str, name: str) -> Column:
        return F.max(F.when(F.col("leg") == tag, F.col(name)))

    out = c.groupBy("pair", "date").agg(*[
        of(tag, name).alias(f"{tag}_{short}")
        for tag in ("near", "far") for name, short in (("contract", "contract"), ("expiry", "expiry"), ("entry_price", "entry"), ("exit_price", "exit"))
    ])
    return out.filter("near_contract IS NOT NULL AND far_contract IS NOT NULL")


def execution_outcomes(
    decisions: DataFrame, panel: DataFrame, pairs: Mapping[str, tuple[str, str]], *, hold: int = 5, roll: int = 10, max_q: int = 8,
    size: float = 5000.0, commission: float = 2.5, ticks: float = 1.0, tick_value: float = 12.5, allow_overlap: bool = False,
) -> DataFrame:
    """Next-open entry and n-session exit of a two-leg position in the same contracts.

    decisions: pair, date, signal (-1/0/1), one row per pair and date. Every decision comes
    back with a status; returns are on the average leg notional.
    """
    sessions = pair_sessions(panel, pairs, "root", "d")
    dated = entry_exit(decisions, sessions, ["pair"], "date", "d", hold, grid=True)
    legs = both_legs(panel, dated, pairs, "entry_date", "exit_date", "open_cents", roll)
    j = dated.join(legs, ["pair", "date"], "left")
    unit = size / 100.0
    j = j.withColumn("_na", F.col("near_entry") * unit).withColumn("_nb", F.col("far_entry") * unit)
    j = j.withColumn("_q", F.when(F.col("_na").isNotNull() & F.col("_nb").isNotNull(), size_pairs("_na", "_nb", max_q)))
    j = j.withColumn("near_qty", F.col("_q.qa")).withColumn("far_qty", F.col("_q.qb")).withColumn("imbalance", F.col("_q.imbalance"))
    pnl = F.col("near_qty") * (F.col("near_exit") - F.col("near_entry")) * unit - F.col("far_qty") * (F.col("far_exit") - F.col("far_entry")) * unit
    notional = (F.col("near_qty") * F.col("_na") + F.col("far_qty") * F.col("_nb")) / 2.0
    j = j.withColumn("gross", div(pnl, notional)).withColumn("near_return", div("near_exit", "near_entry") - 1).withColumn(
        "far_return", div("far_exit", "far_entry") - 1
    ).withColumn("cost", div(trade_cost(F.col("near_qty"), F.col("far_qty"), commission, ticks, tick_value), notional))
    # A decision without an outcome cannot block a later one.
    j = j.withColumn("_live", F.when(F.col("gross").isNotNull(), F.col("signal")).otherwise(0))
    if allow_overlap:
        out = j.withColumn("executed", F.col("_live"))
    else:
        out = no_overlap(j, ["pair"], "entry_date", "exit_date", "_live", "executed", order=["date"])
    out = out.withColumn("executed", F.when(F.col("gross").isNotNull(), F.col("executed")))
    status = (
        F.when(F.col("exit_date").isNull(), "SKIPPED_NO_EXIT").when(F.col("gross").isNull(), "SKIPPED_NO_CONTRACT")
        .when(F.col("signal") == 0, "HOLD").when(F.col("executed") == 0, "SKIPPED_OVERLAP").otherwise("EXECUTED")
    )
    out = out.withColumn("status", status)
    net = F.col("executed") * F.col("gross") - F.abs("executed") * F.col("cost")
    return out.withColumn("net", net).drop("_na", "_nb", "_q", "_live")


def rolled_forward(outcomes: DataFrame, panel: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Whether the near leg is not the nearest listed contract at entry."""
    nearest = panel.withColumn("_r", strip_rank(["root", "d"], "expiry", "contract")).filter("_r = 1").select(
        F.col("root").alias("_root"), F.col("d").alias("entry_date"), F.col("contract").alias("nearest_contract")
    )
    root = F.create_map(*[F.lit(x) for p, legs in pairs.items() for x in (p, legs[0])])[F.col("pair")]
    return outcomes.withColumn("_root", root).join(nearest, ["_root", "entry_date"], "left").withColumn(
        "rolled_forward", F.col("near_contract") != F.col("nearest_contract")
    ).drop("_root")


def settlement_outcomes(decisions: DataFrame, panel: DataFrame, pairs: Mapping[str, tuple[str, str]], *, end: str = "target_end", roll: int = 10) -> DataFrame:
    """Settlement-to-settlement returns on given dates; a decision without both contracts is UNAVAILABLE."""
    dated = decisions.withColumn("entry_date", F.col("date")).withColumn("exit_date", F.col(end))
    legs = both_legs(panel, dated, pairs, "entry_date", "exit_date", "settle_cents", roll)
    j = decisions.join(legs, ["pair", "date"], "left")
    near, far = div("near_exit", "near_entry") - 1, div("far_exit", "far_entry") - 1
    return j.withColumn("near_return", near).withColumn("far_return", far).withColumn("spread_return", near - far).withColumn(
        "close_status", F.when((near - far).isNotNull(), "OK").otherwise("UNAVAILABLE")
    )


def decision_frame(
    features: DataFrame, outcomes: DataFrame, market: DataFrame, keys: Sequence[str], date: str, market_date: str, payload: Sequence[str], strict: bool = True
) -> DataFrame:
    """Features, outcomes and market controls of a prior session, one row per entry session.

    Controls join strictly before the decision date; several decisions that map to one open
    keep the last. Timing is asserted: a violation fails the job.
    """
    from .pit import asof_join

    keys = list(keys)
    j = features.join(outcomes, [*keys, date])
    rest = [c for c in j.columns if c not in (*keys, "entry_date")]
    j = j.groupBy(*keys, "entry_date").agg(F.max_by(F.struct(*rest), F.col(date)).alias("_s")).select(*keys, "entry_date", "_s.*")
    m = market.select(*keys, F.col(market_date).alias("_q"), F.col(market_date).alias("market_data_through"), *payload)
    out = asof_join(j, m, keys, date, "_q", ["market_data_through", *payload], strict=strict, grid=True)
    late = F.col("market_data_through") >= F.col(date) if strict else F.col("market_data_through") > F.col(date)
    bad = F.coalesce(late, F.lit(False)) | (F.col("entry_date") <= F.col(date)) | (F.col("exit_date") <= F.col("entry_date"))
    guard = F.when(bad, F.raise_error(F.lit("decision frame breaks its timing rules")).cast("boolean")).otherwise(F.lit(True))
    return out.filter(guard)


def contract_targets(front: DataFrame, panel: DataFrame, keys: Sequence[str], hold: int, rate) -> DataFrame:
    """Same-contract next-open outcome of a front contract, counted in that contract's own sessions.

    The n-th later session of a contract is a lead over its own history: one window per
    contract, whose length is bounded by the contract's life.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys, "contract").orderBy("d")
    ahead = panel.select(
        *keys, "contract", "d", F.lead("d", 1).over(w).alias("entry_date"), F.lead("open_cents", 1).over(w).alias("entry_open"),
        F.lead("d", 1 + hold).over(w).alias("exit_date"), F.lead("open_cents", 1 + hold).over(w).alias("exit_open"),
    ).filter("exit_date IS NOT NULL")
    j = checked_join(front, ahead, [*keys, "contract", "d"], validate="one_to_one")
    return j.withColumn("target", div("exit_open", "entry_open") - 1).withColumn("cost_rate", rate("entry_open"))


def align_predictions(pred: DataFrame, outcomes: DataFrame, keys: Sequence[str], date: str, multiplier: float = 1.0) -> DataFrame:
    """Frozen predictions on exact outcomes, overlap rule re-applied, repriced at a cost multiple."""
    keys = list(keys)
    signals = pred.withColumn(
        "raw_signal",
        F.when(F.col("signal").isin(-1, 0, 1), F.col("signal").cast("int")).otherwise(F.raise_error(F.lit("signals must be -1, 0 or 1")).cast("int")),
    ).drop("signal")
    j = checked_join(signals, outcomes, [*keys, date], validate="one_to_one")
    run = no_overlap(j, keys, "entry_date", "exit_date", "raw_signal", "signal", order=[date])
    return run.withColumn("net", F.col("signal") * F.col("gross") - F.abs("signal") * F.lit(multiplier) * F.col("cost"))


def waterfall(stages: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Totals of ordered one-change counterfactuals and the increment of each over the one before."""
    from pyspark.sql import Window as W

    stack = ", ".join(f"{i}, '{n}', `{n}`" for i, n in enumerate(names))
    long = stages.select(*keys, F.expr(f"stack({len(names)}, {stack}) as (step, stage, net)"))
    t = long.groupBy(*keys, "step", "stage").agg(F.sum("net").alias("total_net"), F.sum((F.col("net") != 0).cast("long")).alias("trades"))
    return t.withColumn("increment", F.col("total_net") - F.lag("total_net").over(W.partitionBy(*keys).orderBy("step")))


def sensitivity(decisions: DataFrame, panel: DataFrame, pairs: Mapping[str, tuple[str, str]], grid: Sequence[Mapping[str, float]]) -> DataFrame:
    """Total net and trades per (roll, cost) setting.

    Selection depends on the roll only, so outcomes are built once per roll value and every
    cost setting is priced on them by arithmetic.
    """
    from functools import reduce

    parts = []
    for roll in sorted({int(g["roll"]) for g in grid}):
        o = execution_outcomes(decisions, panel, pairs, roll=roll, commission=0.0, ticks=0.0)
        units = div(F.lit(2.0) * (F.col("near_qty") + F.col("far_qty")), (F.col("near_qty") * F.col("near_entry") + F.col("far_qty") * F.col("far_entry")) * 50.0 / 2.0)
        cells = F.array(*[F.struct(F.lit(float(g["side_cost"])).alias("side_cost")) for g in grid if int(g["roll"]) == roll])
        priced = o.withColumn("_units", units).select("pair", "executed", "gross", "_units", F.inline(cells))
        net = F.col("executed") * F.col("gross") - F.abs("executed") * F.col("_units") * F.col("side_cost")
        parts.append(
            priced.groupBy("pair", "side_cost").agg(F.sum(net).alias("total_net"), F.sum((F.col("executed") != 0).cast("long")).alias("trades"))
            .withColumn("roll", F.lit(roll))
        )
    return reduce(DataFrame.unionByName, parts)
