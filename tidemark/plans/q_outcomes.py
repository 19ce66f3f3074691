"""Dated outcome queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import outcomes as TR
from tidemark.operators import topk as TK
from tidemark.operators import windows as WN
from tidemark.operators.pit import asof_join

from .base import BELT, PANEL, belt, panel
from .q_windows import ELIG, busday_sql
from .registry import query, shared

PAIRS = {"AN": ("A", "N"), "AR": ("A", "R"), "NR": ("N", "R")}

DECISIONS = PANEL + """, prs AS (SELECT * FROM (VALUES ('AN', 'A', 'N'), ('AR', 'A', 'R'), ('NR', 'N', 'R')) v(pair, near, far)),
rpx AS (SELECT root, d, sum(settle_cents * oi) / sum(oi) AS px FROM panel GROUP BY 1, 2),
sess AS (SELECT pair, a.d, a.px / b.px AS ratio FROM prs JOIN rpx a ON a.root = near JOIN rpx b ON b.root = far AND b.d = a.d),
dec AS (SELECT pair, max(d) AS date, CASE WHEN arg_max(ratio, d) > 1.02 THEN -1 WHEN arg_max(ratio, d) < 0.98 THEN 1 ELSE 0 END AS signal, arg_max(ratio, d) AS ratio
  FROM sess GROUP BY pair, CAST(date_trunc('week', d + 2) AS DATE)),
cal AS (SELECT pair, d, lead(d, 5) OVER (PARTITION BY pair ORDER BY d) AS x FROM sess),
dated AS (SELECT dec.*, c.d AS entry_date, c.x AS exit_date FROM dec ASOF LEFT JOIN cal c ON dec.pair = c.pair AND dec.date < c.d)"""


def legs_sql(name: str, src: str, price: str, roll: int = 10) -> str:
    def leg(side: str) -> str:
        return f"""SELECT * FROM (SELECT s.pair, s.date, a.contract, a.expiry, a.{price} AS p0, b.{price} AS p1, row_number() OVER (PARTITION BY s.pair, s.date ORDER BY a.expiry, a.contract) AS rk
          FROM {src} s JOIN prs USING (pair) JOIN panel a ON a.root = {side} AND a.d = s.entry_date JOIN panel b ON b.root = {side} AND b.d = s.exit_date AND b.contract = a.contract
          WHERE {busday_sql('s.exit_date', 'a.expiry')} > {roll}) WHERE rk = 1"""

    return f"""{name} AS (SELECT n.pair, n.date, n.contract AS near_contract, n.expiry AS near_expiry, n.p0 AS near_entry, n.p1 AS near_exit, f.contract AS far_contract, f.p0 AS far_entry, f.p1 AS far_exit
      FROM ({leg('near')}) n JOIN ({leg('far')}) f ON n.pair = f.pair AND n.date = f.date)"""


def exec_sql(sfx: str = "", roll: int = 10, fee: float = 15.0) -> str:
    return legs_sql(f"legs{sfx}", "dated", "open_cents", roll) + f""",
sz{sfx} AS (SELECT pair, date, i AS qa, j AS qb, imb FROM (SELECT pair, date, i, j, imb, row_number() OVER (PARTITION BY pair, date ORDER BY imb, i + j, i) AS rk FROM (
  SELECT pair, date, i, j, abs(near_entry * 50.0 * i - far_entry * 50.0 * j) / (near_entry * 50.0 * i + far_entry * 50.0 * j) AS imb FROM legs{sfx}, generate_series(1, 8) x(i), generate_series(1, 8) y(j))) WHERE rk = 1),
o1{sfx} AS (SELECT d.*, l.* EXCLUDE (pair, date), s.qa, s.qb, s.imb, (qa * near_entry * 50.0 + qb * far_entry * 50.0) / 2.0 AS notional FROM dated d LEFT JOIN legs{sfx} l ON l.pair = d.pair AND l.date = d.date LEFT JOIN sz{sfx} s ON s.pair = d.pair AND s.date = d.date),
o2{sfx} AS (SELECT *, (qa * (near_exit - near_entry) * 50.0 - qb * (far_exit - far_entry) * 50.0) / notional AS gross, 2.0 * (qa + qb) * {fee} / notional AS cost FROM o1{sfx}),
lst{sfx} AS (SELECT pair, date, entry_date, exit_date, signal, row_number() OVER (PARTITION BY pair ORDER BY date) AS rn FROM o2{sfx} WHERE gross IS NOT NULL),
ov{sfx} AS (SELECT pair, date, rn, signal AS executed, CASE WHEN signal <> 0 THEN exit_date END AS last FROM lst{sfx} WHERE rn = 1
  UNION ALL SELECT n.pair, n.date, n.rn, CASE WHEN n.signal <> 0 AND (r.last IS NULL OR n.entry_date > r.last) THEN n.signal ELSE 0 END,
    CASE WHEN n.signal <> 0 AND (r.last IS NULL OR n.entry_date > r.last) THEN n.exit_date ELSE r.last END FROM ov{sfx} r JOIN lst{sfx} n ON n.pair = r.pair AND n.rn = r.rn + 1),
outc{sfx} AS (SELECT o.*, v.executed, v.executed * gross - abs(v.executed) * cost AS net,
  CASE WHEN exit_date IS NULL THEN 'SKIPPED_NO_EXIT' WHEN gross IS NULL THEN 'SKIPPED_NO_CONTRACT' WHEN signal = 0 THEN 'HOLD' WHEN v.executed = 0 THEN 'SKIPPED_OVERLAP' ELSE 'EXECUTED' END AS status
  FROM o2{sfx} o LEFT JOIN ov{sfx} v ON v.pair = o.pair AND v.date = o.date)"""


def rec(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


@shared
def sessions(t):
    rpx = panel(t).groupBy("root", "d").agg((F.sum(F.col("settle_cents") * F.col("oi")) / F.sum("oi")).alias("px"))
    cells = F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(a).alias("_n"), F.lit(b).alias("_f")) for p, (a, b) in PAIRS.items()])
    rows = rpx.select("root", "d", "px", F.inline(cells))
    # One pass per pair and session: the leg a row belongs to is a condition, not a self-join.
    g = rows.groupBy("pair", "d").agg(
        F.max(F.when(F.col("root") == F.col("_n"), F.col("px"))).alias("a"), F.max(F.when(F.col("root") == F.col("_f"), F.col("px"))).alias("b")
    )
    return g.filter("a IS NOT NULL AND b IS NOT NULL").select("pair", "d", (F.col("a") / F.col("b")).alias("ratio"))


@shared
def decisions(t):
    w = WN.last_of_period(sessions(t), ["pair"], S.week_fri("d"), "d", ["ratio"])
    sig = F.when(F.col("ratio") > 1.02, -1).when(F.col("ratio") < 0.98, 1).otherwise(0)
    return w.select("pair", F.col("d").alias("date"), sig.alias("signal"), "ratio")


def outcomes(t, **kw):
    return TR.execution_outcomes(decisions(t), panel(t), PAIRS, **kw)


@query(
    "tr1_execution_outcomes",
    rec(DECISIONS, exec_sql()) + """SELECT pair, date, CAST(signal AS BIGINT) AS signal, entry_date, exit_date, near_contract, far_contract, CAST(qa AS BIGINT) AS near_qty, CAST(qb AS BIGINT) AS far_qty, imb AS imbalance, gross, cost,
      CAST(executed AS BIGINT) AS executed, status, net FROM outc""",
    d="imbalance gross cost net",
)
def _(t):
    return outcomes(t).select(
        "pair", "date", "signal", "entry_date", "exit_date", "near_contract", "far_contract", "near_qty", "far_qty", "imbalance", "gross", "cost", "executed", "status", "net"
    )


SETTLE = """, sd AS (SELECT dec.pair, dec.date, dec.signal, dec.date AS entry_date, c.x AS exit_date FROM dec JOIN cal c ON c.pair = dec.pair AND c.d = dec.date)"""


@shared
def settle(t):
    from pyspark.sql import Window as W

    cal = sessions(t).select("pair", F.col("d").alias("date"), F.lead("d", 5).over(W.partitionBy("pair").orderBy("d")).alias("target_end"))
    return TR.settlement_outcomes(decisions(t).join(cal, ["pair", "date"]), panel(t), PAIRS)


@query(
    "tr2_settlement_outcomes",
    rec(DECISIONS) + SETTLE + ", " + legs_sql("sl", "sd", "settle_cents") + """
    SELECT s.pair, s.date, s.exit_date AS target_end, near_contract, far_contract, near_exit / near_entry - 1 AS near_return, far_exit / far_entry - 1 AS far_return,
      near_exit / near_entry - far_exit / far_entry AS spread_return, CASE WHEN near_exit IS NULL THEN 'UNAVAILABLE' ELSE 'OK' END AS close_status FROM sd s LEFT JOIN sl l ON l.pair = s.pair AND l.date = s.date""",
    d="near_return far_return spread_return",
)
def _(t):
    return settle(t).select("pair", "date", "target_end", "near_contract", "far_contract", "near_return", "far_return", "spread_return", "close_status")


@query(
    "tr3_trade_cost",
    "WITH " + PANEL + " SELECT root, contract, d, 2 * (2.5 + 1.0 * 12.5) / (open_cents * 50.0) AS rate FROM panel",
    d="rate",
)
def _(t):
    return panel(t).select("root", "contract", "d", TR.cost_rate("open_cents", 2.5, 1.0, 12.5, 5000.0).alias("rate"))


SLOPES = ", " + ELIG + """, two AS (SELECT a.root, a.d, a.contract AS near, b.settle_cents / a.settle_cents - 1 AS slope FROM elig a JOIN elig b ON a.root = b.root AND a.d = b.d AND a.rk = 1 AND b.rk = 2),
mk AS (SELECT p.pair, t.d, t.slope FROM prs p JOIN two t ON t.root = p.near)"""


@query(
    "tr4_decision_frame",
    rec(DECISIONS, exec_sql()) + SLOPES + """, u AS (SELECT pair, date, ratio, entry_date, exit_date, gross, cost FROM outc WHERE gross IS NOT NULL),
    l AS (SELECT * FROM u WHERE (pair, entry_date, date) IN (SELECT (pair, entry_date, max(date)) FROM u GROUP BY pair, entry_date))
    SELECT l.*, m.d AS market_data_through, m.slope FROM l ASOF LEFT JOIN mk m ON m.pair = l.pair AND l.date > m.d""",
    d="ratio gross cost slope",
)
def _(t):
    o = outcomes(t).filter("gross IS NOT NULL").select("pair", "date", "entry_date", "exit_date", "gross", "cost")
    feats = decisions(t).select("pair", "date", "ratio")
    curve = WN.curve(panel(t), ["root"], "d", "expiry", "contract", "settle_cents", 10).select("root", "d", "slope")
    near = F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(a).alias("_n")) for p, (a, _b) in PAIRS.items()])
    market = curve.select("root", "d", "slope", F.inline(near)).filter("root = _n").select("pair", "d", "slope")
    return TR.decision_frame(feats, o, market, ["pair"], "date", "d", ["slope"]).select(
        "pair", "date", "ratio", "entry_date", "exit_date", "gross", "cost", "market_data_through", "slope"
    )


BELT_OF = {"A": "AFRICA", "N": "AMERICA", "R": "ASIA"}


@query(
    "tr5_commodity_frame",
    rec(PANEL, BELT) + f""", mo AS (SELECT *, settle_cents / lag(settle_cents, 5) OVER (PARTITION BY root, contract ORDER BY d) - 1 AS mom5 FROM panel),
    e AS (SELECT *, row_number() OVER (PARTITION BY root, d ORDER BY expiry, contract) AS rk FROM mo WHERE {busday_sql('d', 'expiry')} > 10),
    ah AS (SELECT root, contract, d, lead(d) OVER w AS entry_date, lead(open_cents) OVER w AS entry_open, lead(d, 6) OVER w AS exit_date, lead(open_cents, 6) OVER w AS exit_open FROM panel WINDOW w AS (PARTITION BY root, contract ORDER BY d)),
    f AS (SELECT e.root, e.d, e.contract, e.mom5, a.entry_date, a.exit_date, a.exit_open / a.entry_open - 1 AS target, 2 * 15.0 / (a.entry_open * 50.0) AS cost_rate FROM e JOIN ah a ON a.root = e.root AND a.contract = e.contract AND a.d = e.d WHERE rk = 1 AND a.exit_date IS NOT NULL),
    w AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY root, CAST(date_trunc('week', d + 2) AS DATE) ORDER BY d DESC) = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY d) AS rn FROM w),
    r AS (SELECT root, d, rn, true AS keep, exit_date AS last FROM n WHERE rn = 1 UNION ALL SELECT n.root, n.d, n.rn, n.entry_date > r.last, CASE WHEN n.entry_date > r.last THEN n.exit_date ELSE r.last END FROM r JOIN n ON n.root = r.root AND n.rn = r.rn + 1),
    wx AS (SELECT CASE k WHEN 'AFRICA' THEN 'A' WHEN 'AMERICA' THEN 'N' ELSE 'R' END AS root, pub, max(d) AS weather_date, arg_max(rain, d) AS rain FROM belt WHERE k IN ('AFRICA', 'AMERICA', 'ASIA') GROUP BY 1, 2)
    SELECT w.*, x.weather_date, x.rain FROM (SELECT w.* FROM w JOIN r ON r.root = w.root AND r.d = w.d AND r.keep) w ASOF LEFT JOIN wx x ON x.root = w.root AND w.d >= x.pub""",
    d="mom5 target cost_rate rain",
)
def _(t):
    p = panel(t)
    mom = p.withColumn("mom5", WN.pct_change(["root", "contract"], "d", "settle_cents", 5))
    front = WN.front_contract(mom, ["root"], "d", "expiry", "contract", 10, ["mom5"]).drop("expiry")
    f = TR.contract_targets(front, p, ["root"], 5, lambda c: TR.cost_rate(c, 2.5, 1.0, 12.5, 5000.0))
    cols = ["contract", "mom5", "entry_date", "exit_date", "target", "cost_rate"]
    weekly = WN.last_of_period(f, ["root"], S.week_fri("d"), "d", cols).drop("period")
    kept = TK.no_overlap(weekly.withColumn("one", F.lit(1)), ["root"], "entry_date", "exit_date", "one", order=["d"]).filter("executed = 1").drop("one", "executed")
    of = F.create_map(*[F.lit(x) for r, b in BELT_OF.items() for x in (b, r)])
    wx = belt(t).filter(F.col("k").isin(*BELT_OF.values())).select(of[F.col("k")].alias("root"), "pub", F.col("d").alias("weather_date"), "rain")
    out = asof_join(kept, wx, ["root"], "d", "pub", ["weather_date", "rain"], ["weather_date"], grid=True)
    return out.select("root", "d", *cols, "weather_date", "rain")


@query(
    "tr6_align_predictions",
    rec(DECISIONS, exec_sql()) + """SELECT pair, date, CAST(signal AS BIGINT) AS raw_signal, CAST(executed AS BIGINT) AS signal, entry_date, exit_date, gross, cost, executed * gross - abs(executed) * 2.0 * cost AS net FROM outc WHERE gross IS NOT NULL""",
    d="gross cost net",
)
def _(t):
    o = outcomes(t, allow_overlap=True).filter("gross IS NOT NULL").select("pair", "date", "entry_date", "exit_date", "gross", "cost")
    return TR.align_predictions(decisions(t).select("pair", "date", "signal"), o, ["pair"], "date", 2.0).select(
        "pair", "date", "raw_signal", "signal", "entry_date", "exit_date", "gross", "cost", "net"
    )


@query(
    "tr7_waterfall",
    rec(DECISIONS, exec_sql()) + SETTLE + ", " + legs_sql("sl", "sd", "settle_cents") + """,
    st AS (SELECT o.pair, o.date, o.signal * (near_e - far_e) - abs(o.signal) * 0.001 AS settlement, o.signal * o.gross - abs(o.signal) * 0.001 AS next_open, o.executed * o.gross - abs(o.executed) * 0.001 AS no_overlap, o.net AS contract_cost
      FROM outc o JOIN (SELECT pair, date, near_exit / near_entry - 1 AS near_e, far_exit / far_entry - 1 AS far_e FROM sl) s ON s.pair = o.pair AND s.date = o.date WHERE o.gross IS NOT NULL),
    l AS (SELECT pair, 0 AS step, 'settlement' AS stage, sum(settlement) AS total_net, count(*) FILTER (settlement <> 0) AS trades FROM st GROUP BY 1
      UNION ALL SELECT pair, 1, 'next_open', sum(next_open), count(*) FILTER (next_open <> 0) FROM st GROUP BY 1 UNION ALL SELECT pair, 2, 'no_overlap', sum(no_overlap), count(*) FILTER (no_overlap <> 0) FROM st GROUP BY 1
      UNION ALL SELECT pair, 3, 'contract_cost', sum(contract_cost), count(*) FILTER (contract_cost <> 0) FROM st GROUP BY 1)
    SELECT pair, CAST(step AS BIGINT) AS step, stage, total_net, trades, total_net - lag(total_net) OVER (PARTITION BY pair ORDER BY step) AS increment FROM l""",
    d="total_net increment",
)
def _(t):
    o = outcomes(t).filter("gross IS NOT NULL").select("pair", "date", "signal", "executed", "gross", "net")
    s = settle(t).filter("close_status = 'OK'").select("pair", "date", "spread_return")
    sig, ex = F.col("signal"), F.col("executed")
    st = o.join(s, ["pair", "date"]).select(
        "pair", (sig * F.col("spread_return") - F.abs(sig) * 0.001).alias("settlement"), (sig * F.col("gross") - F.abs(sig) * 0.001).alias("next_open"),
        (ex * F.col("gross") - F.abs(ex) * 0.001).alias("no_overlap"), F.col("net").alias("contract_cost"),
    )
    return TR.waterfall(st, ["pair"], ["settlement", "next_open", "no_overlap", "contract_cost"])


@query(
    "tr8_sensitivity",
    rec(DECISIONS, exec_sql("_a", 5, 1.0), exec_sql("_b", 20, 1.0)) + """, u AS (SELECT 5 AS roll, pair, executed, gross, cost FROM outc_a UNION ALL SELECT 20, pair, executed, gross, cost FROM outc_b)
    SELECT pair, CAST(v.c AS DOUBLE) AS side_cost, sum(executed * gross - abs(executed) * cost * v.c) AS total_net, count(*) FILTER (executed <> 0) AS trades, CAST(roll AS BIGINT) AS roll FROM u, (VALUES (0.0), (5.0), (15.0)) v(c) GROUP BY pair, v.c, roll""",
    d="side_cost total_net",
)
def _(t):
    grid = [{"roll": r, "side_cost": c} for r in (5, 20) for c in (0.0, 5.0, 15.0)]
    return TR.sensitivity(decisions(t), panel(t), PAIRS, grid)
