"""Validation and uncertainty queries over a ledger of two simple rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import position
from tidemark.operators import folds as WF
from tidemark.operators import sets as SO
from tidemark.operators import topk as TK
from tidemark.operators import uncertainty as UN
from tidemark.operators import validate as VAL
from tidemark.operators import windows as WN

from .harvests import HARV, SETS, harvests
from .q_folds import DEC, RESID, WFRAME, frame
from .registry import query


def rec(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


GROSS = "greatest(least(target, 1.0), -1.0) / 20.0"


def overlap_sql(name: str, src: str, keys: str, raw: str) -> str:
    """Greedy overlap rule over `src` (keys, d, exit_date, raw) as CTE `name` with a `signal` column."""
    on = " AND ".join(f"n.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    ks = ", ".join(f"n.{k.strip()}" for k in keys.split(","))
    j = " AND ".join(f"s.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    return f"""{name}_n AS (SELECT {keys}, d, exit_date, {raw} AS raw, row_number() OVER (PARTITION BY {keys} ORDER BY d) AS rn FROM {src}),
{name}_r AS (SELECT {keys}, d, rn, raw AS signal, CASE WHEN raw <> 0 THEN exit_date END AS last FROM {name}_n WHERE rn = 1
  UNION ALL SELECT {ks}, n.d, n.rn, CASE WHEN n.raw <> 0 AND (r.last IS NULL OR n.d > r.last) THEN n.raw ELSE 0 END, CASE WHEN n.raw <> 0 AND (r.last IS NULL OR n.d > r.last) THEN n.exit_date ELSE r.last END FROM {name}_r r JOIN {name}_n n ON {on} AND n.rn = r.rn + 1),
{name} AS (SELECT s.*, r.signal, r.signal * s.gross - abs(r.signal) * s.cost AS net FROM {src} s JOIN {name}_r r ON {j} AND s.d = r.d)"""


def raw_sql(name: str = "raw", m5: str = "mom5", m20: str = "mom20") -> str:
    return f"""{name} AS (SELECT *, CASE WHEN score > 0.5 THEN 1 WHEN score < -0.5 THEN -1 ELSE 0 END AS raw_signal FROM (
  SELECT 'mom5' AS candidate, k, d, year, exit_date, {GROSS} AS gross, 0.001 AS cost, mom20 AS momentum, -{m5} AS score FROM wf WHERE {m5} IS NOT NULL
  UNION ALL SELECT 'mom20', k, d, year, exit_date, {GROSS}, 0.001, mom20, {m20} FROM wf WHERE {m20} IS NOT NULL))"""


LED = raw_sql() + ", " + overlap_sql("led", "raw", "candidate, k", "raw_signal")


def base_rows(t):
    x = frame(t)
    gross = F.greatest(F.least(F.col("target"), F.lit(1.0)), F.lit(-1.0)) / 20.0
    return x.withColumn("gross", gross).withColumn("cost", F.lit(0.001)).withColumn("momentum", F.col("mom20"))


def ledger(t, x=None):
    x = base_rows(t) if x is None else x
    s = SO.stack(
        {"mom5": x.withColumn("score", -F.col("mom5")).filter("mom5 IS NOT NULL"), "mom20": x.withColumn("score", F.col("mom20")).filter("mom20 IS NOT NULL")},
        "candidate",
    )
    s = s.withColumn("raw_signal", position("score", 0.5))
    run = TK.no_overlap(s, ["candidate", "k"], "d", "exit_date", "raw_signal", "signal")
    return run.withColumn("net", VAL.net_of("signal", "gross", "cost"))


def metrics_sql(name: str, src: str, keys: str, sharpe: str = "net", fold: str = "year") -> str:
    return f"""{name}_e AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY {keys} ORDER BY d ROWS UNBOUNDED PRECEDING)) AS eq FROM {src}),
{name}_d AS (SELECT *, eq / max(eq) OVER (PARTITION BY {keys} ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM {name}_e),
{name}_y AS (SELECT {keys}, count(*) FILTER (s > 0) AS positive_years, count(*) AS years FROM (SELECT {keys}, year, sum(net) AS s FROM {src} GROUP BY {keys}, year) GROUP BY {keys}),
{name}_f AS (SELECT {keys}, count(*) FILTER (s > 0) AS positive_folds, count(*) AS folds FROM (SELECT {keys}, {fold} AS f, sum(net) AS s FROM {src} GROUP BY {keys}, {fold}) GROUP BY {keys}),
{name} AS (SELECT {keys}, count(*) AS observations, count(*) FILTER (signal <> 0) AS trades, avg(CASE WHEN signal <> 0 THEN 1.0 ELSE 0.0 END) AS coverage,
  avg(CASE WHEN signal * gross > 0 THEN 1.0 ELSE 0.0 END) FILTER (signal <> 0) AS hit_rate, avg(net) FILTER (signal <> 0) AS mean_net_per_trade, sum(net) AS total_net,
  sqrt(52.0) * avg({sharpe}) / nullif(stddev_samp({sharpe}), 0) AS sharpe, min(dd) AS max_drawdown, sum(signal * gross - abs(signal) * 2.0 * cost) AS double_cost_net, sum(CASE WHEN year <> 1998 THEN net ELSE 0.0 END) AS net_ex_year,
  any_value(positive_folds) AS positive_folds, any_value(folds) AS folds, any_value(positive_years) AS positive_years, any_value(years) AS years
  FROM {name}_d JOIN {name}_y USING ({keys}) JOIN {name}_f USING ({keys}) GROUP BY {keys})"""


M_D = "coverage hit_rate mean_net_per_trade total_net sharpe max_drawdown double_cost_net net_ex_year"


def metrics(t, **kw):
    return VAL.strategy_metrics(ledger(t), ["candidate", "k"], ["d"], fold="year", ex_year=1998, **kw)


@query("val1_strategy_metrics", rec(WFRAME, LED, metrics_sql("m", "led", "candidate, k")) + "SELECT * FROM m", d=M_D)
def _(t):
    return metrics(t)


@query(
    "val1_metrics_traded_rows",
    rec(WFRAME, LED, metrics_sql("m", "led", "candidate, k", "CASE WHEN signal <> 0 THEN net END")) + "SELECT candidate, k, trades, sharpe FROM m",
    d="sharpe",
)
def _(t):
    return metrics(t, sharpe_rows="traded").select("candidate", "k", "trades", "sharpe")


YF = f"""yf AS (SELECT k, d, year, exit_date, {GROSS} AS gross, 0.001 AS cost, mom20 AS momentum, CAST(f AS BIGINT) AS fold, CASE WHEN year < f THEN 'train' ELSE 'test' END AS role FROM wf, (VALUES (1996), (1997), (1998), (1999), (2000)) v(f) WHERE year <= f),
tm AS (SELECT k, fold, avg(gross) AS m, median(cost) AS c FROM yf WHERE role = 'train' GROUP BY 1, 2),
ts AS (SELECT k, fold, month(d) AS mo, avg(gross) AS s FROM yf WHERE role = 'train' GROUP BY 1, 2, 3),
te AS (SELECT y.*, m, c, coalesce(s, m) AS s FROM yf y JOIN tm USING (k, fold) LEFT JOIN ts ON ts.k = y.k AND ts.fold = y.fold AND ts.mo = month(y.d) WHERE role = 'test'),
rl AS (SELECT k, d, year, exit_date, gross, cost, momentum, fold, rule, CAST(CASE rule WHEN 'no_trade' THEN 0 WHEN 'long_only' THEN 1 WHEN 'short_only' THEN -1 WHEN 'momentum' THEN sign(momentum) WHEN 'mean_reversion' THEN -sign(momentum)
  WHEN 'trailing_mean' THEN CASE WHEN m > c THEN 1 WHEN m < -c THEN -1 ELSE 0 END ELSE CASE WHEN s > c THEN 1 WHEN s < -c THEN -1 ELSE 0 END END AS INTEGER) AS raw_signal
  FROM te, (VALUES ('no_trade'), ('long_only'), ('short_only'), ('momentum'), ('mean_reversion'), ('trailing_mean'), ('seasonal_mean')) v(rule))"""


def rule_rows(t):
    f = WF.year_folds(base_rows(t), "year", (1996, 1997, 1998, 1999, 2000), 1995)
    sig = VAL.rule_signals(f, ["k"], "fold", "d", "gross", "cost", "momentum")
    return VAL.rule_ledger(sig, ["k", "fold"], "d", "exit_date", "gross", "cost")


@query(
    "val2_rule_baselines",
    rec(WFRAME, YF, overlap_sql("rled", "rl", "k, fold, rule", "raw_signal")) + "SELECT k, fold, rule, count(*) AS observations, count(*) FILTER (signal <> 0) AS trades, sum(net) AS total_net FROM rled GROUP BY 1, 2, 3",
    d="total_net",
)
def _(t):
    return rule_rows(t).groupBy("k", "fold", "rule").agg(
        F.count(F.lit(1)).alias("observations"), F.sum((F.col("signal") != 0).cast("long")).alias("trades"), F.sum("net").alias("total_net")
    )


@query(
    "val2_best_rule",
    rec(WFRAME, YF, overlap_sql("rled", "rl", "k, fold, rule", "raw_signal"), metrics_sql("m", "rled", "k, rule", fold="fold")) + """
    SELECT k, rule, sharpe, total_net FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY sharpe DESC NULLS LAST, total_net DESC, rule) = 1""",
    d="sharpe total_net",
)
def _(t):
    m = VAL.strategy_metrics(rule_rows(t), ["k", "rule"], ["d"], fold="fold")
    return VAL.best_rule(m, ["k"])


@query(
    "val3_headline",
    rec(WFRAME, LED) + ", sel AS (SELECT * FROM led WHERE year IN (1998, 1999)), " + metrics_sql("m", "sel", "candidate, k") + """
    SELECT k, candidate, sharpe, total_net FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY sharpe DESC NULLS LAST, total_net DESC, candidate) = 1""",
    d="sharpe total_net",
)
def _(t):
    return VAL.headline(ledger(t), ["k"], "candidate", ["d"], (1998, 1999), fold="year")


SHIFTED = """, wsh AS (SELECT k, d, year, exit_date, target, mom20, lag(mom5) OVER w AS later, lead(mom5) OVER w AS earlier FROM wf WINDOW w AS (PARTITION BY k, year ORDER BY d))"""


def total_sql(name: str, col: str, src: str) -> str:
    r = f"""{name}_raw AS (SELECT k, d, year, exit_date, {GROSS} AS gross, 0.001 AS cost, CASE WHEN {col} > 0.5 THEN 1 WHEN {col} < -0.5 THEN -1 ELSE 0 END AS raw_signal FROM {src} WHERE {col} IS NOT NULL)"""
    return r + ", " + overlap_sql(f"{name}_led", f"{name}_raw", "k", "raw_signal") + f", {name} AS (SELECT k, sum(net) AS total_net FROM {name}_led GROUP BY 1)"


@query(
    "val4_placebo_checks",
    rec(WFRAME) + SHIFTED + ", " + ", ".join([total_sql("hd", "-mom5", "wf"), total_sql("lt", "-later", "wsh"), total_sql("er", "-earlier", "wsh"), total_sql("mk", "mom20", "wf")]) + """
    SELECT hd.k, hd.total_net AS headline_net, lt.total_net AS later_net, hd.total_net > lt.total_net AS beats_later, er.total_net AS earlier_net, hd.total_net > er.total_net AS beats_earlier,
      mk.total_net AS market_net, hd.total_net > mk.total_net AS beats_market FROM hd LEFT JOIN lt USING (k) LEFT JOIN er USING (k) LEFT JOIN mk USING (k)""",
    d="headline_net later_net earlier_net market_net",
)
def _(t):
    x = base_rows(t)

    def total(rows, score):
        r = rows.withColumn("score", score).filter("score IS NOT NULL").withColumn("raw_signal", position("score", 0.5))
        run = TK.no_overlap(r, ["k"], "d", "exit_date", "raw_signal", "signal")
        return run.groupBy("k").agg(F.sum(VAL.net_of("signal", "gross", "cost")).alias("total_net"))

    later = x.withColumn("s", WN.shift_within(["k", "year"], "d", "mom5", 1))
    earlier = x.withColumn("s", WN.shift_within(["k", "year"], "d", "mom5", -1))
    return VAL.placebo_checks(
        total(x, -F.col("mom5")), {"later": total(later, -F.col("s")), "earlier": total(earlier, -F.col("s")), "market": total(x, F.col("mom20"))}, ["k"]
    )


def boot_sql(name: str, src: str, keys: str, block: str, value: str, draws: int, seed: int, mean: bool = False) -> str:
    return f"""{name}_b AS (SELECT {keys}, list(s ORDER BY b) AS a FROM (SELECT {keys}, {block} AS b, sum({value}) AS s FROM {src} GROUP BY {keys}, {block}) GROUP BY {keys}),
{name}_t AS (SELECT {keys}, draw, list_sum(list_transform(generate_series(1, len(a)), lambda s: a[1 + CAST('0x' || substr(md5('{seed}:' || CAST(draw AS VARCHAR) || ':' || CAST(s AS VARCHAR)), 1, 8) AS BIGINT) % len(a)])){' / len(a)' if mean else ''} AS v
  FROM {name}_b, generate_series(1, {draws}) g(draw)),
{name} AS (SELECT {keys}, count(*) AS draws, quantile_cont(v, 0.025) AS p025, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.975) AS p975, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) AS probability_positive FROM {name}_t GROUP BY {keys})"""


def bootstrap(t, led=None):
    return UN.block_bootstrap(ledger(t) if led is None else led, ["candidate", "k"], "year", "net", 5000, 590)


@query("un1_block_bootstrap", rec(WFRAME, LED, boot_sql("bs", "led", "candidate, k", "year", "net", 5000, 590)) + "SELECT * FROM bs", d="p025 median p975 probability_positive")
def _(t):
    return bootstrap(t)


CHECKS = {
    "at least 30 trades": "trades >= 30", "positive net": "total_net > 0", "Sharpe above 0.50": "sharpe > 0.5", "positive in 60% of folds": "positive_folds >= ceil(0.6 * folds)",
    "positive at doubled costs": "double_cost_net > 0", "drawdown no worse than -25%": "max_drawdown > -0.25", "bootstrap probability at least 80%": "probability_positive >= 0.8",
}


def gate_sql() -> str:
    cells = ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in CHECKS.items())
    return f"""g AS (SELECT candidate, k, list_filter([{cells}], lambda x: x IS NOT NULL) AS f FROM m JOIN bs USING (candidate, k))
    SELECT candidate, k, len(f) = 0 AS passed, len(f) AS n_failed, array_to_string(f, '; ') AS failures FROM g"""


@query(
    "val5_gate",
    rec(WFRAME, LED, metrics_sql("m", "led", "candidate, k"), boot_sql("bs", "led", "candidate, k", "year", "net", 5000, 590)) + ", " + gate_sql(),
)
def _(t):
    led = ledger(t)
    m = VAL.strategy_metrics(led, ["candidate", "k"], ["d"], fold="year", ex_year=1998).join(bootstrap(t, led), ["candidate", "k"])
    return VAL.gate(m, ["candidate", "k"], {n: F.expr(c) for n, c in CHECKS.items()})


@query(
    "val6_holdout",
    rec(WFRAME) + f""", h AS (SELECT k, d, year, exit_date, {GROSS} AS gross, 0.001 AS cost, mom5, mom20 FROM wf),
    rm AS (SELECT k, avg(gross) AS my, avg(mom5) AS m0, avg(mom20) AS m1, var_pop(mom5) * (1 + 10.0 / count(*)) AS a0, var_pop(mom20) * (1 + 10.0 / count(*)) AS a1, covar_pop(mom5, mom20) AS x, covar_pop(mom5, gross) AS c0, covar_pop(mom20, gross) AS c1 FROM h WHERE year < 2001 GROUP BY 1),
    hs AS (SELECT h.*, my + (c0 * a1 - c1 * x) / (a0 * a1 - x * x) * (mom5 - m0) + (c1 * a0 - c0 * x) / (a0 * a1 - x * x) * (mom20 - m1) AS score FROM h JOIN rm USING (k) WHERE year = 2001),
    hr AS (SELECT *, CASE WHEN score > 0.002 THEN 1 WHEN score < -0.002 THEN -1 ELSE 0 END AS raw_signal FROM hs), """ + overlap_sql("hl", "hr", "k", "raw_signal") + """
    SELECT k, count(*) AS observations, count(*) FILTER (signal <> 0) AS trades, sum(net) AS total_net FROM hl GROUP BY 1""",
    d="total_net",
)
def _(t):
    """Trained on every year before the sealed one, which is scored once with a fixed threshold."""
    x = base_rows(t).withColumn("role", F.when(F.col("year") < 2001, "train").otherwise("test"))
    f = WF.fit_ridge(x, ["k"], "gross", ["mom5", "mom20"], 10.0).filter("role = 'test'")
    run = TK.no_overlap(f.withColumn("raw_signal", position("score", 0.002)), ["k"], "d", "exit_date", "raw_signal", "signal")
    run = run.withColumn("net", VAL.net_of("signal", "gross", "cost"))
    return run.groupBy("k").agg(
        F.count(F.lit(1)).alias("observations"), F.sum((F.col("signal") != 0).cast("long")).alias("trades"), F.sum("net").alias("total_net")
    )


DIMS = {
    "year": "CAST(year AS VARCHAR)", "direction": "CASE signal WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE 'HOLD' END",
    "season": "CASE WHEN month(d) BETWEEN 4 AND 5 THEN 'early' WHEN month(d) BETWEEN 6 AND 7 THEN 'mid' WHEN month(d) BETWEEN 8 AND 10 THEN 'late' END",
    "market_regime": "CASE WHEN momentum > 0 THEN 'positive momentum' WHEN momentum < 0 THEN 'negative momentum' ELSE 'flat' END",
}
STRATA_U = " UNION ALL ".join(f"SELECT candidate, k, '{n}' AS dimension, {e} AS bucket, net, gross, signal FROM led" for n, e in DIMS.items())


@query(
    "val7_strata",
    rec(WFRAME, LED) + f""", u AS ({STRATA_U})
    SELECT candidate, k, dimension, bucket, count(*) AS observations, count(*) FILTER (signal <> 0) AS trades, avg(CASE WHEN signal * gross > 0 THEN 1.0 ELSE 0.0 END) FILTER (signal <> 0) AS hit_rate, sum(net) AS total_net, avg(net) FILTER (signal <> 0) AS mean_net_per_trade
    FROM u WHERE bucket IS NOT NULL GROUP BY 1, 2, 3, 4""",
    d="hit_rate total_net mean_net_per_trade",
)
def _(t):
    m, sig = F.month("d"), F.col("signal")
    dims = {
        "year": F.col("year"), "direction": F.when(sig == 1, "BUY").when(sig == -1, "SELL").otherwise("HOLD"),
        "season": F.when(m.between(4, 5), "early").when(m.between(6, 7), "mid").when(m.between(8, 10), "late"),
        "market_regime": F.when(F.col("momentum") > 0, "positive momentum").when(F.col("momentum") < 0, "negative momentum").otherwise("flat"),
    }
    return VAL.strata(ledger(t), ["candidate", "k"], dims)


@query(
    "un2_row_bootstrap",
    rec(HARV, RESID) + DEC + """, pv AS (SELECT k, feature_set, ratio, h, max(cost) FILTER (strategy = 'climatology') - max(cost) FILTER (strategy = 'model') AS diff FROM dec GROUP BY 1, 2, 3, 4),
    c AS (SELECT k, feature_set, ratio, count(*) AS harvests, avg(diff) AS mean_saving, count(*) FILTER (diff > 1e-12) AS improved, count(*) FILTER (diff < -1e-12) AS worsened FROM pv GROUP BY 1, 2, 3), """
    + boot_sql("bs", "pv", "k, feature_set, ratio", "h", "diff", 2000, 77, True) + "SELECT * FROM c JOIN bs USING (k, feature_set, ratio)",
    d="ratio mean_saving p025 median p975 probability_positive",
)
def _(t):
    d = WF.decide(WF.fold_residuals(harvests(t), ["k"], "h", "yield", SETS, 8), ["k", "h", "feature_set"], (2.0, 4.0, 8.0))
    pv = d.groupBy("k", "feature_set", "ratio", "h").agg(
        F.max(F.when(F.col("strategy") == "climatology", F.col("cost"))).alias("base"), F.max(F.when(F.col("strategy") == "model", F.col("cost"))).alias("model")
    )
    return UN.row_bootstrap(pv, ["k", "feature_set", "ratio"], "h", "base", "model", 2000, 77)


@query(
    "un3_coef_bootstrap",
    rec(HARV) + """, a AS (SELECT k, list(h ORDER BY h) AS hs, count(*) AS n FROM harv GROUP BY 1),
    i AS (SELECT k, draw, hs[1 + CAST('0x' || substr(md5('31:' || CAST(draw AS VARCHAR) || ':' || CAST(s AS VARCHAR)), 1, 8) AS BIGINT) % n] AS h FROM a, generate_series(1, 2000) g(draw), generate_series(1, 27) x(s) WHERE s <= n),
    m AS (SELECT i.k, draw, var_pop(heat) AS s00, var_pop(rain) AS s11, covar_pop(heat, rain) AS s01, covar_pop(heat, yield) AS c0, covar_pop(rain, yield) AS c1 FROM i JOIN harv ON harv.k = i.k AND harv.h = i.h GROUP BY 1, 2 HAVING count(DISTINCT i.h) >= 4),
    v AS (SELECT k, (c0 * s11 - c1 * s01) / (s00 * s11 - s01 * s01) AS v FROM m)
    SELECT k, count(*) AS draws, quantile_cont(v, 0.025) AS p025, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.975) AS p975, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) AS probability_positive FROM v GROUP BY 1""",
    d="p025 median p975 probability_positive",
)
def _(t):
    return UN.coef_bootstrap(harvests(t), ["k"], "h", "yield", ["heat", "rain"], 2000, 31)


# For every roll of a year, from its last row back: what the rest of the year earns and its last exit, if trading
# is free from that row on. A draw then chains its years.
CIRC = """, cy AS (SELECT candidate, k, year, list(d ORDER BY d) AS e, list(exit_date ORDER BY d) AS x, list(gross ORDER BY d) AS g, list(cost ORDER BY d) AS c, list(raw_signal ORDER BY d) AS s, count(*) AS n,
    row_number() OVER (PARTITION BY candidate, k ORDER BY year) AS y FROM raw GROUP BY candidate, k, year),
cf AS (SELECT *, list_transform(x, lambda v: len(list_filter(e, lambda w: w <= v))) AS f FROM cy),
dp(candidate, k, y, o, i, rest, outs) AS (
  SELECT candidate, k, y, unnest(range(n)), n, [0.0::DOUBLE], [NULL::DATE] FROM cf
  UNION ALL
  SELECT dp.candidate, dp.k, dp.y, o, i - 1,
    list_prepend(CASE WHEN s[(i - 1 - o + n) % n + 1] <> 0 THEN s[(i - 1 - o + n) % n + 1] * g[i] - abs(s[(i - 1 - o + n) % n + 1]) * c[i] + rest[f[i] - i + 1] ELSE rest[1] END, rest),
    list_prepend(CASE WHEN s[(i - 1 - o + n) % n + 1] <> 0 THEN coalesce(outs[f[i] - i + 1], x[i]) ELSE outs[1] END, outs)
  FROM dp JOIN cf ON cf.candidate = dp.candidate AND cf.k = dp.k AND cf.y = dp.y WHERE i > 0),
dd AS (SELECT * FROM dp WHERE i = 0),
ch(candidate, k, draw, y, last, total) AS (
  SELECT candidate, k, draw, CAST(1 AS BIGINT), NULL::DATE, 0.0::DOUBLE FROM (SELECT DISTINCT candidate, k FROM cf), generate_series(1, 5000) g(draw)
  UNION ALL
  SELECT ch.candidate, ch.k, draw, ch.y + 1, coalesce(outs[p], last), total + rest[p]
  FROM (SELECT ch.*, cf.n, CAST('0x' || substr(md5('590:' || CAST(draw AS VARCHAR) || ':' || CAST(cf.year AS VARCHAR)), 1, 8) AS BIGINT) % cf.n AS off,
      CASE WHEN last IS NULL THEN 1 ELSE len(list_filter(e, lambda w: w <= last)) + 1 END AS p
    FROM ch JOIN cf ON cf.candidate = ch.candidate AND cf.k = ch.k AND cf.y = ch.y) ch
  JOIN dd ON dd.candidate = ch.candidate AND dd.k = ch.k AND dd.y = ch.y AND dd.o = ch.off),
cn AS (SELECT candidate, k, draw, arg_max(total, y) AS total FROM ch GROUP BY 1, 2, 3)"""


def shift_null(t, led):
    return UN.circular_null(led, ["candidate", "k"], "d", "year", "raw_signal", "d", "exit_date", "gross", "cost", 5000, 590)


@query("un4_circular_null", rec(WFRAME, raw_sql()) + CIRC + " SELECT * FROM cn", d="total")
def _(t):
    return shift_null(t, ledger(t))


@query(
    "un4_null_p_value",
    rec(WFRAME, LED) + CIRC + """, ob AS (SELECT candidate, k, sum(net) AS observed FROM led GROUP BY 1, 2)
    SELECT candidate, k, observed, count(*) AS draws, (1 + count(*) FILTER (total >= observed)) / CAST(count(*) + 1 AS DOUBLE) AS p_value FROM cn JOIN ob USING (candidate, k) GROUP BY 1, 2, 3""",
    d="observed p_value",
)
def _(t):
    led = ledger(t)
    ob = led.groupBy("candidate", "k").agg(F.sum("net").alias("observed"))
    return UN.null_p(ob, shift_null(t, led), ["candidate", "k"], "observed", "total")


@query(
    "val5_cost_stress",
    rec(WFRAME, LED) + "SELECT candidate, k, sum(signal * gross - abs(signal) * cost) AS net_x1, sum(signal * gross - abs(signal) * 2 * cost) AS net_x2, sum(signal * gross - abs(signal) * 3 * cost) AS net_x3 FROM led GROUP BY 1, 2",
    d="net_x1 net_x2 net_x3",
)
def _(t):
    return VAL.cost_stress(ledger(t), ["candidate", "k"], (1.0, 2.0, 3.0))


@query(
    "val1_prediction_r2",
    rec(WFRAME) + f""", h AS (SELECT k, year, {GROSS} AS gross, -mom5 / 100.0 AS score, avg({GROSS}) FILTER (year < 1998) OVER (PARTITION BY k) AS base FROM wf)
    SELECT k, 1 - sum((gross - score) * (gross - score)) / sum((gross - base) * (gross - base)) AS r2 FROM h WHERE year >= 1998 GROUP BY 1""",
    d="r2",
)
def _(t):
    x = base_rows(t)
    base = x.filter("year < 1998").groupBy("k").agg(F.avg("gross").alias("base"))
    rows = x.filter("year >= 1998").join(base, "k").withColumn("score", -F.col("mom5") / 100.0)
    return VAL.prediction_r2(rows, ["k"], "gross", "score", "base")
