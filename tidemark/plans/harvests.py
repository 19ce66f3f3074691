"""Harvest tables and refit SQL shared by the statistics and fold queries.

The driver tables span seven calendar years, so a quarter stands for a harvest: `h` counts
quarters from 1995 and gives 27 harvests per belt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BELT, ORDK, belt, cents, ordk
from .registry import Tables, shared

H = "CAST((year(d) - 1995) * 4 + quarter(d) AS BIGINT)"

HARV = BELT + ", " + ORDK + f""", hw AS (
  SELECT k, {H} AS h, avg(greatest(tmax - 29.0, 0.0)) AS heat, avg(rain) AS rain, max(tmax) AS peak FROM belt GROUP BY 1, 2),
hy AS (SELECT k, {H} AS h, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS DOUBLE) / (100000.0 * count(*)) AS yield FROM ordk GROUP BY 1, 2),
harv AS (SELECT k, h, heat, rain, peak, yield FROM hw JOIN hy USING (k, h))"""


def harvest(c: str = "d") -> F.Column:
    return ((F.year(c) - 1995) * 4 + F.quarter(c)).cast("long")


@shared
def harvests(t: Tables) -> DataFrame:
    """(k, h, heat, rain, peak, yield): one row per belt and harvest."""
    hot = F.greatest(F.col("tmax") - 29.0, F.lit(0.0))
    w = belt(t).groupBy("k", harvest().alias("h")).agg(F.avg(hot).alias("heat"), F.avg("rain").alias("rain"), F.max("tmax").alias("peak"))
    y = ordk(t).groupBy("k", harvest().alias("h")).agg(
        (F.sum(cents("price")).cast("double") / (F.lit(100000.0) * F.count(F.lit(1)))).alias("yield")
    )
    return w.join(y, ["k", "h"])


SETS = {"heat": ["heat"], "weather": ["heat", "rain"]}


def refit_sql(name: str, src: str, fold: str, min_train: int, alpha: float = 1.0) -> str:
    """Trend, one- and two-feature standardised ridge per fold of `src` (k, h, heat, rain, yield, role, fold columns)."""
    tr = "FILTER (role = 'train')"
    return f"""{name}_tr AS (SELECT {fold}, regr_slope(yield, h) {tr} AS b, regr_intercept(yield, h) {tr} AS a, count(*) {tr} AS n, min(h) {tr} AS f, max(h) {tr} AS l FROM {src} GROUP BY {fold}),
{name}_t AS (SELECT s.*, a + b * h AS trend, yield / (a + b * h) - 1 AS anom, n, f, l FROM {src} s JOIN {name}_tr USING ({fold})),
{name}_m AS (SELECT {fold}, avg(anom) {tr} AS my, avg(heat) {tr} AS m0, avg(rain) {tr} AS m1, var_pop(heat) {tr} * (1 + {alpha} / any_value(n)) AS a0, var_pop(rain) {tr} * (1 + {alpha} / any_value(n)) AS a1,
  covar_pop(heat, rain) {tr} AS x, covar_pop(heat, anom) {tr} AS c0, covar_pop(rain, anom) {tr} AS c1 FROM {name}_t GROUP BY {fold}),
{name}_w AS (SELECT t.*, my + CASE WHEN a0 > 0 THEN c0 / a0 ELSE 0.0 END * (heat - m0) AS p_heat,
  my + (c0 * a1 - c1 * x) / nullif(a0 * a1 - x * x, 0) * (heat - m0) + (c1 * a0 - c0 * x) / nullif(a0 * a1 - x * x, 0) * (rain - m1) AS p_weather
  FROM {name}_t t JOIN {name}_m USING ({fold}) WHERE role <> 'train' AND n >= {min_train}),
{name} AS (SELECT {fold}, h, role, 'trend_only' AS feature_set, n AS train_years, f AS train_start, l AS train_end, yield AS actual, trend, anom AS actual_anomaly, 0.0 AS predicted_anomaly, trend AS predicted FROM {name}_w
  UNION ALL SELECT {fold}, h, role, 'heat', n, f, l, yield, trend, anom, p_heat, trend * (1 + p_heat) FROM {name}_w
  UNION ALL SELECT {fold}, h, role, 'weather', n, f, l, yield, trend, anom, p_weather, trend * (1 + p_weather) FROM {name}_w)"""


EXPAND = "xp AS (SELECT a.h AS fold, b.*, CASE WHEN a.h = b.h THEN 'test' ELSE 'train' END AS role FROM harv a JOIN harv b ON a.k = b.k AND b.h <= a.h)"
PRED = EXPAND + ", " + refit_sql("pred", "xp", "k, fold", 8)
