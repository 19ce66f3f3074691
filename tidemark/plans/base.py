"""Series derived from the driver tables that many queries start from.

Each Spark frame has a SQL twin with the same meaning. Prices are averaged in whole
cents, so both engines add integers and agree exactly whatever the row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables, shared


def whole(x) -> F.Column:
    """Nearest whole number of a non-negative value, without Spark's decimal-based round."""
    return F.floor(x + F.lit(0.5)).cast("long")


def cents(c: str) -> F.Column:
    return whole(F.col(c) * 100)


def mean_cents(x) -> F.Column:
    """Mean of whole cents, back in units."""
    return F.sum(x).cast("double") / (F.lit(100.0) * F.count(F.lit(1)))


def mean(c: str) -> F.Column:
    """Mean without the last bits, which depend on the order rows were added in.

    Thresholds are applied to these means; without this a value exactly on a threshold
    could fall on either side of it from run to run.
    """
    return F.round(F.avg(c), 9).alias(c)


# ------------------------------------------------------------------ daily series

DAILY = """daily AS (
  SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS d,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (100.0 * count(*)) AS px,
         count(*) AS n
  FROM orders GROUP BY 1, 2)"""


@shared
def daily(t: Tables) -> DataFrame:
    """(k, d, px, n): mean order price per priority and day; at most one row per calendar day."""
    return (
        t.orders.select(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").cast("date").alias("d"), "o_totalprice")
        .groupBy("k", "d").agg(mean_cents(cents("o_totalprice")).alias("px"), F.count(F.lit(1)).alias("n"))
    )


# ------------------------------------------------------------------ point weather

OBS = """obs AS (
  SELECT r_name AS belt, n_name AS state, l_suppkey AS point, CAST(l_shipdate AS DATE) AS d,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS tmax,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) AS tmin,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS rain,
         CAST(l_shipdate AS DATE) + CAST(2 + n_nationkey % 3 AS INTEGER) AS pub
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY r_name, n_name, n_nationkey, l_suppkey, CAST(l_shipdate AS DATE))"""


@shared
def places(t: Tables) -> DataFrame:
    """(point, state, belt, lag): supplier -> nation -> region."""
    return t.supplier.join(F.broadcast(states(t)), "s_nationkey").select(
        F.col("s_suppkey").alias("point"), "state", "belt", "lag"
    )


@shared
def small_places(t: Tables) -> DataFrame:
    return places(t)


@shared
def states(t: Tables) -> DataFrame:
    """The 25 nations with their region: fixed size whatever the scale."""
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("state"), F.col("r_name").alias("belt"),
        (F.lit(2) + F.col("n_nationkey") % 3).alias("lag"),
    )


@shared
def obs(t: Tables) -> DataFrame:
    """(belt, state, point, d, tmax, tmin, rain, pub): one row per point and day.

    Rows are folded to (point, day) before the geography is joined on.
    """
    n = F.count(F.lit(1))
    days = (
        t.lineitem.select(
            F.col("l_suppkey").alias("point"), F.col("l_shipdate").cast("date").alias("d"),
            "l_quantity", "l_tax", "l_discount",
        )
        .groupBy("point", "d")
        .agg(
            (F.sum(F.col("l_quantity").cast("long")).cast("double") / n).alias("tmax"),
            (F.sum(cents("l_tax")).cast("double") / n).alias("tmin"),
            (F.sum(cents("l_discount")).cast("double") / n).alias("rain"),
        )
    )
    return days.join(small_places(t), "point").select(
        "belt", "state", "point", "d", "tmax", "tmin", "rain", F.expr("date_add(d, lag)").alias("pub")
    )


BELT = """belt_state AS (
  SELECT r_name AS belt, n_name AS state, CAST(l_shipdate AS DATE) AS d,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS tmax,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) AS tmin,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS rain,
         CAST(l_shipdate AS DATE) + CAST(2 + n_nationkey % 3 AS INTEGER) AS pub
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY r_name, n_name, n_nationkey, CAST(l_shipdate AS DATE)),
belt AS (
  SELECT belt AS k, d, round(avg(tmax), 9) AS tmax, round(avg(tmin), 9) AS tmin, round(avg(rain), 9) AS rain,
         max(pub) AS pub, count(*) AS states
  FROM belt_state GROUP BY belt, d)"""


@shared
def belt_state(t: Tables) -> DataFrame:
    """(belt, state, d, tmax, tmin, rain, pub): whole readings added up per state and day."""
    n = F.count(F.lit(1))
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("point"), F.col("l_shipdate").cast("date").alias("d"), "l_quantity", "l_tax", "l_discount"
    ).join(small_places(t), "point")
    return rows.groupBy("belt", "state", "lag", "d").agg(
        (F.sum(F.col("l_quantity").cast("long")).cast("double") / n).alias("tmax"),
        (F.sum(cents("l_tax")).cast("double") / n).alias("tmin"),
        (F.sum(cents("l_discount")).cast("double") / n).alias("rain"),
    ).select("belt", "state", "d", "tmax", "tmin", "rain", F.expr("date_add(d, lag)").alias("pub"))


@shared
def belt(t: Tables) -> DataFrame:
    """(k, d, tmax, tmin, rain, pub, states): states -> belt, one row per belt and day."""
    return belt_state(t).groupBy(F.col("belt").alias("k"), "d").agg(
        mean("tmax"), mean("tmin"), mean("rain"),
        F.max("pub").alias("pub"), F.count(F.lit(1)).alias("states"),
    )


# ------------------------------------------------------------------ orders by home belt

ORDK = """ordk AS (
  SELECT o_orderkey, r_name AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS price, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
grid AS (
  SELECT k, d, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS DOUBLE) / (100.0 * count(*)) AS px FROM ordk GROUP BY 1, 2)"""


@shared
def homes(t: Tables) -> DataFrame:
    named = t.customer.withColumnRenamed("c_nationkey", "s_nationkey").join(F.broadcast(states(t)), "s_nationkey")
    return named.select(F.col("c_custkey").alias("o_custkey"), F.col("belt").alias("k"))


@shared
def ordk(t: Tables) -> DataFrame:
    """(o_orderkey, k, d, price, priority): every order with the belt of its customer."""
    return t.orders.join(homes(t), "o_custkey").select(
        "o_orderkey", "k", F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"),
    )


@shared
def grid(t: Tables) -> DataFrame:
    """(k, d, px): decision days, one row per belt and day."""
    return ordk(t).groupBy("k", "d").agg(mean_cents(cents("price")).alias("px"))


# ------------------------------------------------------------------ contract strip

PANEL = """panel AS (
  SELECT root, contract, expiry, d,
    CAST(sum(cents) AS DOUBLE) / count(*) AS open_cents, CAST(max(cents) AS DOUBLE) AS high_cents,
    CAST(min(cents) AS DOUBLE) AS low_cents, CAST(sum(net) AS DOUBLE) / count(*) AS settle_cents,
    CAST(sum(qty) AS BIGINT) AS volume, count(*) AS oi
  FROM (
    SELECT root, d, cents, net, qty, expiry,
           root || substr('FGHJKMNQUVXZ', CAST(month(expiry) AS INTEGER), 1) || right(CAST(year(expiry) AS VARCHAR), 2) AS contract
    FROM (
      SELECT l_returnflag AS root, CAST(l_shipdate AS DATE) AS d,
        CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) AS cents,
        CAST(round(l_extendedprice * (1 - l_discount) * 100 / l_quantity) AS BIGINT) AS net,
        CAST(l_quantity AS BIGINT) AS qty,
        CASE WHEN CAST(l_shipdate AS DATE) <= make_date(CAST(year(l_shipdate) AS INTEGER), l_linenumber + 5, 14)
             THEN make_date(CAST(year(l_shipdate) AS INTEGER), l_linenumber + 5, 14)
             ELSE make_date(CAST(year(l_shipdate) AS INTEGER) + 1, l_linenumber + 5, 14) END AS expiry
      FROM lineitem) a) b
  GROUP BY root, contract, expiry, d)"""


@shared
def panel(t: Tables) -> DataFrame:
    """(root, contract, expiry, d, open/high/low/settle cents, volume, oi).

    A dated strip: seven contracts per root trade on any day, expiring on the 14th of
    June to December; one row per root, contract and session.
    """
    d = F.col("l_shipdate").cast("date")
    this = F.make_date(F.year(d), F.col("l_linenumber") + 5, F.lit(14))
    nxt = F.make_date(F.year(d) + 1, F.col("l_linenumber") + 5, F.lit(14))
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("root"), d.alias("d"),
        whole(F.col("l_extendedprice") * 100 / F.col("l_quantity")).alias("cents"),
        whole(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 / F.col("l_quantity")).alias("net"),
        F.col("l_quantity").cast("long").alias("qty"),
        F.when(d <= this, this).otherwise(nxt).alias("expiry"),
    )
    code = F.concat(
        "root", F.substring(F.lit("FGHJKMNQUVXZ"), F.month("expiry"), F.lit(1)), F.date_format("expiry", "yy")
    )
    n = F.count(F.lit(1))
    return (
        rows.groupBy("root", code.alias("contract"), "expiry", "d")
        .agg(
            (F.sum("cents").cast("double") / n).alias("open_cents"), F.max("cents").cast("double").alias("high_cents"),
            F.min("cents").cast("double").alias("low_cents"), (F.sum("net").cast("double") / n).alias("settle_cents"),
            F.sum("qty").alias("volume"), n.alias("oi"),
        )
    )


# ------------------------------------------------------------------ fetch log

LOG = """log AS (
  SELECT event_type AS source, CAST(user_id AS VARCHAR) AS key, event_id AS pos, ts AS fetched_at,
         props AS body, sha256(props) AS sha, length(props) AS n_bytes, CAST(ts AS DATE) AS pub
  FROM events)"""


@shared
def log(t: Tables) -> DataFrame:
    """(source, key, pos, fetched_at, body, sha, n_bytes, pub): the append-only fetch log."""
    return t.events.select(
        F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("pos"),
        F.col("ts").alias("fetched_at"), F.col("props").alias("body"), F.sha2("props", 256).alias("sha"),
        F.length("props").cast("long").alias("n_bytes"), F.col("ts").cast("date").alias("pub"),
    )


# ------------------------------------------------------------------ annual tables

ANNUAL = BELT + """, weather_year AS (
  SELECT k, CAST(year(d) AS BIGINT) AS year, avg(greatest(tmax - 29.0, 0.0)) AS heat, avg(rain) AS rain, max(tmax) AS peak, count(*) AS days
  FROM belt GROUP BY 1, 2),
yield_year AS (
  SELECT r_name AS k, CAST(year(o_orderdate) AS BIGINT) AS year,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (100000.0 * count(*)) AS yield
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
annual AS (
  SELECT k, year, heat, rain, peak, days, yield FROM weather_year JOIN yield_year USING (k, year))"""


@shared
def annual(t: Tables) -> DataFrame:
    """(k, year, heat, rain, peak, days, yield): one row per belt and harvest year."""
    hot = F.greatest(F.col("tmax") - 29.0, F.lit(0.0))
    weather = belt(t).groupBy("k", F.year("d").cast("long").alias("year")).agg(
        F.avg(hot).alias("heat"), F.avg("rain").alias("rain"), F.max("tmax").alias("peak"), F.count(F.lit(1)).alias("days")
    )
    per_cust = t.orders.groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(
        F.sum(cents("o_totalprice")).alias("c"), F.count(F.lit(1)).alias("n")
    )
    yields = per_cust.join(homes(t), "o_custkey").groupBy("k", "year").agg(
        (F.sum("c").cast("double") / (F.lit(100000.0) * F.sum("n"))).alias("yield")
    )
    return weather.join(yields, ["k", "year"])


def with_sql(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
