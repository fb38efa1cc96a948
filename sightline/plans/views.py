"""Views that shape the given tables into the tables of the library, each with its SQL as common table expressions.

Times are whole numbers: `t` epoch seconds, `tick` epoch minutes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.tables import table

INTERVAL = 360  # minutes between the ticks of the views

#: Fixed time that stands for now in the observation views: 2024-01-20 00:00 UTC, in seconds.
NOW = 1705708800

SOURCES = ["alpha", "beta", "gamma", "delta"]


def events(spark, sf: str) -> DataFrame:
    """(event_id, entity, event_type, value, t, k)"""
    e = table(spark, sf, "events")
    k = F.regexp_extract(F.coalesce("props", F.lit("")), '"k": *([0-9]+)', 1)
    return e.select("event_id", F.col("user_id").alias("entity"), "event_type", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.when(k != "", k).cast("long").alias("k"))


EVENTS = """e AS (
  SELECT event_id, user_id AS entity, event_type, value, epoch_us(ts) // 1000000 AS t, TRY_CAST(regexp_extract(coalesce(props, ''), '"k": *([0-9]+)', 1) AS BIGINT) AS k
  FROM events)"""


def ticks(spark, sf: str) -> DataFrame:
    """(entity, tick, verdict, confidence): six-hour buckets of a user's events."""
    has = lambda kind: F.count_if(F.col("event_type") == kind)
    agg = events(spark, sf).groupBy("entity", (F.floor(F.col("t") / 21600) * 360).cast("long").alias("tick")).agg(has("error").alias("bad"), has("purchase").alias("good"), has("click").alias("clicks"), F.count("*").alias("n"))
    verdict = F.when((F.col("bad") > 0) & (F.col("good") > 0), "CONFLICTING").when(F.col("bad") > 0, "NOT_AVAILABLE").when(F.col("good") > 0, "AVAILABLE").when(F.col("clicks") == F.col("n"), "LIKELY_AVAILABLE").otherwise("INDIRECT")
    confidence = F.when(verdict == "AVAILABLE", F.least(F.col("good") + 1, F.lit(3))).when(verdict == "NOT_AVAILABLE", 2).otherwise(1).cast("long")
    return agg.select("entity", "tick", verdict.alias("verdict"), confidence.alias("confidence"))


TICKS = EVENTS + """, buckets AS (
  SELECT entity, t // 21600 * 360 AS tick, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type = 'purchase') AS good,
         count(*) FILTER (event_type = 'click') AS clicks, count(*) AS n
  FROM e GROUP BY 1, 2
), ticks AS (
  SELECT entity, tick, verdict, CASE verdict WHEN 'AVAILABLE' THEN least(good + 1, 3) WHEN 'NOT_AVAILABLE' THEN 2 ELSE 1 END AS confidence,
         CASE verdict WHEN 'NOT_AVAILABLE' THEN 'N' WHEN 'AVAILABLE' THEN 'P' WHEN 'LIKELY_AVAILABLE' THEN 'W' ELSE 'X' END AS kind
  FROM (SELECT *, CASE WHEN bad > 0 AND good > 0 THEN 'CONFLICTING' WHEN bad > 0 THEN 'NOT_AVAILABLE' WHEN good > 0 THEN 'AVAILABLE' WHEN clicks = n THEN 'LIKELY_AVAILABLE' ELSE 'INDIRECT' END AS verdict FROM buckets))"""

SEGMENTS = TICKS + """, marked AS (
  SELECT *, CASE WHEN tick - lag(tick) OVER w > 1080 OR lag(kind) OVER w IN ('P', 'X') THEN 1 ELSE 0 END AS reset FROM ticks WINDOW w AS (PARTITION BY entity ORDER BY tick)
), segments AS (
  SELECT *, sum(reset) OVER (PARTITION BY entity ORDER BY tick) AS segment FROM marked
), episodes AS (
  SELECT entity, started, restored, restored - started AS minutes
  FROM (SELECT entity, segment, min(tick) FILTER (kind = 'N') AS started, max(tick) FILTER (kind = 'P') AS restored FROM segments GROUP BY 1, 2)
  WHERE started IS NOT NULL AND restored IS NOT NULL)"""


def members(spark, sf: str) -> DataFrame:
    """(entity, tick, member): which source listed the entity; source = event_id % 4."""
    e = events(spark, sf)
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("entity", (F.floor(F.col("t") / 21600) * 360).cast("long").alias("tick"), F.concat(source, F.lit(":"), F.col("entity").cast("string")).alias("member")).distinct()


_SOURCE = "['alpha', 'beta', 'gamma', 'delta'][event_id % 4 + 1]"
MEMBERS = f"""members AS (SELECT DISTINCT entity, t // 21600 * 360 AS tick, {_SOURCE} || ':' || entity AS member FROM e)"""


def health(spark, sf: str) -> DataFrame:
    """(tick, source, status) of the sources at a tick: HTTP_ERROR where errors prevail, PARTIAL where they are many."""
    e = events(spark, sf)
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.col("event_id") % 4 + 1).cast("int"))
    agg = e.groupBy((F.floor(F.col("t") / 21600) * 360).cast("long").alias("tick"), source.alias("source")).agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.count("*").alias("n"))
    status = F.when(F.col("bad") * 3 > F.col("n"), "HTTP_ERROR").when(F.col("bad") * 4 > F.col("n"), "PARTIAL").when(F.col("bad") == 0, "DISABLED").otherwise("OK")
    return agg.select("tick", "source", status.alias("status"))


HEALTH = f"""health AS (
  SELECT tick, source, CASE WHEN bad * 3 > n THEN 'HTTP_ERROR' WHEN bad * 4 > n THEN 'PARTIAL' WHEN bad = 0 THEN 'DISABLED' ELSE 'OK' END AS status
  FROM (SELECT t // 21600 * 360 AS tick, {_SOURCE} AS source, count(*) FILTER (event_type = 'error') AS bad, count(*) AS n FROM e GROUP BY 1, 2))"""


def reports(spark, sf: str) -> DataFrame:
    """(entity, source, grade, at, sign, status, grade_specific, tick_seconds): purchases say yes, errors no."""
    e = events(spark, sf).where("event_type in ('purchase', 'error', 'signup')")
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.col("event_id") % 4 + 1).cast("int"))
    yes = F.col("event_type") == "purchase"
    return e.select("event_id", "entity", source.alias("source"), (F.col("k") % 4).alias("grade"), F.col("t").alias("at"), F.when(yes, 1).when(F.col("event_type") == "error", -1).otherwise(0).alias("sign"), F.when(yes & (F.col("k") % 2 == 0), "IN_STOCK").when(~yes, "OUT_OF_STOCK").alias("status"), (F.col("event_type") != "signup").alias("grade_specific"), (F.col("t") - (F.col("k") - 95) * 100).alias("tick_seconds"))


REPORTS = EVENTS + f""", reports AS (
  SELECT event_id, entity, {_SOURCE} AS source, k % 4 AS grade, t AS at, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS sign,
         CASE WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'IN_STOCK' WHEN event_type <> 'purchase' THEN 'OUT_OF_STOCK' END AS status,
         event_type <> 'signup' AS grade_specific, t - (k - 95) * 100 AS tick_seconds
  FROM e WHERE event_type IN ('purchase', 'error', 'signup'))"""
