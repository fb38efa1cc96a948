"""G: statistics over the history of ticks; F4 and F10 on the same ticks are in snapshot_queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import history as H
from sightline.plans import views as V
from sightline.plans.register import query


def _episodes(spark, sf):
    return H.outage_episodes(V.ticks(spark, sf), V.INTERVAL)


@query("g1_coverage_summary", f"WITH {V.TICKS} SELECT count(DISTINCT tick) AS ticks, min(tick) AS first, max(tick) AS last, (max(tick) - min(tick)) // 360 + 1 AS expected FROM ticks")
def g1(spark, sf):
    return H.coverage_summary(V.ticks(spark, sf), V.INTERVAL)


@query("g2_collection_gaps", f"""WITH {V.EVENTS}, d AS (SELECT DISTINCT t // 60 AS tick FROM e WHERE event_type = 'error'), g AS (SELECT lag(tick) OVER (ORDER BY tick) AS gap_from, tick AS gap_to FROM d),
h AS (SELECT *, gap_to - gap_from AS minutes FROM g WHERE gap_to - gap_from > 30) SELECT *, (SELECT count(*) FROM h) AS gaps FROM h ORDER BY minutes DESC, gap_from LIMIT 5""")
def g2(spark, sf):
    # The minutes at which errors came in, as the ticks of a collector that should run every ten.
    polls = V.events(spark, sf).where("event_type = 'error'").select(F.floor(F.col("t") / 60).cast("long").alias("tick"))
    return H.collection_gaps(polls, 10)


@query("g3_source_health", f"""WITH {V.EVENTS}, {V.HEALTH} SELECT source, count(*) AS ticks, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'PARTIAL') AS partial,
count(*) FILTER (status NOT IN ('OK', 'PARTIAL')) AS other, floor(100.0 * count(*) FILTER (status = 'OK') / count(*) + 0.5)::BIGINT AS ok_share FROM health GROUP BY 1""")
def g3(spark, sf):
    return H.health_shares(V.health(spark, sf))


_SHARES = """shares AS (SELECT entity, count(*) AS samples, floor(100.0 * count(*) FILTER (kind = 'P') / count(*) + 0.5)::BIGINT AS positive, floor(100.0 * count(*) FILTER (kind = 'N') / count(*) + 0.5)::BIGINT AS negative,
floor(100.0 * count(*) FILTER (kind IN ('W', 'X')) / count(*) + 0.5)::BIGINT AS unclear FROM ticks GROUP BY 1)"""


@query("g4_sample_shares", f"WITH {V.TICKS}, {_SHARES} SELECT * FROM shares")
def g4(spark, sf):
    return H.sample_shares(V.ticks(spark, sf))


@query("g5_outage_episodes", f"WITH {V.SEGMENTS} SELECT * FROM episodes")
def g5(spark, sf):
    return _episodes(spark, sf)


@query("g6_current_run", f"""WITH {V.TICKS}, s AS (SELECT *, CASE kind WHEN 'P' THEN 'positive' WHEN 'N' THEN 'negative' ELSE 'unclear' END AS state FROM ticks),
m AS (SELECT *, CASE WHEN tick - lag(tick) OVER w > 1080 OR lag(state) OVER w <> state OR lag(state) OVER w IS NULL THEN tick END AS start FROM s WINDOW w AS (PARTITION BY entity ORDER BY tick))
SELECT entity, arg_max(state, tick) AS state, max(start) AS since, max(tick) = (SELECT max(tick) FROM ticks) AS visible FROM m GROUP BY 1""")
def g6(spark, sf):
    return H.current_run(V.ticks(spark, sf), V.INTERVAL)


_NEGATIVE = """neg AS (SELECT *, verdict = 'NOT_AVAILABLE' AS out, CASE WHEN verdict <> 'NOT_AVAILABLE' OR tick - lag(tick) OVER w > 1080 OR NOT coalesce(lag(verdict) OVER w = 'NOT_AVAILABLE', false) THEN tick END AS start FROM ticks WINDOW w AS (PARTITION BY entity ORDER BY tick)),
negative AS (SELECT entity, max(start) AS negative_since FROM neg GROUP BY 1 HAVING arg_max(out, tick))"""


@query("g7_current_negative_start", f"WITH {V.TICKS}, {_NEGATIVE} SELECT * FROM negative")
def g7(spark, sf):
    return H.current_negative_start(V.ticks(spark, sf), V.INTERVAL)


_QUANTILES = """quantiles AS (SELECT entity, count(*) AS outages, floor(quantile_cont(minutes::DOUBLE, 0.25) + 0.5)::BIGINT AS p25, floor(quantile_cont(minutes::DOUBLE, 0.5) + 0.5)::BIGINT AS median,
floor(quantile_cont(minutes::DOUBLE, 0.75) + 0.5)::BIGINT AS p75, max(minutes) AS longest FROM episodes GROUP BY 1)"""


@query("g8_duration_quantiles", f"WITH {V.SEGMENTS}, {_QUANTILES} SELECT * FROM quantiles")
def g8(spark, sf):
    return H.duration_quantiles(_episodes(spark, sf))


@query("g9_hour_histogram", f"""WITH {V.SEGMENTS}, x AS (SELECT DISTINCT entity FROM episodes) SELECT x.entity, h AS hour, count(e.entity) AS n
FROM x CROSS JOIN unnest(range(24)) AS u(h) LEFT JOIN episodes e ON e.entity = x.entity AND (e.restored + 180) % 1440 // 60 = h GROUP BY 1, 2""")
def g9(spark, sf):
    return H.hour_histogram(_episodes(spark, sf))


@query("g9_weekday_histogram", f"""WITH {V.SEGMENTS}, x AS (SELECT DISTINCT entity FROM episodes) SELECT x.entity, h AS weekday, count(e.entity) AS n
FROM x CROSS JOIN unnest(range(7)) AS u(h) LEFT JOIN episodes e ON e.entity = x.entity AND ((e.restored + 180) // 1440 + 3) % 7 = h GROUP BY 1, 2""")
def g9w(spark, sf):
    return H.weekday_histogram(_episodes(spark, sf))


def circular_sql(source: str, keys: str, at: str, least: int) -> str:
    """Common table expression `circle` (keys, n, centre, q0, q1, q2) over rows of `source`."""
    names = keys.split(", ")
    on = " AND ".join(f"a.{k} = b.{k}" for k in names)
    pick = ", ".join(f"a.{k}" for k in names)
    diff = "((a.m - b.centre + 2160) % 1440 - 720)::DOUBLE"
    quartiles = ", ".join(f"quantile_cont({diff}, {q}) AS q{i}" for i, q in enumerate((0.25, 0.5, 0.75)))
    return f"""cm AS (SELECT {keys}, {at} AS at, ({at} + 180) % 1440 AS m FROM {source}),
ca AS (SELECT {keys}, m, min(at) AS at FROM cm GROUP BY {keys}, m),
cost AS (SELECT {pick}, a.m, a.at, sum(abs((b.m - a.m + 2160) % 1440 - 720)) AS cost FROM ca a JOIN cm b ON {on} GROUP BY {pick}, a.m, a.at),
centre AS (SELECT {keys}, arg_min(m, (cost, at, m)) AS centre FROM cost GROUP BY {keys}),
circle AS (SELECT {pick}, count(*) AS n, any_value(b.centre) AS centre, {quartiles} FROM cm a JOIN centre b ON {on} GROUP BY {pick} HAVING count(*) >= {least})"""


@query("g10_typical_time", f"""WITH {V.SEGMENTS}, {circular_sql("episodes", "entity", "restored", 3)} SELECT entity, n, (floor(centre + q1 + 0.5)::BIGINT + 1440) % 1440 AS median_minute,
(floor(centre + q0 + 0.5)::BIGINT + 1440) % 1440 AS window_start, (floor(centre + q2 + 0.5)::BIGINT + 1440) % 1440 AS window_end FROM circle""")
def g10(spark, sf):
    return H.typical_time(_episodes(spark, sf))


_ARRIVALS = "arrivals AS (SELECT DISTINCT entity, source, at FROM reports WHERE sign = 1 AND grade_specific AND (status IS NULL OR status IN ('IN_STOCK', 'LIMITED')) AND at <= tick_seconds + 300)"


def _arrivals(spark, sf):
    return H.arrival_events(V.reports(spark, sf).where("sign = 1"))


@query("g11_arrival_events", f"WITH {V.REPORTS}, {_ARRIVALS} SELECT * FROM arrivals")
def g11(spark, sf):
    return _arrivals(spark, sf)


_SESSIONS = """opened AS (SELECT *, CASE WHEN at - lag(at) OVER (PARTITION BY entity ORDER BY at) > 7200 THEN 1 ELSE 0 END AS opens FROM arrivals),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY entity ORDER BY at) AS session FROM opened),
sessions AS (SELECT entity, min(at) AS at, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS reports FROM numbered GROUP BY entity, session)"""


@query("g12_arrival_sessions", f"WITH {V.REPORTS}, {_ARRIVALS}, {_SESSIONS} SELECT * FROM sessions")
def g12(spark, sf):
    return H.arrival_sessions(_arrivals(spark, sf))


@query("g13_last_episodes", f"WITH {V.SEGMENTS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY restored DESC) AS place FROM episodes) WHERE place <= 5")
def g13(spark, sf):
    return H.latest(_episodes(spark, sf), [F.desc("restored")])


@query("g13_last_arrivals", f"WITH {V.REPORTS}, {_ARRIVALS}, {_SESSIONS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY at DESC) AS place FROM sessions) WHERE place <= 5")
def g13a(spark, sf):
    return H.latest(H.arrival_sessions(_arrivals(spark, sf)), [F.desc("at")])


@query("g14_timeline", f"""WITH {V.TICKS}, {V.MEMBERS}, {V.HEALTH}, l AS (SELECT entity, tick, string_agg(DISTINCT split_part(member, ':', 1), ',' ORDER BY split_part(member, ':', 1)) AS listed_by FROM members GROUP BY 1, 2),
f AS (SELECT tick, string_agg(source, ',' ORDER BY source) AS failed FROM health WHERE status NOT IN ('OK', 'DISABLED') GROUP BY 1)
SELECT t.entity, t.tick, verdict, confidence, coalesce(listed_by, '') AS listed_by, coalesce(failed, '') AS failed FROM ticks t LEFT JOIN l ON l.entity = t.entity AND l.tick = t.tick LEFT JOIN f ON f.tick = t.tick""")
def g14(spark, sf):
    return H.timeline(V.ticks(spark, sf), V.members(spark, sf), V.health(spark, sf))


@query("g15_result_order", f"WITH {V.SEGMENTS}, {_SHARES}, {_QUANTILES} SELECT s.entity, coalesce(outages, 0) AS outages, positive FROM shares s LEFT JOIN quantiles q ON q.entity = s.entity ORDER BY outages DESC, positive, s.entity")
def g15(spark, sf):
    return H.result_order(H.sample_shares(V.ticks(spark, sf)), H.duration_quantiles(_episodes(spark, sf)))


@query("g16_latest_fields", f"""WITH {V.EVENTS} SELECT entity, arg_max(CASE WHEN k % 3 > 0 THEN event_type END, (t, event_id)) FILTER (k % 3 > 0) AS title, arg_max(CASE WHEN k % 5 > 0 THEN k END, (t, event_id)) FILTER (k % 5 > 0) AS brand FROM e GROUP BY 1""")
def g16(spark, sf):
    e = V.events(spark, sf).select("entity", F.struct("t", "event_id").alias("tick"), F.when(F.col("k") % 3 > 0, F.col("event_type")).alias("title"), F.when(F.col("k") % 5 > 0, F.col("k")).alias("brand"))
    return H.latest_fields(e, ["title", "brand"])


@query("g17_entity_keys", f"WITH {V.EVENTS}, {V.MEMBERS} SELECT entity, string_agg(DISTINCT member, ',' ORDER BY member) AS keys FROM members GROUP BY 1")
def g17(spark, sf):
    keys = H.entity_keys(V.members(spark, sf).select("entity", F.col("member").alias("token")))
    return keys.select("entity", F.array_join("keys", ",").alias("keys"))


@query("d10_conservative_collapse", f"""WITH {V.EVENTS}, r AS (SELECT entity // 3 AS entity, t // 21600 * 360 AS tick, CASE event_type WHEN 'error' THEN 'NOT_AVAILABLE' WHEN 'purchase' THEN 'AVAILABLE' WHEN 'click' THEN 'LIKELY_AVAILABLE' ELSE 'INDIRECT' END AS verdict,
1 + k % 3 AS confidence, 'm' || entity AS member FROM e), g AS (SELECT entity, tick, bool_and(verdict = 'NOT_AVAILABLE') AS o, bool_and(verdict = 'AVAILABLE' OR verdict = 'LIKELY_AVAILABLE' AND confidence >= 2) AS p, min(verdict) AS a, max(verdict) AS b, count(*) AS n, min(confidence) AS confidence,
string_agg(DISTINCT member, ',' ORDER BY member) AS members FROM r GROUP BY 1, 2)
SELECT entity, tick, CASE WHEN n = 1 THEN a WHEN o THEN 'NOT_AVAILABLE' WHEN p AND a = b THEN a WHEN p THEN 'LIKELY_AVAILABLE' ELSE 'CONFLICTING' END AS verdict, confidence, members FROM g""")
def d10(spark, sf):
    e = V.events(spark, sf)
    verdict = F.when(F.col("event_type") == "error", "NOT_AVAILABLE").when(F.col("event_type") == "purchase", "AVAILABLE").when(F.col("event_type") == "click", "LIKELY_AVAILABLE").otherwise("INDIRECT")
    rows = e.select(F.floor(F.col("entity") / 3).alias("entity"), (F.floor(F.col("t") / 21600) * 360).cast("long").alias("tick"), verdict.alias("verdict"), (1 + F.col("k") % 3).alias("confidence"), F.concat(F.lit("m"), F.col("entity").cast("string")).alias("member"))
    return H.collapse(rows).withColumn("members", F.array_join("members", ","))
