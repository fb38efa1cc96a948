"""F, H and the join patterns J: on ticks of `events`, and on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import forecast as C, history as H, joins, snapshot as S
from sightline.params import Params
from sightline.plans import fuse_queries as Q, views as V
from sightline.plans.history_queries import _NEGATIVE, circular_sql
from sightline.plans.register import query
from sightline.sources import payloads as P, store
from sightline.tables import table

NOW = V.NOW


def assessments(spark, sf):
    """One row per user from its events up to now."""
    e = V.events(spark, sf).where(F.col("t") <= NOW)
    a = e.groupBy("entity").agg(F.max_by("event_type", F.struct("t", "event_id")).alias("last"), F.count("*").alias("n"), F.max_by("k", F.struct("t", "event_id")).alias("k"), F.max("t").alias("t"), F.count_distinct(F.col("event_id") % 4).alias("sources"))
    verdict = Q._case(F.col("last"), purchase="AVAILABLE", click="LIKELY_AVAILABLE", error="NOT_AVAILABLE", view="INDIRECT", signup="CONFLICTING")
    confidence = F.element_at(F.array(*[F.lit(x) for x in ("NONE", "LOW", "MEDIUM", "HIGH")]), (F.col("k") % 4 + 1).cast("int"))
    ordinal = F.element_at(F.array(*[F.lit(x) for x in ("NONE", "SHORT", "MEDIUM", "LONG", "VERY_LONG")]), (F.col("k") % 5 + 1).cast("int"))
    return a.select("entity", verdict.alias("verdict"), confidence.alias("confidence"), (F.col("k") % 6 == 0).alias("resumed"), (F.col("k") % 6 == 1).alias("ongoing"), "sources", F.when(F.col("k") % 7 > 0, ((NOW - F.col("t")) / 60).cast("double")).alias("freshest_age"), F.when(F.col("k") % 3 == 0, F.col("k")).alias("vehicles"), F.when(F.col("k") % 3 == 1, ordinal).alias("queue_ordinal"), F.when(F.col("k") % 2 == 0, "OBSERVED_TRANSITION").alias("run_basis"), (NOW - F.col("t")).alias("run_age"), (F.col("entity") % 100).cast("double").alias("distance"), F.when(F.col("entity") % 4 > 0, F.col("entity") % 4 > 1).alias("sells_requested"))


ASSESS = V.EVENTS + f""", lastk AS (SELECT entity, arg_max(event_type, (t, event_id)) AS last, arg_max(k, (t, event_id)) AS k, max(t) AS t, count(DISTINCT event_id % 4) AS sources FROM e WHERE t <= {NOW} GROUP BY 1),
asm AS (SELECT entity, CASE last WHEN 'purchase' THEN 'AVAILABLE' WHEN 'click' THEN 'LIKELY_AVAILABLE' WHEN 'error' THEN 'NOT_AVAILABLE' WHEN 'view' THEN 'INDIRECT' ELSE 'CONFLICTING' END AS verdict, k % 4 AS crank, ['NONE', 'LOW', 'MEDIUM', 'HIGH'][k % 4 + 1] AS confidence,
k % 6 AS act, sources, CASE WHEN k % 7 > 0 THEN ({NOW} - t) / 60.0::DOUBLE END AS age, CASE WHEN k % 3 = 0 THEN k END AS vehicles, CASE WHEN k % 3 = 1 THEN k % 5 END AS word, k % 2 = 0 AS observed, {NOW} - t AS run_age, entity % 100 AS distance, CASE WHEN entity % 4 > 0 THEN entity % 4 > 1 END AS sells FROM lastk)"""
_ORDER = "CASE act WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, -sources, -crank, coalesce(age, 9e15), CASE WHEN vehicles IS NOT NULL THEN 0 WHEN word IS NOT NULL THEN 1 ELSE 2 END, coalesce(vehicles, word, 9e15), CASE WHEN observed THEN run_age ELSE 9e15 END, distance, entity"


@query("f1_ranking", f"WITH {ASSESS} SELECT entity, verdict, confidence FROM asm WHERE verdict IN ('AVAILABLE', 'LIKELY_AVAILABLE') ORDER BY {_ORDER}")
def f1(spark, sf):
    return S.ranked(assessments(spark, sf)).select("entity", "verdict", "confidence")


@query("f2_top_listing", f"WITH {ASSESS} SELECT entity, verdict, row_number() OVER (ORDER BY {_ORDER}) AS place FROM asm WHERE verdict IN ('AVAILABLE', 'LIKELY_AVAILABLE') ORDER BY place LIMIT 5")
def f2(spark, sf):
    return S.top(assessments(spark, sf), 5).select("entity", "verdict", "place")


def _slice(spark, sf, tick):
    return V.ticks(spark, sf).where(F.col("tick") == tick).select("entity", "verdict", F.col("confidence").cast("string").alias("confidence"), (F.col("entity") % 3).cast("string").alias("queue"))


_TICK = 28401120  # 2024-01-01 00:00 UTC in minutes


@query("f3_snapshot_diff", f"WITH {V.TICKS}, a AS (SELECT * FROM ticks WHERE tick = {_TICK + 7200}), b AS (SELECT * FROM ticks WHERE tick = {_TICK + 7560}) SELECT CASE WHEN a.entity IS NULL THEN 'ADDED' WHEN b.entity IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change, coalesce(a.entity, b.entity) AS entity, a.verdict AS was, b.verdict AS now FROM a FULL JOIN b ON a.entity = b.entity WHERE a.entity IS NULL OR b.entity IS NULL OR a.verdict <> b.verdict OR a.confidence <> b.confidence")
def f3(spark, sf):
    return S.diff(_slice(spark, sf, _TICK + 7200), _slice(spark, sf, _TICK + 7560))


@query("f4_availability_runs", f"""WITH {V.TICKS}, sq AS (SELECT tick, row_number() OVER (ORDER BY tick) AS seq FROM (SELECT DISTINCT tick FROM ticks)), a AS (SELECT t.*, seq, (verdict IN ('AVAILABLE', 'LIKELY_AVAILABLE'))::INT AS pos, (verdict = 'NOT_AVAILABLE')::INT AS neg FROM ticks t JOIN sq USING (tick)),
b AS (SELECT *, sum(pos) OVER w AS grp, lag(verdict) OVER w AS bv, lag(seq) OVER w AS bs, lag(tick) OVER w AS bt FROM a WINDOW w AS (PARTITION BY entity ORDER BY tick)), c AS (SELECT *, sum(neg) OVER (PARTITION BY entity, grp ORDER BY tick) AS negs FROM b),
d AS (SELECT *, pos = 1 AND (coalesce(lag(grp) OVER w, 0) = 0 OR lag(negs) OVER w >= 2) AS opens FROM c WINDOW w AS (PARTITION BY entity ORDER BY tick)), f AS (SELECT *, sum(opens::INT) OVER (PARTITION BY entity ORDER BY tick) AS run, opens AND bv = 'NOT_AVAILABLE' AND bs = seq - 1 AND (verdict = 'AVAILABLE' OR confidence >= 2) AS moved FROM d)
SELECT entity, min(tick) FILTER (opens) AS opened, max(tick) FILTER (pos = 1) AS last_confirmed, min(tick) FILTER (grp > 0 AND negs = 2 AND neg = 1) AS closed, CASE WHEN bool_or(moved) THEN 'OBSERVED_TRANSITION' ELSE 'FIRST_SEEN' END AS basis, max(bt) FILTER (moved) AS after, arg_min(verdict, tick) AS verdict, arg_max(confidence, tick) FILTER (pos = 1) AS confidence
FROM f WHERE run > 0 GROUP BY entity, run""")
def f4(spark, sf):
    return S.availability_runs(V.ticks(spark, sf))


def _metrics(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    st = d.select("source", F.col("doc_id").alias("station"), F.when(F.col("n_chars") % 11 > 0, F.col("n_chars").cast("double")).alias("lon"), F.lit(1.0).alias("lat"))
    ob = l.join(d.select("doc_id", "source"), "doc_id").select("source", F.col("doc_id").alias("station"), F.when(F.col("quality") == 1, F.col("doc_id")).alias("at"))
    return P.coverage(st, ob)


METRICS = """o AS (SELECT d.source, count(DISTINCT l.doc_id) AS fueled, avg((l.quality = 1)::INT) AS timed FROM labels l JOIN documents d USING (doc_id) GROUP BY 1),
m AS (SELECT d.source, count(*) AS station_count, avg((n_chars % 11 > 0)::INT) AS coordinate_coverage, 1 - count(DISTINCT doc_id) / count(*) AS duplicate_ratio, coalesce(any_value(fueled), 0) / count(DISTINCT doc_id) AS fuel_block_coverage, coalesce(any_value(timed), 0) AS timestamp_coverage FROM documents d LEFT JOIN o USING (source) GROUP BY 1)"""
_ROUNDED = "round(coordinate_coverage, 6) AS coordinate_coverage, round(duplicate_ratio, 6) AS duplicate_ratio, round(fuel_block_coverage, 6) AS fuel_block_coverage, round(timestamp_coverage, 6) AS timestamp_coverage"


@query("a17_coverage_metrics", f"WITH {METRICS} SELECT source, station_count, {_ROUNDED} FROM m")
def a17(spark, sf):
    m = _metrics(spark, sf)
    return m.select("source", "station_count", *[F.round(c, 6).alias(c) for c in m.columns[2:]])


# The baseline's size and age follow from the number in the source's name, which both engines read alike.
def _baseline_frame(spark, sf):
    n = F.regexp_extract("source", "([0-9]+)", 1).cast("long")
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("c")).select("source", (F.col("c") * (1 + n % 4)).alias("base_count"), (NOW - n % 12 * 10 * 86400).alias("updated_at"))


BASE = f"bl AS (SELECT source, count(*) * (1 + any_value(n) % 4) AS base_count, {NOW} - any_value(n) % 12 * 10 * 86400 AS updated_at FROM (SELECT source, regexp_extract(source, '([0-9]+)', 1)::BIGINT AS n FROM documents) GROUP BY 1)"


@query("f5_completeness", f"""WITH {METRICS}, {BASE}, f AS (SELECT m.source, concat_ws(',', CASE WHEN base_count >= 4 AND {NOW} - updated_at <= 7776000 AND station_count < base_count * 0.5 THEN 'STATION_COUNT' END, CASE WHEN duplicate_ratio > 0.15 THEN 'DUPLICATES' END, CASE WHEN coordinate_coverage < 0.9 THEN 'COORDINATES' END,
CASE WHEN fuel_block_coverage < 0.2 THEN 'FUEL_BLOCKS' END, CASE WHEN timestamp_coverage < 0.2 THEN 'TIMESTAMPS' END) AS failed FROM m LEFT JOIN bl USING (source)) SELECT source, failed, CASE WHEN failed = '' THEN 'OK' ELSE 'PARTIAL' END AS status FROM f""")
def f5(spark, sf):
    return S.completeness(_metrics(spark, sf).withColumn("freshness_expected", F.lit(True)), _baseline_frame(spark, sf), NOW)


@query("f6_baseline_roll", f"""WITH {BASE}, x AS (SELECT source, 'a' AS area, 'c' AS contract, base_count AS station_count, updated_at FROM bl WHERE {NOW} - updated_at <= 7776000 UNION ALL SELECT source, 'a', 'c', count(*), {NOW} FROM documents WHERE regexp_extract(source, '([0-9]+)', 1)::BIGINT % 3 > 0 GROUP BY 1)
SELECT source, area, contract, max(station_count) AS station_count, max(updated_at) AS updated_at FROM x GROUP BY ALL""")
def f6(spark, sf):
    scope = [F.lit("a").alias("area"), F.lit("c").alias("contract")]
    old = _baseline_frame(spark, sf).select("source", *scope, F.col("base_count").alias("station_count"), "updated_at")
    n = F.regexp_extract("source", "([0-9]+)", 1).cast("long")
    fresh = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("station_count")).select("source", *scope, "station_count", F.when(n % 3 > 0, "OK").otherwise("PARTIAL").alias("status"))
    return S.roll_baselines(old, fresh, NOW)


@query("f7_bucket_counts", f"""WITH {ASSESS}, z AS (SELECT verdict, verdict IN ('AVAILABLE', 'LIKELY_AVAILABLE') AS good, coalesce(sells, true) OR verdict IN ('AVAILABLE', 'LIKELY_AVAILABLE') AS s FROM asm) SELECT count(*) FILTER (good) AS positive, count(*) FILTER (NOT s) AS not_sold, count(*) FILTER (s AND verdict IN ('CONFLICTING', 'INDIRECT')) AS unclear,
count(*) FILTER (s AND verdict = 'NOT_AVAILABLE') AS negative, count(*) FILTER (s AND verdict = 'NO_FRESH_DATA') AS empty FROM z""")
def f7(spark, sf):
    return S.bucket_counts(assessments(spark, sf))


@query("f8_source_availability", f"""WITH {V.EVENTS}, {V.HEALTH}, h AS (SELECT source || '-' || tick % 7 AS source, max(status) AS status FROM health GROUP BY 1), c AS (SELECT DISTINCT source || '-' || tick % 5 AS source FROM health)
SELECT count(*) AS enabled, count(*) FILTER (source IN (SELECT source FROM c)) AS contributing, count(*) FILTER (source IN (SELECT source FROM c) AND status <> 'OK') AS degraded FROM h WHERE status <> 'DISABLED'""")
def f8(spark, sf):
    h = V.health(spark, sf)
    tag = lambda m: F.concat("source", F.lit("-"), (F.col("tick") % m).cast("string"))
    return S.source_availability(h.groupBy(tag(7).alias("source")).agg(F.max("status").alias("status")), h.select(tag(5).alias("source")))


@query("f9_user_warnings", "SELECT DISTINCT CASE WHEN p_type IN ('SMALL', 'LARGE') THEN lower(p_type) || ' things' ELSE p_type END AS warning FROM part WHERE p_type NOT IN ('PROMO')")
def f9(spark, sf):
    codes = table(spark, sf, "part").select(F.col("p_type").alias("code"))
    texts = codes.where("code in ('SMALL', 'LARGE')").distinct().withColumn("text", F.concat(F.lower("code"), F.lit(" things")))
    return S.user_warnings(codes, codes.where("code = 'PROMO'").distinct(), texts)


@query("f10_empty_streaks", f"""WITH {V.TICKS}, g AS (SELECT *, sum((kind NOT IN ('X', 'W'))::INT) OVER (PARTITION BY entity ORDER BY tick) AS grp FROM ticks) SELECT entity, min(tick) AS started, count(*) AS ticks, count(*) >= 4 AS compact FROM g WHERE kind IN ('X', 'W') GROUP BY entity, grp""")
def f10(spark, sf):
    return S.empty_streaks(V.ticks(spark, sf).withColumn("empty", F.col("verdict").isin("LIKELY_AVAILABLE", "CONFLICTING", "INDIRECT")))


@query("f11_tick_summary", f"WITH {V.TICKS} SELECT tick, count(*) AS entities, {', '.join(f'''count(*) FILTER (verdict = '{v}') AS {v.lower()}''' for v in ('AVAILABLE', 'LIKELY_AVAILABLE', 'CONFLICTING', 'INDIRECT', 'NOT_AVAILABLE'))} FROM ticks GROUP BY 1")
def f11(spark, sf):
    return S.tick_summary(V.ticks(spark, sf))


# H: forecasts. A day's length stands for minutes, as in the fusion views.
HP = Params(quiet_gap_minutes=60, resume_window_minutes=360, minimum_events=1, strong_signal=3)


def rolling(spark, sf):
    """Click counts per user, source, grade and six hours, zero-filled over the ticks that the user has."""
    e = V.events(spark, sf)
    tick = (F.floor(F.col("t") / 21600) * 360).cast("long")
    return e.select("entity", F.lit("s").alias("source"), (F.col("entity") % 2).alias("grade"), tick.alias("tick"), (F.col("k") % 3).cast("string").alias("variant"), F.lit(True).alias("grade_specific"), (F.col("event_type") == "click").cast("long").alias("count"), F.lit(360.0).alias("window_minutes"), F.when(F.col("event_type") == "click", F.floor(F.col("t") / 60)).alias("latest"), Q._case(F.col("event_type"), purchase="IN_STOCK", click="LIMITED", error="OUT_OF_STOCK", view="UNKNOWN", signup="UNKNOWN").alias("status"))


ROLL = V.EVENTS + """, ra AS (SELECT entity, 's' AS source, entity % 2 AS grade, t // 21600 * 360 AS tick, (k % 3)::VARCHAR AS variant, (event_type = 'click')::BIGINT AS c, CASE WHEN event_type = 'click' THEN t // 60 END AS latest, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS s FROM e),
rv AS (SELECT entity, source, grade, tick, variant, sum(c) AS c, max(latest) AS latest, max(s) AS s FROM ra GROUP BY ALL), rc AS (SELECT entity, source, grade, tick, sum(c) AS n, max(latest) AS latest, max(s) AS s FROM rv GROUP BY ALL),
rb AS (SELECT *, lag(tick) OVER w AS btick, lag(n) OVER w AS bn, lag(s) OVER w AS bs FROM rc WINDOW w AS (PARTITION BY entity, source, grade ORDER BY tick)),
re AS (SELECT r.entity, r.tick, max(r.latest) AS at, count(DISTINCT grade) AS grades, sum(n) AS total, count(DISTINCT grade) >= 2 OR sum(n) >= 3 AS medium FROM rb r WHERE tick - btick <= 1080 AND bn = 0 AND n >= 1 AND tick - latest <= 360 AND (tick - latest) * 60 >= -120 AND EXISTS (SELECT 1 FROM rv a JOIN rv b ON a.entity = b.entity AND a.variant = b.variant WHERE a.entity = r.entity AND a.tick = r.tick AND b.tick = r.btick AND a.c > 0 AND b.c = 0) GROUP BY r.entity, r.tick),
se AS (SELECT r.entity, r.tick, r.tick AS at, count(DISTINCT grade) AS grades, count(DISTINCT grade) >= 2 AS medium FROM rb r WHERE tick - btick <= 1080 AND bs = 1 AND s >= 2 AND EXISTS (SELECT 1 FROM rv a JOIN rv b ON a.entity = b.entity AND a.variant = b.variant WHERE a.entity = r.entity AND a.tick = r.tick AND b.tick = r.btick AND a.s >= 2 AND b.s = 1) GROUP BY r.entity, r.tick)"""


@query("h1_rolling_counts", f"WITH {ROLL} SELECT entity, source, grade, tick, n AS count, 360.0::DOUBLE AS window_minutes, latest FROM rc")
def h1(spark, sf):
    return C.rolling_counts(rolling(spark, sf)).drop("variants")


@query("h2_grade_statuses", f"WITH {ROLL} SELECT entity, source, grade, tick, s AS status FROM rc")
def h2(spark, sf):
    return C.grade_statuses(rolling(spark, sf)).drop("variants")


@query("h3_variant_keys", "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'AI95_UNKNOWN' END WHEN p_type = 'SMALL' THEN CASE WHEN p_size % 2 = 0 THEN p_name END ELSE p_type END AS variant FROM part")
def h3(spark, sf):
    p = table(spark, sf, "part")
    key = F.when(F.col("p_type") == "PROMO", "AI95_UNKNOWN").when(F.col("p_type") != "SMALL", F.col("p_type"))
    return p.select("p_partkey", C.variant_key(key, F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("")).alias("variant"))


@query("h4_rolling_events", f"WITH {ROLL} SELECT entity, tick, at, grades, total, medium FROM re")
def h4(spark, sf):
    return C.rolling_events(C.rolling_counts(rolling(spark, sf)), V.INTERVAL, HP)


@query("h5_status_events", f"WITH {ROLL} SELECT * FROM se")
def h5(spark, sf):
    return C.status_events(C.grade_statuses(rolling(spark, sf)), V.INTERVAL)


_TIMELINE = """tt AS (SELECT DISTINCT entity, source, grade, at FROM reports WHERE sign = 1), tu AS (SELECT *, CASE WHEN at - lag(at) OVER (PARTITION BY entity ORDER BY at) > 7200 THEN 1 ELSE 0 END AS o FROM tt), tv AS (SELECT *, sum(o) OVER (PARTITION BY entity ORDER BY at) AS s FROM tu),
te AS (SELECT entity, min(at) AS at, count(DISTINCT grade) AS grades, count(DISTINCT source) AS sources, count(DISTINCT grade) >= 2 OR count(DISTINCT source) >= 2 AS medium FROM tv GROUP BY entity, s)"""


def _timeline(spark, sf):
    return C.timeline_events(V.reports(spark, sf).where("sign = 1"))


@query("h6_timeline_clusters", f"WITH {V.REPORTS}, {_TIMELINE} SELECT * FROM te")
def h6(spark, sf):
    return _timeline(spark, sf)


def _brand():
    return F.concat(F.lit("b"), (F.col("entity") % 6).cast("string"))


def _events(spark, sf):
    """Resumptions and timeline clusters of all entities, with the ranks of their signals."""
    r = C.rolling_events(C.rolling_counts(rolling(spark, sf)), V.INTERVAL, HP).select("entity", "at", "medium", F.lit(0).alias("signal"))
    t = _timeline(spark, sf).select("entity", F.floor(F.col("at") / 60).alias("at"), "medium", F.lit(1).alias("signal"))
    return r.unionByName(t).withColumn("brand", _brand())


def _durations(spark, sf):
    return C.duration_patterns(H.outage_episodes(V.ticks(spark, sf), V.INTERVAL, True).withColumn("brand", _brand()))


_FE = """fe AS (SELECT entity, at, medium, 0 AS signal FROM re UNION ALL SELECT entity, at // 60, medium, 1 FROM te),
fs AS (SELECT at, medium, signal, 0 AS basis, entity::VARCHAR AS scope FROM fe UNION ALL SELECT at, medium, signal, 1, 'b' || entity % 6 FROM fe UNION ALL SELECT at, medium, signal, 2, '' FROM fe)"""
_PATTERNS = f"""{_FE}, {circular_sql('fs', 'signal, basis, scope', 'at', 2)}, fd AS (SELECT signal, basis, scope, count(DISTINCT (at + 180) // 1440) AS days, count(*) FILTER (medium) AS strong FROM fs GROUP BY ALL),
patterns AS (SELECT c.*, strong FROM circle c JOIN fd USING (signal, basis, scope) WHERE days >= 2)"""
_REPORTS_ONLY = V.REPORTS.partition("""events)""")[2].lstrip(", ")
_SEGMENTS_ONLY = V.SEGMENTS.partition("""events)""")[2].lstrip(", ")
_DUR = """ds AS (SELECT 0 AS basis, entity::VARCHAR AS scope, minutes FROM episodes WHERE minutes > 0 UNION ALL SELECT 1, 'b' || entity % 6, minutes FROM episodes WHERE minutes > 0 UNION ALL SELECT 2, '', minutes FROM episodes WHERE minutes > 0),
durations AS (SELECT basis, scope, count(*) AS n, quantile_cont(minutes::DOUBLE, 0.25) AS q0, quantile_cont(minutes::DOUBLE, 0.5) AS q1, quantile_cont(minutes::DOUBLE, 0.75) AS q2 FROM ds GROUP BY ALL HAVING count(*) >= 2)"""


def _patterns(spark, sf):
    return C.time_patterns(_events(spark, sf))


@query("h7_patterns", f"WITH {ROLL}, {_REPORTS_ONLY}, {_TIMELINE}, {_PATTERNS} SELECT signal, basis, scope, n, centre, q0, q1, q2, strong FROM patterns")
def h7(spark, sf):
    return _patterns(spark, sf)


@query("h9_duration_patterns", f"WITH {V.SEGMENTS}, {_DUR} SELECT * FROM durations")
def h9(spark, sf):
    return _durations(spark, sf)


_END = _TICK + 30 * 1440


def _candidates(spark, sf):
    ticks = V.ticks(spark, sf)
    now = ticks.groupBy("entity").agg(F.max_by("verdict", "tick").alias("verdict")).withColumns({"sells_requested": F.when(F.col("entity") % 5 > 0, F.col("entity") % 5 != 1), "brand": _brand()})
    return C.candidates(now, H.current_negative_start(ticks, V.INTERVAL))


def _forecasts(spark, sf):
    return C.forecast(_candidates(spark, sf), _patterns(spark, sf), _durations(spark, sf), _END)


_FORECAST = f"""WITH {ROLL}, {_REPORTS_ONLY}, {_TIMELINE}, {_SEGMENTS_ONLY}, {_NEGATIVE}, {_PATTERNS}, {_DUR}, cand AS (SELECT entity, negative_since FROM negative WHERE entity % 5 <> 1),
sc AS (SELECT entity, negative_since, 0 AS basis, entity::VARCHAR AS scope FROM cand UNION ALL SELECT entity, negative_since, 1, 'b' || entity % 6 FROM cand UNION ALL SELECT entity, negative_since, 2, '' FROM cand),
tm AS (SELECT sc.*, p.* EXCLUDE (basis, scope) FROM sc JOIN patterns p ON p.basis = sc.basis AND p.scope = sc.scope QUALIFY row_number() OVER (PARTITION BY entity ORDER BY signal, sc.basis) = 1),
tn AS (SELECT *, (centre + q1 - floor((centre + q1) / 1440) * 1440) - ({_END} + 180) % 1440 AS ahead FROM tm), tx AS (SELECT *, {_END} + CASE WHEN ahead > 0 THEN ahead ELSE ahead + 1440 END AS ex FROM tn),
du AS (SELECT sc.*, d.* EXCLUDE (basis, scope) FROM sc JOIN durations d ON d.basis = sc.basis AND d.scope = sc.scope WHERE entity NOT IN (SELECT entity FROM tm) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY sc.basis) = 1),
al AS (SELECT entity, negative_since, ex AS x, greatest(ex + q0 - q1, {_END}) AS a, ex + q2 - q1 AS b, basis = 0 AND n >= 3 AND strong >= 2 AS medium, basis, signal, n FROM tx UNION ALL SELECT entity, negative_since, greatest(negative_since + q1, {_END}), greatest(negative_since + q0, {_END}), negative_since + q2, basis = 0 AND n >= 3, basis, 3, n FROM du WHERE negative_since + q2 > {_END}),
fc AS (SELECT entity, negative_since, floor(x + 0.5)::BIGINT AS expected_at, floor(a + 0.5)::BIGINT AS window_start, floor(b + 0.5)::BIGINT AS window_end, CASE WHEN medium THEN 'MEDIUM' ELSE 'LOW' END AS confidence, ['STATION', 'BRAND', 'AREA'][basis + 1] AS basis, ['ROLLING_ACTIVITY', 'SOURCE_TIMELINE', 'PETROL_STATUS_PATTERN', 'STATUS_TRANSITION'][signal + 1] AS signal, n FROM al)"""


@query("h8_forecasts", f"{_FORECAST} SELECT * FROM fc")
def h8(spark, sf):
    return _forecasts(spark, sf)


@query("h9_duration_forecasts", f"{_FORECAST} SELECT * FROM fc".replace("WHERE days >= 2)", "WHERE days < 0)"))
def h9f(spark, sf):
    # Where no time pattern is known, all candidates fall back to durations.
    return C.forecast(_candidates(spark, sf), _patterns(spark, sf).where("false"), _durations(spark, sf), _END)


@query("h10_next_restorations", f"{_FORECAST} SELECT * FROM fc ORDER BY expected_at, entity LIMIT 3")
def h10(spark, sf):
    return C.next_restorations(_forecasts(spark, sf))


@query("h11_entity_brand", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_brand ELSE p_name END AS brand FROM part")
def h11(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.entity_brand(F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).otherwise(""), F.col("p_name")).alias("brand"))


@query("h12_forecast_window", f"WITH {V.TICKS} SELECT entity, count(*) AS ticks FROM ticks WHERE tick >= {_END} - least(90, 28) * 1440 GROUP BY 1")
def h12(spark, sf):
    return joins.in_forecast_window(V.ticks(spark, sf), _END).groupBy("entity").agg(F.count("*").alias("ticks"))


# J: the join patterns on the order tables; F: dedupe.
@query("j1_member_evidence", "SELECT o_custkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j1(spark, sf):
    members = table(spark, sf, "orders").select(F.col("o_orderkey").alias("member"), F.col("o_custkey").alias("entity"))
    evidence = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("member"), "l_extendedprice")
    found = joins.member_evidence(members, evidence).groupBy("entity").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return found.withColumnRenamed("entity", "o_custkey")


@query("j2_enumerated_semi_join", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def j2(spark, sf):
    return joins.enumerated(table(spark, sf, "labels").select("doc_id", "quality"), table(spark, sf, "documents").where("lang = 'en'"), ["doc_id"])


@query("j5_previous_row", f"WITH {V.TICKS} SELECT entity, tick, lag(verdict) OVER (PARTITION BY entity ORDER BY tick) AS before FROM ticks")
def j5(spark, sf):
    return joins.latest_before(V.ticks(spark, sf), ["verdict"]).select("entity", "tick", F.col("before_verdict").alias("before"))


@query("j7_dictionary_lookup", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def j7(spark, sf):
    found = joins.looked_up(table(spark, sf, "customer").select("c_nationkey"), table(spark, sf, "nation"), "c_nationkey", "n_nationkey", ["n_name"])
    return found.where("n_name is not null").groupBy("n_name").agg(F.count("*").alias("customers"))


@query("a9_idempotent_append", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def a9(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("fetched_at"), F.lit("a").alias("area"), F.lit("q").alias("query"))
    l = table(spark, sf, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("fetched_at"), F.lit("a").alias("area"), F.lit("q").alias("query"))
    return store.new_ticks(o, l).select(F.col("fetched_at").alias("o_orderkey"))
