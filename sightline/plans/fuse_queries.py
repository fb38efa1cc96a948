"""E: evidence fusion on observations shaped from `events`, with "now" fixed at a time inside the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import fuse as U
from sightline.params import Params
from sightline.plans import views as V
from sightline.plans.register import query

NOW = V.NOW
#: The given events are hours apart, so the limits are a day where the defaults are minutes.
P = Params(fresh_minutes=1440, recent_minutes=2880, stale_minutes=5760, expire_minutes=5760, conflict_window_minutes=720, resume_window_minutes=1440, quiet_gap_minutes=2880)
PRODUCTS = ["p0", "p1", "p2"]


def _case(column, **names):
    out = F.lit(None)
    for key, value in names.items():
        out = F.when(column == key, value).otherwise(out)
    return out


def observations(spark, sf):
    e = V.events(spark, sf).where(F.col("t") <= NOW + 300)
    source = F.element_at(F.array(*[F.lit(s) for s in V.SOURCES]), (F.col("event_id") % 4 + 1).cast("int"))
    age = F.greatest(F.lit(0), F.floor((NOW - F.col("t")) / 60))
    k5, k7 = F.col("event_id") % 5, F.col("event_id") % 7
    return e.select(
        "event_id", "entity", F.when(F.col("k") % 4 == 3, "unknown").otherwise(F.concat(F.lit("p"), (F.col("k") % 4).cast("string"))).alias("product"),
        F.when(k7 == 0, "FAMILY_ONLY").when(k7 == 1, "CATALOG_ONLY").otherwise("EXACT_VARIANT").alias("specificity"),
        _case(F.col("event_type"), purchase="IN_STOCK", click="LIMITED", error="OUT_OF_STOCK", view="UNCERTAIN", signup="UNKNOWN").alias("status"),
        source.alias("source"), F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string")).alias("provenance"), ((F.col("event_type") == "error") & (k7 == 0)).alias("family_all"),
        (F.col("value") / 10).alias("signals"), F.when(k5 == 0, "UNKNOWN").when(k5 == 1, "BOUNDED_AGE").otherwise("EXACT").alias("time_kind"), F.col("t").alias("at"),
        F.floor(age / 2).alias("min_minutes"), (age + F.col("k")).alias("max_minutes"),
    )


OBS = V.EVENTS + f""", obs AS (
  SELECT event_id, entity, CASE WHEN k % 4 = 3 THEN 'unknown' ELSE 'p' || (k % 4) END AS product, CASE event_id % 7 WHEN 0 THEN 'FAMILY_ONLY' WHEN 1 THEN 'CATALOG_ONLY' ELSE 'EXACT_VARIANT' END AS specificity,
         CASE event_type WHEN 'purchase' THEN 'IN_STOCK' WHEN 'click' THEN 'LIMITED' WHEN 'error' THEN 'OUT_OF_STOCK' WHEN 'view' THEN 'UNCERTAIN' ELSE 'UNKNOWN' END AS status,
         ['alpha', 'beta', 'gamma', 'delta'][event_id % 4 + 1] AS source, 'g' || (event_id % 3) AS provenance, event_type = 'error' AND event_id % 7 = 0 AS family_all, value / 10 AS signals,
         CASE event_id % 5 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'BOUNDED_AGE' ELSE 'EXACT' END AS time_kind, t AS at, greatest(0, ({NOW} - t) // 60) // 2 AS min_minutes, greatest(0, ({NOW} - t) // 60) + k AS max_minutes
  FROM e WHERE t <= {NOW} + 300
), aged AS (
  SELECT *, CASE WHEN time_kind = 'EXACT' AND at <= {NOW} + 120 THEN greatest(0.0::DOUBLE, ({NOW} - at) / 60.0::DOUBLE) WHEN time_kind = 'BOUNDED_AGE' THEN max_minutes::DOUBLE END AS age,
         CASE WHEN time_kind = 'EXACT' AND at <= {NOW} + 120 THEN at::DOUBLE WHEN time_kind = 'BOUNDED_AGE' THEN {NOW} - max_minutes * 60.0::DOUBLE END AS observed FROM obs
), ev AS (
  SELECT *, CASE WHEN age IS NULL THEN CASE WHEN time_kind = 'UNKNOWN' THEN 'unknown' ELSE 'invalid' END WHEN age <= 1440 THEN 'fresh' WHEN age <= 2880 THEN 'recent' WHEN age <= 5760 THEN 'stale' ELSE 'expired' END AS band,
         coalesce(age <= 5760, false) AS usable, time_kind = 'BOUNDED_AGE' AND age IS NOT NULL AS approximate FROM aged
), sg AS (
  SELECT *, usable AND specificity = 'EXACT_VARIANT' AND status IN ('IN_STOCK', 'LIMITED') AS positive, usable AND status = 'OUT_OF_STOCK' AND (specificity = 'EXACT_VARIANT' OR family_all) AS negative,
         usable AND specificity = 'FAMILY_ONLY' AND status IN ('IN_STOCK', 'LIMITED') AS family_positive FROM ev)"""


@query("e1_freshness", f"WITH {OBS} SELECT event_id, band, usable, approximate, round(age, 3) AS age FROM sg")
def e1(spark, sf):
    return U.enrich(observations(spark, sf), NOW, P).select("event_id", "band", "usable", "approximate", F.round("age", 3).alias("age"))


@query("e2_fresh_conflicts", f"""WITH {OBS} SELECT DISTINCT a.entity, a.product FROM sg a JOIN sg b ON a.entity = b.entity AND a.product = b.product AND a.positive AND b.negative AND a.band = 'fresh' AND b.band = 'fresh'
AND abs(a.observed - b.observed) <= 43200""")
def e2(spark, sf):
    return U.fresh_conflicts(U.enrich(observations(spark, sf), NOW, P), ["entity", "product"], P)


def timelines(spark, sf):
    e = V.events(spark, sf).where("event_type in ('click', 'purchase', 'view')").where(F.col("t") <= NOW + 300)
    return e.groupBy("entity", F.concat(F.lit("p"), (F.col("k") % 4).cast("string")).alias("product")).agg(F.collect_list("t").alias("event_times")).select("entity", F.when(F.col("product") == "p3", "unknown").otherwise(F.col("product")).alias("product"), "event_times", (F.col("entity") % 10 != 0).alias("grade_specific"), F.lit("RECENT_SIGNAL").alias("kind"), F.when(F.col("entity") % 3 == 0, 5000.0).alias("preceding_gap_minutes"))


ACT = f"""tl AS (
  SELECT entity, CASE WHEN k % 4 = 3 THEN 'unknown' ELSE 'p' || (k % 4) END AS product, max(t) FILTER (t <= {NOW} + 120) AS last, min(t) FILTER ({NOW} - t <= 86400 AND t <= {NOW} + 120) AS first_recent, count(*) FILTER ({NOW} - t <= 86400 AND t <= {NOW} + 120) AS recent,
         max(t) FILTER ({NOW} - t > 86400) AS before, entity % 10 <> 0 AS grade_specific, CASE WHEN entity % 3 = 0 THEN 5000.0 END AS given
  FROM e WHERE event_type IN ('click', 'purchase', 'view') AND t <= {NOW} + 300 GROUP BY ALL
), act AS (
  SELECT entity, product, CASE WHEN NOT grade_specific OR last IS NULL THEN 'RECENT_SIGNAL' WHEN recent >= 2 AND coalesce(gap >= 2880, false) THEN 'TRANSACTIONS_RESUMED' WHEN recent > 0 THEN 'TRANSACTIONS_ONGOING' ELSE 'RECENT_SIGNAL' END AS kind, grade_specific, first_recent, last
  FROM (SELECT *, CASE WHEN recent > 0 AND before IS NOT NULL THEN (first_recent - before) / 60.0 ELSE given END AS gap FROM tl))"""


def activity(spark, sf):
    d = U.derive_activity(timelines(spark, sf), NOW, P)
    return d.select("entity", "product", F.col("derived_kind").alias("kind"), "grade_specific", F.col("latest_event_at").alias("at"), "resumed_at")


@query("e8_activity_derivation", f"WITH {V.EVENTS}, {ACT} SELECT entity, product, kind, CASE WHEN kind = 'TRANSACTIONS_RESUMED' THEN first_recent END AS resumed_at, CASE WHEN kind = 'TRANSACTIONS_RESUMED' THEN last END AS latest_event_at FROM act")
def e8(spark, sf):
    return activity(spark, sf).select("entity", "product", "kind", "resumed_at", F.col("at").alias("latest_event_at"))


def assess_sql(p: str, keys: str, obs: str, act: str) -> str:
    """Common table expressions ending in {p}r (keys, verdict, rank, freshest_age, approximate, sources)."""
    names = keys.split(", ")
    on = " AND ".join(f"a.{k} = b.{k}" for k in names)
    using = f"USING ({keys})"
    return f"""{p}a AS (SELECT {keys}, max(observed) FILTER (positive) AS pos, max(observed) FILTER (negative) AS neg, bool_or(family_positive) AS fam, bool_or(usable) AS anyu, count(DISTINCT provenance) FILTER (positive AND band = 'fresh') AS prov,
 max(signals) FILTER (positive AND band = 'fresh') AS strong, count(*) FILTER (positive AND band = 'fresh') AS fresh, min(age) FILTER (usable) AS freshest_age, bool_or(usable AND approximate) AS approximate, string_agg(DISTINCT source, ',' ORDER BY source) FILTER (usable) AS sources FROM {obs} GROUP BY {keys}),
{p}s AS (SELECT {keys}, max(last) FILTER (last <= {NOW} + 120 AND {NOW} - last <= 345600) AS resumed, true AS ever FROM {act} WHERE kind = 'TRANSACTIONS_RESUMED' AND grade_specific GROUP BY {keys}),
{p}c AS (SELECT DISTINCT {", ".join("a." + k for k in names)}, true AS clash FROM {obs} a JOIN {obs} b ON {on} AND a.positive AND b.negative AND a.band = 'fresh' AND b.band = 'fresh' AND abs(a.observed - b.observed) <= 43200),
{p}v AS (SELECT *, CASE WHEN clash THEN 'CONFLICTING' WHEN pos IS NOT NULL AND (neg IS NULL OR pos > neg) THEN 'AVAILABLE' WHEN fam THEN 'LIKELY_AVAILABLE' WHEN abs(resumed - neg) <= 43200 THEN 'CONFLICTING' WHEN resumed IS NOT NULL AND (neg IS NULL OR resumed > neg) THEN 'LIKELY_AVAILABLE'
 WHEN neg IS NOT NULL AND (pos IS NULL OR neg > pos) THEN 'NOT_AVAILABLE' WHEN anyu THEN 'INDIRECT' ELSE 'NO_FRESH_DATA' END AS verdict FROM {p}a FULL JOIN {p}s {using} LEFT JOIN {p}c {using}),
{p}r AS (SELECT {keys}, verdict, CASE WHEN verdict = 'AVAILABLE' THEN CASE WHEN prov >= 2 OR strong >= 4 THEN 3 WHEN fresh > 0 OR ever THEN 2 ELSE 1 END WHEN verdict = 'LIKELY_AVAILABLE' AND NOT coalesce(fam, false) THEN 2 WHEN verdict = 'NOT_AVAILABLE' THEN 2 WHEN verdict = 'NO_FRESH_DATA' THEN 0 ELSE 1 END AS rank,
 freshest_age, coalesce(approximate, false) AS approximate, coalesce(sources, '') AS sources FROM {p}v)"""


_LABEL = "['NONE', 'LOW', 'MEDIUM', 'HIGH'][{} + 1]"


@query("e3_verdicts", f"WITH {OBS}, {ACT}, {assess_sql('x', 'entity, product', 'sg', 'act')} SELECT entity, product, verdict, {_LABEL.format('rank')} AS confidence FROM xr")
def e3(spark, sf):
    return U.assess(observations(spark, sf), activity(spark, sf), ["entity", "product"], NOW, P).select("entity", "product", "verdict", "confidence")


@query("e4_positive_confidence", f"WITH {OBS}, {ACT}, {assess_sql('x', 'entity, product', 'sg', 'act')} SELECT verdict, {_LABEL.format('rank')} AS confidence, count(*) AS n FROM xr GROUP BY ALL")
def e4(spark, sf):
    return U.assess(observations(spark, sf), activity(spark, sf), ["entity", "product"], NOW, P).groupBy("verdict", "confidence").agg(F.count("*").alias("n"))


@query("e6_compact_assessments", f"WITH {OBS}, {ACT}, {assess_sql('x', 'entity, product', 'sg', 'act')} SELECT entity, product, verdict, round(freshest_age, 3) AS freshest_age, approximate, sources FROM xr")
def e6(spark, sf):
    return U.assess(observations(spark, sf), activity(spark, sf), ["entity", "product"], NOW, P).select("entity", "product", "verdict", F.round("freshest_age", 3).alias("freshest_age"), "approximate", "sources")


_UNION = f"""{OBS}, {ACT}, sp AS (SELECT * EXCLUDE (slots), unnest(slots) AS slot FROM (SELECT *, CASE WHEN family_all AND specificity = 'FAMILY_ONLY' THEN list_distinct(['p0', 'p1', 'p2', product]) ELSE [product] END AS slots FROM sg)),
ac AS (SELECT *, product AS slot FROM act), {assess_sql('x', 'entity, slot', 'sp', 'ac')}, fo AS (SELECT * FROM sg WHERE specificity = 'FAMILY_ONLY'), fact AS (SELECT * FROM act WHERE entity IN (SELECT entity FROM fo)), {assess_sql('f', 'entity', 'fo', 'fact')},
w AS (SELECT xr.* FROM xr WHERE slot <> 'unknown' OR entity IN (SELECT entity FROM obs WHERE product = 'unknown')),
g AS (SELECT entity, max(rank) FILTER (verdict = 'AVAILABLE') AS av, max(rank) FILTER (verdict = 'LIKELY_AVAILABLE') AS li, max(rank) FILTER (verdict = 'CONFLICTING') AS co, count(*) FILTER (verdict = 'NOT_AVAILABLE' AND slot <> 'unknown') AS outs,
 min(rank) FILTER (verdict = 'NOT_AVAILABLE' AND slot <> 'unknown') AS weakest, bool_or(verdict = 'INDIRECT') AS indirect FROM w GROUP BY 1),
every AS (SELECT entity FROM obs UNION SELECT entity FROM act), gone AS (SELECT DISTINCT entity, true AS gone FROM fo WHERE family_all AND status = 'OUT_OF_STOCK' AND usable),
u AS (SELECT entity, CASE WHEN av IS NOT NULL THEN 'AVAILABLE' WHEN li IS NOT NULL OR fr.verdict = 'LIKELY_AVAILABLE' THEN 'LIKELY_AVAILABLE' WHEN co IS NOT NULL THEN 'CONFLICTING' WHEN gone OR outs = 3 THEN 'NOT_AVAILABLE' WHEN indirect OR fr.verdict = 'INDIRECT' THEN 'INDIRECT' ELSE 'NO_FRESH_DATA' END AS verdict,
 CASE WHEN av IS NOT NULL THEN av WHEN li IS NOT NULL THEN li WHEN fr.verdict = 'LIKELY_AVAILABLE' THEN fr.rank WHEN co IS NOT NULL THEN co WHEN gone THEN 2 WHEN outs = 3 THEN weakest WHEN indirect OR fr.verdict = 'INDIRECT' THEN 1 ELSE 0 END AS rank
 FROM every LEFT JOIN g USING (entity) LEFT JOIN fr USING (entity) LEFT JOIN gone USING (entity))"""


@query("e5_union_verdicts", f"WITH {_UNION} SELECT entity, verdict, {_LABEL.format('rank')} AS confidence FROM u")
def e5(spark, sf):
    return U.assess_union(observations(spark, sf), activity(spark, sf), PRODUCTS, "unknown", NOW, P)


@query("e7_strongest_weakest", f"""WITH {OBS}, {ACT}, {assess_sql('x', 'entity, product', 'sg', 'act')} SELECT entity, arg_max(product, (rank, -CAST(ascii(product[-1]) AS INT))) AS strongest, arg_min(product, (rank, CAST(ascii(product[-1]) AS INT))) AS weakest FROM xr GROUP BY 1""")
def e7(spark, sf):
    a = U.assess(observations(spark, sf), activity(spark, sf), ["entity", "product"], NOW, P).withColumns({"rank": U.confidence_rank(F.col("confidence")), "place": F.ascii(F.substring("product", -1, 1))})
    return a.groupBy("entity").agg(F.max_by("product", F.struct("rank", -F.col("place"))).alias("strongest"), F.min_by("product", F.struct("rank", "place")).alias("weakest"))


_TRANS = """r2 AS (SELECT entity, CASE WHEN event_id % 9 = 0 THEN NULL ELSE grade END AS grade, at, sign FROM reports),
tr AS (SELECT entity, grade, at, sign FROM r2 WHERE grade IS NOT NULL UNION ALL SELECT f.entity, g.grade, f.at, f.sign FROM r2 f JOIN (SELECT DISTINCT entity, grade FROM r2 WHERE grade IS NOT NULL) g ON f.entity = g.entity WHERE f.grade IS NULL AND f.sign = -1),
tb AS (SELECT *, last_value(CASE WHEN sign <> 0 THEN sign END IGNORE NULLS) OVER (PARTITION BY entity, grade ORDER BY at, sign ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tr),
trans AS (SELECT DISTINCT entity, grade, at FROM tb WHERE sign = 1 AND before = -1)"""


def _transitions(spark, sf):
    r = V.reports(spark, sf)
    return U.transitions(r.withColumn("grade", F.when(F.col("event_id") % 9 != 0, F.col("grade"))))


@query("e9_report_transitions", f"WITH {V.REPORTS}, {_TRANS} SELECT * FROM trans")
def e9(spark, sf):
    return _transitions(spark, sf)


def queues(spark, sf):
    e = V.events(spark, sf).where(F.col("t") <= NOW)
    kind = _case(F.col("event_type"), purchase="VEHICLES", click="ORDINAL", view="PRESENCE", error="TEXT", signup="TEXT")
    ordinal = F.element_at(F.array(*[F.lit(x) for x in ("NONE", "SHORT", "MEDIUM", "LONG", "VERY_LONG")]), (F.col("k") % 5 + 1).cast("int"))
    recent = e.where(F.col("t") > NOW - 86400)
    return recent.select("entity", kind.alias("kind"), F.when(F.col("k") % 3 > 0, F.col("k").cast("double")).alias("vehicle_count"), ordinal.alias("ordinal"), F.concat(F.lit("about "), F.col("k").cast("string")).alias("raw_value"), F.when(F.col("event_id") % 6 > 0, F.floor(F.col("t") / 3600) * 3600).alias("at"))


@query("e10_queue_fusion", f"""WITH {V.EVENTS}, q AS (SELECT entity, CASE event_type WHEN 'purchase' THEN 'VEHICLES' WHEN 'click' THEN 'ORDINAL' WHEN 'view' THEN 'PRESENCE' ELSE 'TEXT' END AS kind, CASE WHEN k % 3 > 0 THEN k::DOUBLE END AS vehicle_count, (k % 5)::INT AS o,
['NONE', 'SHORT', 'MEDIUM', 'LONG', 'VERY_LONG'][k % 5 + 1] AS ordinal, 'about ' || k AS raw_value, CASE WHEN event_id % 6 > 0 THEN t // 3600 * 3600 END AS at FROM e WHERE t <= {NOW} AND t > {NOW} - 86400),
z AS (SELECT *, CASE WHEN kind = 'VEHICLES' AND vehicle_count IS NOT NULL THEN 0 WHEN kind = 'ORDINAL' THEN 1 WHEN kind = 'PRESENCE' THEN 2 ELSE 3 END AS c, CASE WHEN at IS NULL THEN 1e15 ELSE ({NOW} - at) / 60.0::DOUBLE END AS age FROM q),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY entity ORDER BY c, age, o, vehicle_count NULLS FIRST, ordinal, raw_value) = 1)
SELECT entity, c < 2 AS comparable, CASE WHEN c = 0 THEN vehicle_count END AS vehicle_count, CASE WHEN c = 1 THEN ordinal END AS ordinal, CASE WHEN c < 2 AND age < 1e15 THEN age END AS freshest_age, CASE WHEN c = 3 THEN raw_value END AS text FROM b""")
def e10(spark, sf):
    return U.fuse_queues(queues(spark, sf), NOW)


@query("e11_catalogue", f"""WITH {V.EVENTS}, m AS (SELECT entity, CASE WHEN event_type = 'signup' THEN NULL ELSE ['9' || (k % 4), '9' || (k % 7)] END AS a FROM e WHERE t > {NOW} - 86400 AND t <= {NOW}),
u AS (SELECT entity, list_sort(list_distinct(flatten(list(a) FILTER (a IS NOT NULL)))) AS l FROM m GROUP BY 1) SELECT entity, array_to_string(l, ',') AS assortment, CASE WHEN l IS NULL THEN NULL ELSE list_has_any(l, ['95', '92']) END AS sells_requested FROM u""")
def e11(spark, sf):
    e = V.events(spark, sf).where((F.col("t") > NOW - 86400) & (F.col("t") <= NOW))
    grade = lambda m: F.concat(F.lit("9"), (F.col("k") % m).cast("string"))
    members = e.select("entity", F.when(F.col("event_type") != "signup", F.array(grade(4), grade(7))).alias("assortment"))
    return U.catalogue(members, ["95", "92"]).withColumn("assortment", F.array_join("assortment", ","))


@query("e12_tightest_limit", f"""WITH {V.EVENTS}, l AS (SELECT entity, CASE WHEN k % 3 = 0 THEN NULL ELSE '9' || (k % 4 + 3) END AS grade, (k - 5)::DOUBLE AS liters, CASE WHEN event_type IN ('click', 'view') THEN t END AS observed_at, CASE WHEN event_type = 'signup' THEN t END AS in_force_since,
['alpha', 'beta', 'gamma', 'delta'][event_id % 4 + 1] AS source FROM e WHERE t <= {NOW}), f AS (SELECT * FROM l WHERE (in_force_since IS NOT NULL OR observed_at IS NOT NULL AND {NOW} - observed_at <= 345600) AND (grade IS NULL OR grade = '95') AND liters > 0),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY entity ORDER BY liters, coalesce(observed_at, 0), source) = 1) SELECT entity, liters, source, CASE WHEN {NOW} - observed_at > 86400 THEN ({NOW} - observed_at) / 60.0::DOUBLE END AS shown_age FROM b""")
def e12(spark, sf):
    e = V.events(spark, sf).where(F.col("t") <= NOW)
    source = F.element_at(F.array(*[F.lit(s) for s in V.SOURCES]), (F.col("event_id") % 4 + 1).cast("int"))
    limits = e.select("entity", F.when(F.col("k") % 3 != 0, F.concat(F.lit("9"), (F.col("k") % 4 + 3).cast("string"))).alias("grade"), (F.col("k") - 5).cast("double").alias("liters"), F.when(F.col("event_type").isin("click", "view"), F.col("t")).alias("observed_at"), F.when(F.col("event_type") == "signup", F.col("t")).alias("in_force_since"), source.alias("source"))
    return U.tightest_limit(limits, "95", NOW, P)


@query("e13_support", f"WITH {OBS} SELECT entity, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n_sources, round(min(age), 3) AS age FROM sg WHERE usable AND status IN ('IN_STOCK', 'LIMITED') AND specificity IN ('EXACT_VARIANT', 'FAMILY_ONLY') GROUP BY 1")
def e13(spark, sf):
    return U.support(observations(spark, sf), NOW, P).withColumn("age", F.round("age", 3))


@query("e14_latest_cluster", f"""WITH {V.REPORTS}, {_TRANS}, lv AS (SELECT * FROM trans WHERE at <= {NOW} + 120 AND {NOW} - at <= 345600), o AS (SELECT *, CASE WHEN at - lag(at) OVER (PARTITION BY entity ORDER BY at) > 7200 THEN 1 ELSE 0 END AS opens FROM lv),
n AS (SELECT *, sum(opens) OVER (PARTITION BY entity ORDER BY at) AS s FROM o), c AS (SELECT entity, s, min(at) AS first, max(at) AS last, count(*) AS n, string_agg(DISTINCT grade::VARCHAR, ',' ORDER BY grade::VARCHAR) AS grades FROM n GROUP BY 1, 2)
SELECT entity, first, last, n, grades FROM c QUALIFY row_number() OVER (PARTITION BY entity ORDER BY s DESC) = 1""")
def e14(spark, sf):
    return U.latest_cluster(_transitions(spark, sf), NOW, P)
