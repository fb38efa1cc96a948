"""D: entity resolution of `customer` and `supplier` as two sources of stations, and identity over shared tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import resolve as R
from sightline.plans.register import query
from sightline.plans.spatial_queries import hav
from sightline.tables import table


def stations(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("c").alias("source"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("s").alias("source"))
    b = c.unionByName(s)
    place, n = F.col("k") % 1000, F.col("k") * 7919 % 1000
    brand = F.when(F.col("k") % 11 == 0, "brand-id:9").otherwise(F.concat(F.lit("brand "), (place % 7).cast("string")))
    house = place.cast("string")
    return b.select(
        "k", "source", F.when(F.col("k") % 50 > 0, F.col("k").cast("string")).alias("station"), F.concat(F.lit("station "), (place % 9).cast("string")).alias("title"), brand.alias("brand"),
        F.when(F.col("k") % 11 == 0, "").otherwise(brand).alias("comparable"), F.concat(F.lit("street "), (place % 5).cast("string"), F.lit(" "), house).alias("norm"), house.alias("house"),
        F.when(F.col("k") % 13 == 0, F.create_map(F.lit("корпус"), F.col("source"))).otherwise(F.create_map().cast("map<string,string>")).alias("units"),
        (44.40 + n / 5000 + F.when(F.col("source") == "s", 0.0001).otherwise(0.0)).alias("lon"), (48.65 + (F.col("k") * 104729 % 1000) / 5000).alias("lat"),
    ).withColumn("member", F.concat("source", F.lit(":"), F.coalesce("station", F.concat(F.lit("x"), F.col("k").cast("string")))))


STATIONS = """b AS (SELECT c_custkey AS k, 'c' AS source FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier),
st AS (SELECT source, CASE WHEN k % 50 > 0 THEN k::VARCHAR END AS station, k, 'station ' || (k % 1000) % 9 AS title, CASE WHEN k % 11 = 0 THEN 'brand-id:9' ELSE 'brand ' || (k % 1000) % 7 END AS brand, CASE WHEN k % 11 = 0 THEN '' ELSE 'brand ' || (k % 1000) % 7 END AS comparable,
'street ' || (k % 1000) % 5 || ' ' || k % 1000 AS norm, (k % 1000)::VARCHAR AS house, CASE WHEN k % 13 = 0 THEN source END AS unit, 44.40::DOUBLE + (k * 7919 % 1000)::DOUBLE / 5000 + CASE source WHEN 's' THEN 0.0001::DOUBLE ELSE 0 END AS lon, 48.65::DOUBLE + (k * 104729 % 1000)::DOUBLE / 5000 AS lat, source || ':' || CASE WHEN k % 50 > 0 THEN k::VARCHAR ELSE 'x' || k END AS member FROM b)"""


@query("d1_initial_keys", f"WITH {STATIONS} SELECT source, k, station, CASE WHEN k % 100 = 7 THEN 'manual:m' || k % 1000 WHEN station IS NOT NULL THEN 'source:' || source || ':' || k ELSE 'anon:' || left(sha256(comparable || '|' || norm || '|' || lon::VARCHAR || '|' || lat::VARCHAR), 20) END AS key FROM st")
def d1(spark, sf):
    s = stations(spark, sf)
    overrides = s.where("k % 100 = 7").select("member", F.concat(F.lit("m"), "house").alias("manual"))
    return R.initial_keys(s, overrides).select("source", "k", "station", "key")


_DIST = hav("a.lon", "a.lat", "b.lon", "b.lat")
_JAC = "len(list_intersect(string_split(a.{0}, ' '), string_split(b.{0}, ' '))) / len(list_distinct(list_concat(string_split(a.{0}, ' '), string_split(b.{0}, ' '))))"


PAIRS = f"""near AS (SELECT a.member AS a, b.member AS b, {_DIST} AS d, a.comparable <> '' AND a.comparable = b.comparable AS same, {_JAC.format('norm')} AS ja, {_JAC.format('title')} AS jt, a.norm = b.norm AS eq
FROM st a JOIN st b ON a.member < b.member AND abs(a.lat - b.lat) < 0.002 AND abs(a.lon - b.lon) < 0.003 WHERE a.comparable <> '' AND b.comparable <> '' AND a.comparable = b.comparable AND a.house = b.house AND NOT coalesce(a.unit <> b.unit, false)),
pair AS (SELECT a, b, CASE WHEN eq AND d <= 5 THEN 1.2 ELSE 0.45 * (1 - d / 100) + 0.4 * ja + 0.15 * greatest(jt, same::INT) END AS score FROM near WHERE d <= 100)"""


@query("d3_pair_scores", f"WITH {STATIONS}, {PAIRS} SELECT a, b, round(score, 6) AS score FROM pair")
def d3(spark, sf):
    return R.pair_scores(stations(spark, sf), digits=6)


def _resolved(spark, sf, first=None):
    s = stations(spark, sf)
    keyed = R.initial_keys(s, s.where("k % 100 = 7").select("member", F.concat(F.lit("m"), "source", F.col("k").cast("string")).alias("manual")))
    return keyed, *R.resolve(keyed, first=first)


# The greedy merge for these two sources, a place at a time (pairs share their house number). A merged group has both
# sources, so it takes no part in later steps: a pair's rivals are the unmerged pairs that share one of its groups.
MERGED = f"""{STATIONS}, {PAIRS},
kd AS (SELECT *, CASE WHEN k % 100 = 7 THEN 'manual:m' || source || k WHEN station IS NOT NULL THEN 'source:' || source || ':' || k ELSE 'anon:' || left(sha256(comparable || '|' || norm || '|' || lon::VARCHAR || '|' || lat::VARCHAR), 20) END AS key FROM st),
g0 AS (SELECT key, min(member) AS first, min(source) AS source, min(house) AS house, list(member ORDER BY member) AS members FROM kd GROUP BY 1),
gm AS (SELECT first, source, house, key, members, unnest(members) AS member FROM g0),
cand AS (SELECT x.house, x.first AS i, y.first AS j, min(score) AS s, array_to_string(list_sort(list_concat(any_value(x.members), any_value(y.members))), ',') AS name FROM pair JOIN gm x ON x.member = a JOIN gm y ON y.member = b
 WHERE x.source < y.source AND NOT (x.key LIKE 'manual:%' AND y.key LIKE 'manual:%') GROUP BY 1, 2, 3 HAVING count(*) = len(any_value(x.members)) * len(any_value(y.members))),
step AS (SELECT DISTINCT house, 0 AS n, []::VARCHAR[] AS used, []::VARCHAR[] AS doubts, true AS more FROM cand UNION ALL
 SELECT house, n + 1, list_concat(used, CASE WHEN pick IS NULL THEN [] ELSE [pick[1], pick[2]] END), list_concat(doubts, coalesce(list(name) FILTER (weak AND (pick IS NULL OR (i, j) < pick)), [])), pick IS NOT NULL
 FROM (SELECT *, min((i, j)) FILTER (s >= 0.82 AND NOT weak) OVER (PARTITION BY house) AS pick
  FROM (SELECT *, s >= 0.82 AND s - greatest(coalesce(max(s) OVER (PARTITION BY house, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 0), coalesce(max(s) OVER (PARTITION BY house, j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 0)) < 0.18 AS weak
   FROM (SELECT step.*, i, j, s, name FROM step JOIN cand USING (house) WHERE more AND NOT list_contains(used, i) AND NOT list_contains(used, j)))) GROUP BY house, n, used, doubts, pick),
last AS (SELECT house, arg_max(used, n) AS used, arg_max(doubts, n) AS doubts FROM step GROUP BY 1),
join2 AS (SELECT used[2 * q - 1] AS i, used[2 * q] AS j FROM (SELECT used, unnest(range(1, len(used) // 2 + 1)) AS q FROM last)),
grp AS (SELECT coalesce(join2.i, gm.first) AS g, gm.member, gm.key FROM gm LEFT JOIN join2 ON gm.first = join2.j)"""


@query("d5_greedy_merge", f'WITH RECURSIVE {MERGED} SELECT g AS "group", member FROM grp')
def d5(spark, sf):
    return _resolved(spark, sf)[1]


@query("d6_stable_keys", f"""WITH RECURSIVE {MERGED}, agg AS (SELECT g, max(key) FILTER (key LIKE 'manual:%') AS manual, count(DISTINCT old) AS n, min(old) AS old, count(*) AS size, min(grp.key) AS single, left(sha256(to_json(list(member ORDER BY member))::VARCHAR), 20) AS hash
 FROM (SELECT grp.*, CASE WHEN k % 3 = 0 THEN 'old:' || house END AS old FROM grp JOIN st USING (member)) grp GROUP BY 1),
won AS (SELECT *, n = 1 AND g = min(g) FILTER (manual IS NULL AND n = 1) OVER (PARTITION BY old) AS won FROM agg)
SELECT g AS "group", CASE WHEN manual IS NOT NULL THEN manual WHEN won THEN old WHEN size = 1 THEN single ELSE 'merged:' || hash END AS station_key, CASE WHEN manual IS NOT NULL THEN 'MANUAL' WHEN won THEN 'PREVIOUS_MEMBER' WHEN size = 1 THEN 'SOURCE_ID' ELSE 'HIGH' END AS confidence FROM won""")
def d6(spark, sf):
    keyed, groups, _ = _resolved(spark, sf)
    previous = keyed.where("k % 3 = 0").select("member", F.concat(F.lit("old:"), "house").alias("previous"))
    return R.stable_keys(groups, keyed, previous)


@query("d7_canonical_fields", f"WITH {STATIONS}, g AS (SELECT house, arg_min(title, (CASE source WHEN 's' THEN 0 ELSE 1 END, source, member)) AS title, arg_min(brand, (CASE source WHEN 's' THEN 0 ELSE 1 END, source, member)) AS brand FROM st GROUP BY 1) SELECT * FROM g")
def d7(spark, sf):
    s = stations(spark, sf)
    out = R.canonical(s.select(F.col("house").alias("group"), "member"), s, ["s", "c"])
    return out.select(F.col("group").alias("house"), "title", "brand")


@query("d8_identity_diagnostics", f"""WITH RECURSIVE {MERGED}, found AS (SELECT 'OPAQUE_BRAND' AS kind, member AS subject FROM st WHERE brand <> '' AND comparable = '' UNION SELECT 'AMBIGUOUS_MATCH', unnest(doubts) FROM last)
SELECT kind, subject FROM found ORDER BY kind DESC, subject LIMIT 100""")
def d8(spark, sf):
    keyed, _, doubts = _resolved(spark, sf, 100)
    return R.diagnostics(keyed, doubts, 100)


@query("d9_historical_identity", """WITH RECURSIVE t AS (SELECT c_custkey::VARCHAR AS record, 'a' || floor(c_acctbal / 20) AS token FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'n' || c_nationkey || c_mktsegment || c_custkey // 40 FROM customer),
g AS (SELECT DISTINCT a.record AS u, b.record AS v FROM t a JOIN t b ON a.token = b.token), r AS (SELECT u, v FROM g UNION SELECT r.u, g.v FROM r JOIN g ON r.v = g.u) SELECT u AS record, min(v) AS entity FROM r GROUP BY 1""")
def d9(spark, sf):
    c = table(spark, sf, "customer")
    rec = F.col("c_custkey").cast("string").alias("record")
    a = c.select(rec, F.concat(F.lit("a"), F.floor(F.col("c_acctbal") / 20).cast("string")).alias("token"))
    n = c.select(rec, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), "c_mktsegment", F.floor(F.col("c_custkey") / 40).cast("string")).alias("token"))
    return R.historical_identity(a.unionByName(n))
