"""C and J3: areas and distances, on stations with coordinates derived from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions.columns import haversine
from sightline.operators import evidence_filters as E, spatial as S
from sightline.plans import fuse_queries as Q, views as V
from sightline.plans.register import query
from sightline.tables import Scratch, table

#: Areas of the queries.
BOX = (44.43, 48.68, 44.52, 48.79)
RINGS = [[(44.41, 48.66), (44.55, 48.70), (44.50, 48.75), (44.56, 48.80), (44.42, 48.83)], [(44.45, 48.72), (44.48, 48.72), (44.48, 48.76), (44.45, 48.76)]]
ROUTE = [(44.40, 48.66), (44.47, 48.72), (44.47, 48.80), (44.58, 48.84)]
CENTRE = (44.5, 48.75)


def stations(spark, sf, name="customer", key="c_custkey"):
    k = F.col(key)
    return table(spark, sf, name).select(k.alias("id"), (44.40 + (k * 7919 % 1000) / 5000).alias("lon"), (48.65 + (k * 104729 % 1000) / 5000).alias("lat"), F.lit(name).alias("source"))


ST = """c AS (SELECT c_custkey AS id, 44.40::DOUBLE + (c_custkey * 7919 % 1000)::DOUBLE / 5000 AS lon, 48.65::DOUBLE + (c_custkey * 104729 % 1000)::DOUBLE / 5000 AS lat FROM customer),
s AS (SELECT s_suppkey AS id, 44.40::DOUBLE + (s_suppkey * 7919 % 1000)::DOUBLE / 5000 AS lon, 48.65::DOUBLE + (s_suppkey * 104729 % 1000)::DOUBLE / 5000 AS lat FROM supplier)"""


def hav(a, b, c, d):
    h = f"(pow(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2))"
    return f"(2 * 6371008.8::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})))"


def edges_sql(sides, name):
    rows = ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" for v in s) + ")" for s in sides)
    return f"{name}(x1, y1, x2, y2) AS (VALUES {rows})"


INSIDE = """(count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / CASE WHEN y2 <> y1 THEN y2 - y1 ELSE 1.0 END + x1) % 2 = 1
 OR bool_or(abs((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)) < 1e-12 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)))"""
_K = f"{S.METRES_PER_DEGREE!r}::DOUBLE"
_AX, _AY, _BX, _BY = f"((x1 - lon) * cos(radians(lat)) * {_K})", f"((y1 - lat) * {_K})", f"((x2 - lon) * cos(radians(lat)) * {_K})", f"((y2 - lat) * {_K})"
DIST = f"""(SELECT sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)) FROM (SELECT ax, ay, dx, dy, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE 0.0 END AS t
 FROM (SELECT {_AX} AS ax, {_AY} AS ay, {_BX} - {_AX} AS dx, {_BY} - {_AY} AS dy)))"""


@query("c1_haversine", f"WITH {ST} SELECT id, round({hav('lon', 'lat', '44.5', '48.75')}, 3) AS metres FROM c")
def c1(spark, sf):
    return stations(spark, sf).select("id", F.round(haversine(F.col("lon"), F.col("lat"), F.lit(CENTRE[0]), F.lit(CENTRE[1])), 3).alias("metres"))


@query("c2_rectangle", f"WITH {ST} SELECT id FROM c WHERE lon BETWEEN 44.43 AND 44.52 AND lat BETWEEN 48.68 AND 48.79")
def c2(spark, sf):
    return stations(spark, sf).where(S.in_rectangle(F.col("lon"), F.col("lat"), *BOX)).select("id")


_POLY = edges_sql(S.edges(RINGS), "p")


@query("c3_point_in_polygon", f"WITH {ST}, {_POLY} SELECT id, {INSIDE} AS inside FROM c CROSS JOIN p GROUP BY id, lon, lat")
def c3(spark, sf):
    return stations(spark, sf).select("id", S.in_polygon(F.col("lon"), F.col("lat"), RINGS).alias("inside"))


def areas(spark, sf):
    return stations(spark, sf).withColumn("area", F.concat(F.lit("a"), (F.col("id") % 40).cast("string"))).select("area", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"))


# Corners of the areas' hulls: ends of a side that has every other point on its left or on itself. Coordinates between
# 32 and 64 are whole multiples of 2^-47, so the turns are worked out in integers.
HULLS = f"""{ST}, pt AS (SELECT DISTINCT 'a' || id % 40 AS area, round(lon, 4) AS lon, round(lat, 4) AS lat, (round(lon, 4) * 140737488355328::DOUBLE)::HUGEINT AS x, (round(lat, 4) * 140737488355328::DOUBLE)::HUGEINT AS y FROM c),
sd AS (SELECT a.area, a.x AS a_x, a.y AS a_y, b.x AS b_x, b.y AS b_y FROM pt a JOIN pt b ON a.area = b.area AND (a.x, a.y) <> (b.x, b.y)),
side AS (SELECT area, a_x, a_y, b_x, b_y FROM (SELECT sd.*, x, y, (b_x - a_x) * (y - a_y) - (b_y - a_y) * (x - a_x) AS t FROM sd JOIN pt USING (area)) GROUP BY area, a_x, a_y, b_x, b_y HAVING bool_and(t > 0 OR t = 0 AND x BETWEEN least(a_x, b_x) AND greatest(a_x, b_x) AND y BETWEEN least(a_y, b_y) AND greatest(a_y, b_y))),
corner AS (SELECT pt.* FROM pt SEMI JOIN side ON pt.area = side.area AND pt.x = side.a_x AND pt.y = side.a_y),
ends AS (SELECT area, min((x, y)) AS lo, max((x, y)) AS hi FROM corner GROUP BY 1),
up AS (SELECT corner.*, (hi[1] - lo[1]) * (y - lo[2]) - (hi[2] - lo[2]) * (x - lo[1]) > 0 AS up FROM corner JOIN ends USING (area)),
hull AS (SELECT area, (row_number() OVER (PARTITION BY area ORDER BY up, CASE WHEN up THEN -x ELSE x END, CASE WHEN up THEN -y ELSE y END) - 1)::INT AS place, lon, lat FROM up)"""


@query("c4_convex_hulls", f"WITH {HULLS} SELECT area, place, lon, lat FROM hull")
def c4(spark, sf):
    return S.convex_hulls(areas(spark, sf))


@query("c5_buffered_polygon", f"WITH {ST}, {_POLY}, d AS (SELECT id, lon, lat, {DIST} AS d, x1, y1, x2, y2 FROM c CROSS JOIN p) SELECT id FROM d GROUP BY id, lon, lat HAVING {INSIDE} OR min(d) <= 400")
def c5(spark, sf):
    return stations(spark, sf).where(S.in_buffered_polygon(F.col("lon"), F.col("lat"), RINGS, 400)).select("id")


@query("c6_route_corridor", f"WITH {ST}, {edges_sql(S.edges([ROUTE], False), 'p')} SELECT id FROM (SELECT id, {DIST} AS d FROM c CROSS JOIN p) GROUP BY id HAVING min(d) <= 750")
def c6(spark, sf):
    return stations(spark, sf).where(S.in_corridor(F.col("lon"), F.col("lat"), ROUTE, 1500)).select("id")


_SIDE = "sign(({1}_x - {0}_x) * ({2}_y - {0}_y) - ({1}_y - {0}_y) * ({2}_x - {0}_x))"


@query("c7_area_rejects", f"""WITH {HULLS}, odd AS (SELECT area, CASE WHEN substr(area, 2)::INT % 4 = 0 THEN place * 2 % 5 * 100 + place ELSE place END AS place, lon, lat FROM hull),
ring AS (SELECT area, row_number() OVER w AS i, count(*) OVER (PARTITION BY area) AS n, lon AS px, lat AS py, coalesce(lead(lon) OVER w, first(lon) OVER w) AS qx, coalesce(lead(lat) OVER w, first(lat) OVER w) AS qy FROM odd WINDOW w AS (PARTITION BY area ORDER BY place)),
size AS (SELECT area, abs(sum(px * qy - qx * py)) / 2 * cos(radians(avg(py))) * pow({_K} / 1000, 2) AS km2 FROM ring GROUP BY 1),
two AS (SELECT a.area, a.px AS a_x, a.py AS a_y, a.qx AS b_x, a.qy AS b_y, b.px AS c_x, b.py AS c_y, b.qx AS d_x, b.qy AS d_y FROM ring a JOIN ring b ON a.area = b.area AND b.i >= a.i + 2 AND NOT (a.i = 1 AND b.i = b.n)),
cut AS (SELECT DISTINCT area FROM two WHERE {_SIDE.format('a', 'b', 'c')} * {_SIDE.format('a', 'b', 'd')} < 0 AND {_SIDE.format('c', 'd', 'a')} * {_SIDE.format('c', 'd', 'b')} < 0),
why AS (SELECT area, CASE WHEN area IN (FROM cut) THEN 'SELF_CROSSING' WHEN km2 <= 1e-9 THEN 'EMPTY' WHEN km2 > 2000 THEN 'TOO_LARGE' WHEN km2 > CASE WHEN substr(area, 2)::INT % 3 = 0 THEN 120 ELSE 1000 END THEN 'ABOVE_CEILING' END AS reason FROM size)
SELECT * FROM why WHERE reason IS NOT NULL""")
def c7(spark, sf):
    corners = S.convex_hulls(areas(spark, sf))
    # Every fourth area's corners are put out of order, so that its ring crosses itself.
    odd = corners.withColumn("place", F.when(F.substring("area", 2, 9).cast("int") % 4 == 0, F.pmod(F.col("place") * 2, F.lit(5)) * 100 + F.col("place")).otherwise(F.col("place")))
    ceilings = corners.select("area").distinct().select("area", F.when(F.substring("area", 2, 9).cast("int") % 3 == 0, 120.0).otherwise(1000.0).alias("max_km2"))
    return S.area_rejects(odd, ceilings)


# The mean of a convex ring's corners is inside it.
@query("c8_reference_points", f"WITH {HULLS} SELECT area, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM hull GROUP BY 1")
def c8(spark, sf):
    return S.reference_points(S.convex_hulls(areas(spark, sf))).select("area", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


_RING = "side_of AS (SELECT area, lon AS x1, lat AS y1, coalesce(lead(lon) OVER w, first(lon) OVER w) AS x2, coalesce(lead(lat) OVER w, first(lat) OVER w) AS y2 FROM hull WINDOW w AS (PARTITION BY area ORDER BY place))"


@query("c3_points_in_areas", f"WITH {HULLS}, {_RING} SELECT id, area FROM (SELECT c.id, area, lon, lat, x1, y1, x2, y2 FROM c CROSS JOIN side_of) GROUP BY id, area, lon, lat HAVING {INSIDE}")
def c3_areas(spark, sf):
    return S.in_areas(stations(spark, sf), S.convex_hulls(areas(spark, sf)), Scratch(spark, "areas"))


@query("c5_points_near_areas", f"WITH {HULLS}, {_RING}, d AS (SELECT id, area, lon, lat, {DIST} AS d, x1, y1, x2, y2 FROM s CROSS JOIN side_of) SELECT id, area FROM d GROUP BY id, area, lon, lat HAVING {INSIDE} OR min(d) <= 400")
def c5_areas(spark, sf):
    return S.near_areas(stations(spark, sf, "supplier", "s_suppkey"), S.convex_hulls(areas(spark, sf)), 400, Scratch(spark, "areas"))


@query("c10_resolved_in_areas", f"WITH {HULLS}, {_RING}, g AS (SELECT id % 500 AS entity, arg_min(lon, id) AS lon, arg_min(lat, id) AS lat FROM c GROUP BY 1) SELECT entity, area FROM (SELECT entity, area, lon, lat, x1, y1, x2, y2 FROM g CROSS JOIN side_of) GROUP BY entity, area, lon, lat HAVING {INSIDE}")
def c10_areas(spark, sf):
    g = stations(spark, sf).groupBy((F.col("id") % 500).alias("entity")).agg(F.min_by(F.struct("lon", "lat"), "id").alias("p")).select(F.col("entity").alias("id"), "p.*")
    return S.in_areas(g, S.convex_hulls(areas(spark, sf)), Scratch(spark, "areas")).withColumnRenamed("id", "entity")


@query("c9_anchor_exemption", f"""WITH {ST} SELECT c.id FROM c JOIN customer u ON u.c_custkey = c.id WHERE lon BETWEEN 44.43 AND 44.52 AND lat BETWEEN 48.68 AND 48.79 OR trim(regexp_replace(lower(c_mktsegment || ', No. ' || c_custkey % 50), '[^a-z0-9]+', ' ', 'g')) IN ('building no 7', 'machinery no 12')""")
def c9(spark, sf):
    c = stations(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit(", No. "), (F.col("c_custkey") % 50).cast("string")).alias("address")), "id")
    return c.where(S.in_rectangle(F.col("lon"), F.col("lat"), *BOX) | E.same_place(F.col("address"), ["Building, no.7", "MACHINERY no 12"])).select("id")


@query("c10_area_after_resolution", f"WITH {ST}, g AS (SELECT id % 500 AS entity, arg_min(lon, id) AS lon, arg_min(lat, id) AS lat FROM c GROUP BY 1) SELECT entity FROM g WHERE lon BETWEEN 44.43 AND 44.52 AND lat BETWEEN 48.68 AND 48.79")
def c10(spark, sf):
    g = stations(spark, sf).groupBy((F.col("id") % 500).alias("entity")).agg(F.min_by(F.struct("lon", "lat"), "id").alias("p")).select("entity", "p.*")
    return g.where(S.in_rectangle(F.col("lon"), F.col("lat"), *BOX)).select("entity")


@query("c11_ceiling", f"WITH {ST} SELECT id FROM c WHERE lon BETWEEN 44.43 AND 44.52 AND lat BETWEEN 48.68 AND 48.79")
def c11(spark, sf):
    inside = stations(spark, sf).where(S.in_rectangle(F.col("lon"), F.col("lat"), *BOX)).select("id")
    return S.within_ceiling(inside, 1_000_000_000)


@query("c12_anchor_drift", f"WITH {ST} SELECT c.id, round(sqrt(pow((c.lon - s.lon) * cos(radians((c.lat + s.lat) / 2)) * {_K}, 2) + pow((c.lat - s.lat) * {_K}, 2)), 3) AS metres FROM (SELECT id, lon + 0.0004 AS lon, lat - 0.0003 AS lat FROM s) c JOIN s USING (id)")
def c12(spark, sf):
    s = stations(spark, sf, "supplier", "s_suppkey")
    moved = s.select("id", (F.col("lon") + 0.0004).alias("lon"), (F.col("lat") - 0.0003).alias("lat"))
    return S.anchor_drift(moved, s).select("id", F.round("metres", 3).alias("metres"))


@query("c13_text_search", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_type) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%' OR 'k' || p_partkey LIKE '%ring%'")
def c13(spark, sf):
    p = table(spark, sf, "part").withColumn("keys", F.array(F.concat(F.lit("k"), F.col("p_partkey").cast("string"))))
    return S.text_search(p, "RING", ["p_name", "p_type", "p_brand"], "keys").select("p_partkey")


@query("c14_latest_scope", f"WITH {V.TICKS}, q AS (SELECT *, tick // 7200 % 3 AS area, tick // 2880 % 2 AS query FROM ticks), l AS (SELECT arg_max(area, tick) AS a, arg_max(query, tick) AS b FROM q) SELECT entity, tick FROM q, l WHERE area = a AND query = b")
def c14(spark, sf):
    t = V.ticks(spark, sf).withColumns({"area": F.floor(F.col("tick") / 7200) % 3, "query": F.floor(F.col("tick") / 2880) % 2})
    return S.latest_scope(t).select("entity", "tick")


@query("c15_fresh_activity", f"WITH {V.EVENTS}, a AS (SELECT event_id, coalesce(CASE WHEN k % 3 = 0 THEN t END, CASE WHEN k % 3 = 1 THEN t + 60 END, t - 60) AS at FROM e) SELECT event_id FROM a WHERE at <= {V.NOW} + 120 AND {V.NOW} - at <= 21600")
def c15(spark, sf):
    e = V.events(spark, sf)
    a = e.select("event_id", F.when(F.col("k") % 3 == 0, F.col("t")).alias("latest_event_at"), F.when(F.col("k") % 3 == 1, F.col("t") + 60).alias("resumed_at"), (F.col("t") - 60).alias("observed_at"))
    return a.where(E.fresh_activity(V.NOW)).select("event_id")


@query("c16_current_positive", f"WITH {Q.OBS} SELECT event_id FROM sg WHERE status IN ('IN_STOCK', 'LIMITED') AND specificity IN ('EXACT_VARIANT', 'FAMILY_ONLY') AND usable AND age IS NOT NULL")
def c16(spark, sf):
    return Q.U.enrich(Q.observations(spark, sf), V.NOW, Q.P).where(E.current_positive()).select("event_id")


@query("c17_sells_requested", "SELECT c_custkey FROM customer WHERE coalesce(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment <> 'BUILDING' END, true)")
def c17(spark, sf):
    c = table(spark, sf, "customer").withColumn("sells_requested", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment") != "BUILDING"))
    return c.where(E.may_sell()).select("c_custkey")


@query("j3_neighbour_pairs", f"WITH {ST} SELECT c.id AS a, s.id AS b, round({hav('c.lon', 'c.lat', 's.lon', 's.lat')}, 3) AS metres FROM c JOIN s ON abs(c.lat - s.lat) < 0.01 AND abs(c.lon - s.lon) < 0.01 AND {hav('c.lon', 'c.lat', 's.lon', 's.lat')} <= 300")
def j3(spark, sf):
    pairs = S.neighbour_pairs(stations(spark, sf), stations(spark, sf, "supplier", "s_suppkey"), 300)
    return pairs.select("a", "b", F.round("metres", 3).alias("metres"))
