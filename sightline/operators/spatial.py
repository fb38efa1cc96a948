"""Areas and distances: membership tests as column expressions, hulls and area checks per area, grid neighbours.

Polygons and routes given as parameters are lists of (lon, lat); they become literal arrays, evaluated with
higher-order functions on each row. Areas given as a table are covered by grid cells, and points meet them by cell.
Distances beside haversine are local equirectangular metres.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sightline.functions.columns import haversine
from sightline.params import DEFAULTS
from sightline.tables import Scratch

METRES_PER_DEGREE = 6371008.8 * math.pi / 180

Point = tuple[float, float]


def in_rectangle(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """Boundary inside."""
    return lon.between(west, east) & lat.between(south, north)


def edges(rings: list[list[Point]], closed: bool = True) -> list[tuple[float, float, float, float]]:
    out = []
    for ring in rings:
        ends = ring[1:] + ring[:1] if closed else ring[1:]
        out += [(*a, *b) for a, b in zip(ring, ends, strict=False) if a != b]
    return out


def edge_array(sides: list[tuple[float, float, float, float]]) -> Column:
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(s, ("x1", "y1", "x2", "y2"), strict=True)]) for s in sides])


def in_polygon(lon: Column, lat: Column, rings: list[list[Point]]) -> Column:
    """Even-odd rule over all rings, so inner rings are holes; points on an edge are inside."""
    sides = edge_array(edges(rings))

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > lat) != (e["y2"] > lat)
        return spans & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.when(e["y2"] != e["y1"], e["y2"] - e["y1"]).otherwise(1.0) + e["x1"])

    def touches(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lon - e["x1"])
        return (F.abs(cross) < 1e-12) & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    odd = F.aggregate(sides, F.lit(False), lambda a, e: a != crosses(e))
    return F.coalesce(odd | F.exists(sides, touches), F.lit(False))


def distance_to_lines(lon: Column, lat: Column, sides: list[tuple[float, float, float, float]]) -> Column:
    """Least distance in metres to the given segments."""
    kx, ky = F.cos(F.radians(lat)) * METRES_PER_DEGREE, F.lit(METRES_PER_DEGREE)

    def one(e: Column) -> Column:
        ax, ay, bx, by = (e["x1"] - lon) * kx, (e["y1"] - lat) * ky, (e["x2"] - lon) * kx, (e["y2"] - lat) * ky
        dx, dy = bx - ax, by - ay
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / size))).otherwise(0.0)
        return F.sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy))

    return F.array_min(F.transform(edge_array(sides), one))


def in_buffered_polygon(lon: Column, lat: Column, rings: list[list[Point]], metres: float) -> Column:
    return in_polygon(lon, lat, rings) | (distance_to_lines(lon, lat, edges(rings)) <= metres)


def in_corridor(lon: Column, lat: Column, route: list[Point], width: float) -> Column:
    return distance_to_lines(lon, lat, edges([route], closed=False)) <= width / 2


def turn(a: Point, b: Point, c: Point) -> float:
    """Positive where a, b, c turn left, zero where they are in line; worked out in fractions where doubles can't tell."""
    left, right = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    if abs(left - right) > 1e-15 * (abs(left) + abs(right)):
        return left - right
    (ax, ay), (bx, by), (cx, cy) = ([Fraction(float(v)) for v in p] for p in (a, b, c))
    exact = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (exact > 0) - (exact < 0)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the least; points in line with two corners left out."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(rows):
        out: list = []
        for p in rows:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(chain(points)[:-1] + chain(points[::-1])[:-1])


def convex_hulls(anchors: DataFrame, salts: int = 16) -> DataFrame:
    """Hull corners (area, place, lon, lat) of anchors (area, lon, lat).

    Hulls of slices first, then the hull of their corners, so a large area is never one task's work. An area of fewer
    than three corners (too few anchors, or all in line) raises.
    """

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = hull(pdf[["lon", "lat"]].to_numpy(np.float64))
        return pd.DataFrame({"area": pdf["area"].iloc[0], "place": range(len(corners)), "lon": corners[:, 0], "lat": corners[:, 1]})

    schema = "area string, place int, lon double, lat double"
    rows = anchors.where("lon is not null and lat is not null").select("area", "lon", "lat", F.pmod(F.xxhash64("lon", "lat"), F.lit(salts)).alias("salt"))
    corners = rows.groupBy("area", "salt").applyInPandas(part, schema).groupBy("area").applyInPandas(part, schema)
    checked = corners.groupBy("area").agg(F.count("*").alias("n"), F.collect_list(F.struct("place", "lon", "lat")).alias("c"))
    whole = F.when(F.col("n") < 3, F.raise_error(F.concat(F.lit("fewer than three corners: "), F.col("area")))).otherwise(F.col("c"))
    return checked.select("area", F.explode(whole).alias("p")).select("area", "p.*")


def ring_metrics(corners: DataFrame) -> DataFrame:
    """Per area: corners, area in square kilometres (shoelace, at the ring's mean latitude), mean point."""
    w = W.partitionBy("area").orderBy("place")
    n = corners.withColumns({"nx": F.coalesce(F.lead("lon").over(w), F.first("lon").over(w)), "ny": F.coalesce(F.lead("lat").over(w), F.first("lat").over(w))})
    agg = n.groupBy("area").agg(F.count("*").alias("corners"), F.sum(F.col("lon") * F.col("ny") - F.col("nx") * F.col("lat")).alias("twice"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    km2 = F.abs(F.col("twice")) / 2 * F.cos(F.radians("lat")) * (METRES_PER_DEGREE / 1000) ** 2
    return agg.select("area", "corners", km2.alias("km2"), "lon", "lat")


def ring_sides(corners: DataFrame) -> DataFrame:
    """Sides (area, ring, place, n, x1, y1, x2, y2) of rings given by corners (area[, ring], place, lon, lat); n: of the area.

    Sides of no length are left out. The last corner of a ring is joined to its first.
    """
    c = corners if "ring" in corners.columns else corners.withColumn("ring", F.lit(0))
    w = W.partitionBy("area", "ring").orderBy("place")
    ends = c.withColumns({"x2": F.coalesce(F.lead("lon").over(w), F.first("lon").over(w)), "y2": F.coalesce(F.lead("lat").over(w), F.first("lat").over(w)), "k": F.row_number().over(w)})
    sides = ends.select("area", "ring", F.col("k").alias("place"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), "x2", "y2").where("x1 <> x2 or y1 <> y2")
    sizes = sides.groupBy("area").agg(F.count("*").alias("n"))
    return sides.join(sizes, "area")


def steps(low: Column, high: Column) -> Column:
    return F.sequence(low.cast("long"), F.greatest(low, high).cast("long"))


def side_cells(sides: DataFrame, size: Column, x_margin: Column, y_margin: Column) -> DataFrame:
    """A row for each grid cell (cx, cy) of the given size that a side comes within the margins of.

    A side is cut at the rows of cells, and each piece takes the cells between its ends, so a long side takes the cells
    along it, not all of its box.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = sides.withColumn("cy", F.explode(steps(F.floor((low - y_margin) / size), F.floor((high + y_margin) / size))))
    bottom, top = F.greatest(low, F.col("cy") * size - y_margin), F.least(high, (F.col("cy") + 1) * size + y_margin)
    # Where the piece begins and ends: along the side in proportion to the height, all of it if it is flat.
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")))
    flat = F.col("y1") == F.col("y2")
    left = F.when(flat, F.least("x1", "x2")).otherwise(F.greatest(F.least(at(bottom), at(top)), F.least("x1", "x2")))
    right = F.when(flat, F.greatest("x1", "x2")).otherwise(F.least(F.greatest(at(bottom), at(top)), F.greatest("x1", "x2")))
    return rows.withColumn("cx", F.explode(steps(F.floor((left - x_margin) / size), F.floor((right + x_margin) / size))))


def crosses(lon: Column, lat: Column) -> Column:
    """Whether a side x1, y1, x2, y2 crosses the line that goes right from a point."""
    return ((F.col("y1") > lat) != (F.col("y2") > lat)) & (lon < (F.col("x2") - F.col("x1")) * (lat - F.col("y1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1")).otherwise(1.0) + F.col("x1"))


def touches(lon: Column, lat: Column) -> Column:
    across = (F.col("x2") - F.col("x1")) * (lat - F.col("y1")) - (F.col("y2") - F.col("y1")) * (lon - F.col("x1"))
    return (F.abs(across) < 1e-12) & lon.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & lat.between(F.least("y1", "y2"), F.greatest("y1", "y2"))


#: Cells are powers of two of a degree; a ring's box has about this many cells a side, more for rings of many sides.
CELLS = 16
MARGIN = 1e-9


def levels(sides: DataFrame, most: int = 1024) -> DataFrame:
    """sides with `level`, the power of two of their area's cells, and `size`: twice the root of its sides, or CELLS, a side."""
    box = sides.groupBy("area").agg(F.greatest(F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2")), F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("wide"), F.max("n").alias("m"))
    cells = F.least(F.greatest(F.lit(float(CELLS)), 2 * F.sqrt("m")), F.lit(float(most)))
    level = F.ceil(F.log2(F.greatest(F.col("wide"), F.lit(1e-6)) / cells)).cast("int")
    return sides.join(box.select("area", level.alias("level")), "area").withColumn("size", F.pow(F.lit(2.0), F.col("level")))


def in_areas(points: DataFrame, corners: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (id, area) of points (id, lon, lat) and the areas (area[, ring], place, lon, lat of corners) that hold them.

    As `in_polygon` for each area: even-odd over its rings, an edge is inside. Areas are covered by cells of a size of
    their own; a cell that no side comes near is inside or outside as a whole, by the sides that cross its row further
    right. A point looks up its cell once for each size in use. Points in inside cells are in; only points in cells at
    the edge are tested, and only against the sides of that row. Points are no pairs with areas they are far from.
    """
    sides = scratch.keep(levels(ring_sides(corners)))
    size = F.col("size")
    edge = scratch.keep(side_cells(sides, size, F.lit(MARGIN), F.lit(MARGIN)).select("area", "level", "cx", "cy").distinct())
    # Where sides cross the middle line of a row of cells, counted by cell; what lies right of a cell is odd if it is inside.
    middle = (F.col("cy") + 0.5) * size
    rows = sides.withColumn("cy", F.explode(steps(F.floor(F.least("y1", "y2") / size), F.floor(F.greatest("y1", "y2") / size)))).where((F.col("y1") > middle) != (F.col("y2") > middle))
    cut = F.floor((F.col("x1") + (F.col("x2") - F.col("x1")) * (middle - F.col("y1")) / (F.col("y2") - F.col("y1"))) / size)
    counts = rows.groupBy("area", "level", "cy", cut.alias("cx")).agg(F.count("*").alias("crossings"))
    w = W.partitionBy("area", "cy").orderBy("cx")
    upto = F.coalesce(F.sum("crossings").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    runs = counts.select("area", "level", "cy", "cx", (upto % 2).alias("odd"), F.lead("cx").over(w).alias("next"))
    inner = runs.where("odd = 1 and next > cx + 1").select("area", "level", "cy", F.explode(steps(F.col("cx") + 1, F.col("next") - 1)).alias("cx"))
    inner = inner.join(edge, ["area", "level", "cx", "cy"], "left_anti")
    cover = scratch.keep(inner.withColumn("whole", F.lit(True)).unionByName(edge.withColumn("whole", F.lit(False))))
    used = [r.level for r in cover.select("level").distinct().collect()]  # powers of two of a degree: a few dozen at most
    if not used:
        return points.select("id", F.lit(None).cast(corners.schema["area"].dataType).alias("area")).where("false")
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("lon") / 2.0**k).alias("cx"), F.floor(F.col("lat") / 2.0**k).alias("cy")) for k in used]))
    placed = points.where("lon is not null and lat is not null").select("id", "lon", "lat", at.alias("c")).select("id", "lon", "lat", "c.*")
    met = scratch.keep(placed.join(cover, ["level", "cx", "cy"]))
    strips = sides.withColumn("cy", F.explode(steps(F.floor((F.least("y1", "y2") - MARGIN) / size), F.floor((F.greatest("y1", "y2") + MARGIN) / size)))).select("area", "cy", "x1", "y1", "x2", "y2")
    tested = met.where("not whole").join(strips, ["area", "cy"]).groupBy("id", "lon", "lat", "area").agg(((F.count_if(crosses(F.col("lon"), F.col("lat"))) % 2 == 1) | F.bool_or(touches(F.col("lon"), F.col("lat")))).alias("inside"))
    return met.where("whole").select("id", "area").unionByName(tested.where("inside").select("id", "area")).distinct()


def near_areas(points: DataFrame, corners: DataFrame, metres: float, scratch: Scratch, max_lat: float = 75.0) -> DataFrame:
    """Pairs (id, area) of points and the areas that hold them or have a side within `metres`.

    Sides are dealt to the cells that they come within the distance of; a point is measured against the sides dealt to
    its cell. Beyond `max_lat` degrees north or south points are measured too near the pole for that and raise.
    """
    y, wide = metres * 1.01 / METRES_PER_DEGREE, metres * 1.01 / METRES_PER_DEGREE / math.cos(math.radians(max_lat))
    size = F.lit(max(wide, 1e-4))
    dealt = side_cells(ring_sides(corners), size, F.lit(wide), F.lit(y)).select("area", "cx", "cy", "x1", "y1", "x2", "y2")
    polar = F.when(F.abs("lat") > max_lat, F.raise_error(F.lit(f"a point beyond {max_lat} degrees"))).otherwise(F.col("lat"))
    placed = points.where("lon is not null and lat is not null").select("id", "lon", polar.alias("lat")).withColumns({"cx": F.floor(F.col("lon") / size), "cy": F.floor(F.col("lat") / size)})
    kx, ky = F.cos(F.radians("lat")) * METRES_PER_DEGREE, F.lit(METRES_PER_DEGREE)
    ax, ay, bx, by = (F.col("x1") - F.col("lon")) * kx, (F.col("y1") - F.col("lat")) * ky, (F.col("x2") - F.col("lon")) * kx, (F.col("y2") - F.col("lat")) * ky
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
    close = placed.join(dealt, ["cx", "cy"]).where(F.sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy)) <= metres)
    return close.select("id", "area").unionByName(in_areas(points, corners, scratch)).distinct()


def self_crossing(corners: DataFrame) -> DataFrame:
    """Areas whose ring crosses itself (area, crossing): sides that share a cell are tested against each other.

    Sides that follow each other are not, nor are ends that merely touch.
    """
    cells = side_cells(levels(ring_sides(corners)), F.col("size"), F.lit(MARGIN), F.lit(MARGIN)).select("area", "ring", "n", "cx", "cy", F.col("place").alias("i"), "x1", "y1", "x2", "y2")
    last = ring_sides(corners).groupBy("area", "ring").agg(F.max("place").alias("last"))
    other = cells.select("area", "ring", "cx", "cy", F.col("i").alias("j"), F.col("x1").alias("u1"), F.col("y1").alias("v1"), F.col("x2").alias("u2"), F.col("y2").alias("v2"))
    met = cells.join(other, ["area", "ring", "cx", "cy"]).where("j >= i + 2").join(last, ["area", "ring"]).where("not (i = 1 and j = last)")
    side = lambda a, b, c: F.signum((F.col(b[0]) - F.col(a[0])) * (F.col(c[1]) - F.col(a[1])) - (F.col(b[1]) - F.col(a[1])) * (F.col(c[0]) - F.col(a[0])))
    p, q, r, s = ("x1", "y1"), ("x2", "y2"), ("u1", "v1"), ("u2", "v2")
    bad = met.where((side(p, q, r) * side(p, q, s) < 0) & (side(r, s, p) * side(r, s, q) < 0)).select("area").distinct().withColumn("crossing", F.lit(True))
    return corners.select("area").distinct().join(bad, "area", "left").select("area", F.coalesce("crossing", F.lit(False)).alias("crossing"))


def area_rejects(corners: DataFrame, ceilings: DataFrame, greatest: float = 2000.0) -> DataFrame:
    """Areas that fail (area, reason): self-crossing, empty, too large, or above their own ceiling (area, max_km2)."""
    m = ring_metrics(corners).join(self_crossing(corners), "area", "left").join(ceilings, "area", "left")
    reason = F.when(F.col("crossing"), "SELF_CROSSING").when(F.col("km2") <= 1e-9, "EMPTY").when(F.col("km2") > greatest, "TOO_LARGE").when(F.col("km2") > F.col("max_km2"), "ABOVE_CEILING")
    return m.select("area", reason.alias("reason")).where("reason is not null")


def inside_own(tried: DataFrame, sides: DataFrame) -> DataFrame:
    """tried (area, place, px, py) with `inside`: each point against the sides of its area's strip only."""
    size = F.col("size")
    strips = sides.select("area", "x1", "y1", "x2", "y2", F.explode(steps(F.floor((F.least("y1", "y2") - MARGIN) / size), F.floor((F.greatest("y1", "y2") + MARGIN) / size))).alias("strip"))
    dealt = tried.join(sides.groupBy("area").agg(F.first("size").alias("size")), "area").withColumn("strip", F.floor(F.col("py") / size))
    met = dealt.join(strips, ["area", "strip"], "left")
    held = (F.count_if(crosses(F.col("px"), F.col("py"))) % 2 == 1) | F.coalesce(F.bool_or(touches(F.col("px"), F.col("py"))), F.lit(False))
    return met.groupBy("area", "place", "px", "py").agg(held.alias("inside"))


def reference_points(corners: DataFrame) -> DataFrame:
    """A point of each area: the mean of its corners if that is inside or on the edge, or else the first middle of two
    alternate corners that is, or else the mean all the same.

    Middles are tried for areas only whose mean is outside.
    """
    sides = levels(ring_sides(corners))
    mean = corners.groupBy("area").agg(F.avg("lon").alias("px"), F.avg("lat").alias("py")).withColumn("place", F.lit(-1))
    first = mean.join(inside_own(mean, sides).select("area", "inside"), "area", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    w = W.partitionBy("area").orderBy("place")
    middles = corners.withColumns({"px": (F.col("lon") + F.lead("lon", 2).over(w)) / 2, "py": (F.col("lat") + F.lead("lat", 2).over(w)) / 2}).where("px is not null")
    open_ = first.where("not inside").select("area")
    second = inside_own(middles.join(open_, "area", "left_semi").select("area", "place", "px", "py"), sides).where("inside").groupBy("area").agg(F.min_by(F.struct("px", "py"), "place").alias("m"))
    return first.join(second, "area", "left").select("area", F.coalesce("m.px", "px").alias("lon"), F.coalesce("m.py", "py").alias("lat"))


def neighbour_pairs(left: DataFrame, right: DataFrame, drift: float = DEFAULTS.drift_meters, max_lat: float = 60.0, alike: str | None = None) -> DataFrame:
    """Pairs of (id, lon, lat) rows within `drift` metres: rows meet in grid cells, one side is copied to 9 cells.

    A cell is slightly larger than the drift, so near points are never two cells apart. Rows without coordinates
    meet nobody. With `alike`, a column of both sides, rows meet only where it is equal or null on either side: a cell
    that holds very many rows is then joined by its values, not as a whole.
    """
    size = drift * 1.01 / METRES_PER_DEGREE
    wide = size / math.cos(math.radians(max_lat))
    cell = lambda c, s: F.floor(F.col(c) / s)
    value = F.col(alike).cast("string") if alike else F.lit("")
    a = left.where("lon is not null and lat is not null").select(F.col("id").alias("a"), F.col("lon").alias("ax"), F.col("lat").alias("ay"), cell("lon", wide).alias("cx"), cell("lat", size).alias("cy"), value.alias("v"))
    b = right.where("lon is not null and lat is not null").select(F.col("id").alias("b"), F.col("lon").alias("bx"), F.col("lat").alias("by"), cell("lon", wide).alias("x"), cell("lat", size).alias("y"), value.alias("v"))
    around = F.explode(F.array(*[F.struct((F.col("x") + i).alias("cx"), (F.col("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = b.select("b", "bx", "by", "v", around.alias("c")).select("b", "bx", "by", "v", "c.*")
    near = a.join(b, ["cx", "cy", "v"]).drop("v")
    if alike:
        near = near.unionByName(a.where("v is null").drop("v").join(b.drop("v"), ["cx", "cy"])).unionByName(a.where("v is not null").drop("v").join(b.where("v is null").drop("v"), ["cx", "cy"]))
    return near.withColumn("metres", haversine(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).where(F.col("metres") <= drift).select("a", "b", "metres")


def anchor_drift(anchors: DataFrame, resolved: DataFrame) -> DataFrame:
    """Metres between stored anchors and resolved points (id, lon, lat); an unresolved anchor raises."""
    r = resolved.select("id", F.col("lon").alias("rx"), F.col("lat").alias("ry"))
    j = anchors.join(r, "id", "left")
    kx = F.cos(F.radians((F.col("lat") + F.col("ry")) / 2)) * METRES_PER_DEGREE
    d = F.sqrt(F.pow((F.col("lon") - F.col("rx")) * kx, F.lit(2)) + F.pow((F.col("lat") - F.col("ry")) * METRES_PER_DEGREE, F.lit(2)))
    return j.select("id", F.when(F.col("rx").isNull(), F.raise_error(F.concat(F.lit("unresolved anchor "), F.col("id").cast("string")))).otherwise(d).alias("metres"))


def within_ceiling(rows: DataFrame, most: int) -> DataFrame:
    """rows, or an error if there are more than `most` (checked when the rows are read)."""
    total = rows.agg(F.count("*")).scalar()
    return rows.where(F.when(total > most, F.raise_error(F.lit(f"more than {most} rows")).cast("boolean")).otherwise(True))


def text_search(rows: DataFrame, query: str, columns: list[str], keys: str | None = None) -> DataFrame:
    """Rows where any column, or any of an array of keys, holds the query, whatever the case."""
    q = query.lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False))
    if keys:
        hit = hit | F.coalesce(F.exists(keys, lambda k: F.lower(k).contains(q)), F.lit(False))
    return rows.where(hit)


def latest_scope(ticks: DataFrame) -> DataFrame:
    """Ticks of the latest tick's (area, query) only."""
    last = ticks.agg(F.max_by(F.struct("area", "query"), "tick")).scalar()
    return ticks.where(F.struct("area", "query") == last)
