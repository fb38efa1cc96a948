import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from sightline.operators import spatial as S
from sightline.tables import Scratch


def exact_corners(points):
    """Points outside every side and triangle of the others, in fractions."""
    p = sorted({(Fraction(x), Fraction(y)) for x, y in points})
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    out = set()
    for a in p:
        for b in p:
            if a != b and all((t := turn(a, b, c)) > 0 or t == 0 and min(a, b) <= c <= max(a, b) for c in p):
                out |= {a, b}
    return {(float(x), float(y)) for x, y in out}


def test_hull_of_points_nearly_in_line():
    rng = random.Random(4)
    for _ in range(300):
        points = [(round(44.4 + rng.randint(0, 6) / 5000, 4), round(48.65 + rng.randint(0, 6) / 5000, 4)) for _ in range(rng.randint(3, 14))]
        if len(set(points)) > 2:
            assert set(map(tuple, S.hull(np.array(points)).tolist())) == exact_corners(points)


def test_reference_points(spark):
    """Inside; in a notched ring, the first middle that is inside; on a sliver, the mean."""
    rings = {"square": [(0, 0), (2, 0), (2, 2), (0, 2)], "notch": [(0, 0), (9, 0), (9, 9), (8, 9), (8, 1), (0, 1)], "sliver": [(44.4, 48.65), (44.4002, 48.6502), (44.4006, 48.6506)]}
    rows = [(a, i, float(x), float(y)) for a, ring in rings.items() for i, (x, y) in enumerate(ring)]
    got = {r.area: (round(r.lon, 4), round(r.lat, 4)) for r in S.reference_points(spark.createDataFrame(rows, "area string, place int, lon double, lat double")).collect()}
    assert got["square"] == (1, 1) and got["sliver"] == (44.4003, 48.6503)
    x, y = got["notch"]
    assert 0 <= y <= 1 or 8 <= x <= 9


def corners_of(spark, rings):
    """rings: area -> list of rings"""
    rows = [(a, k, i, float(x), float(y)) for a, some in rings.items() for k, ring in enumerate(some) for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "area string, ring int, place int, lon double, lat double")


def brute_inside(x, y, rings):
    odd, on = False, False
    for x1, y1, x2, y2 in S.edges(rings):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
        across = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        on |= abs(across) < 1e-12 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)
    return odd or on


def test_points_in_many_areas(spark):
    """Areas of very unlike sizes, with holes, sharing edges, one within another; points on corners and cell borders too."""
    rng = random.Random(9)
    rings = {"box": [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)]], "next": [[(4, 0), (8, 0), (8, 4), (4, 4)]], "tiny": [[(1.5, 1.5), (1.5001, 1.5), (1.5, 1.5001)]], "bow": [[(-3, -3), (3, 3), (3, -3), (-3, 3)]]}
    for k in range(6):
        n = rng.randint(5, 60)
        turn = sorted(rng.random() * 2 * np.pi for _ in range(n))
        rings[f"r{k}"] = [[(rng.uniform(-5, 5) * 0.2 + (1 + rng.random()) * np.cos(t), (1 + rng.random()) * np.sin(t)) for t in turn]]
    points = [(rng.uniform(-6, 9), rng.uniform(-6, 6)) for _ in range(400)] + [(float(x), float(y)) for some in rings.values() for ring in some for x, y in ring] + [(x / 4, y / 4) for x in range(-4, 20) for y in range(-4, 20)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(-1, None, 1.0)], "id long, lon double, lat double")
    got = {(r.id, r.area) for r in S.in_areas(frame, corners_of(spark, rings), Scratch(spark, "test-areas")).collect()}
    assert got == {(i, a) for i, (x, y) in enumerate(points) for a, some in rings.items() if brute_inside(x, y, some)}
    none = corners_of(spark, {"line": [[(0, 0), (0, 0)]]})
    assert S.in_areas(frame, none, Scratch(spark, "test-areas")).count() == 0


def test_points_near_areas(spark):
    rng = random.Random(10)
    rings = {"a": [[(44.4, 48.6), (44.6, 48.6), (44.6, 48.8)]], "b": [[(44.5, 48.7), (44.5001, 48.7), (44.5, 48.7001)]]}
    points = [(rng.uniform(44.35, 44.65), rng.uniform(48.55, 48.85)) for _ in range(600)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, lon double, lat double")
    for metres in (50, 3000):
        want = set()
        for a, some in rings.items():
            want |= {(r.id, a) for r in frame.where(S.in_buffered_polygon(F.col("lon"), F.col("lat"), some, metres)).collect()}
        assert {(r.id, r.area) for r in S.near_areas(frame, corners_of(spark, rings), metres, Scratch(spark, "test-near")).collect()} == want


def brute_crossing(ring):
    side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    n = len(ring)
    for i in range(n):
        for j in range(i + 2, n if i else n - 1):
            a, b, c, d = ring[i], ring[(i + 1) % n], ring[j], ring[(j + 1) % n]
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return True
    return False


def test_self_crossing_equals_all_pairs(spark):
    rng = random.Random(11)
    rings = {f"r{k}": [[(rng.randint(0, 30) / 10, rng.randint(0, 30) / 10) for _ in range(rng.randint(3, 8))]] for k in range(60)}
    for k in range(20):
        turn = sorted(rng.random() * 6.28 for _ in range(30))
        rings[f"s{k}"] = [[((1 + rng.random()) * np.cos(t), (1 + rng.random()) * np.sin(t)) for t in turn]]
    # a point that comes twice running has no side of its own
    plain = {a: [p for i, p in enumerate(r[0]) if p != r[0][i - 1]] for a, r in rings.items()}
    got = {r.area: r.crossing for r in S.self_crossing(corners_of(spark, rings).drop("ring")).collect()}
    assert got == {a: brute_crossing(ring) for a, ring in plain.items()}
    assert any(got.values()) and not all(got.values())


def test_ring_of_very_many_corners(spark):
    """100,000 corners, once plain and once with a loop; the mean of the crescent is outside."""
    import time

    n = 100_000
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    circle = list(zip((44 + np.cos(t)).tolist(), (48 + np.sin(t)).tolist(), strict=True))
    looped = circle[:50_000] + [circle[50_010], circle[50_005]] + circle[50_020:]
    half = np.linspace(0, np.pi, n // 2)
    crescent = list(zip((np.cos(half)).tolist(), (np.sin(half)).tolist(), strict=True)) + list(zip((0.95 * np.cos(half[::-1])).tolist(), (0.95 * np.sin(half[::-1]) - 0.01).tolist(), strict=True))
    import pandas as pd

    rows = pd.concat([pd.DataFrame({"area": a, "place": range(len(r)), "lon": [p[0] for p in r], "lat": [p[1] for p in r]}) for a, r in (("circle", circle), ("looped", looped), ("crescent", crescent))])
    frame = spark.createDataFrame(rows, "area string, place int, lon double, lat double")
    began = time.time()
    assert {r.area: r.crossing for r in S.self_crossing(frame).collect()} == {"circle": False, "looped": True, "crescent": False}
    points = {r.area: (r.lon, r.lat) for r in S.reference_points(frame).collect()}
    assert abs(points["circle"][0] - 44) < 1e-6 and brute_inside(*points["crescent"], [crescent]) and not brute_inside(np.mean([p[0] for p in crescent]), np.mean([p[1] for p in crescent]), [crescent])
    assert time.time() - began < 120
