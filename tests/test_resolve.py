"""Entity resolution and components against plain single-machine versions."""

import random
import time

from pyspark.sql import functions as F

from sightline.functions.address import address_parts, normal_address
from sightline.operators import resolve as R
from sightline.operators.components import connected_components
from sightline.params import Params


def test_components_match_union_find(spark):
    R_ = random.Random(4)
    edges = [(R_.randrange(400), R_.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_merges_per_component_equal_one_global_merge():
    """Random score graphs: merging each component alone gives what merging all at once gives."""
    rng = random.Random(7)
    several = 0
    for _ in range(300):
        p = Params(ambiguity_margin=rng.choice([0, 0.18, 0.5]))
        n = rng.randint(4, 10)
        members = [(0, f"m{i:02}", f"manual:{rng.randint(0, 1)}" if rng.random() < 0.1 else f"source:m{i}", rng.choice("wxyz")) for i in range(n)]
        scores = {(f"m{i:02}", f"m{j:02}"): rng.choice([0.5, 0.83, 0.9, 1.0, 1.2]) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3}
        up = {m[1]: m[1] for m in members}

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        keyed = {}
        for _, m, k, _s in members:
            keyed.setdefault(k, m)
            up[find(m)] = find(keyed[k])
        for a, b in scores:
            up[find(a)] = find(b)
        parts = {}
        for m in members:
            parts.setdefault(find(m[1]), []).append(m)
        several += len(parts) > 1
        whole = R.merge_component(members, scores, p)
        apart = [R.merge_component(ms, scores, p) for ms in parts.values()]
        assert sorted(map(sorted, whole[0])) == sorted(sorted(g) for a in apart for g in a[0])
        assert sorted(whole[1]) == sorted(d for a in apart for d in a[1])
    assert several > 100


STATION = "source string, station string, title string, brand string, comparable string, norm string, house string, units map<string,string>, lon double, lat double"


def station(source, ident, lon=44.5, lat=48.7, norm="мира 5", house="5", brand="x", comparable=None, units=None):
    return (source, ident, "t", brand, brand if comparable is None else comparable, norm, house, units or {}, lon, lat)


def resolved(spark, rows):
    keyed = R.initial_keys(spark.createDataFrame(rows, STATION), spark.createDataFrame([], "member string, manual string"))
    groups, doubts = R.resolve(keyed)
    return sorted(sorted(g) for g in _by_group(groups)), doubts.count()


def _by_group(groups):
    out = {}
    for r in groups.collect():
        out.setdefault(r.group, []).append(r.member)
    return out.values()


def test_what_merges(spark):
    assert resolved(spark, [station("a", "1"), station("b", "1")]) == ([["a:1", "b:1"]], 0)
    assert resolved(spark, [station("a", "1"), station("a", "2")]) == ([["a:1"], ["a:2"]], 0)
    assert resolved(spark, [station("a", "1"), station("b", "1", house="5а", norm="мира 5а")])[0] == [["a:1"], ["b:1"]]
    assert resolved(spark, [station("a", "1"), station("b", "1", brand="brand-id:99", comparable="")])[0] == [["a:1"], ["b:1"]]
    assert resolved(spark, [station("a", "1", lon=None), station("b", "1")])[0] == [["a:1"], ["b:1"]]
    near = [station("a", "1"), station("b", "1", lat=48.7002), station("b", "2", lat=48.69981)]
    groups, doubts = resolved(spark, near)
    assert groups == [["a:1"], ["b:1"], ["b:2"]] and doubts == 2


def whole_resolve(spark, rows, p):
    """All stations and scores at once, by the plain rule."""
    keyed = R.initial_keys(spark.createDataFrame(rows, STATION), spark.createDataFrame([], "member string, manual string"))
    scores = {(r.a, r.b): r.score for r in R.pair_scores(keyed, p).collect()}
    return plain_merges([(0, r.member, r.key, r.source) for r in keyed.collect()], scores, p)


def test_twins_stand_for_all(spark):
    """Places with several alike rows of a source: as the plain rule over all rows, doubts of all of them too."""
    rng = random.Random(30)
    merged = doubted = 0
    for k in range(3):
        rows = []
        for place in range(14):
            for source in "abc"[: rng.randint(1, 3)]:
                for i in range(rng.choice([1, 1, 1, 3, 5])):
                    rows.append(station(source, f"{place}-{i}", lon=44.5 + place / 100, lat=48.7 + rng.choice([0, 0, 0, 0.0001]), brand=rng.choice("xxy"), house=rng.choice(["5", "5", None])))
        p = Params(ambiguity_margin=[0.18, 0.05, 0][k])
        keyed = R.initial_keys(spark.createDataFrame(rows, STATION), spark.createDataFrame([], "member string, manual string"))
        groups, doubts = R.resolve(keyed, p)
        want, told = whole_resolve(spark, rows, p)
        assert sorted(sorted(g) for g in _by_group(groups)) == want
        assert sorted(r.members for r in doubts.collect()) == [d[0] for d in told]
        few = R.resolve(keyed, p, 4)[1]
        assert sorted(r.members for r in few.collect())[:4] == [d[0] for d in told][:4]
        merged, doubted = merged + (len(want) < len(rows)), doubted + len(told)
    assert merged == 3 and doubted > 50


def test_many_alike_rows_at_one_place(spark):
    """40,000 rows of four sources at one place: no pairs of rows."""
    rows = spark.range(40_000).selectExpr("array('a','b','c','d')[id % 4] as source", "string(id) as station", "'t' as title", "'x' as brand", "'x' as comparable", "'мира 5' as norm", "'5' as house", "cast(map() as map<string,string>) as units", "44.5D as lon", "48.7D as lat")
    keyed = R.initial_keys(rows, spark.createDataFrame([], "member string, manual string"))
    began = time.time()
    groups, doubts = R.resolve(keyed, most=100)
    assert groups.select("group").distinct().count() == 40_000 == groups.count()
    assert doubts.select("members").distinct().count() == 6 * 100 * 100 and time.time() - began < 120


def test_pairs_of_kinds_equal_all_pairs(spark, monkeypatch):
    """Kinds of many sizes, in blocks of about two: the scores of all pairs of rows, one by one."""
    monkeypatch.setattr(R, "SHARE", 2)
    rng, rows = random.Random(31), []
    for i in range(90):
        place = rng.randrange(4)
        rows.append(station(rng.choice("ab"), str(i), lon=44.5 + place / 100, lat=48.7 + rng.choice([0, 0, 0.0005]), brand=rng.choice(["x", "x", "y", ""]), house=rng.choice(["5", "5", "6", None]), units=rng.choice([{}, {}, {"корпус": "1"}, {"корпус": "2"}])))
    rows.append(station("a", "far", lon=None))
    keyed = R.initial_keys(spark.createDataFrame(rows, STATION), spark.createDataFrame([], "member string, manual string"))
    told = keyed.select("member", F.struct("brand", "comparable", "title", "norm", "house", "units", "lon", "lat").alias("s"))
    every = told.select(F.col("member").alias("m"), F.col("s").alias("a")).crossJoin(told.select(F.col("member").alias("n"), F.col("s").alias("b"))).where("m < n")
    want = sorted(tuple(r) for r in every.select("m", "n", R.score().alias("score")).where("score is not null").collect())
    assert len(want) > 300 and sorted(tuple(r) for r in R.pair_scores(keyed).collect()) == want
    assert sorted(tuple(r) for r in R.pair_scores(keyed, above=1.0, digits=2).collect()) == [(a, b, round(x, 2)) for a, b, x in want if x > 1.0]


def test_many_pairs_at_one_place(spark):
    """32 million pairs of 8,000 rows."""
    rows = spark.range(8000).selectExpr("concat('a:', id) as member", "'t' as title", "'x' as brand", "'x' as comparable", "'мира 5' as norm", "'5' as house", "cast(map() as map<string,string>) as units", "44.5D as lon", "48.7D as lat")
    began = time.time()
    assert R.pair_scores(rows).agg(F.count("*"), F.min("score")).first() == (8000 * 7999 // 2, 1.2) and time.time() - began < 60


def test_manual_and_shared_keys_stand_for_all(spark):
    """Alike rows of manual keys, and of one key, as the plain rule over all rows."""
    rng = random.Random(32)
    merged = doubted = large = 0
    for k in range(3):
        rows, keys = [], []
        for place in range(16):
            for source in "abc"[: rng.randint(1, 3)]:
                for i in range(rng.choice([1, 1, 2, 4])):
                    rows.append(station(source, f"{place}-{i}", lon=44.5 + place / 100, lat=48.7 + rng.choice([0, 0, 0, 0.0001]), brand=rng.choice("xxxy"), house="5"))
                    how = rng.choice(["own", "own", "manual", "shared"] if place % 2 else ["shared", "shared", "own"])
                    keys.append({"own": f"source:{source}:{place}-{i}", "manual": f"manual:{source}{place}-{i}", "shared": f"anon:{place}-{source if rng.random() < 0.9 else ''}"}[how])
        p = Params(ambiguity_margin=[0.18, 0.05, 0][k])
        keyed = spark.createDataFrame([(*r, f"{r[0]}:{r[1]}", key) for r, key in zip(rows, keys, strict=True)], f"{STATION}, member string, key string")
        groups, doubts = R.resolve(keyed, p)
        scores = {(r.a, r.b): r.score for r in R.pair_scores(keyed, p).collect()}
        want, told = plain_merges([(0, f"{r[0]}:{r[1]}", key, r[0]) for r, key in zip(rows, keys, strict=True)], scores, p)
        found = {}
        for r in groups.collect():
            found.setdefault(r.group, []).append(r.member)
        assert sorted(map(sorted, found.values())) == want and all(g == min(m) for g, m in found.items())
        assert sorted(r.members for r in doubts.collect()) == [d[0] for d in told]
        first = sorted({r.members for r in R.resolve(keyed, p, first=5)[1].collect()})
        assert first[:5] == [d[0] for d in told][:5]
        merged, doubted, large = merged + (len(want) < len(set(keys))), doubted + len(told), large + any(len(g) > 3 for g in want)
    assert merged == 3 and doubted > 20 and large > 1


def test_many_manual_and_shared_keys_at_one_place(spark):
    """6,000 rows of manual keys and 6,000 of one key at two places make few pairs."""
    rows = spark.range(12_400).selectExpr(
        "if(id % 31 = 0, 'b', 'a') as source", "string(id) as station", "'t' as title", "'x' as brand", "'x' as comparable", "'мира 5' as norm", "'5' as house",
        "cast(map() as map<string,string>) as units", "44.5D + id % 2 as lon", "48.7D as lat", "concat(if(id % 31 = 0, 'b:', 'a:'), id) as member",
        "case when id % 31 = 0 then concat('source:', id) when id % 2 = 0 then concat('manual:', id) else 'anon:1' end as key",
    )
    began = time.time()
    groups, doubts = R.resolve(rows, first=100)
    assert groups.count() == 12_400 and groups.select("group").distinct().count() == 12_400 - 5999
    assert groups.where("member = 'a:12399'").first().group == "a:1"
    names = sorted(r.members for r in doubts.collect())
    assert names[0].startswith("a:1,a:100") and names[0].count(",") == 6000 and time.time() - began < 100


def test_stable_keys(spark):
    groups = spark.createDataFrame([("a:1", "a:1"), ("a:1", "b:1"), ("c:1", "c:1")], "group string, member string")
    members = spark.createDataFrame([("a:1", "source:a:1"), ("b:1", "source:b:1"), ("c:1", "source:c:1")], "member string, key string")
    previous = spark.createDataFrame([("b:1", "old"), ("c:1", "old")], "member string, previous string")
    got = {r.group: r.station_key for r in R.stable_keys(groups, members, previous).collect()}
    assert got == {"a:1": "old", "c:1": "source:c:1"}


def plain_merges(members, scores, p):
    """The rule as stated, starting again after every merge."""
    groups = {}
    for _, m, key, source in sorted(members):
        groups.setdefault(key, [[], set(), key if key.startswith("manual:") else None])[0].append(m)
        groups[key][1].add(source)
    live, doubts = list(groups.values()), {}

    def total(x, y):
        found = [scores.get((min(a, b), max(a, b))) for a in x[0] for b in y[0]]
        return None if None in found else min(found)

    clash = lambda x, y: x[2] and y[2] and x[2] != y[2]

    def rival(x, y):
        return max((total(x, g) or 0 for g in live if g is not x and g is not y and g[1] & y[1] and not g[1] & x[1] and not clash(x, g)), default=0)

    def step():
        for i, x in enumerate(live):
            for y in live[i + 1 :]:
                s = None if x[1] & y[1] or clash(x, y) else total(x, y)
                if s is None or s < p.merge_threshold:
                    continue
                second = max(rival(x, y), rival(y, x))
                if s - second >= p.ambiguity_margin:
                    live[i] = [x[0] + y[0], x[1] | y[1], x[2] or y[2]]
                    live.remove(y)
                    return True
                name = ",".join(sorted(x[0] + y[0]))
                doubts.setdefault(name, (name, round(s, 4), round(second, 4)))
        return False

    while step():
        pass
    return sorted(sorted(g[0]) for g in live), sorted(doubts.values())


def test_merges_equal_the_plain_rule():
    rng = random.Random(20)
    merged = 0
    for _ in range(1500):
        p = Params(ambiguity_margin=rng.choice([0, 0.05, 0.18, 0.5]))
        n = rng.randint(3, 12)
        members = [(0, f"m{i:02}", f"manual:{rng.randint(0, 1)}" if rng.random() < 0.1 else f"source:m{rng.randint(0, i):02}", rng.choice("vwxyz")) for i in range(n)]
        scores = {(f"m{i:02}", f"m{j:02}"): rng.choice([0.5, 0.83, 0.9, 1.0, 1.2]) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        groups, doubts = R.merge_component(members, scores, p)
        assert (sorted(map(sorted, groups)), sorted(doubts)) == plain_merges(members, scores, p)
        told = {pair: s for pair, s in scores.items() if s > p.merge_threshold - p.ambiguity_margin - 1e-9}
        assert R.merge_component(members, told, p) == (groups, doubts)
        merged += len(groups) < len({m[2] for m in members})
    assert merged > 300


def test_large_components_merge_in_time():
    n = 3000
    members = [(0, f"m{i:05}", f"source:m{i:05}", f"s{i % 7}") for i in range(n)]
    scores = {(f"m{i:05}", f"m{j:05}"): 1.2 - (j - i) / 100 for i in range(n) for j in range(i + 1, min(n, i + 8))}
    began = time.process_time()
    groups, _ = R.merge_component(members, scores, Params(ambiguity_margin=0))
    assert sum(map(len, groups)) == n and time.process_time() - began < 20


def test_address_rules():
    """One case for each rule of the grammar."""
    told = {
        "ул. Мира, 10/1": "мира 10 корпус 1", "ул. Мира, 10, лит. А": "мира 10 литера а", "Мира 10 стр. Б": "мира 10 строение б", "Мира 5 к 2": "мира 5 корпус 2",
        "ул. Мира, 27 г": "мира 27г", "ул. Мира, 27 г, Волгоград": "мира 27г", "ул. Мира, 27, г. Волгоград": "мира 27", "Мира 27Г": "мира 27г",
        "400075 г. Волгоград, ул. Мира, 27": "мира 27", "ул. им. К. А. Тимирязева, 5": "к а тимирязева 5", "Ёлочная ул., 3": "елочная 3", "проспект Мира １２": "мира 12",
    }
    assert {a: normal_address(a) for a in told} == told
    assert normal_address("ул. им. К. Маркса, 5", {"карла маркса": ["к маркса"]}) == "карла маркса 5"
    assert address_parts("мира 10 литера а") == ("10", {"литера": "а"}) and address_parts("мира 12 корпус 3 строение б") == ("12", {"корпус": "3", "строение": "б"})


def test_addresses():
    assert normal_address("г. Волгоград, ул. Мира, 5/2") == "мира 5 корпус 2"
    assert normal_address("400005, проспект Мира, 5 г, стр. 3") == "мира 5г строение 3"
    assert normal_address("ул. им. маршала Советского Союза Г.К. Жукова, 12 а") == "маршала жукова 12а"
    assert normal_address(None) == "" and normal_address("") == ""
    assert address_parts("мира 5 корпус 2") == ("5", {"корпус": "2"}) and address_parts("") == (None, {})
