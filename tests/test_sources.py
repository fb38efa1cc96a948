"""Files and payloads at their edges."""

import json

from sightline.functions import text as X
from sightline.functions.text import normal_text
from sightline.sources import payloads as P, store
from pyspark.sql import functions as F


def test_corrupt_lines_are_counted(spark, tmp_path):
    (tmp_path / "day.jsonl").write_text('{"fetched_at": 1, "stations": ["a"]}\n{"fetched_at": 2, "stat\n{"fetched_at": 3}\n')
    rows, bad = store.read_lines(spark, f"file://{tmp_path}/day.jsonl", "fetched_at long, stations array<string>")
    assert [r.fetched_at for r in rows.collect()] == [1] and bad.first().corrupt == 2


def test_days_prune_and_rewrite(spark, tmp_path):
    path = f"file://{tmp_path}/ticks"
    ticks = spark.createDataFrame([(86400 * d + 100, d) for d in range(5)], "fetched_at long, n int")
    store.write_ticks(ticks, path)
    late = store.read_ticks(spark, path, 86400 * 3)
    assert sorted(r.n for r in late.collect()) == [3, 4]
    assert "PartitionFilters: [isnotnull(day" in late._jdf.queryExecution().executedPlan().toString()
    store.write_snapshot(spark.createDataFrame([(1, 99, "1970-01-02")], "fetched_at long, n int, day string"), path)
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [0, 2, 3, 4, 99]


def test_bad_payloads_make_no_rows(spark):
    rows = [("s", 1, None), ("s", 1, "not json"), ("s", 1, "[]"), ("s", 1, json.dumps([{"id": "", "lon": "1", "lat": "1"}, {"id": "x", "lon": " ", "lat": "1"}, {"id": "y", "lon": "1", "lat": "2"}]))]
    made = P.timeline(spark.createDataFrame(rows, "source string, fetched_at long, payload string"))
    (s,) = made["stations"].collect()
    assert s.station == "y" and s.assortment is None
    assert [r.status for r in made["observations"].collect()] == ["UNKNOWN"]


def test_prose_is_no_fuel_list(spark):
    said = ["Обновлено 95 минут назад", "92 · Очередь 100+ машин", "АИ-95, 98 · ДТ", None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(P.fuel_segments(F.col("s"))).collect()]
    assert got == ["", "92", "АИ-95, 98, ДТ", ""]


def test_negatives_before_positives(spark):
    said = ["not available", "Нет в наличии", "available", "есть топливо", "", None, "low stock", "n/a", "maybe"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(X.status(F.col("s"))).collect()]
    assert got == ["OUT_OF_STOCK", "OUT_OF_STOCK", "IN_STOCK", "IN_STOCK", "UNKNOWN", "UNKNOWN", "LIMITED", "UNKNOWN", "UNKNOWN"]


def test_compatibility_forms(spark):
    got = [r[0] for r in spark.createDataFrame([("ＡＩ－９５ Ёлка",), (None,)], "s string").select(normal_text(F.col("s"))).collect()]
    assert got == ["ai 95 елка", ""]


def payloads(spark, *texts):
    return spark.createDataFrame([("s", 1, t) for t in texts], "source string, fetched_at long, payload string")


def test_lists_bare_or_wrapped(spark):
    one = {"id": "y", "osm_id": "7", "lon": "1", "lat": "2", "detail": "92 · Очередь 20–50 машин"}
    made = P.timeline(payloads(spark, json.dumps([one]), json.dumps({"stations": [one]}), json.dumps({"other": [one]}), json.dumps(one)))
    assert [r.station for r in made["stations"].collect()] == ["7", "7"]
    assert {(r.value, r.ordinal) for r in made["queues"].collect()} == {("20–50 машин", "LONG")}


def test_trees_of_any_shape(spark, tmp_path):
    from sightline.tables import Scratch

    deep = {"id": 5, "coordinates": [1, 2], "fuels": [{"fuel": "95", "status": "yes"}]}
    for _ in range(5):
        deep = {"x": [deep]}
    texts = [json.dumps(deep), json.dumps({"a": {"id": "q", "fuels": {"АИ-92": "есть", "ДТ": {"status": "нет"}, "list": [1]}, "queue": "long"}, "updatedAt": 3}), "not json", "[]", "3", None, json.dumps({"id": "", "fuels": [{"fuel": "95"}]}), json.dumps([{"id": "twice", "point": [1, 1]}, [{"id": "twice", "point": ["3", " "]}]])]
    made = P.state_tree(payloads(spark, *texts), Scratch(spark, "test-tree"))
    assert sorted((r.station, r.fuel, r.status, r["at"]) for r in made["observations"].collect()) == [("5", "95", "yes", None), ("q", "АИ-92", "есть", None), ("q", "ДТ", "нет", None)]
    assert sorted((r.station, r.lon, r.lat) for r in made["stations"].collect() if r.lon) == [("5", 1.0, 2.0)]
    assert [r.station for r in made["stations"].where("lon is null").collect()] == ["twice"]  # the last of an id counts
    assert [(r.station, r.ordinal) for r in made["queues"].collect()] == [("q", "LONG")]
    assert sorted((r.station, r.grade, r.kind) for r in made["activity"].collect()) == [("5", "95", "PETROL_STATUS_SNAPSHOT"), ("q", "АИ-92", "PETROL_STATUS_SNAPSHOT")]


def test_container_deeper_than_the_walk_is_left(spark):
    from sightline.tables import Scratch

    tree = payloads(spark, json.dumps({"a": {"b": {"id": "x", "fuels": [{"fuel": "95"}]}}}))
    assert P.state_tree(tree, Scratch(spark, "t1"), 1)["observations"].count() == 0
    assert P.state_tree(tree, Scratch(spark, "t2"), 2)["observations"].count() == 1


def test_contract_counts_in_the_same_pass(spark):
    from sightline.tables import Scratch

    stations = spark.createDataFrame([("s", "1", 1.0, 1.0), ("s", "1", 1.0, 1.0), ("s", "2", None, None)], "source string, station string, lon double, lat double")
    rows = {"observations": spark.createDataFrame([("s", "1", "P", "EXACT"), ("s", "2", None, None), ("s", "9", "P", "EXACT"), ("s", None, "P", "EXACT"), ("z", "1", "P", "EXACT")], "source string, station string, product_key string, specificity string")}
    kept, rejects, health, counts = P.checked(stations, rows, Scratch(spark, "test-checked"), "CATALOG_ONLY")
    assert [(r.station, r.specificity) for r in kept["observations"].collect()] == [("1", "CATALOG_ONLY")]
    assert sorted((r.source, r.reason) for r in rejects.collect()) == [("s", "NOT_ENUMERATED"), ("s", "NO_STATION"), ("s", "UNCLASSIFIED"), ("z", "NOT_ENUMERATED")]
    assert counts["observations"] == {"rows": 5, "NO_STATION": 1, "NOT_ENUMERATED": 2, "UNCLASSIFIED": 1}
    assert [tuple(r) for r in health.collect()] == [("s", "PARTIAL", "COORDINATE_COVERAGE", 3, 1)]


SIGHTING = "station long, title string, brand string, address string, lon double, lat double, fetched_at long"
SEEN = [(1, "a", "x", "p", 1.0, 1.0, 10), (1, None, "x", "q", None, None, 20), (1, "b", None, None, 2.0, 2.0, 30), (2, None, None, None, None, None, 15), (1, "a", "x", "r", None, None, 40), (1, "b", "y", "s", None, None, 40), (3, "c", None, None, None, 1.0, 35)]


def test_upserts_in_any_order_give_the_same_fields(spark, tmp_path):
    whole = sorted(tuple(r)[:-1] for r in store.station_dimension(spark.createDataFrame(SEEN, SIGHTING)).collect())
    for n, order in enumerate([[0, 1, 2, 3], [3, 1, 0, 2], [2, 0, 3, 1]]):
        root = f"file://{tmp_path}/dimension-{n}"
        for i in order:
            part = [r for r in SEEN if (r[6] - 10) // 10 == i]
            dimension = store.upsert_stations(spark, root, spark.createDataFrame(part, SIGHTING))
        assert sorted(tuple(r)[:-1] for r in store.told_stations(dimension).collect()) == whole
        if n == 0:
            assert {r.station: r.labels for r in store.told_stations(dimension).collect()} == {r.station: r.labels for r in store.station_dimension(spark.createDataFrame(SEEN, SIGHTING)).collect()}


def test_sightings_of_one_time_count_in_their_order(spark, tmp_path):
    """Values and labels of one second: the first sighting counts, at once and upserted in any order."""
    seen = [(1, "a", "x", "q", 1.0, 1.0, 10, 2), (1, "c", None, "p", 2.0, 1.0, 10, 1), (1, "b", "z", "r", 3.0, 1.0, 10, 3), (2, "b", None, "n", None, None, 5, 8), (2, "a", None, "m", None, None, 5, 9)]
    schema = f"{SIGHTING}, order long"
    want = [(1, "c", "x", "p", 2.0, 1.0, 10, 10, [("c", None), ("a", "x"), ("b", "z")]), (2, "b", None, "n", None, None, 5, 5, [("b", None), ("a", None)])]
    got = store.station_dimension(spark.createDataFrame(seen, schema)).orderBy("station").collect()
    assert [(*tuple(r)[:-1], [tuple(x) for x in r.labels]) for r in got] == want
    for n, turns in enumerate([[0, 1, 2, 3, 4], [4, 2, 0, 3, 1]]):
        root = f"file://{tmp_path}/ties-{n}"
        for i in turns:
            dimension = store.upsert_stations(spark, root, spark.createDataFrame([seen[i]], schema))
        assert [tuple(r)[:-1] for r in store.told_stations(dimension).orderBy("station").collect()] == [w[:-1] for w in want]


def test_dimension_stored_without_turns_takes_new_sightings(spark):
    stored = store.seen_stations(spark.createDataFrame(SEEN, SIGHTING)).drop("turn")
    new = store.seen_stations(spark.createDataFrame([(1, "d", None, "a", None, None, 40)], SIGHTING))
    got = store.told_stations(store.merged_stations(stored, new)).where("station = 1").first()
    assert tuple(got)[:6] == (1, "d", "y", "s", 2.0, 2.0)


def test_expired_days_go_and_partly_expired_ones_stay(spark, tmp_path):
    path = f"file://{tmp_path}/ticks"
    store.write_ticks(spark.createDataFrame([(86400 * d + 100, d) for d in range(5)], "fetched_at long, n int"), path)
    now = 86400 * 4 + 200  # two days back: from day 2, 200 s
    early = store.read_ticks(spark, path, now - 2 * 86400)  # a reader that planned before
    assert store.expire_days(spark, path, now, 2, 0) == ["1970-01-01", "1970-01-02"]
    assert sorted(r.n for r in store.read_ticks(spark, path).collect()) == [2, 3, 4]
    assert sorted(r.n for r in early.collect()) == sorted(r.n for r in store.read_ticks(spark, path, now - 2 * 86400).collect()) == [3, 4]
    assert store.expire_days(spark, path, now + 86400, 2, 86400) == []


def test_a_writer_that_dies_leaves_the_old_snapshot(spark, tmp_path):
    root = f"file://{tmp_path}/snapshot"
    rows = spark.createDataFrame([(d, f"1970-01-0{d}") for d in range(1, 6)], "n int, day string")
    assert store.current(spark, root) is None
    store.publish(rows, root, ["day"])
    reader = store.current(spark, root)
    bad = rows.withColumn("n", F.when(F.col("n") == 4, F.raise_error(F.lit("killed"))).otherwise(F.col("n") + 10))
    try:
        store.publish(bad, root, ["day"])
    except Exception as e:  # noqa: BLE001  any failure of the job
        assert "killed" in str(e)
    assert sorted(r.n for r in store.current(spark, root).collect()) == [1, 2, 3, 4, 5]
    store.publish(rows.where("n > 3").withColumn("n", F.col("n") + 20), root, ["day"])
    assert sorted(r.n for r in store.current(spark, root).collect()) == [24, 25]
    assert reader.count() == 5  # found before the switch
