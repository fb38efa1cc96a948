"""Streams against the batch operators, with rows that come late and out of order."""

import shutil
from pathlib import Path
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sightline.operators import snapshot
from sightline.plans import catalog, stream_queries as Q, views as V
from sightline.streaming import ticks as S
from sightline.tables import Scratch

DAY = datetime(2024, 1, 1)


def hours(n):
    return DAY + timedelta(hours=n)


def run(spark, deals, schema, processor, late="2 hours"):
    """Each deal is one file, and a trigger of its own."""
    scratch = Scratch(spark, "test-stream")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", Q.ROCKS)
    path = scratch.path()
    for deal in deals:
        spark.createDataFrame(deal, schema).coalesce(1).write.mode("append").parquet(path)
    return Q._drain(spark, S.stateful(S.read(spark, path, spark.createDataFrame([], schema).schema, 1), ["entity"], processor, late), scratch)


TICK = "entity long, ts timestamp, verdict string, confidence long"


def test_row_of_a_later_trigger_counts_at_its_own_time(spark):
    """Out at 0:00, back at 1:00; the second good row at 2:00 comes first."""
    a, b, c = (1, hours(0), "NOT_AVAILABLE", 2), (1, hours(1), "AVAILABLE", 2), (1, hours(2), "AVAILABLE", 2)
    end = (None, hours(99), None, None)
    for deals in ([[a, c], [b], [end]], [[c], [b], [a], [end]], [[a, b, c, end]], [[a], [b], [c], [end]]):
        got = run(spark, deals, TICK, S.Episodes(360), "3 hours").collect()
        assert [(r.started, r.restored, r.minutes) for r in got] == [(hours(0), hours(1), 60)], deals


def test_rows_wait_for_the_watermark(spark):
    """Without a heartbeat, what the watermark has not passed is not yet told."""
    got = run(spark, [[(1, hours(0), "NOT_AVAILABLE", 2)], [(1, hours(1), "AVAILABLE", 2)], [(2, hours(2), "AVAILABLE", 2)]], TICK, S.Episodes(360), "2 hours").collect()
    assert got == []


def test_opening_is_observed_only_from_the_snapshot_before(spark):
    """Entity 1 was in the snapshot before, entity 2 was not."""
    rows = [(1, hours(0), "NOT_AVAILABLE", 2, None), (1, hours(6), "AVAILABLE", 2, hours(0)), (2, hours(0), "NOT_AVAILABLE", 2, None), (2, hours(12), "AVAILABLE", 2, hours(6))]
    got = run(spark, [rows[::-1], [(None, hours(99), None, None, None)]], TICK + ", before timestamp", S.Runs()).collect()
    assert sorted((r.entity, r.event, r.basis) for r in got) == [(1, "OPENED", "OBSERVED_TRANSITION"), (2, "OPENED", "FIRST_SEEN")]


def test_streamed_runs_equal_the_batch_operator(spark, sf):
    batch = snapshot.availability_runs(V.ticks(spark, sf))
    want = sorted((r.entity, r.opened, r.basis) for r in batch.collect())
    got = catalog.QUERIES["s2_stateful_runs"](spark, sf).collect()
    assert sorted((r.entity, r["at"], r.basis) for r in got if r.event == "OPENED") == want
    assert sorted((r.entity, r["at"]) for r in got if r.event == "CLOSED") == sorted((r.entity, r.closed) for r in batch.collect() if r.closed is not None)


@pytest.mark.parametrize("tick,before", [(0, None), (5, 0), (1440, 5), (2880, 1440), (2890, 2880)])
def test_previous_tick_across_days(spark, tick, before):
    ticks = spark.createDataFrame([(t,) for t in (0, 0, 5, 1440, 2880, 2890)], "tick long")
    assert {r.tick: r.before for r in snapshot.previous_ticks(ticks).collect()}[tick] == before


ROW = "id long, ts timestamp, note string"


def ingest(spark, deals, late=3600, before_retry=None):
    scratch = Scratch(spark, "test-ingest")
    path, root, checkpoint = scratch.path(), scratch.path(), scratch.path()
    for i, deal in enumerate(deals):
        spark.createDataFrame(deal, ROW).write.mode("append").parquet(path)
        S.ingest(S.read(spark, path, spark.createDataFrame([], ROW).schema), ["id"], root, checkpoint, late).awaitTermination()
        if before_retry == i:
            # The commit of this batch is lost: the next run does the batch again.
            local = checkpoint.removeprefix("file://")
            shutil.move(f"{local}/commits/{i}", f"{local}/lost-{i}")
            Path(f"{local}/commits/.{i}.crc").unlink(missing_ok=True)
            S.ingest(S.read(spark, path, spark.createDataFrame([], ROW).schema), ["id"], root, checkpoint, late).awaitTermination()
    return {kind: sorted((r.id, r.note) for r in S.ingested(spark, root, kind, ROW).collect()) for kind in ("clean", "repeat", "late")}


DEALS = [
    [(1, hours(10), "a"), (2, hours(12), "b"), (2, hours(12.5), "again")],
    [(3, hours(11.75), "in time"), (4, hours(11), "late"), (1, hours(10), "late too"), (2, hours(12), "twice"), (5, hours(14), "c"), (None, None, "no time")],
    [(6, hours(13), "late"), (5, hours(14), "twice"), (None, hours(15), "null key"), (None, hours(15.5), "null twice")],
]
WANT = {"clean": [(1, "a"), (2, "b"), (3, "in time"), (5, "c")], "repeat": [(2, "again"), (2, "twice"), (5, "twice")], "late": [(4, "late"), (6, "late"), (1, "late too")]}


def key(rows):
    return sorted((str(i), n) for i, n in rows)


@pytest.mark.parametrize("retry", [None, 1])
def test_ingest_deals_every_row_once(spark, retry):
    deals = [[r for r in d if r[0] is not None] for d in DEALS]
    got = ingest(spark, deals, before_retry=retry)
    assert {k: key(v) for k, v in got.items()} == {k: key(v) for k, v in WANT.items()}
    assert sum(map(len, got.values())) == sum(map(len, deals))


def test_fold_is_a_plain_function():
    runs = S.Runs()
    held, out = runs.fold((1,), None, SimpleNamespace(ts=hours(0), verdict="AVAILABLE", confidence=3, before=None))
    assert out == (1, "OPENED", hours(0), "FIRST_SEEN") and held == (True, 0, "AVAILABLE", hours(0))
