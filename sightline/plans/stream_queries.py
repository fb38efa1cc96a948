"""S: the streaming twins, run over what is there now (availableNow) and read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.operators import snapshot
from sightline.plans import snapshot_queries as Q, views as V
from sightline.plans.register import query
from sightline.streaming import ticks as S
from sightline.tables import Scratch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(spark, frame: DataFrame, scratch: Scratch, per_trigger: int | None = None) -> DataFrame:
    """The rows of a table as a stream of its files."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    path = scratch.path()
    frame.write.parquet(path)
    return S.read(spark, path, frame.schema, per_trigger)


def _drain(spark, stream: DataFrame, scratch: Scratch) -> DataFrame:
    """Run a stream over all that is there, in append mode, and read what it wrote."""
    out = scratch.path()
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", scratch.path()).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _dealt(spark, frame: DataFrame, scratch: Scratch, spans: int = 3) -> tuple[DataFrame, str]:
    """(stream, delay): the rows in several triggers, half of them a trigger late, all within the delay; then a heartbeat.

    The heartbeat, a row with a time only, moves the watermark past all rows, so a stream that ends gives all it has.
    """
    low, high = frame.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    span = max(1, ((high or 0) - (low or 0)) // spans)
    kept = scratch.keep(frame.withColumn("__deal", F.floor((F.unix_seconds("ts") - (low or 0)) / span) + F.pmod(F.xxhash64(*frame.columns), F.lit(2))))
    path = scratch.path()
    for deal in range(spans + 2):
        kept.where(F.col("__deal") == deal).drop("__deal").write.mode("append").parquet(path)
    beat = spark.createDataFrame([((high or 0) + 9 * span,)], "s long").select(*[F.timestamp_seconds("s").alias(c.name) if c.name == "ts" else F.lit(None).cast(c.dataType).alias(c.name) for c in frame.schema])
    beat.write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return S.read(spark, path, frame.schema, max(1, len(kept.inputFiles()))), f"{3 * span} seconds"


def _timed(frame: DataFrame, column: str, seconds: int = 1) -> DataFrame:
    return frame.withColumn("ts", F.timestamp_seconds(F.col(column) * seconds))


@query("s1_ingest_dedupe", f"WITH {V.EVENTS} SELECT event_id, t FROM e WHERE t <= {V.NOW} + 120")
def s1(spark, sf):
    scratch = Scratch(spark, "s1")
    e = _timed(V.events(spark, sf), "t").select("event_id", "t", "ts")
    twice = e.unionByName(e.where("event_id % 10 = 0"))
    return _drain(spark, S.clean(_stream(spark, twice, scratch), ["event_id"], "60 days", 120, V.NOW), scratch).select("event_id", "t")


_SPLIT = f"""WITH {V.EVENTS}, r AS (SELECT min(t) AS low, (max(t) - min(t)) // 2 AS span FROM e), x AS (SELECT event_id, t, (t - low) // span + event_id % 2 + copy AS deal, span FROM e, r, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR event_id % 10 = 0),
d AS (SELECT deal, max(max(t)) OVER (ORDER BY deal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM x GROUP BY deal), y AS (SELECT event_id, deal, coalesce(t <= latest - span // 2, false) AS late FROM x JOIN d USING (deal)),
z AS (SELECT event_id, CASE WHEN late THEN 'late' WHEN row_number() OVER (PARTITION BY event_id, late ORDER BY deal) = 1 THEN 'clean' ELSE 'repeat' END AS kind FROM y) SELECT event_id, kind, count(*) AS n FROM z GROUP BY ALL"""


@query("s1_late_rows", _SPLIT)
def s1_late(spark, sf):
    """Each deal is a run of the query of its own, from the checkpoint of the one before."""
    scratch = Scratch(spark, "s1-late")
    e = _timed(V.events(spark, sf), "t").select("event_id", "t", "ts")
    low, high = e.agg(F.min("t"), F.max("t")).first()
    span = max(1, ((high or 0) - (low or 0)) // 2)
    copies = e.withColumn("copy", F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    kept = scratch.keep(copies.withColumn("deal", F.floor((F.col("t") - (low or 0)) / span) + F.col("event_id") % 2 + F.col("copy")).drop("copy"))
    path, root, checkpoint = scratch.path(), scratch.path(), scratch.path()
    for deal in range(5):
        kept.where(F.col("deal") == deal).drop("deal").write.mode("append").parquet(path)
        S.ingest(S.read(spark, path, e.schema), ["event_id"], root, checkpoint, span // 2).awaitTermination()
    out = [S.ingested(spark, root, kind, e.schema).select("event_id", F.lit(kind).alias("kind")) for kind in ("clean", "repeat", "late")]
    return out[0].unionByName(out[1]).unionByName(out[2]).groupBy("event_id", "kind").agg(F.count("*").alias("n"))


@query("s2_stateful_runs", f"""WITH {V.TICKS}, sq AS (SELECT tick, lag(tick) OVER (ORDER BY tick) AS pt FROM (SELECT DISTINCT tick FROM ticks)), a AS (SELECT t.*, pt, (verdict IN ('AVAILABLE', 'LIKELY_AVAILABLE'))::INT AS pos, (verdict = 'NOT_AVAILABLE')::INT AS neg FROM ticks t JOIN sq USING (tick)),
b AS (SELECT *, sum(pos) OVER w AS grp, lag(verdict) OVER w AS bv, lag(tick) OVER w AS bt FROM a WINDOW w AS (PARTITION BY entity ORDER BY tick)),
c AS (SELECT *, sum(neg) OVER (PARTITION BY entity, grp ORDER BY tick) AS negs FROM b), d AS (SELECT *, pos = 1 AND (coalesce(lag(grp) OVER w, 0) = 0 OR lag(negs) OVER w >= 2) AS opens FROM c WINDOW w AS (PARTITION BY entity ORDER BY tick))
SELECT entity, 'OPENED' AS event, tick AS at, CASE WHEN bv = 'NOT_AVAILABLE' AND bt = pt AND (verdict = 'AVAILABLE' OR confidence >= 2) THEN 'OBSERVED_TRANSITION' ELSE 'FIRST_SEEN' END AS basis FROM d WHERE opens UNION ALL SELECT entity, 'CLOSED', min(tick), NULL FROM d WHERE grp > 0 AND negs = 2 AND neg = 1 GROUP BY entity, grp""")
def s2(spark, sf):
    scratch = Scratch(spark, "s2")
    t = V.ticks(spark, sf)
    t = t.join(snapshot.previous_ticks(t), "tick").withColumn("before", F.timestamp_seconds(F.col("before") * 60))
    stream, late = _dealt(spark, _timed(t, "tick", 60), scratch)
    out = _drain(spark, S.stateful(stream, ["entity"], S.Runs(), late), scratch)
    return out.select("entity", "event", F.floor(F.unix_seconds("at") / 60).alias("at"), "basis")


@query("s3_stateful_episodes", f"WITH {V.SEGMENTS} SELECT * FROM episodes")
def s3(spark, sf):
    scratch = Scratch(spark, "s3")
    stream, late = _dealt(spark, _timed(V.ticks(spark, sf), "tick", 60), scratch)
    out = _drain(spark, S.stateful(stream, ["entity"], S.Episodes(V.INTERVAL), late), scratch)
    minutes = lambda c: F.floor(F.unix_seconds(c) / 60).alias(c)
    return out.select("entity", minutes("started"), minutes("restored"), "minutes")


@query("s4_arrival_sessions", f"""WITH {V.EVENTS}, a AS (SELECT entity, t AS at FROM e WHERE event_type = 'purchase'), o AS (SELECT *, CASE WHEN at - lag(at) OVER (PARTITION BY entity ORDER BY at) > 7200 THEN 1 ELSE 0 END AS o FROM a), n AS (SELECT *, sum(o) OVER (PARTITION BY entity ORDER BY at) AS s FROM o),
g AS (SELECT entity, min(at) AS at, max(at) AS last, count(*) AS reports FROM n GROUP BY entity, s) SELECT entity, at, reports FROM g WHERE last + 7200 <= (SELECT max(at) FROM a) - 7200""")
def s4(spark, sf):
    scratch = Scratch(spark, "s4")
    e = _timed(V.events(spark, sf).where("event_type = 'purchase'"), "t").select("entity", "ts")
    out = _drain(spark, S.arrival_sessions(_stream(spark, e, scratch)), scratch)
    return out.select("entity", F.unix_seconds("at").alias("at"), "reports")


@query("s5_resumptions", f"WITH {Q.ROLL} SELECT entity, source, grade, tick AS at, n::BIGINT AS count FROM rb WHERE tick - btick <= 1080 AND bn = 0 AND n >= 1")
def s5(spark, sf):
    scratch = Scratch(spark, "s5")
    counts = Q.C.rolling_counts(Q.rolling(spark, sf)).select("entity", "source", "grade", "tick", F.col("count").alias("count_"), "window_minutes")
    stream, late = _dealt(spark, _timed(counts, "tick", 60), scratch)
    out = _drain(spark, S.stateful(stream, ["entity", "source", "grade"], S.Resumptions(V.INTERVAL, 60, 1), late), scratch)
    return out.select("entity", "source", "grade", F.floor(F.unix_seconds("at") / 60).alias("at"), "count")


@query("s6_tick_metrics", f"WITH {V.EVENTS}, {V.HEALTH} SELECT tick AS start, source, status, count(*) AS n FROM health WHERE tick * 60 + 3600 <= (SELECT max(tick) FROM health) * 60 - 7200 GROUP BY ALL")
def s6(spark, sf):
    scratch = Scratch(spark, "s6")
    h = _timed(V.health(spark, sf), "tick", 60).select("source", "status", "ts")
    out = _drain(spark, S.tick_metrics(_stream(spark, h, scratch)), scratch)
    return out.select(F.floor(F.unix_seconds("start") / 60).alias("start"), "source", "status", "n")


@query("s7_publication", f"WITH {V.EVENTS} SELECT event_id, entity FROM e")
def s7(spark, sf):
    scratch = Scratch(spark, "s7")
    out = scratch.path()
    stream = _stream(spark, V.events(spark, sf).select("event_id", "entity").repartition(4), scratch, 2)
    S.publish(stream, out, scratch.path()).awaitTermination()
    return spark.read.parquet(out).select("event_id", "entity")
