"""Streaming twins: ticks as they arrive, with the questions of the batch operators.

Sources are file or other streams of rows with `ts` (timestamp). Stateful operators keep a small value and the rows that
the watermark has not passed for each entity in Spark's state store, and use event-time timers: they see rows in order
of time, however late within the watermark these come, so their results are those of the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from types import SimpleNamespace

import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from sightline.params import DEFAULTS


def read(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    stream = spark.readStream.schema(schema)
    if files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(path)


def clean(stream: DataFrame, keys: list[str], late: str = "2 hours", skew_seconds: int | None = None, now: int | None = None) -> DataFrame:
    """Ticks without repeats and without rows too far ahead of `now` (wall clock if none is given)."""
    out = stream.withWatermark("ts", late)
    if skew_seconds is not None:
        limit = F.lit(now) if now is not None else F.unix_timestamp()
        out = out.where(F.unix_timestamp("ts") <= limit + skew_seconds)
    return out.dropDuplicatesWithinWatermark(keys)


def tick_metrics(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window, source and status; a window is given once the watermark has passed its end."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "source", "status").count().select(F.col("window.start").alias("start"), "source", "status", F.col("count").alias("n"))


def arrival_sessions(stream: DataFrame, gap: str = f"{DEFAULTS.arrival_gap_minutes} minutes", late: str = "2 hours") -> DataFrame:
    """Arrivals of an entity, merged while pauses are at most the gap; given once the watermark has passed the gap after the last."""
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "entity").agg(F.count("*").alias("reports"), F.min("ts").alias("at"))
    return s.select("entity", "at", "reports")


class InOrder(StatefulProcessor):
    """Folds the rows of a key in event-time order, whatever order they arrive in.

    Rows wait in the state store until the watermark has passed them: no row that could come before them is let in any
    more. One event-time timer a key stands at its earliest waiting row; when it fires, all rows up to the watermark go
    through `fold` in order of time, then of their other columns. A row at or behind the watermark never arrives here
    (see `ingest` for where it goes).

    A subclass names the columns that it folds (COLUMNS, after the time), what it carries from row to row (HELD), what
    it returns (SCHEMA) and `fold(key, held or None, row) -> (held, result row or None)`.
    """

    COLUMNS = HELD = SCHEMA = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"ts timestamp, {self.COLUMNS}")
        self.due = handle.getValueState("due", "at long")
        self.held = handle.getValueState("held", self.HELD)
        self.names = ["ts", *(c.split()[0] for c in self.COLUMNS.split(", "))]

    def wait_until(self, first: datetime) -> None:
        """Let the key's one timer stand at its earliest waiting row."""
        at = -(-int(round(first.replace(tzinfo=timezone.utc).timestamp() * 10**6)) // 1000)
        now = self.due.get()[0] if self.due.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(plain(v) for v in r) for part in rows for r in part[self.names].itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            self.wait_until(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: [(v is None, v if v is not None else 0) for v in r])
        passed = [r for r in rows if r[0].replace(tzinfo=timezone.utc).timestamp() * 1000 <= now]
        rest = rows[len(passed) :]
        self.due.clear()
        self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.wait_until(rest[0][0])
        held, out = self.held.get() if self.held.exists() else None, []
        for row in passed:
            held, result = self.fold(key, held, SimpleNamespace(**dict(zip(self.names, row, strict=True))))
            if result is not None:
                out.append(result)
        if passed:
            self.held.update(held)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.SCHEMA.split(", ")])

    def fold(self, key, held, row):
        raise NotImplementedError

    def close(self) -> None:
        pass


class Runs(InOrder):
    """Availability runs: an opening and a closing row for each run of an entity.

    Each row carries the time of the snapshot before its own (`before`, null for the first): an opening is an observed
    transition only if the entity was in that very snapshot, not available.
    """

    COLUMNS = "verdict string, confidence long, before timestamp"
    HELD = "is_open boolean, negatives int, verdict string, at timestamp"
    SCHEMA = "entity long, event string, at timestamp, basis string"

    def fold(self, key, held, row):
        is_open, negatives, last, at = held or (False, 0, None, None)
        out = None
        if row.verdict in ("AVAILABLE", "LIKELY_AVAILABLE"):
            if not is_open:
                seen = last == "NOT_AVAILABLE" and at == row.before and (row.verdict == "AVAILABLE" or row.confidence >= 2)
                out = (key[0], "OPENED", row.ts, "OBSERVED_TRANSITION" if seen else "FIRST_SEEN")
            is_open, negatives = True, 0
        elif row.verdict == "NOT_AVAILABLE" and is_open:
            negatives += 1
            if negatives >= 2:
                out = (key[0], "CLOSED", row.ts, None)
                is_open, negatives = False, 0
        return (is_open, negatives, row.verdict, row.ts), out


class Episodes(InOrder):
    """Outage episodes: a row when an outage ends; more than three intervals of silence cancel it."""

    COLUMNS = "verdict string, confidence long"
    HELD = "started timestamp, last timestamp"
    SCHEMA = "entity long, started timestamp, restored timestamp, minutes long"

    def __init__(self, interval_minutes: int):
        self.gap = 3 * interval_minutes * 60

    def fold(self, key, held, row):
        started, last = held or (None, None)
        out = None
        if last is not None and (row.ts - last).total_seconds() > self.gap:
            started = None
        if row.verdict == "NOT_AVAILABLE":
            started = started or row.ts
        elif row.verdict == "AVAILABLE" or (row.verdict == "LIKELY_AVAILABLE" and row.confidence >= 2):
            if started is not None:
                out = (key[0], started, row.ts, int((row.ts - started).total_seconds() // 60))
            started = None
        elif row.verdict != "LIKELY_AVAILABLE":
            started = None
        return (started, row.ts), out


class Resumptions(InOrder):
    """Resumed activity of (entity, source, grade): a count that rises from zero after a quiet window."""

    COLUMNS = "count_ long, window_minutes double"
    HELD = "at timestamp, count long, window double"
    SCHEMA = "entity long, source string, grade long, at timestamp, count long"

    def __init__(self, interval_minutes: int, quiet_gap: float, minimum: int):
        self.gap, self.quiet, self.minimum = 3 * interval_minutes * 60, quiet_gap, minimum

    def fold(self, key, held, row):
        at, count, window = held or (None, None, None)
        close = at is not None and (row.ts - at).total_seconds() <= self.gap
        resumed = close and count == 0 and window >= self.quiet and row.count_ >= self.minimum
        return (row.ts, row.count_, row.window_minutes), ((*key, row.ts, row.count_) if resumed else None)


def plain(value):
    """A value of a pandas row as the state store takes it: times without a zone are UTC, missing ones None."""
    if value is None or value is pd.NaT or value != value:
        return None
    if isinstance(value, pd.Timestamp):
        return (value.tz_convert("UTC").tz_localize(None) if value.tzinfo else value).to_pydatetime()
    return value.item() if hasattr(value, "item") else value


def stateful(stream: DataFrame, keys: list[str], processor: StatefulProcessor, late: str = "2 hours") -> DataFrame:
    """Run a processor per keys in event time. Needs the RocksDB state store.

    Rows whose keys are all null are heartbeats: they move the watermark and go no further.
    """
    timed = stream.withWatermark("ts", late)
    # The second term names the time, so that the filter stays above the watermark and heartbeats are seen by it.
    some = timed.where(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull() | F.col("ts").isNull())
    return some.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.SCHEMA, outputMode="Append", timeMode="EventTime")


def ingest(stream: DataFrame, keys: list[str], root: str, checkpoint: str, late_seconds: int) -> StreamingQuery:
    """Start a query that deals each row to one of three tables under `root`: clean, repeat or late, exactly once.

    A batch's watermark is the greatest time of all batches before it less `late_seconds`, as Spark's own; it is kept in
    a row for each batch beside the tables (`progress`), so a batch that runs again after a failure sees the same
    watermark, deals its rows alike and replaces its own folders. Rows at or behind the watermark are late. Of rows
    with equal keys the first is clean, by batch, then time; the rest are repeats. Keys are forgotten as in Spark's
    deduplication within the watermark: once the watermark has passed the clean row by `late_seconds`. Rows without a
    time are late; null keys are equal to each other.
    """
    spark = stream.sparkSession
    step = late_seconds * 10**6

    def write(frame: DataFrame, name: str, batch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")

    def seen(name: str) -> DataFrame | None:
        try:
            return spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None  # before the first batch
            raise

    def deal(frame: DataFrame, batch: int) -> None:
        progress = seen("progress")
        known = progress.where(F.col("batch") < batch).agg(F.max("latest")).first()[0] if progress is not None else None
        mark = None if known is None else known - step
        at = F.unix_micros("ts")
        kind = F.when(F.col("ts").isNull(), "late") if mark is None else F.when(F.col("ts").isNull() | (at <= mark), "late")
        frame = frame.persist(StorageLevel.DISK_ONLY)
        rows = frame.withColumn("__late", kind.isNotNull())
        latest = frame.agg(F.max(at)).first()[0]
        timely = rows.where("not __late")
        first = timely.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy("ts", F.xxhash64(*frame.columns))))
        old = None
        if mark is not None and (clean := seen("clean")) is not None:
            alive = [r.batch for r in progress.where((F.col("batch") < batch) & (F.col("newest") + step > mark)).select("batch").collect()]
            old = clean.where(F.col("batch").isin(alive) & (F.unix_micros("ts") + step > mark)).select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        if old is not None:
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
            first = first.join(old.withColumn("__old", F.lit(True)), same, "left").withColumn("__n", F.when(F.col("__old"), 2).otherwise(F.col("__n"))).drop("__old", *[f"__{k}" for k in keys])
        first = first.drop("__late").persist(StorageLevel.DISK_ONLY)
        write(first.where("__n = 1").drop("__n"), "clean", batch)
        write(first.where("__n > 1").drop("__n"), "repeat", batch)
        write(rows.where("__late").drop("__late"), "late", batch)
        newest = first.where("__n = 1").agg(F.max(at)).first()[0]
        write(spark.createDataFrame([(latest if known is None or (latest or known) > known else known, newest)], "latest long, newest long"), "progress", batch)
        first.unpersist()
        frame.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(deal).start()


def ingested(spark: SparkSession, root: str, name: str, schema: StructType | str) -> DataFrame:
    """One of the tables of `ingest` (clean, repeat or late), with the batch of each row."""
    typed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType([*typed.fields, StructField("batch", IntegerType())])).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")


def publish(stream: DataFrame, path: str, checkpoint: str, by: str = "batch") -> Callable:
    """Start a query that writes each micro-batch to its own partition; a batch that runs again replaces itself."""

    def write(frame: DataFrame, batch: int) -> None:
        frame.withColumn(by, F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
