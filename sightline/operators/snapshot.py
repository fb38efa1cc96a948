"""Snapshot operators: ranking, differences, availability runs, completeness, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from sightline.functions.columns import confidence_rank
from sightline.params import DEFAULTS, QUEUE

FAR = 1 << 53


def rank(assessments: DataFrame) -> DataFrame:
    """Positive assessments in order, with their place.

    Order: resumed, then ongoing activity; supporting sources; confidence; freshest age; counted before ordinal queues,
    shorter first; age of an observed run; distance; key. The key makes the order total.
    """
    word = F.coalesce(*[F.when(F.col("queue_ordinal") == k, v) for k, v in QUEUE.items()])
    keys = {
        "k1": F.when(F.col("resumed"), 0).when(F.col("ongoing"), 1).otherwise(2), "k2": -F.col("sources"), "k3": -confidence_rank(F.col("confidence")), "k4": F.coalesce("freshest_age", F.lit(float(FAR))),
        "k5": F.when(F.col("vehicles").isNotNull(), 0).when(word.isNotNull(), 1).otherwise(2), "k6": F.coalesce(F.col("vehicles").cast("double"), word.cast("double"), F.lit(float(FAR))),
        "k7": F.when(F.col("run_basis") == "OBSERVED_TRANSITION", F.col("run_age").cast("double")).otherwise(float(FAR)), "k8": F.coalesce("distance", F.lit(0.0)),
    }
    return assessments.where(F.col("verdict").isin("AVAILABLE", "LIKELY_AVAILABLE")).withColumns(keys)


ORDER = ["k1", "k2", "k3", "k4", "k5", "k6", "k7", "k8", "entity"]


def top(assessments: DataFrame, k: int = 5) -> DataFrame:
    """The first k in rank order with their place; the window runs over k rows."""
    best = rank(assessments).orderBy(*ORDER).limit(k)
    return best.withColumn("place", F.row_number().over(W.orderBy(*ORDER))).drop(*ORDER[:-1])


def ranked(assessments: DataFrame) -> DataFrame:
    """All positive assessments, globally sorted."""
    return rank(assessments).orderBy(*ORDER).drop(*ORDER[:-1])


def diff(before: DataFrame, after: DataFrame, same_scope: bool = True) -> DataFrame:
    """Changes between two snapshots (entity, verdict, confidence, queue): ADDED, REMOVED, CHANGED.

    Another scope suppresses everything but one SCOPE_CHANGED row.
    """
    if not same_scope:
        return after.limit(1).select(F.lit("SCOPE_CHANGED").alias("change"), F.lit(None).cast(after.schema["entity"].dataType).alias("entity"), F.lit(None).cast("string").alias("was"), F.lit(None).cast("string").alias("now"))
    a = before.select("entity", F.struct("verdict", "confidence", "queue").alias("a"))
    b = after.select("entity", F.struct("verdict", "confidence", "queue").alias("b"))
    j = a.join(b, "entity", "full")
    kind = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").when(~F.col("a").eqNullSafe(F.col("b")), "CHANGED")
    return j.select(kind.alias("change"), "entity", F.col("a.verdict").alias("was"), F.col("b.verdict").alias("now")).where("change is not null")


def previous_ticks(ticks: DataFrame) -> DataFrame:
    """(tick, before): each snapshot's time and that of the one before it, null for the first.

    Ticks are compared within their day; only the last tick of each day goes through a window over all days.
    """
    seq = ticks.select("tick").distinct().withColumn("day", F.floor(F.col("tick") / 1440))
    days = seq.groupBy("day").agg(F.max("tick").alias("last")).select("day", F.lag("last").over(W.orderBy("day")).alias("carried"))
    return seq.withColumn("before", F.lag("tick").over(W.partitionBy("day").orderBy("tick"))).join(days, "day").select("tick", F.coalesce("before", "carried").alias("before"))


def availability_runs(ticks: DataFrame, all_ticks: DataFrame | None = None) -> DataFrame:
    """Runs (entity, opened, last_confirmed, closed or null, basis, verdict, confidence of the last positive).

    A positive opens or extends; two negatives since the last positive close; other verdicts neither count nor reset.
    A run is an observed transition if the snapshot just before had the entity not available and the opening verdict
    is available or of medium confidence.
    """
    seq = (all_ticks if all_ticks is not None else ticks).select("tick").distinct()
    day = F.floor(F.col("tick") / 1440)
    # Number ticks by day and offset, so no window runs over all ticks in one task.
    counts = seq.groupBy(day.alias("day")).agg(F.count("*").alias("c"))
    starts = counts.select("day", (F.sum("c").over(W.orderBy("day")) - F.col("c")).alias("base"))
    seq = seq.withColumn("day", day).withColumn("n", F.row_number().over(W.partitionBy("day").orderBy("tick"))).join(starts, "day").select("tick", (F.col("base") + F.col("n")).alias("seq"))
    w = W.partitionBy("entity").orderBy("tick")
    positive = F.col("verdict").isin("AVAILABLE", "LIKELY_AVAILABLE")
    t = ticks.join(seq, "tick").withColumns({"pos": positive.cast("int"), "neg": (F.col("verdict") == "NOT_AVAILABLE").cast("int")})
    t = t.withColumns({"group": F.sum("pos").over(w), "before": F.lag("verdict").over(w), "before_seq": F.lag("seq").over(w), "before_tick": F.lag("tick").over(w)})
    t = t.withColumn("negs", F.sum("neg").over(W.partitionBy("entity", "group").orderBy("tick")))
    opens = (F.col("pos") == 1) & ((F.lag("group").over(w) == 0) | F.lag("group").over(w).isNull() | (F.lag("negs").over(w) >= 2))
    t = t.withColumn("opens", F.coalesce(opens, F.lit(True)) & (F.col("pos") == 1))
    t = t.withColumn("run", F.sum(F.col("opens").cast("int")).over(w)).where("run > 0")
    moved = F.col("opens") & (F.col("before") == "NOT_AVAILABLE") & (F.col("before_seq") == F.col("seq") - 1) & ((F.col("verdict") == "AVAILABLE") | (F.col("confidence") >= 2))
    return t.groupBy("entity", "run").agg(
        F.min(F.when(F.col("opens"), F.col("tick"))).alias("opened"), F.max(F.when(F.col("pos") == 1, F.col("tick"))).alias("last_confirmed"),
        F.min(F.when((F.col("group") > 0) & (F.col("negs") == 2) & (F.col("neg") == 1), F.col("tick"))).alias("closed"),
        F.when(F.bool_or(moved), "OBSERVED_TRANSITION").otherwise("FIRST_SEEN").alias("basis"), F.max(F.when(moved, F.col("before_tick"))).alias("after"),
        F.min_by("verdict", "tick").alias("verdict"), F.max_by("confidence", F.when(F.col("pos") == 1, F.col("tick"))).alias("confidence"),
    ).drop("run")


def completeness(metrics: DataFrame, baselines: DataFrame, now: int) -> DataFrame:
    """Failed invariants per source, and the status they leave: OK turns to PARTIAL.

    metrics (source, station_count, duplicate_ratio, coordinate_coverage, fuel_block_coverage, timestamp_coverage,
    freshness_expected), baselines (source, base_count, updated_at seconds).
    """
    j = metrics.join(baselines, "source", "left")
    valid = (F.col("base_count") >= 4) & (now - F.col("updated_at") <= DEFAULTS.retention_days * 86400)
    checks = [
        (valid & (F.col("station_count") < F.col("base_count") * 0.5), "STATION_COUNT"), (F.col("duplicate_ratio") > 0.15, "DUPLICATES"), (F.col("coordinate_coverage") < 0.9, "COORDINATES"),
        (F.col("fuel_block_coverage") < 0.2, "FUEL_BLOCKS"), (F.col("freshness_expected") & (F.col("timestamp_coverage") < 0.2), "TIMESTAMPS"),
    ]
    failed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))
    return j.select("source", F.array_join(failed, ",").alias("failed"), F.when(F.size(failed) > 0, "PARTIAL").otherwise("OK").alias("status"))


def roll_baselines(old: DataFrame, fresh: DataFrame, now: int) -> DataFrame:
    """Greatest station count per (source, area, contract) over the old baselines and the OK runs; old ones expire."""
    live = old.where(now - F.col("updated_at") <= DEFAULTS.retention_days * 86400)
    both = live.select("source", "area", "contract", "station_count", "updated_at").unionByName(fresh.where("status = 'OK'").select("source", "area", "contract", "station_count", F.lit(now).cast("long").alias("updated_at")))
    return both.groupBy("source", "area", "contract").agg(F.max("station_count").alias("station_count"), F.max("updated_at").alias("updated_at"))


def bucket_counts(assessments: DataFrame) -> DataFrame:
    """Counts of an overview; an entity with a live positive is never counted as not selling."""
    good = F.col("verdict").isin("AVAILABLE", "LIKELY_AVAILABLE")
    sells = F.coalesce("sells_requested", F.lit(True)) | good
    n = lambda c: F.count_if(c)
    return assessments.agg(n(good).alias("positive"), n(~sells).alias("not_sold"), n(sells & F.col("verdict").isin("CONFLICTING", "INDIRECT")).alias("unclear"), n(sells & (F.col("verdict") == "NOT_AVAILABLE")).alias("negative"), n(sells & (F.col("verdict") == "NO_FRESH_DATA")).alias("empty"))


def source_availability(health: DataFrame, coverage: DataFrame) -> DataFrame:
    """How many sources contribute (have coverage), and how many of those are degraded; disabled ones are ignored."""
    j = health.where("status <> 'DISABLED'").join(coverage.select("source", F.lit(True).alias("covered")).distinct(), "source", "left")
    has = F.coalesce("covered", F.lit(False))
    return j.agg(F.count("*").alias("enabled"), F.count_if(has).alias("contributing"), F.count_if(has & (F.col("status") != "OK")).alias("degraded"))


def user_warnings(warnings: DataFrame, technical: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct warnings without technical codes; known ones as their text, unknown ones as they are."""
    kept = warnings.join(technical, "code", "left_anti").join(texts, "code", "left")
    return kept.select(F.coalesce("text", "code").alias("warning")).distinct()


def empty_streaks(ticks: DataFrame, threshold: int = DEFAULTS.compact_after_empty) -> DataFrame:
    """Per entity, runs of consecutive empty ticks (started, ticks), and whether the report would be compact."""
    w = W.partitionBy("entity").orderBy("tick")
    t = ticks.withColumn("group", F.sum((~F.col("empty")).cast("int")).over(w)).where("empty")
    return t.groupBy("entity", "group").agg(F.min("tick").alias("started"), F.count("*").alias("ticks")).select("entity", "started", "ticks", (F.col("ticks") >= threshold).alias("compact"))


def tick_summary(ticks: DataFrame) -> DataFrame:
    """Per tick, how many entities have each verdict."""
    names = ["AVAILABLE", "LIKELY_AVAILABLE", "CONFLICTING", "INDIRECT", "NOT_AVAILABLE"]
    return ticks.groupBy("tick").agg(F.count("*").alias("entities"), *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in names])
