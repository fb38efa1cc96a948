"""History statistics over ticks: coverage, gaps, outage episodes, durations, times of day, arrivals.

A tick row is (tick, entity, verdict, confidence): epoch minutes, a key, a verdict and a confidence rank, one row per
entity and tick. All of these share the partitioning by entity; a window over an entity's ticks spills by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sightline.functions.columns import circular_difference, confirmed_positive, half_up, kind, local_minute, local_weekday
from sightline.params import DEFAULTS

GAP = DEFAULTS.gap_intervals


def by_entity() -> W:
    return W.partitionBy("entity").orderBy("tick")


def collapse(rows: DataFrame) -> DataFrame:
    """One row per (entity, tick) from several: the conservative verdict, the least confidence, the union of members.

    All negative: not available. All confirmed positive: the verdict if one, else likely. Else conflicting.
    """
    agg = rows.groupBy("entity", "tick").agg(
        F.bool_and(F.col("verdict") == "NOT_AVAILABLE").alias("out"),
        F.bool_and(confirmed_positive(F.col("verdict"), F.col("confidence"))).alias("good"),
        F.min("verdict").alias("low"), F.max("verdict").alias("high"), F.count("*").alias("n"),
        F.min("confidence").alias("confidence"),
        F.array_sort(F.collect_set("member")).alias("members"),
    )
    verdict = F.when(F.col("n") == 1, F.col("low")).when(F.col("out"), "NOT_AVAILABLE").when(F.col("good") & (F.col("low") == F.col("high")), F.col("low")).when(F.col("good"), "LIKELY_AVAILABLE").otherwise("CONFLICTING")
    return agg.select("entity", "tick", verdict.alias("verdict"), "confidence", "members")


def coverage_summary(ticks: DataFrame, interval: int) -> DataFrame:
    """Number of ticks, first and last, and how many the interval would give."""
    agg = ticks.agg(F.count_distinct("tick").alias("ticks"), F.min("tick").alias("first"), F.max("tick").alias("last"))
    return agg.withColumn("expected", F.floor((F.col("last") - F.col("first")) / interval).cast("long") + 1)


def distinct_ticks_with_gap(ticks: DataFrame) -> DataFrame:
    """Distinct ticks with the tick before: found by day, then across the first ticks of days, so no task sees all."""
    day = F.floor(F.col("tick") / 1440)
    each = ticks.select("tick").distinct().withColumn("day", day)
    inside = each.withColumn("before", F.lag("tick").over(W.partitionBy("day").orderBy("tick")))
    days = each.groupBy("day").agg(F.max("tick").alias("last"))
    earlier = days.withColumn("before_day", F.lag("last").over(W.orderBy("day"))).select("day", "before_day")
    return inside.join(earlier, "day").select("tick", F.coalesce("before", "before_day").alias("before"))


def collection_gaps(ticks: DataFrame, interval: int, k: int = 5) -> DataFrame:
    """The k longest pauses of more than three intervals between ticks, with the number of all such pauses."""
    gaps = distinct_ticks_with_gap(ticks).where(F.col("tick") - F.col("before") > GAP * interval)
    longest = gaps.select(F.col("before").alias("gap_from"), F.col("tick").alias("gap_to"), (F.col("tick") - F.col("before")).alias("minutes")).orderBy(F.desc("minutes"), "gap_from").limit(k)
    return longest.withColumn("gaps", gaps.agg(F.count("*")).scalar())


def health_shares(health: DataFrame) -> DataFrame:
    """Per source: ticks by status, and the share of OK among ticks that carry health. health (tick, source, status)."""
    agg = health.groupBy("source").agg(F.count("*").alias("ticks"), F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(F.col("status") == "PARTIAL").alias("partial"), F.count_if(~F.col("status").isin("OK", "PARTIAL")).alias("other"))
    return agg.withColumn("ok_share", half_up(100.0 * F.col("ok") / F.col("ticks")))


def sample_shares(ticks: DataFrame) -> DataFrame:
    """Rounded percent of ticks that are positive, negative and unclear; they need not sum to 100."""
    k = kind(F.col("verdict"), F.col("confidence"))
    agg = ticks.groupBy("entity").agg(F.count("*").alias("samples"), F.count_if(k == "P").alias("p"), F.count_if(k == "N").alias("n"))
    share = lambda x: half_up(100.0 * x / F.col("samples"))
    return agg.select("entity", "samples", share(F.col("p")).alias("positive"), share(F.col("n")).alias("negative"), share(F.col("samples") - F.col("p") - F.col("n")).alias("unclear"))


def segments(ticks: DataFrame, gap: int) -> DataFrame:
    """Ticks with kind and segment: a segment ends after P or X, or at a gap; W rows stay in."""
    k = ticks.withColumn("kind", kind(F.col("verdict"), F.col("confidence")))
    w = by_entity()
    reset = (F.col("tick") - F.lag("tick").over(w) > gap) | F.lag("kind").over(w).isin("P", "X")
    marked = k.withColumn("reset", F.when(reset, 1).otherwise(0))
    return marked.withColumn("segment", F.sum("reset").over(w)).drop("reset")


def outage_episodes(ticks: DataFrame, interval: int, positive_length: bool = False) -> DataFrame:
    """Completed outages (entity, started, restored, minutes): from not available to confirmed positive, without a gap."""
    agg = segments(ticks, GAP * interval).groupBy("entity", "segment").agg(F.min(F.when(F.col("kind") == "N", F.col("tick"))).alias("started"), F.max(F.when(F.col("kind") == "P", F.col("tick"))).alias("restored"))
    out = agg.where("started is not null and restored is not null").select("entity", "started", "restored", (F.col("restored") - F.col("started")).alias("minutes"))
    return out.where("minutes > 0") if positive_length else out


def current_run(ticks: DataFrame, interval: int) -> DataFrame:
    """State at the entity's last tick, since when, and whether the last tick of all lists the entity."""
    k = kind(F.col("verdict"), F.col("confidence"))
    w = by_entity()
    marked = ticks.withColumn("state", F.when(k == "P", "positive").when(k == "N", "negative").otherwise("unclear"))
    starts = (F.col("tick") - F.lag("tick").over(w) > GAP * interval) | (F.lag("state").over(w) != F.col("state")) | F.lag("state").over(w).isNull()
    marked = marked.withColumn("start", F.when(starts, F.col("tick")))
    agg = marked.groupBy("entity").agg(F.max_by("state", "tick").alias("state"), F.max("start").alias("since"), F.max("tick").alias("seen"))
    return agg.select("entity", "state", "since", (F.col("seen") == ticks.agg(F.max("tick")).scalar()).alias("visible"))


def current_negative_start(ticks: DataFrame, interval: int) -> DataFrame:
    """Entities whose last tick is not available, and since when without a gap or any other verdict (weak ones too)."""
    w = by_entity()
    out = F.col("verdict") == "NOT_AVAILABLE"
    breaks = ~out | (F.col("tick") - F.lag("tick").over(w) > GAP * interval) | ~F.coalesce(F.lag(out).over(w), F.lit(False))
    marked = ticks.withColumns({"out": out, "start": F.when(breaks, F.col("tick"))})
    agg = marked.groupBy("entity").agg(F.max_by("out", "tick").alias("out"), F.max("start").alias("negative_since"))
    return agg.where("out").select("entity", "negative_since")


def duration_quantiles(episodes: DataFrame) -> DataFrame:
    """Exact quartiles and greatest of outage minutes, whole minutes."""
    agg = episodes.groupBy("entity").agg(F.count("*").alias("outages"), F.percentile("minutes", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max("minutes").alias("longest"))
    q = lambda i: half_up(F.element_at("q", i))
    return agg.select("entity", "outages", q(1).alias("p25"), q(2).alias("median"), q(3).alias("p75"), "longest")


def hour_histogram(episodes: DataFrame, offset: int = DEFAULTS.utc_offset_minutes) -> DataFrame:
    """Dense 24 counts of restorations by local hour, for each entity."""
    hour = F.floor(local_minute(F.col("restored"), offset) / 60)
    return dense_histogram(episodes, hour, 24, "hour")


def weekday_histogram(episodes: DataFrame, offset: int = DEFAULTS.utc_offset_minutes) -> DataFrame:
    """Dense 7 counts of restorations by local weekday, for each entity."""
    return dense_histogram(episodes, local_weekday(F.col("restored"), offset), 7, "weekday")


def dense_histogram(episodes: DataFrame, value: Column, bins: int, name: str) -> DataFrame:
    counts = [F.count_if(value == b).alias(f"b{b}") for b in range(bins)]
    agg = episodes.groupBy("entity").agg(*counts)
    pairs = F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias(name), F.col(f"b{b}").alias("n")) for b in range(bins)])).alias("x")
    return agg.select("entity", pairs).select("entity", f"x.{name}", "x.n")


def circular_window(values: DataFrame, keys: list[str], at: str, offset: int = DEFAULTS.utc_offset_minutes, least: int = 3) -> DataFrame:
    """Typical local time of day of event times `at` (epoch minutes) per keys, with the middle half around it.

    The centre is the observed minute with the least sum of circular distances (the earliest event on a tie); the
    window ends are the quartiles of the distances to it. Events are counted by minute first, so a group never holds
    more than 1440 values.
    """
    minute = local_minute(F.col(at), offset).alias("m")
    counted = values.groupBy(*keys, minute).agg(F.count("*").alias("c"), F.min(at).alias("first"))
    groups = counted.groupBy(*keys).agg(F.sum("c").alias("n"), F.collect_list(F.struct("m", "c", "first")).alias("a")).where(F.col("n") >= least)
    cost = F.transform("a", lambda x: F.struct(F.aggregate("a", F.lit(0).cast("long"), lambda s, y: s + y["c"] * F.abs(circular_difference(y["m"], x["m"]))).alias("cost"), x["first"].alias("first"), x["m"].alias("m")))
    centred = groups.withColumn("centre", F.array_min(cost)["m"])
    rows = centred.select(*keys, "n", "centre", F.explode("a").alias("x")).select(*keys, "n", "centre", circular_difference(F.col("x.m"), F.col("centre")).alias("d"), F.col("x.c").alias("c"))
    agg = rows.groupBy(*keys, "n", "centre").agg(F.percentile("d", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("c")).alias("q"))
    return agg.select(*keys, "n", "centre", *[F.element_at("q", i + 1).alias(f"q{i}") for i in range(3)])


def typical_time(episodes: DataFrame) -> DataFrame:
    """Local minutes of day at which outages usually end: median, and the window around it."""
    w = circular_window(episodes, ["entity"], "restored")
    at = lambda q: F.pmod(half_up(F.col("centre") + F.col(q)), F.lit(1440))
    return w.select("entity", "n", at("q1").alias("median_minute"), at("q0").alias("window_start"), at("q2").alias("window_end"))


def arrival_events(reports: DataFrame, start: int | None = None) -> DataFrame:
    """Distinct (entity, source, at) of grade-specific transition reports with no or a positive status.

    reports (entity, source, at seconds, status, grade_specific, tick_seconds): those before `start`, or over five
    minutes after their tick, are left out.
    """
    ok = reports.where("grade_specific and (status is null or status in ('IN_STOCK', 'LIMITED')) and at <= tick_seconds + 300")
    if start is not None:
        ok = ok.where(F.col("at") >= start)
    return ok.select("entity", "source", "at").distinct()


def sessions(events: DataFrame, keys: list[str], at: str, gap_seconds: int) -> DataFrame:
    """events with `session`, a running number per keys: a pause of more than the gap opens a new one."""
    w = W.partitionBy(*keys).orderBy(at)
    opens = F.when(F.col(at) - F.lag(at).over(w) > gap_seconds, 1).otherwise(0)
    return events.withColumn("opens", opens).withColumn("session", F.sum("opens").over(w.rangeBetween(W.unboundedPreceding, 0))).drop("opens")


def arrival_sessions(arrivals: DataFrame, gap_minutes: int = DEFAULTS.arrival_gap_minutes) -> DataFrame:
    """Reports of one arrival: first time, the sources, and how many."""
    s = sessions(arrivals, ["entity"], "at", gap_minutes * 60)
    return s.groupBy("entity", "session").agg(F.min("at").alias("at"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("reports")).drop("session")


def latest(rows: DataFrame, order: list[Column], k: int = 5) -> DataFrame:
    """The k latest rows of each entity."""
    w = W.partitionBy("entity").orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def timeline(ticks: DataFrame, members: DataFrame, health: DataFrame) -> DataFrame:
    """Per entity and tick: verdict, confidence, sources that listed it, and sources that failed at the tick.

    members (entity, tick, member `source:id`); a disabled source has not failed.
    """
    listed = members.groupBy("entity", "tick").agg(F.array_join(F.array_sort(F.collect_set(F.substring_index("member", ":", 1))), ",").alias("listed_by"))
    failed = health.where("status not in ('OK', 'DISABLED')").groupBy("tick").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("failed"))
    return ticks.join(listed, ["entity", "tick"], "left").join(failed, "tick", "left").select("entity", "tick", "verdict", "confidence", F.coalesce("listed_by", F.lit("")).alias("listed_by"), F.coalesce("failed", F.lit("")).alias("failed"))


def result_order(shares: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Entities ordered by outages (most first), then positive share, then key; with their place."""
    joined = shares.join(quantiles.select("entity", "outages"), "entity", "left").select("entity", F.coalesce("outages", F.lit(0)).alias("outages"), "positive")
    return joined.orderBy(F.desc("outages"), "positive", "entity")


def latest_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The last value that is not null of each display field."""
    return rows.groupBy("entity").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("tick"))).alias(f) for f in fields])


def entity_keys(tokens: DataFrame) -> DataFrame:
    """All distinct tokens of each entity, sorted."""
    return tokens.groupBy("entity").agg(F.array_sort(F.collect_set("token")).alias("keys"))
