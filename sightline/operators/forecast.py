"""Forecast of the next restoration, with back-off from the entity to its brand to the area.

Event rows have entity, brand, at (epoch minutes), medium (its confidence), signal. Patterns are aggregated once per
scope; an entity looks its scopes up with joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from sightline.functions.columns import half_up, local_minute
from sightline.operators.history import circular_window, sessions
from sightline.params import DEFAULTS, STATUS, Params

SIGNALS = ["ROLLING_ACTIVITY", "SOURCE_TIMELINE", "PETROL_STATUS_PATTERN"]


def rolling_counts(activity: DataFrame) -> DataFrame:
    """Per (entity, source, grade, tick): total count, least window, latest event, counts by variant."""
    ok = activity.where("grade_specific and count is not null and window_minutes is not null and grade is not null")
    each = ok.groupBy("entity", "source", "grade", "tick", "variant").agg(F.sum("count").alias("c"), F.min("window_minutes").alias("w"), F.max("latest").alias("l"))
    return each.groupBy("entity", "source", "grade", "tick").agg(F.sum("c").alias("count"), F.min("w").alias("window_minutes"), F.max("l").alias("latest"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", "c")))).alias("variants"))


def grade_statuses(activity: DataFrame) -> DataFrame:
    """Per (entity, source, grade, tick): the strongest status (as a rank), and by variant."""
    rank = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in STATUS.items()], F.lit(0))
    each = activity.where("grade_specific and grade is not null").groupBy("entity", "source", "grade", "tick", "variant").agg(F.max(rank).alias("s"))
    return each.groupBy("entity", "source", "grade", "tick").agg(F.max("s").alias("status"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", "s")))).alias("variants"))


def variant_key(product_key, label):
    """The product key unless unknown, else the label."""
    return F.coalesce(F.when(product_key != "AI95_UNKNOWN", product_key), F.when(label != "", label), product_key)


def _with_before(rows: DataFrame, fields: list[str]) -> DataFrame:
    w = W.partitionBy("entity", "source", "grade").orderBy("tick")
    return rows.withColumn("b", F.lag(F.struct("tick", *fields)).over(w))


def rolling_events(counts: DataFrame, interval: int, p: Params = DEFAULTS) -> DataFrame:
    """Resumptions (entity, tick, at, grades, total, medium): counts that rise from zero, witnessed by one variant.

    The row before must be at most three intervals old, with a zero count over a quiet window; the count now must
    reach the minimum with a recent event; and some variant must read zero before and above it now.
    """
    r = _with_before(counts, ["count", "window_minutes", "variants"])
    witness = F.exists(F.map_entries("variants"), lambda e: (e["value"] > 0) & (F.try_element_at(F.col("b.variants"), e["key"]) == 0))
    age = F.col("tick") - F.col("latest")
    ok = (F.col("tick") - F.col("b.tick") <= 3 * interval) & witness & (F.col("b.window_minutes") >= p.quiet_gap_minutes) & (F.col("b.count") == 0) & (F.col("count") >= p.minimum_events) & (age * 60 >= -p.future_skew_seconds) & (age <= p.resume_window_minutes)
    agg = r.where(ok).groupBy("entity", "tick").agg(F.max("latest").alias("at"), F.count_distinct("grade").alias("grades"), F.sum("count").alias("total"))
    return agg.withColumn("medium", (F.col("grades") >= 2) | (F.col("total") >= p.strong_signal))


def status_events(statuses: DataFrame, interval: int) -> DataFrame:
    """Transitions (entity, tick, at, grades, medium) from out of stock to limited or in stock, with a variant witness."""
    r = _with_before(statuses, ["status", "variants"])
    witness = F.exists(F.map_entries("variants"), lambda e: (e["value"] >= 2) & (F.try_element_at(F.col("b.variants"), e["key"]) == 1))
    ok = (F.col("tick") - F.col("b.tick") <= 3 * interval) & witness & (F.col("b.status") == 1) & (F.col("status") >= 2)
    agg = r.where(ok).groupBy("entity", "tick").agg(F.count_distinct("grade").alias("grades"))
    return agg.select("entity", "tick", F.col("tick").alias("at"), "grades", (F.col("grades") >= 2).alias("medium"))


def timeline_events(reports: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Clusters (entity, at seconds, grades, sources, medium) of distinct reports (entity, source, grade, at)."""
    gap = max(p.resume_window_minutes, 2 * p.quiet_gap_minutes) * 60
    s = sessions(reports.select("entity", "source", "grade", "at").distinct(), ["entity"], "at", gap)
    agg = s.groupBy("entity", "session").agg(F.min("at").alias("at"), F.count_distinct("grade").alias("grades"), F.count_distinct("source").alias("sources"))
    return agg.withColumn("medium", (F.col("grades") >= 2) | (F.col("sources") >= 2)).drop("session")


def scoped(events: DataFrame) -> DataFrame:
    """Each event under its three scopes (basis, scope key)."""
    scopes = F.array(F.struct(F.lit(0).alias("basis"), F.col("entity").cast("string").alias("scope")), F.struct(F.lit(1).alias("basis"), F.col("brand").alias("scope")), F.struct(F.lit(2).alias("basis"), F.lit("").alias("scope")))
    return events.withColumn("s", F.explode(scopes)).withColumns({"basis": F.col("s.basis"), "scope": F.col("s.scope")}).drop("s").where("scope is not null")


def time_patterns(events: DataFrame, offset: int = DEFAULTS.utc_offset_minutes) -> DataFrame:
    """Time-of-day patterns by (signal rank, basis, scope) with at least two values on two local dates."""
    rows = scoped(events)
    keys = ["signal", "basis", "scope"]
    days = rows.groupBy(*keys).agg(F.count_distinct(F.floor((F.col("at") + offset) / 1440)).alias("days"), F.count_if("medium").alias("strong"))
    return circular_window(rows, keys, "at", offset, least=2).join(days, keys).where("days >= 2").drop("days")


def duration_patterns(episodes: DataFrame) -> DataFrame:
    """Quartiles of outage minutes by (basis, scope) with at least two episodes."""
    agg = scoped(episodes).groupBy("basis", "scope").agg(F.count("*").alias("n"), F.percentile("minutes", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return agg.where("n >= 2").select("basis", "scope", "n", *[F.element_at("q", i + 1).alias(f"q{i}") for i in range(3)])


def candidates(assessments: DataFrame, negative: DataFrame) -> DataFrame:
    """Entities not available now that may sell the product, with the start of their negative run."""
    return assessments.where(F.col("verdict") == "NOT_AVAILABLE").where(F.coalesce("sells_requested", F.lit(True))).join(negative, "entity").select("entity", "brand", "negative_since")


def forecast(cands: DataFrame, patterns: DataFrame, durations: DataFrame, now: int, offset: int = DEFAULTS.utc_offset_minutes) -> DataFrame:
    """Expected restoration of each candidate (epoch minutes): expected_at, window_start, window_end, confidence, basis, signal, n.

    Signals in order, and within a signal entity, brand, area; a duration pattern only where no time pattern is. A
    duration window that has ended drops the candidate.
    """
    known = patterns.select("basis", "scope", "signal", "n", "centre", "q0", "q1", "q2", "strong")
    # Durations stand behind all signals, so the first that is there decides, and both tables are planned once.
    lengths = durations.select("basis", "scope", F.lit(len(SIGNALS)).alias("signal"), "n", F.lit(None).cast("double").alias("centre"), "q0", "q1", "q2", F.lit(0).cast("long").alias("strong"))
    told = scoped(cands).join(known.unionByName(lengths), ["basis", "scope"])
    fields = [c for c in told.columns if c not in ("entity", "negative_since")]
    best = told.groupBy("entity", "negative_since").agg(F.min_by(F.struct(*fields), F.struct("signal", "basis")).alias("b")).select("entity", "negative_since", "b.*")
    timed, start = F.col("signal") < len(SIGNALS), F.col("negative_since")
    centred = F.col("centre") + F.col("q1")
    minute = F.pmod(F.floor(centred), F.lit(1440)) + (centred - F.floor(centred))
    ahead = minute - local_minute(F.lit(now), offset)
    expected = now + F.when(ahead > 0, ahead).otherwise(ahead + 1440)
    strong = (F.col("basis") == 0) & (F.col("n") >= 3)
    out = best.where(timed | (start + F.col("q2") > now)).select(
        "entity",
        "negative_since",
        F.when(timed, expected).otherwise(F.greatest(start + F.col("q1"), F.lit(now))).alias("expected_at"),
        F.when(timed, F.greatest(expected + F.col("q0") - F.col("q1"), F.lit(now))).otherwise(F.greatest(start + F.col("q0"), F.lit(now))).alias("window_start"),
        F.when(timed, expected + F.col("q2") - F.col("q1")).otherwise(start + F.col("q2")).alias("window_end"),
        (strong & (~timed | (F.col("strong") >= 2))).alias("medium"),
        "basis",
        "signal",
        "n",
    )
    names = F.array(*[F.lit(x) for x in [*SIGNALS, "STATUS_TRANSITION"]])
    bases = F.array(*[F.lit(x) for x in ("STATION", "BRAND", "AREA")])
    r = lambda c: half_up(F.col(c).cast("double")).alias(c)
    return out.select("entity", "negative_since", r("expected_at"), r("window_start"), r("window_end"), F.when(F.col("medium"), "MEDIUM").otherwise("LOW").alias("confidence"), F.element_at(bases, F.col("basis") + 1).alias("basis"), F.element_at(names, F.col("signal") + 1).alias("signal"), "n")


def next_restorations(forecasts: DataFrame, k: int = DEFAULTS.forecast_count) -> DataFrame:
    return forecasts.orderBy("expected_at", "entity").limit(k)


def entity_brand(brand, title):
    """The comparable brand, else the plain title."""
    return F.coalesce(F.when(brand != "", brand), F.when(title != "", title))
