"""Evidence fusion: from observations of several sources to a verdict with a confidence.

An observation row has entity, product, specificity (EXACT_VARIANT, FAMILY_ONLY, CATALOG_ONLY), status, source,
provenance, family_all (an explicit negative for the whole family), signals (per hour) and a time: time_kind (EXACT,
BOUNDED_AGE, UNKNOWN), at (seconds), min_minutes, max_minutes. Everything is built-in expressions: one aggregation per
entity and product, ordered conditions on top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sightline.functions.columns import confidence_label, confidence_rank
from sightline.operators.history import sessions
from sightline.params import DEFAULTS, QUEUE, Params

POSITIVE = ["IN_STOCK", "LIMITED"]


def band(age: Column, p: Params) -> Column:
    return F.when(age <= p.fresh_minutes, "fresh").when(age <= p.recent_minutes, "recent").when(age <= p.stale_minutes, "stale").otherwise("expired")


def enrich(observations: DataFrame, now: int, p: Params = DEFAULTS) -> DataFrame:
    """Adds age (minutes), band, approximate, usable and observed (seconds).

    Exact times are aged from now, not below zero, and invalid beyond the future skew; a bounded age counts as its
    greatest; anything else is unusable.
    """
    exact = (F.col("time_kind") == "EXACT") & (F.col("at") <= now + p.future_skew_seconds)
    bounded = (F.col("time_kind") == "BOUNDED_AGE") & (F.col("min_minutes") >= 0) & (F.col("max_minutes") >= F.col("min_minutes"))
    age = F.when(exact, F.greatest(F.lit(0.0), (now - F.col("at")) / 60.0)).when(bounded, F.col("max_minutes").cast("double"))
    bad = F.col("time_kind").isin("EXACT", "BOUNDED_AGE")
    observed = F.when(exact, F.col("at").cast("double")).when(bounded, now - F.col("max_minutes") * 60.0)
    out = observations.withColumns({"age": age, "observed": observed})
    label = F.when(F.col("age").isNotNull(), band(F.col("age"), p)).when(bad, "invalid").otherwise("unknown")
    return out.withColumns({"band": label, "approximate": F.coalesce(bounded, F.lit(False)), "usable": F.coalesce(F.col("age") <= p.expire_minutes, F.lit(False))})


def signs(evidence: DataFrame) -> DataFrame:
    """Adds positive, negative and family_positive: the roles an observation may play."""
    exact = F.col("specificity") == "EXACT_VARIANT"
    good = F.col("status").isin(POSITIVE)
    return evidence.withColumns({"positive": F.col("usable") & exact & good, "negative": F.col("usable") & (F.col("status") == "OUT_OF_STOCK") & (exact | F.coalesce("family_all", F.lit(False))), "family_positive": F.col("usable") & good & (F.col("specificity") == "FAMILY_ONLY")})


def fresh_conflicts(evidence: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Keys that have a fresh positive and a fresh negative within the conflict window of each other.

    The nearest opposite sign is among the neighbours in time, so the pairs are found by a window, not by a join of
    all positives with all negatives.
    """
    fresh = signs(evidence).where("band = 'fresh' and (positive or negative)")
    w = W.partitionBy(*keys).orderBy("observed")
    upto = w.rangeBetween(W.unboundedPreceding, 0)
    last_positive = F.max(F.when(F.col("positive"), F.col("observed"))).over(upto)
    last_negative = F.max(F.when(F.col("negative"), F.col("observed"))).over(upto)
    near = F.coalesce(F.col("positive") & (F.col("observed") - last_negative <= p.conflict_window_minutes * 60), F.lit(False)) | F.coalesce(F.col("negative") & (F.col("observed") - last_positive <= p.conflict_window_minutes * 60), F.lit(False))
    return fresh.withColumn("near", near).where("near").select(*keys).distinct()


def positive_confidence(provenances: Column, strongest: Column, fresh: Column, resumed: Column, p: Params) -> Column:
    """Rank: two provenances among fresh positives or a strong signal is high; any fresh, or resumed activity, medium."""
    return F.when((provenances >= 2) | (F.coalesce(strongest, F.lit(0.0)) >= p.strong_signal), 3).when((fresh > 0) | resumed, 2).otherwise(1)


def assess(observations: DataFrame, activity: DataFrame, keys: list[str], now: int, p: Params = DEFAULTS) -> DataFrame:
    """Verdict, confidence, age of the freshest usable evidence, whether approximate, and supporting sources, per keys.

    activity (keys, kind, grade_specific, at seconds): resumed transactions count where specific to the grade.
    """
    evidence = signs(enrich(observations, now, p))
    when = lambda c: F.max(F.when(F.col(c), F.col("observed")))
    fresh = F.col("positive") & (F.col("band") == "fresh")
    agg = evidence.groupBy(*keys).agg(
        when("positive").alias("pos"), when("negative").alias("neg"), F.bool_or("family_positive").alias("family"), F.bool_or("usable").alias("any"),
        F.count_distinct(F.when(fresh, F.col("provenance"))).alias("provenances"), F.max(F.when(fresh, F.col("signals"))).alias("strongest"), F.count_if(fresh).alias("fresh"),
        F.min(F.when(F.col("usable"), F.col("age"))).alias("freshest_age"), F.bool_or(F.col("usable") & F.col("approximate")).alias("approximate"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("usable"), F.col("source")))), ",").alias("sources"),
    )
    specific = activity.where("kind = 'TRANSACTIONS_RESUMED' and grade_specific")
    live = (F.col("at") <= now + p.future_skew_seconds) & (now - F.col("at") <= p.expire_minutes * 60)
    resumed = specific.groupBy(*keys).agg(F.max(F.when(live, F.col("at").cast("double"))).alias("resumed"))
    clash = fresh_conflicts(evidence, keys, p).withColumn("clash", F.lit(True))
    j = agg.join(resumed.withColumn("ever_resumed", F.lit(True)), keys, "full").join(clash, keys, "left")
    newer = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) > F.col(b)))
    window = p.conflict_window_minutes * 60
    near = F.coalesce(F.abs(F.col("resumed") - F.col("neg")) <= window, F.lit(False))
    case = F.when(F.coalesce("clash", F.lit(False)), "CONFLICTING").when(newer("pos", "neg"), "AVAILABLE").when(F.coalesce("family", F.lit(False)), "LIKELY_AVAILABLE").when(near, "CONFLICTING").when(newer("resumed", "neg"), "LIKELY_AVAILABLE").when(newer("neg", "pos"), "NOT_AVAILABLE").when(F.coalesce("any", F.lit(False)), "INDIRECT").otherwise("NO_FRESH_DATA")
    sure = positive_confidence(F.coalesce("provenances", F.lit(0)), F.col("strongest"), F.coalesce("fresh", F.lit(0)), F.coalesce("ever_resumed", F.lit(False)), p)
    j = j.withColumn("verdict", case)
    rank = F.when(F.col("verdict") == "AVAILABLE", sure).when((F.col("verdict") == "LIKELY_AVAILABLE") & ~F.coalesce("family", F.lit(False)), 2).when(F.col("verdict") == "NOT_AVAILABLE", 2).when(F.col("verdict") == "NO_FRESH_DATA", 0).otherwise(1)
    return j.select(*keys, "verdict", confidence_label(rank).alias("confidence"), "freshest_age", F.coalesce("approximate", F.lit(False)).alias("approximate"), F.coalesce("sources", F.lit("")).alias("sources"))


def assess_union(observations: DataFrame, activity: DataFrame, products: list[str], unknown: str, now: int, p: Params = DEFAULTS) -> DataFrame:
    """One verdict per entity over the configured products, the unclassified product and the family as a whole.

    A whole-family negative speaks for every configured product. Order: available, likely, likely by family,
    conflicting, whole family negative, every product negative (weakest confidence), indirect, no data.
    """
    whole = F.coalesce("family_all", F.lit(False)) & (F.col("specificity") == "FAMILY_ONLY")
    listed = F.array(*[F.lit(x) for x in products])
    spread = observations.withColumn("slot", F.explode(F.when(whole, F.array_union(listed, F.array("product"))).otherwise(F.array("product")))).where(F.col("slot").isin([*products, unknown]))
    acts = activity.withColumn("slot", F.col("product")).where(F.col("slot").isin([*products, unknown]))
    each = assess(spread, acts, ["entity", "slot"], now, p)
    # Activity for the unclassified product alone makes no assessment of it.
    seen = observations.where(F.col("product") == unknown).select("entity").distinct().withColumn("has_unknown", F.lit(True))
    each = each.join(seen, "entity", "left").where((F.col("slot") != unknown) | F.col("has_unknown"))
    family = observations.where("specificity = 'FAMILY_ONLY'")
    as_family = assess(family, activity.join(family.select("entity").distinct(), "entity", "left_semi"), ["entity"], now, p).select("entity", F.col("verdict").alias("family"), confidence_rank(F.col("confidence")).alias("family_rank"))
    gone = enrich(family, now, p).where("family_all and status = 'OUT_OF_STOCK' and usable").select("entity").distinct().withColumn("all_gone", F.lit(True))
    rank = confidence_rank(F.col("confidence"))
    best = lambda v: F.max(F.when(F.col("verdict") == v, rank)).alias(v)
    out_here = (F.col("verdict") == "NOT_AVAILABLE") & F.col("slot").isin(products)
    agg = each.groupBy("entity").agg(best("AVAILABLE"), best("LIKELY_AVAILABLE"), best("CONFLICTING"), F.count_if(out_here).alias("outs"), F.min(F.when(out_here, rank)).alias("weakest"), F.bool_or(F.col("verdict") == "INDIRECT").alias("indirect"))
    everyone = observations.select("entity").union(activity.select("entity")).distinct()
    j = everyone.join(agg, "entity", "left").join(as_family, "entity", "left").join(gone, "entity", "left")
    steps = [
        (F.col("AVAILABLE").isNotNull(), "AVAILABLE", F.col("AVAILABLE")), (F.col("LIKELY_AVAILABLE").isNotNull(), "LIKELY_AVAILABLE", F.col("LIKELY_AVAILABLE")),
        (F.col("family") == "LIKELY_AVAILABLE", "LIKELY_AVAILABLE", F.col("family_rank")), (F.col("CONFLICTING").isNotNull(), "CONFLICTING", F.col("CONFLICTING")),
        (F.coalesce("all_gone", F.lit(False)), "NOT_AVAILABLE", F.lit(2)), (F.col("outs") == len(products), "NOT_AVAILABLE", F.col("weakest")),
        (F.coalesce("indirect", F.lit(False)) | (F.coalesce("family", F.lit("")) == "INDIRECT"), "INDIRECT", F.lit(1)),
    ]
    verdict, confidence = F.lit("NO_FRESH_DATA"), F.lit(0)
    for test, name, value in reversed(steps):
        verdict = F.when(test, name).otherwise(verdict)
        confidence = F.when(test, value).otherwise(confidence)
    return j.select("entity", verdict.alias("verdict"), confidence_label(confidence).alias("confidence"))


def derive_activity(records: DataFrame, fetched: int, p: Params = DEFAULTS) -> DataFrame:
    """Kind of each timeline of grade-specific events: resumed after a quiet gap, ongoing, or a recent signal.

    records (.., event_times array<bigint seconds>, preceding_gap_minutes, grade_specific, kind).
    """
    times = F.array_sort(F.filter("event_times", lambda t: t.isNotNull() & (t <= fetched + p.future_skew_seconds)))
    recent = F.filter("times", lambda t: fetched - t <= p.resume_window_minutes * 60)
    out = records.withColumn("times", times).withColumn("recent", recent)
    before = F.filter("times", lambda t: t < F.get("recent", F.lit(0)))
    gap = F.when((F.size("recent") > 0) & (F.size(before) > 0), (F.get("recent", F.lit(0)) - F.array_max(before)) / 60.0).otherwise(F.col("preceding_gap_minutes").cast("double"))
    out = out.withColumn("gap", gap)
    resumed = (F.size("recent") >= p.minimum_events) & F.coalesce(F.col("gap") >= p.quiet_gap_minutes, F.lit(False))
    plain = ~F.coalesce("grade_specific", F.lit(False)) | (F.size("times") == 0)
    kind = F.when(plain, F.when(F.col("kind") == "TRANSACTIONS_RESUMED", "RECENT_SIGNAL").otherwise(F.col("kind"))).when(resumed, "TRANSACTIONS_RESUMED").when(F.size("recent") > 0, "TRANSACTIONS_ONGOING").otherwise("RECENT_SIGNAL")
    is_resumed = ~plain & resumed
    return out.withColumns({"derived_kind": kind, "resumed_at": F.when(is_resumed, F.get("recent", F.lit(0))), "latest_event_at": F.when(is_resumed, F.array_max("recent"))}).drop("recent", "times", "gap")


def transitions(reports: DataFrame) -> DataFrame:
    """Returns to stock: rows (entity, grade, at) where a yes follows a no.

    reports (entity, grade, at, sign): 1 yes or queue, -1 no. A no without a grade speaks for every grade of its entity.
    """
    grades = reports.where("grade is not null").select("entity", "grade").distinct()
    family = reports.where("grade is null and sign = -1").select("entity", "at", "sign").join(grades, "entity")
    rows = reports.where("grade is not null").select("entity", "grade", "at", "sign").unionByName(family)
    # At one instant a no comes before a yes.
    w = W.partitionBy("entity", "grade").orderBy("at", "sign")
    before = F.last(F.when(F.col("sign") != 0, F.col("sign")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("before", before).where("sign = 1 and before = -1").select("entity", "grade", "at").distinct()


def fuse_queues(queues: DataFrame, now: int) -> DataFrame:
    """One queue per entity: counts beat ordinals beat presence beat text; the freshest first, then the shorter.

    queues (entity, kind, vehicle_count, ordinal, raw_value, at seconds or null).
    """
    age = F.when(F.col("at").isNotNull(), F.greatest(F.lit(0.0), (now - F.col("at")) / 60.0)).otherwise(F.lit(1e15))
    order = F.coalesce(*[F.when(F.col("ordinal") == name, rank) for name, rank in QUEUE.items()])
    klass = F.when((F.col("kind") == "VEHICLES") & F.col("vehicle_count").isNotNull(), 0).when((F.col("kind") == "ORDINAL") & order.isNotNull(), 1).when(F.col("kind") == "PRESENCE", 2).otherwise(3)
    ranked = queues.withColumns({"class": klass, "age": age, "order": order})
    best = F.min(F.struct("class", "age", F.coalesce("order", F.lit(9)).alias("o"), "vehicle_count", "ordinal", "raw_value"))
    agg = ranked.groupBy("entity").agg(best.alias("b"))
    c = F.col("b.class")
    return agg.select("entity", (c < 2).alias("comparable"), F.when(c == 0, F.col("b.vehicle_count")).alias("vehicle_count"), F.when(c == 1, F.col("b.ordinal")).alias("ordinal"), F.when((c < 2) & (F.col("b.age") < 1e15), F.col("b.age")).alias("freshest_age"), F.when(c == 3, F.coalesce(F.col("b.raw_value"), F.lit("unknown size"))).alias("text"))


def catalogue(members: DataFrame, requested: list[str]) -> DataFrame:
    """Per entity the union of the assortments its members publish (null if none does) and whether it sells a requested one."""
    agg = members.groupBy("entity").agg(F.collect_set(F.when(F.col("assortment").isNotNull(), F.col("assortment"))).alias("lists"))
    merged = F.when(F.size("lists") > 0, F.array_sort(F.array_distinct(F.flatten("lists"))))
    out = agg.select("entity", merged.alias("assortment"))
    return out.withColumn("sells_requested", F.arrays_overlap("assortment", F.array(*[F.lit(x) for x in requested])))


def tightest_limit(limits: DataFrame, family: str, now: int, p: Params = DEFAULTS) -> DataFrame:
    """The least litres in force per entity: of the family or unlabelled; observed limits expire, in-force ones do not."""
    live = F.col("in_force_since").isNotNull() | (F.col("observed_at").isNotNull() & (now - F.col("observed_at") <= p.expire_minutes * 60))
    fits = F.col("grade").isNull() | (F.col("grade") == family)
    agg = limits.where(live & fits & (F.col("liters") > 0)).groupBy("entity").agg(F.min(F.struct("liters", F.coalesce("observed_at", F.lit(0)).alias("o"), "observed_at", "source")).alias("b"))
    age = F.when(F.col("b.observed_at").isNotNull() & (now - F.col("b.observed_at") > p.fresh_minutes * 60), (now - F.col("b.observed_at")) / 60.0)
    return agg.select("entity", F.col("b.liters").alias("liters"), F.col("b.source").alias("source"), age.alias("shown_age"))


def support(observations: DataFrame, now: int, p: Params = DEFAULTS) -> DataFrame:
    """Distinct sources and least age of the current positives of an entity."""
    good = enrich(observations, now, p).where(F.col("usable") & F.col("status").isin(POSITIVE) & F.col("specificity").isin("EXACT_VARIANT", "FAMILY_ONLY"))
    return good.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count_distinct("source").alias("n_sources"), F.min("age").alias("age"))


def latest_cluster(transitions_: DataFrame, now: int, p: Params = DEFAULTS) -> DataFrame:
    """The last group of fresh transitions (pauses of at most 120 minutes) of each entity."""
    live = transitions_.where((F.col("at") <= now + p.future_skew_seconds) & (now - F.col("at") <= p.expire_minutes * 60))
    s = sessions(live, ["entity"], "at", p.arrival_gap_minutes * 60).groupBy("entity", "session").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("grade").cast("string"))), ",").alias("grades"))
    return s.groupBy("entity").agg(F.max_by(F.struct("first", "last", "n", "grades"), "session").alias("b")).select("entity", "b.*")
