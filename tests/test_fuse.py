"""The verdict ladder on single cases."""

from sightline.operators import fuse as U

NOW = 1_700_000_000
OBS = "entity long, product string, specificity string, status string, source string, provenance string, family_all boolean, signals double, time_kind string, at long, min_minutes long, max_minutes long"
ACT = "entity long, product string, kind string, grade_specific boolean, at long"


def obs(entity, status, minutes, product="a", specificity="EXACT_VARIANT", source="s", provenance=None, family=False, signals=None, kind="EXACT", low=None):
    bounded = kind == "BOUNDED_AGE"
    return (entity, product, specificity, status, source, provenance or source, family, signals, kind, None if bounded else NOW - minutes * 60, low if bounded else None, minutes if bounded else None)


def verdicts(spark, rows, acts=()):
    got = U.assess(spark.createDataFrame(rows, OBS), spark.createDataFrame(list(acts), ACT), ["entity"], NOW)
    return {r.entity: (r.verdict, r.confidence) for r in got.collect()}


def test_ladder(spark):
    rows = [
        obs(1, "IN_STOCK", 10), obs(1, "OUT_OF_STOCK", 20),
        obs(2, "IN_STOCK", 60), obs(2, "OUT_OF_STOCK", 80),
        obs(3, "OUT_OF_STOCK", 10), obs(3, "IN_STOCK", 20, specificity="FAMILY_ONLY"),
        obs(4, "OUT_OF_STOCK", 60), obs(4, "IN_STOCK", 100),
        obs(5, "UNCERTAIN", 10), obs(6, "IN_STOCK", 400),
        obs(7, "IN_STOCK", 10, source="x", provenance="g"), obs(7, "IN_STOCK", 12, source="y", provenance="g"),
        obs(8, "IN_STOCK", 10, source="x"), obs(8, "IN_STOCK", 12, source="y"),
        obs(9, "IN_STOCK", 10, signals=4.0),
        obs(10, "IN_STOCK", 60), obs(10, "OUT_OF_STOCK", 60),
        obs(11, "IN_STOCK", 500, kind="BOUNDED_AGE", low=5), obs(12, "IN_STOCK", 40, kind="BOUNDED_AGE", low=5),
        obs(13, "IN_STOCK", -10), obs(14, "IN_STOCK", 10, kind="UNKNOWN"),
    ]
    assert verdicts(spark, rows) == {
        1: ("CONFLICTING", "LOW"), 2: ("AVAILABLE", "LOW"), 3: ("LIKELY_AVAILABLE", "LOW"), 4: ("NOT_AVAILABLE", "MEDIUM"), 5: ("INDIRECT", "LOW"), 6: ("NO_FRESH_DATA", "NONE"),
        7: ("AVAILABLE", "MEDIUM"), 8: ("AVAILABLE", "HIGH"), 9: ("AVAILABLE", "HIGH"), 10: ("INDIRECT", "LOW"), 11: ("NO_FRESH_DATA", "NONE"), 12: ("AVAILABLE", "MEDIUM"), 13: ("NO_FRESH_DATA", "NONE"), 14: ("NO_FRESH_DATA", "NONE"),
    }


def test_resumed_activity(spark):
    act = lambda e, minutes, specific=True: (e, "a", "TRANSACTIONS_RESUMED", specific, NOW - minutes * 60)
    rows = [obs(1, "OUT_OF_STOCK", 100), obs(2, "OUT_OF_STOCK", 30), obs(3, "OUT_OF_STOCK", 100)]
    assert verdicts(spark, rows, [act(1, 10), act(2, 10), act(3, 10, False), act(4, 5)]) == {1: ("LIKELY_AVAILABLE", "MEDIUM"), 2: ("CONFLICTING", "LOW"), 3: ("NOT_AVAILABLE", "MEDIUM"), 4: ("LIKELY_AVAILABLE", "MEDIUM")}


def test_union(spark):
    rows = [
        obs(1, "OUT_OF_STOCK", 10, "a"),
        obs(2, "OUT_OF_STOCK", 10, "a"), obs(2, "OUT_OF_STOCK", 10, "b"),
        obs(3, "OUT_OF_STOCK", 10, "fam", "FAMILY_ONLY", family=True),
        obs(4, "OUT_OF_STOCK", 10, "a"), obs(4, "IN_STOCK", 10, "b"),
        obs(5, "IN_STOCK", 10, "unknown"),
    ]
    got = U.assess_union(spark.createDataFrame(rows, OBS), spark.createDataFrame([], ACT), ["a", "b"], "unknown", NOW)
    assert {r.entity: (r.verdict, r.confidence) for r in got.collect()} == {1: ("NO_FRESH_DATA", "NONE"), 2: ("NOT_AVAILABLE", "MEDIUM"), 3: ("NOT_AVAILABLE", "MEDIUM"), 4: ("AVAILABLE", "MEDIUM"), 5: ("AVAILABLE", "MEDIUM")}


def test_empty(spark):
    none, quiet = spark.createDataFrame([], OBS), spark.createDataFrame([], ACT)
    assert U.assess(none, quiet, ["entity"], NOW).count() == 0
    assert U.assess_union(none, quiet, ["a"], "unknown", NOW).count() == 0
