"""Hand-made histories with known answers."""

from pyspark.sql import functions as F

from sightline.functions.columns import circular_difference
from sightline.operators import forecast as C, history as H, snapshot as S
from sightline.params import Params

DAY = 28401120  # 2024-01-01 00:00 UTC in minutes


def ticks(spark, rows):
    return spark.createDataFrame([(e, DAY + t, v, c) for e, t, v, c in rows], "entity string, tick long, verdict string, confidence int")


def local(day, hour, minute=0):
    """Minutes after DAY of a local time (three hours ahead)."""
    return day * 1440 + hour * 60 + minute - 180


def outage(entity, day, back):
    rows = [(entity, local(day, 6) + m, "NOT_AVAILABLE", 2) for m in range(0, back - 360, 15)]
    return rows + [(entity, local(day, 0) + back, "AVAILABLE", 3)]


def test_three_outages_and_their_times(spark):
    t = ticks(spark, outage("a", 1, 420) + outage("a", 2, 450) + outage("a", 3, 435))
    episodes = H.outage_episodes(t, 15)
    assert sorted(r.minutes for r in episodes.collect()) == [60, 75, 90]
    (w,) = H.typical_time(episodes).collect()
    assert (w.n, w.median_minute, w.window_start, w.window_end) == (3, 435, 428, 443)


def test_gap_cancels_and_weak_positive_does_not_end(spark):
    gap = [("a", 0, "NOT_AVAILABLE", 2), ("a", 180, "AVAILABLE", 3)]
    weak = [("b", 0, "NOT_AVAILABLE", 2), ("b", 15, "LIKELY_AVAILABLE", 1), ("b", 30, "AVAILABLE", 3)]
    broken = [("c", 0, "NOT_AVAILABLE", 2), ("c", 15, "CONFLICTING", 1), ("c", 30, "AVAILABLE", 3)]
    got = H.outage_episodes(ticks(spark, gap + weak + broken), 15).collect()
    assert [(r.entity, r.minutes) for r in got] == [("b", 30)]
    assert {r.entity for r in H.outage_episodes(ticks(spark, gap), 60).collect()} == {"a"}


def test_current_runs(spark):
    t = ticks(spark, [("a", 0, "AVAILABLE", 3), ("a", 15, "NOT_AVAILABLE", 2), ("a", 30, "NOT_AVAILABLE", 2), ("b", 0, "NOT_AVAILABLE", 2), ("b", 15, "LIKELY_AVAILABLE", 1)])
    got = {r.entity: (r.state, r.since - DAY, r.visible) for r in H.current_run(t, 15).collect()}
    assert got == {"a": ("negative", 15, True), "b": ("unclear", 15, False)}
    assert {r.entity: r.negative_since - DAY for r in H.current_negative_start(t, 15).collect()} == {"a": 15}


def test_empty_history(spark):
    none = ticks(spark, [])
    assert H.outage_episodes(none, 15).count() == 0 and H.current_run(none, 15).count() == 0
    assert S.availability_runs(none).count() == 0
    assert H.coverage_summary(none, 15).first().ticks == 0


def test_runs_close_after_two_negatives(spark):
    seq = ["NOT_AVAILABLE", "AVAILABLE", "NOT_AVAILABLE", "AVAILABLE", "NOT_AVAILABLE", "CONFLICTING", "NOT_AVAILABLE", "LIKELY_AVAILABLE"]
    got = S.availability_runs(ticks(spark, [("a", 15 * i, v, 1) for i, v in enumerate(seq)])).orderBy("opened").collect()
    assert [(r.opened - DAY, r.last_confirmed - DAY, r.closed and r.closed - DAY, r.basis) for r in got] == [(15, 45, 90, "OBSERVED_TRANSITION"), (105, 105, None, "FIRST_SEEN")]


def test_diff_of_scopes(spark):
    a = spark.createDataFrame([(1, "AVAILABLE", "HIGH", "2"), (2, "AVAILABLE", "HIGH", None)], "entity long, verdict string, confidence string, queue string")
    b = spark.createDataFrame([(1, "AVAILABLE", "HIGH", "3"), (3, "INDIRECT", "LOW", None)], a.schema)
    assert sorted((r.entity, r.change) for r in S.diff(a, b).collect()) == [(1, "CHANGED"), (2, "REMOVED"), (3, "ADDED")]
    assert S.diff(a, a).count() == 0
    assert [r.change for r in S.diff(a, b, same_scope=False).collect()] == ["SCOPE_CHANGED"]


def test_duration_forecast(spark):
    """Outages of 120 and 150 minutes, negative since 10:00, now 12:00: expected at 12:15."""
    e = spark.createDataFrame([("a", "b", 120), ("a", "b", 150)], "entity string, brand string, minutes long")
    cand = spark.createDataFrame([("a", "b", DAY + 600)], "entity string, brand string, negative_since long")
    none = C.time_patterns(spark.createDataFrame([], "entity string, brand string, at long, medium boolean, signal int"))
    (r,) = C.forecast(cand, none, C.duration_patterns(e), DAY + 720).collect()
    assert (r.expected_at - DAY, r.basis, r.n, r.confidence, r.signal) == (735, "STATION", 2, "LOW", "STATUS_TRANSITION")


def test_time_of_day_forecast_needs_two_dates(spark):
    events = [("a", "b", DAY + local(1, 7), True, 0), ("a", "b", DAY + local(2, 6, 56), True, 0)]
    frame = lambda rows: spark.createDataFrame(rows, "entity string, brand string, at long, medium boolean, signal int")
    cand = spark.createDataFrame([("a", "b", DAY + local(3, 5))], "entity string, brand string, negative_since long")
    empty = C.duration_patterns(spark.createDataFrame([], "entity string, brand string, minutes long"))
    (r,) = C.forecast(cand, C.time_patterns(frame(events)), empty, DAY + local(3, 6)).collect()
    assert (r.expected_at - DAY, r.basis, r.n) == (local(3, 6, 58), "STATION", 2)
    same_day = [events[0], ("a", "b", DAY + local(1, 9), True, 0)]
    assert C.time_patterns(frame(same_day)).count() == 0


def test_variants_witness_rolling_events(spark):
    schema = "entity string, source string, grade string, tick long, variant string, grade_specific boolean, count long, window_minutes double, latest long"
    row = lambda t, v, n: ("a", "s", "95", DAY + t, v, True, n, 60.0, DAY + t)
    appears = [row(0, "x", 0), row(10, "x", 0), row(10, "y", 3)]
    rises = [row(0, "x", 0), row(10, "x", 3)]
    run = lambda rows: C.rolling_events(C.rolling_counts(spark.createDataFrame(rows, schema)), 10, Params()).count()
    assert run(appears) == 0 and run(rises) == 1


def test_circular_difference(spark):
    got = spark.range(1).select(circular_difference(F.lit(10), F.lit(1430)).alias("a"), circular_difference(F.lit(1430), F.lit(10)).alias("b")).first()
    assert (got.a, got.b) == (20, -20)
