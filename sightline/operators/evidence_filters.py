"""Predicates on evidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sightline.functions.text import plain
from sightline.params import DEFAULTS, Params


def fresh_activity(now: int, p: Params = DEFAULTS) -> Column:
    """Event time (latest, else resumed, else observed) neither too far ahead nor expired."""
    at = F.coalesce("latest_event_at", "resumed_at", "observed_at")
    return (at <= now + p.future_skew_seconds) & (now - at <= p.expire_minutes * 60)


def current_positive() -> Column:
    """Enriched observations that show stock now, by variant or family."""
    return F.col("status").isin("IN_STOCK", "LIMITED") & F.col("specificity").isin("EXACT_VARIANT", "FAMILY_ONLY") & F.col("usable") & F.col("age").isNotNull()


def may_sell() -> Column:
    """A catalogue without the family excludes an entity; an unknown catalogue does not."""
    return F.coalesce("sells_requested", F.lit(True))


def same_place(address: Column, anchors: list[str]) -> Column:
    """Normalised exact equality with one of the anchors' addresses."""
    return plain(address).isin([" ".join("".join(c if c.isalnum() else " " for c in a.lower()).split()) for a in anchors])
