"""The joins by which evidence, dictionaries and earlier rows meet, each under its own name.

Sides are left to Spark's size statistics and adaptive execution; a hot key is split by its skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from sightline.params import DEFAULTS, Params


def member_evidence(members: DataFrame, evidence: DataFrame, member: str = "member", entity: str = "entity") -> DataFrame:
    """Evidence rows with the entity whose member they speak of; evidence of no member is left out, nulls meet nobody."""
    return evidence.join(members.select(member, entity), member)


def enumerated(rows: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys a source has listed, once each however often it listed them."""
    return rows.join(listed.select(*keys), keys, "left_semi")


def looked_up(rows: DataFrame, dictionary: DataFrame, key: str, entry: str, fields: list[str]) -> DataFrame:
    """rows with fields of their dictionary entry; without an entry, or with a null key, the fields are null."""
    told = dictionary.select(F.col(entry).alias(key), *fields)
    return rows.join(told, key, "left")


def latest_before(ticks: DataFrame, fields: list[str], entity: str = "entity", tick: str = "tick") -> DataFrame:
    """ticks with the fields of the entity's row before, as before_<field>; null in its first."""
    w = W.partitionBy(entity).orderBy(tick)
    return ticks.withColumns({f"before_{f}": F.lag(f).over(w) for f in fields})


def in_forecast_window(ticks: DataFrame, end: int, days: int = 28, p: Params = DEFAULTS, tick: str = "tick") -> DataFrame:
    """ticks (minutes) of the last days before `end`, at most as many as are retained; a filter on a range that scans take."""
    return ticks.where(F.col(tick) >= end - min(p.retention_days, days) * 1440)
