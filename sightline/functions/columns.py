"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sightline.params import CONFIDENCE


def half_up(x: Column) -> Column:
    """Nearest whole number, halves up (also below zero)."""
    return F.floor(x + F.lit(0.5)).cast("long")


def confidence_rank(label: Column) -> Column:
    out = F.lit(0)
    for name, rank in CONFIDENCE.items():
        out = F.when(label == name, rank).otherwise(out)
    return out


def confidence_label(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in CONFIDENCE]), rank.cast("int") + 1)


def confirmed_positive(verdict: Column, confidence: Column) -> Column:
    """Available, or likely so with medium confidence at least; confidence as a rank."""
    return (verdict == "AVAILABLE") | ((verdict == "LIKELY_AVAILABLE") & (confidence >= 2))


def kind(verdict: Column, confidence: Column) -> Column:
    """N not available, P confirmed positive, W likely but weak, X anything else."""
    return F.when(verdict == "NOT_AVAILABLE", "N").when(confirmed_positive(verdict, confidence), "P").when(verdict == "LIKELY_AVAILABLE", "W").otherwise("X")


def circular_difference(a: Column, b: Column) -> Column:
    """Signed minutes from b to a on a day's circle, from -720 to 719."""
    return F.pmod(a - b + 720, F.lit(1440)) - 720


def local_minute(epoch_minutes: Column, offset: int) -> Column:
    return F.pmod(epoch_minutes + offset, F.lit(1440))


def local_weekday(epoch_minutes: Column, offset: int) -> Column:
    """Monday is 0; 1970-01-01 was a Thursday."""
    return F.pmod(F.floor((epoch_minutes + offset) / 1440) + 3, F.lit(7))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371008.8) -> Column:
    """Metres between two points."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))
