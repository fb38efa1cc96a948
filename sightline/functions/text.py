"""Text normalisers as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Latin letters that look like Cyrillic ones.
LATIN, CYRILLIC = "aieopcxykmtbh", "аиеорсхукмтвн"

#: The petrol grades by octane number.
OCTANES = ["92", "95", "98", "100"]


def plain(text: Column) -> Column:
    """Lower case, ё as е, runs of anything but letters and digits as one space."""
    return F.btrim(F.regexp_replace(F.translate(F.lower(text), "ё", "е"), r"[^\p{L}\p{N}]+", " "))


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else unicodedata.normalize("NFKC", v) for v in values], dtype="object")


def nfkc(text: Column) -> Column:
    """Compatibility composition, which Spark SQL has no function for; ASCII is sent to Python as null and stays as it is."""
    other = text.rlike("[^\\x00-\\x7F]")
    return F.when(other, _nfkc(F.when(other, text))).otherwise(text)


def normal_text(text: Column) -> Column:
    return plain(nfkc(F.coalesce(text, F.lit(""))))


def product_label(text: Column) -> Column:
    """plain, with Latin look-alikes as Cyrillic letters and + as a word. Apply nfkc first where labels may need it."""
    alike = F.translate(F.translate(F.lower(text), "ё", "е"), LATIN, CYRILLIC)
    return F.btrim(F.regexp_replace(F.replace(alike, F.lit("+"), F.lit(" плюс ")), r"[^\p{L}\p{N}]+", " "))


def octane(product_key: Column, family: Column, label: Column) -> Column:
    """92, 95, 98 or 100 from the product key, else the family, else the label; null for anything else."""
    some = lambda text, pattern: F.when(F.coalesce(F.regexp_extract(text, pattern, 1), F.lit("")) != "", F.regexp_extract(text, pattern, 1))
    return F.coalesce(some(product_key, r"^AI(92|95|98|100)(?:_|$)"), some(family, r"^AI[_-]?(92|95|98|100)$"), some(product_label(F.coalesce(label, F.lit(""))), r"(?:^|\s)(?:аи\s*)?(92|95|98|100)(?:\s|$)"))


def squeezed(text: Column) -> Column:
    """Compatibility composition, lower case, _ and - as spaces, white space squeezed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(nfkc(F.coalesce(text, F.lit("")))), "ё", "е"), "[_-]+", " "), r"\s+", " "))


def first_match(text: Column, ladder: list[tuple[str, str]]) -> Column:
    """The name of the first pattern that is found; null if none is."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(ladder):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


#: Words of statuses, in the order in which they are tried; negatives before positives.
STATUS_WORDS = [
    ("UNKNOWN", r"^(?:нет данных(?: о топливе)?|неизвестно|unknown|no data|n/a)?$"),
    ("OUT_OF_STOCK", r"\b(?:unavailable|not\s+available|out[\s-]*of[\s-]*stock|sold\s+out)\b|(?:^|\s)(?:нет|не)\s+(?:в\s+)?налич(?:ии|ие)(?:\s|$)|(?:^|\s)нет\s+топлива(?:\s|$)|(?:^|\s)отсутств\p{L}*(?:\s+в\s+наличии)?(?:\s|$)|^нет$"),
    ("LIMITED", r"\b(?:limited|low\s+stock)\b|(?:^|\s)(?:мало|заканч\p{L}*)(?:\s|$)"),
    ("IN_STOCK", r"\b(?:in[\s-]*stock|available)\b|(?:^|\s)(?:есть(?:\s+топливо)?|в\s+наличии)(?:\s|$)"),
    ("UNCERTAIN", r"\buncertain\b|сомнит|возможно"),
]

#: Words of queue lengths, in the order in which they are tried.
QUEUE_WORDS = [
    ("UNKNOWN", r"^(?:unknown)?$"),
    ("VERY_LONG", r"very.?(?:long|high)|очень.*(?:длин|бол)"),
    ("NONE", r"(?:^|\s)(?:no|none)(?:\s|$)|no.?queue|нет\s+очеред|без\s+очеред"),
    ("LONG", r"(?:^|[^\p{L}])(?:long|high)(?:[^\p{L}]|$)|(?<!не)больш|длин"),
    ("MEDIUM", r"(?:^|[^\p{L}])(?:medium|moderate)(?:[^\p{L}]|$)|сред"),
    ("SHORT", r"(?:^|[^\p{L}])(?:short|low|small)(?:[^\p{L}]|$)|небольш|мал|корот"),
    ("NONE", r"(?:^|\s)(?:нет|без)(?:\s|$)"),
]


def status(text: Column) -> Column:
    return F.coalesce(first_match(squeezed(text), STATUS_WORDS), F.lit("UNKNOWN"))


def ordinal(text: Column) -> Column:
    """Queue length word; null if there is none."""
    found = first_match(squeezed(text), QUEUE_WORDS)
    return F.when(found != "UNKNOWN", found)


def queue_ordinal(value: Column, token: Column) -> Column:
    """A source's own wording beats its enumeration token."""
    return F.coalesce(ordinal(value), ordinal(token))


def assortment(texts: Column) -> Column:
    """Distinct grades named in a list of texts, by number; null if the list is null or holds no text."""
    said = F.filter(texts, lambda x: F.btrim(x) != "")
    grades = F.flatten(F.transform(said, lambda x: F.regexp_extract_all(x, F.lit(r"(?<![0-9])(92|95|98|100)(?![0-9])"), F.lit(1))))
    return F.when(F.size(said) > 0, F.transform(F.array_sort(F.transform(F.array_distinct(grades), lambda g: g.cast("int"))), lambda n: n.cast("string")))


def observation_time(observed_at: Column, low: Column, high: Column) -> Column:
    """struct<kind, observed_at, min_minutes, max_minutes>: exact if it parses, else a bounded age, else unknown."""
    at = F.try_to_timestamp(observed_at)
    kind = F.when(at.isNotNull(), "EXACT").when(low.isNotNull() & high.isNotNull(), "BOUNDED_AGE").otherwise("UNKNOWN")
    exact, bounded = kind == "EXACT", kind == "BOUNDED_AGE"
    return F.struct(kind.alias("kind"), F.when(exact, at).alias("observed_at"), F.when(bounded, low).alias("min_minutes"), F.when(bounded, high).alias("max_minutes"))


def epoch_time(value: Column) -> Column:
    """Seconds since 1970 of an epoch number in seconds (below 1e12) or milliseconds."""
    return F.when(value < 1e12, value).otherwise(value / 1000.0).cast("double")


def coordinate(first: Column, second: Column, order: str = "LON_LAT") -> tuple[Column, Column]:
    """(lon, lat) from texts; blank or unreadable is null, as is a pair out of range."""
    a, b = F.btrim(first).try_cast("double"), F.btrim(second).try_cast("double")
    lon, lat = (a, b) if order == "LON_LAT" else (b, a)
    good = lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(good, lon), F.when(good, lat)


def brand(name: Column, alias: Column, title: Column, label: Column, ident: Column) -> Column:
    """First brand field that says something; an id alone is opaque."""
    said = [F.when(F.btrim(c) != "", F.btrim(c)) for c in (name, alias, title, label)]
    return F.coalesce(*said, F.when(ident.isNotNull(), F.concat(F.lit("brand-id:"), ident)), F.lit("opaque-brand"))


def joined_brands(labels: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.transform(labels, lambda x: F.btrim(x)), lambda x: x != "")), " / ")


def litre_limit(text: Column) -> tuple[Column, Column]:
    """(litres, grade or null) of a limit named in a text."""
    pattern = r"(?iu)лимит\s*([0-9]+(?:[.,][0-9]+)?)\s*л(?:\s*(?:на|для)\s*((?:аи[-\s]?)?(?:92|95|98|100)|дт|дизел\p{L}*))?"
    litres = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
    grade = F.regexp_extract(text, pattern, 2)
    return litres, F.when(grade != "", grade)


def trust(values: Column) -> Column:
    """map<string, string>: entries that are not blank, cut to 40 characters; null if none is left."""
    kept = F.transform_values(F.map_filter(values, lambda k, v: v.isNotNull() & (F.btrim(v) != "")), lambda k, v: F.substring(F.btrim(v), 1, 40))
    return F.when(F.size(kept) > 0, kept)


def clamp(text: Column, length: int) -> Column:
    return F.substring(F.btrim(F.regexp_replace(text, r"\s+", " ")), 1, length)


def content_hash(*columns: str) -> Column:
    """sha256 of the JSON of the columns in name order, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
