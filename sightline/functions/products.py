"""Classification of product labels by a table of aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions.text import plain, product_label


def classify(rows: DataFrame, products: list[dict], include_unknown: bool = True, column: str = "label") -> DataFrame:
    """rows with product_key and variant.

    products: dicts with product_key, variant, aliases. A label without the family's number is no product (null). "Plus"
    is the generic premium product, or an unknown premium where that is not configured. Else the longest alias found
    wins (the lesser key on a tie); BASE needs the bare family name. What is left is UNKNOWN, or null if not asked for.
    """
    label = product_label(F.coalesce(F.col(column), F.lit("")))
    out = rows.withColumn("__l", label)
    norm = F.col("__l")
    plus = next((p for p in products if p["product_key"] == "AI95_PREMIUM_GENERIC"), None)
    struct = lambda key, variant: F.struct(F.lit(key).alias("product_key"), F.lit(variant).alias("variant"))
    unknown = lambda variant: struct("AI95_UNKNOWN", variant)
    hits: list[Column] = []
    for p in products:
        for alias in p["aliases"]:
            a = product_label(F.lit(alias))
            found = norm.rlike(r"^(?:аи\s*)?95$") if p["variant"] == "BASE" else norm.contains(a)
            hits.append(F.when(found, F.struct((-F.length(a)).alias("size"), F.lit(p["product_key"]).alias("product_key"), F.lit(p["variant"]).alias("variant"))))
    best = F.array_min(F.array_compact(F.array(*hits)))
    pick = F.struct(best["product_key"].alias("product_key"), best["variant"].alias("variant"))
    rest = unknown("UNKNOWN") if include_unknown else F.lit(None)
    case = F.when(~norm.rlike(r"(?:^|\s)(?:аи\s*)?95(?:\s|$)"), F.lit(None)).when(norm.rlike(r"(?:^|\s)плюс(?:\s|$)"), struct(plus["product_key"], plus["variant"]) if plus else unknown("PREMIUM")).when(best.isNotNull(), pick).otherwise(rest)
    return out.withColumn("__p", case).withColumns({"product_key": F.col("__p.product_key"), "variant": F.col("__p.variant")}).drop("__l", "__p")


def comparable_brand(rows: DataFrame, aliases: DataFrame, column: str = "brand") -> DataFrame:
    """rows with comparable: the alias table's canonical name, else the plain brand; opaque brands are ''.

    aliases (alias, canonical), both plain; a small dictionary that Spark may broadcast by its size.
    """
    opaque = F.col(column).rlike("^(?:brand-id:|brand:|opaque-brand$)")
    keyed = rows.withColumn("__b", plain(F.coalesce(F.col(column), F.lit(""))))
    joined = keyed.join(aliases.select(F.col("alias").alias("__b"), F.col("canonical").alias("__c")), "__b", "left")
    return joined.withColumn("comparable", F.when(opaque, "").otherwise(F.coalesce("__c", "__b"))).drop("__b", "__c")
