"""URL filters: a fixed rule list, then association rules mined from labelled URLs with FP-growth.

`mine` turns labelled URLs into token baskets, lets Spark's FP-growth find token combinations that go with a bad
label, and keeps rules of enough support, confidence and lift that no shorter rule makes redundant. `match` finds
the rules of every URL with an inverted index: each rule is listed under its rarest token only, so that frequent
tokens (com, www) open no posting list, and a hit is verified against the whole rule.

Nulls: a null URL, or one without `://`, has an empty host and path, fits no rule and is allowed. Rows whose label is
null are unlabelled. Repeated labels of one id count once (bad if any is). Repeated pages are judged one by one. Empty
pages give an empty result, empty labels no mined rule. Very long URLs are read whole. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from sightline.tables import Scratch, table

#: The contract's rule list, verdict by rule.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}

BAD = "label=bad"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits: its host is the URL's or a parent domain, and the path starts with its path."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at, _, start = rule.partition("/")
        out = F.when(((host == at) | host.endswith("." + at)) & path.startswith("/" + start), F.lit(rule)).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct tokens: parts of host labels and of path segments (digits as #), names of query parameters."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    parts = lambda kind, text, by: F.transform(F.split(text, by), lambda x: F.when(x != "", F.concat(F.lit(kind), x)))
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    named = F.transform(names, lambda x: F.when(x != "", F.concat(F.lit("q:"), x)))
    segments = F.regexp_replace(ascii_lower(path), "[0-9]+", "#")
    return F.array_distinct(F.array_compact(F.concat(parts("h:", host, "[.-]"), parts("p:", segments, "[/._-]"), named)))


def labelled_urls(pages: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """Rows (tokens, bad) of labelled pages: about `max_labelled` at most, chosen by a hash of the id."""
    bad = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    total = bad.count()
    if total > max_labelled:
        bad = bad.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * max_labelled / total)))
    return pages.select("page_id", "url").join(bad, "page_id").select(tokens_of(F.col("url")).alias("tokens"), "bad")


def mine(labelled: DataFrame, scratch: Scratch, min_support: float = 0.001, min_confidence: float = 0.8, min_lift: float = 1.2, min_rows: int = 20) -> DataFrame:
    """Rules (rule_id, items, confidence, lift, support) whose consequent is the bad label.

    Of two rules, the longer one goes if the shorter one's items are among its own and its confidence is no higher.
    """
    baskets = scratch.keep(labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items")))
    rows = baskets.count()
    if not rows:
        return labelled.sparkSession.createDataFrame([], "rule_id string, items array<string>, confidence double, lift double, support double")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_rows / rows), minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where((F.element_at("consequent", 1) == BAD) & (F.col("lift") >= min_lift))
    found = scratch.keep(found.select(F.array_sort("antecedent").alias("items"), "confidence", "lift", "support").withColumn("rule_id", F.array_join("items", " ")))
    short = found.select(F.col("items").alias("less"), F.element_at("items", 1).alias("token"), F.col("confidence").alias("sure"))
    longer = found.select("rule_id", "items", "confidence", F.explode("items").alias("token")).join(short, "token")
    redundant = longer.where((F.size("less") < F.size("items")) & (F.size(F.array_except("less", "items")) == 0) & (F.col("sure") >= F.col("confidence"))).select("rule_id").distinct()
    return scratch.keep(found.join(redundant, "rule_id", "left_anti").select("rule_id", "items", "confidence", "lift", "support"))


def inverted_index(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """Rows (token, items, rule_id): each rule under the one of its tokens that fewest labelled URLs have."""
    spread = rules.select("rule_id", "items", F.explode("items").alias("token"))
    often = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rarest = spread.join(often, "token", "left").groupBy("rule_id").agg(F.min(F.struct("n", "token"))["token"].alias("token"), F.first("items").alias("items"))
    return rarest.select("token", "items", "rule_id")


def match(urls: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (url, mined_rule) of the distinct urls that some mined rule matches; the least rule id stands for all.

    A token is looked up with a hash of its url alone; the url's own tokens verify what is found, so that a hash two
    urls share does no harm and a url of n tokens makes n short rows.
    """
    each = urls.where("url is not null").select("url").distinct().withColumns({"k": F.xxhash64("url"), "tokens": tokens_of(F.col("url"))})
    near = each.select("k", F.explode("tokens").alias("token")).join(index, "token").select("k", "rule_id", "items").distinct()
    hits = each.join(near, "k").where(F.size(F.array_except("items", "tokens")) == 0)
    return hits.groupBy("url").agg(F.min("rule_id").alias("mined_rule"))


def judge(pages: DataFrame, labels: DataFrame, max_labelled: int = 200_000, rules: dict[str, str] = RULES, **limits) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, mined_rule) of every page.

    verdict: the fixed rule's; where none fits, block if a mined rule matches, else allow. The miner sees about
    `max_labelled` labelled rows at most; every page is judged.
    """
    scratch = Scratch(pages.sparkSession, "url-rules")
    labelled = scratch.keep(labelled_urls(pages, labels, max_labelled))
    index = scratch.keep(inverted_index(mine(labelled, scratch, **limits), labelled))
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    split = split.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    out = split.join(match(split.where("rule is null"), index), "url", "left")
    fixed = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    ours = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    verdict = F.when(F.col("rule").isNotNull(), F.try_element_at(fixed, F.col("rule"))).otherwise(ours)
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined_rule")).alias("mined_rule"))


def op4_url_filters(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_url_filters": op4_url_filters}
ORACLES: dict[str, str] = {}
