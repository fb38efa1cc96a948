"""Rule bitmask ledger: every quality rule is evaluated once, and policies are applied to the stored bits.

`ledger` measures each text with built-in expressions only and stores the measurements and one bit per failed rule.
`apply_policy` reads the bits, never the texts, so a new policy version costs a scan of a few integers per document.
`ablation` tells in one aggregation, from the bits, what each rule of a policy does alone and beside the others.

Very long texts are one row each, measured in place. Nulls: a null text has no words (all measurements 0), a null id stays null. Repeated rows are judged one by one, so
ties cannot arise. An empty table gives an empty ledger. Columns whose names clash with a measurement's are replaced;
other extra columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sightline.tables import Scratch, table

#: ASCII white space that separates words, and the characters counted as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: Measurements, in ledger order.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"]


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body reads it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def covered_by_repeats(words: Column, width: int = 3) -> Column:
    """Number of words inside a window of `width` words that occurs twice or more in the list.

    In-row and n log n: window hashes are sorted as longs; where few hashes repeat, positions are found by testing
    membership in that short list, else by sorting (hash, position) pairs. No row is exploded or shuffled.
    """

    def positions(hashes: Column) -> Column:
        def of(repeated: Column) -> Column:
            few = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i)), lambda p: p.isNotNull())
            pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            beside = lambda z: F.filter(z, lambda x, i: (x["h"] == F.get(z, i - 1)["h"]) | (x["h"] == F.get(z, i + 1)["h"]))
            many = F.sort_array(F.transform(let(pairs, beside), lambda x: x["i"]))
            return F.when(F.size(repeated) == 0, F.array().cast("array<int>")).when(F.size(repeated) <= 12, few).otherwise(many)

        again = lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1)))
        return let(let(F.sort_array(hashes), again), of)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        whole = F.when(F.size(w) < width, F.lit(0))
        return whole.otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(positions(h), covered))))

    return let(words, count).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the columns MEASURES (long)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    with_word = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = docs.withColumns({"__words": words_of(F.col(text)), "__lines": with_word(whole)})
    return cut.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(whole, F.lit(SYMBOL)).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": covered_by_repeats(F.col("__words")),
            "n_upper": F.regexp_count(whole, F.lit("[A-Z]")).cast("long"),
        }
    ).drop("__words", "__lines")


@dataclass(frozen=True)
class Rule:
    """A rule fails where `failed` (a SQL predicate over MEASURES) is true; its place in RULES is its bit."""

    name: str
    failed: str


RULES = [
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("long_words", "word_chars > 14 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("capitals", "2 * n_upper > word_chars"),
    Rule("no_lines", "n_lines = 0"),
]

#: Policies by version: the rules that a document must not fail.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "repeated_lines", "long_words", "short_words", "capitals"],
}


def mask(policy: str, rules: list[Rule] = RULES, policies: dict[str, list[str]] = POLICIES) -> int:
    names = [r.name for r in rules]
    return sum(1 << names.index(n) for n in policies[policy])


def ledger(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Measurements and `fail_bits` (long): bit k is set where rules[k] fails. Up to 63 rules."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text).withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, policy: str, out: str = "kept") -> DataFrame:
    """`book` with a boolean: no rule of the policy failed."""
    return book.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(book: DataFrame, policy: str, rules: list[Rule] = RULES) -> DataFrame:
    """For each rule of the policy (and its bit): rows failing it, rows only it fails, and rows kept without it.

    One pass: the rows of each distinct bit pattern are counted first (at most 2 ** number of rules rows).
    """
    m = mask(policy, rules)
    seen = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    parts = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(rules) if m >> k & 1]
    one = seen.select("bits", "n", F.explode(F.array(*parts)).alias("r")).select("bits", "n", "r.rule", "r.bit")
    return one.groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failing_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def op8_quality_rules(spark, sf_dir):
    """The ledger, stored once and without the texts; policies base and v1 and v1's ablation read the stored bits.

    failing_alone: of a document that a single rule of v1 fails, how many documents that rule alone fails.
    """
    scratch = Scratch(spark, "quality-rules")
    book = scratch.keep(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    alone = scratch.keep(ablation(book, "v1").select(F.col("bit").alias("sole"), "failing_alone"))
    book = apply_policy(apply_policy(book, "v1"), "base", out="base_kept")
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask("v1")))
    out = book.withColumn("sole", F.when(F.bit_count(failed) == 1, failed)).join(alone, "sole", "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "n_lines", "n_upper", "fail_bits", "failing_alone")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT rid, sum(least(3, coalesce(nxt - i, 3))) AS c
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid
), m AS (
  SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c, 0)::BIGINT AS n_repeat_words,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper
  FROM d LEFT JOIN cov ON cov.rid = d.rid
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 14 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars THEN 64 ELSE 0 END + CASE WHEN n_lines = 0 THEN 128 ELSE 0 END)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       (fail_bits & 127) = 0 AS kept, n_lines, n_upper, fail_bits,
       CASE WHEN bit_count(fail_bits & 127) = 1 THEN count(*) OVER (PARTITION BY fail_bits & 127) END AS failing_alone
FROM b
"""

QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES = {"op8_quality_rules": ORACLE}
