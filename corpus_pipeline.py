"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs. All
but the last return the columns of `documents`; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.llm import bpe, decontaminate, line_dedup, quality_model, simhash
from sightline.tables import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained quality classifier keeps.

    Null texts are judged as empty ones, repeated rows alike; null ids stay. Columns beyond those of documents go, also
    ones named as what the classifier adds. An empty table stays empty; where no labeller votes bad, all documents stay.
    """
    docs = docs.select(*COLUMNS)
    return quality_model.score(docs, quality_model.fit(docs)).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that an earlier one has, up to one word; a document that loses all its words goes.

    Documents without a word to begin with stay, as do null texts and rows without a doc_id; repeated rows lose nothing
    to each other. Very long lines are lines as any other. An empty table stays empty; columns beyond those of documents
    go, also ones named as what line dedup counts.
    """
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    cut = cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_dropped") == 0))
    return cut.select("doc_id", "text", "lang", "source", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8, held against the shingles
    themselves): the one with the least doc_id.

    Null and empty texts are copies of each other. A row without a doc_id stays only if no row of its group has one.
    Rows that share a doc_id stay apart where their texts do; of rows with equal doc_id and text, the least stays.
    """
    return simhash.first_of_each(docs.select(*COLUMNS))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, also with other numbers, names or units.

    Null and empty texts contain none; rows without a doc_id are not judged and stay; repeated rows share one judgement.
    """
    out = decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return out.where("not contaminated").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, encoded and decoded.

    A null text is an empty one; ids pass through, null or repeated, a row for each document. An empty table gives no
    rows, and columns beyond doc_id and text are not looked at.
    """
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


STAGES = [("quality", quality), ("line_dedup", lines), ("simhash", near_duplicates), ("decontamination", benchmark_free), ("byte_level_bpe", tokens)]

#: The classifier is trained, and the later stages are no SQL either; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to `documents`."""
    scratch = Scratch(spark, "pipeline-run")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
