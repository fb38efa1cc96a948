"""Token-ID output: Parquet files of token lists with chosen encoding, row groups and page indexes.

`write_tokens` tokenises every text (tokenizers library as loaded, Arrow batches; texts are cut where a pre-token is sure
to begin, so that repeated words are encoded once; a text that holds an added token's string is encoded whole),
range-partitions by id, and writes one row per document, in ascending id order within and across parts: `part`, `doc_id`, `n_tokens`, `tokens`. Token lists are delta-encoded (or dictionary-encoded), row groups
hold a set number of bytes, pages are small, and the writer adds page indexes; so a reader that asks for a few
documents, or for the counts alone, reads little. `read_tokens` reads them, with `start`, the number of ids before each
document, from the counts alone: in-part running sums plus the totals of earlier parts.

Nulls: a null text is an empty one (the end id alone); rows whose doc_id is null come first. Rows of one doc_id keep
one defined order, by the hash and length of their texts; repeated rows are written as often as they came. An empty
table gives files without rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sightline.llm.kernels import text_slices
from sightline.llm.parts import FOLLOWS, PackedMemory, places, split
from sightline.tables import Scratch, bounded_batches, table

#: A part that begins with a mark follows this one, which is one token, where many parts are encoded as one text.
LEAD = b" a"


class Encoder:
    """The library's tokenizer of a file, with a memory of parts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.made = Tokenizer.from_file(path)
        vocabulary = self.made.get_vocab()
        # A token of a byte-level vocabulary is written with one character for each of its bytes.
        self.widths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.widths[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.added = [t.content.encode() for t in self.made.get_added_tokens_decoder().values()]
        self.memory = PackedMemory(self.coded)

    def whole(self, text: bytes) -> bool:
        return any(t in text for t in self.added)

    def alone(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for k in range(0, len(parts), 256) for e in self.made.encode_batch_fast([p.decode() for p in parts[k : k + 256]], add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, counts.sum()), counts

    def together(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that may follow each other, encoded as one text and told apart by the widths of tokens."""
        out, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(0, len(parts), 4096):
            rows = parts[k : k + 4096]
            laid = [x for p in rows for x in ((p,) if p[0] in b" \n" else (LEAD, p))]
            marks = np.flatnonzero([p[0] not in b" \n" for p in rows])
            led = np.zeros(len(laid), bool)
            led[marks + np.arange(len(marks))] = True
            (coded,) = self.made.encode_batch_fast([b"".join(laid).decode()], add_special_tokens=False)
            ids = np.array(coded.ids, np.int32)
            ends, stops = np.cumsum(self.widths[ids]), np.cumsum(list(map(len, laid)))
            at = np.searchsorted(ends, stops) + 1
            if not np.array_equal(ends[at - 1], stops):
                raise RuntimeError("a token runs across a place where a pre-token begins")
            count = np.diff(at, prepend=0)
            out.append(ids[~np.repeat(led, count)])
            counts.append(count[~led])
        return np.concatenate(out), np.concatenate(counts)

    def coded(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts in a row, number of ids of each)"""
        follow = np.fromiter((m is not None for m in map(FOLLOWS.match, parts)), bool, len(parts))
        if self.whole(b"\0".join(parts)):
            follow &= ~np.fromiter(map(self.whole, parts), bool, len(parts))
        some, rest = np.flatnonzero(follow), np.flatnonzero(~follow)
        (ids, counts), (more, others) = self.together([parts[k] for k in some]), self.alone([parts[k] for k in rest])
        count = np.empty(len(parts), np.int64)
        count[some], count[rest] = counts, others
        first = np.empty(len(parts), np.int64)
        first[some], first[rest] = np.cumsum(counts) - counts, len(ids) + np.cumsum(others) - others
        return np.concatenate([ids, more])[places(first, count)], count

    def parts(self, parts: list[bytes]) -> list[bytes]:
        return split(*self.coded(parts))

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)"""
        return self.memory.texts(texts, self.whole)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()  # one vocabulary at a time
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoder(path: str, end_id: int):
    """A mapInArrow function: (doc_id, text) to (doc_id, n_tokens, tokens)."""

    def run(stream):
        made = encoder_of(path)
        for batch in stream:
            for rows, texts in text_slices(batch, 1, 1 << 20):
                ids, counts = made.texts(texts)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<i4", copy=False)
                offsets = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(*rows), pa.array(counts + 1, pa.int64()), tokens], names=["doc_id", "n_tokens", "tokens"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, encoding: str = "delta", row_group_bytes: int = 8 << 20, page_bytes: int = 64 << 10, part_bytes: int = 256 << 20) -> None:
    """Write the token files of docs (doc_id, text) to `path`. encoding: delta or dictionary.

    A part holds about `part_bytes` of text or less; there are at least as many as the session's shuffle partitions.
    Rows that are equal in all they are sorted by are dealt among parts by their place in the input.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-size // part_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["doc_id", "__h", "__l"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("__h"), F.length("text").alias("__l"), F.monotonically_increasing_id().alias("__place"))
    dealt = rows.repartitionByRange(n, *order, "__place").sortWithinPartitions(*order).select("doc_id", "text")
    coded = dealt.mapInArrow(encoder(tokenizer_path, end_id), "doc_id long, n_tokens long, tokens array<int>")
    placed = coded.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()).select("part", "place", "doc_id", "n_tokens", "tokens")
    dictionary = str(encoding == "dictionary").lower()
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": dictionary, "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "compression": "zstd"}
    placed.write.options(**options).parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, tokens); only the columns and row groups asked for are read."""
    whole = spark.read.parquet(path)
    totals = whole.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row per written part, so the window over all of them is small at any size.
    bases = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("base"))
    starts = whole.select("part", "place", F.sum("n_tokens").over(W.partitionBy("part").orderBy("place")).alias("upto"))
    starts = starts.join(bases, "part").select("place", (F.col("base") + F.col("upto")).alias("upto"))
    return whole.join(starts, "place").select("doc_id", (F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "tokens")


def checksums(stream):
    """A mapInArrow function: (part, place, doc_id, n_tokens, tokens) with the tokens' unsigned crc32 in their place."""
    for batch in stream:
        lists = batch.column(4)
        values = np.asarray(lists.values).astype("<u4", copy=False)
        at = np.asarray(lists.offsets)
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], names=["part", "place", "doc_id", "n_tokens", "ids_crc32"])


def read_checksums(spark, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from written token files: the lists are read once, and stay in place."""
    summed = spark.read.parquet(path).select("part", "place", "doc_id", "n_tokens", "tokens").mapInArrow(checksums, "part int, place long, doc_id long, n_tokens long, ids_crc32 long")
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("base"))
    upto = F.sum("n_tokens").over(W.partitionBy("part").orderBy("place"))
    return summed.withColumn("upto", upto).join(bases, "part").select("doc_id", (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark, sf_dir):
    import public_tokenizers

    path = Scratch(spark, "token-files").path()
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_checksums(spark, path)


QUERIES = {"op2_token_files": op2_token_files}
ORACLES: dict[str, str] = {}
