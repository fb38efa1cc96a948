"""Ranked lexical search over a K2-treap of the term-document grid.

The grid has a row for each term and a column for each document; a cell holds the term's impact on the document. Columns
are dealt to blocks of bounded size, each the columns that one task has read. A block is a quadtree laid out level by
level: four bits for each cell that is not empty say which of its quarters are not, and each quarter has the difference
between its parent's greatest impact and its own. Frequent terms have neighbouring rows. `build` writes the blocks as
rows of a table: the terms and their document counts, the documents, the bits and the differences.

`search` reads each block once for all queries. A query's terms are paths down the rows; they descend together, over
ranges of documents. A range's bound is the sum, over the terms, of the term's weight times the greatest impact in the
cell that its path has reached, so no document of the range scores more; at a single document the bound is its score.
Ranges with the highest bounds are opened first, some at a time, until none can reach the last of the best so far; what
a task has found in one block bounds its next. Each task leaves the best of each query, which are ranked in two steps.
Queries go to the tasks in chunks of bounded size, each a pass over the blocks.

The formula in integers: a term found tf times in a document of n terms has the impact (10**9 * tf) div (1000 * tf + 20
* m), where m = 50 + (50 * n * N) div L for N documents with a term and L terms in them; its weight is floor(1000 *
ln((2 * N + 2) / (2 * df + 1))).

Terms are runs of ASCII digits and letters (A-Z lower-cased) and characters beyond ASCII. Nulls: a null text has no
terms; a document or query without one is found or finds nothing. Very long texts are read in pieces and fill a block of
their own. Each row of the queries has its own ranking, repeated rows and null ids too; repeated documents are ranked
each. Equal scores rank by ascending id, null ids last. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from sightline.llm.kernels import lut, pieces, spans, text_slices
from sightline.tables import Scratch, bounded_batches, table

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
NO_TERM = ~lut(bytes(x for x in range(256) if TERM.match(bytes([x]))))
DEPTH = 50
#: A block's bounds: documents, and cells that are not empty (one document alone may have more).
DOCUMENTS, CELLS = 1 << 13, 1 << 20
#: Ranges opened at a time, entries of paths held at a time, and bytes of queries in a chunk.
OPENED, HELD, CHUNK = 256, 1 << 24, 4 << 20
BLOCK = "doc_ids array<long>, terms array<binary>, dfs array<int>, height int, levels array<int>, bits binary, falls binary"


def counted(text: bytes) -> tuple[Counter, int]:
    """(times of each term, terms with repeats) of a text."""
    counts, n = Counter(), 0
    for a, b in pieces(text):
        found = TERM.findall(text[a:b].lower())
        counts.update(found)
        n += len(found)
    return counts, n


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats) of docs (text)."""

    def run(stream):
        documents = terms = 0
        for batch in stream:
            for _, texts in text_slices(batch, 0):
                data = np.frombuffer(b"\0".join(texts), np.uint8)
                starts, _ = spans(data, NO_TERM)
                ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
                documents += len(np.unique(np.searchsorted(ends, starts, "right")))
                terms += len(starts)
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], names=["documents", "terms"])

    got = docs.select("text").mapInArrow(run, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return got[0] or 0, got[1] or 0


def spread(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers with a zero before each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Builder:
    """A block that takes documents until it is full."""

    def __init__(self):
        self.doc_ids, self.numbers = [], {}
        self.rows, self.impacts, self.sizes = [], [], []
        self.cells = 0

    def add(self, doc_id: int | None, counts: Counter, m: int) -> None:
        numbers = self.numbers
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        self.rows.append(np.array([numbers.setdefault(t, len(numbers)) for t in counts], np.int32))
        self.impacts.append((10**9 * tf // (1000 * tf + 20 * m)).astype(np.uint32))
        self.doc_ids.append(doc_id)
        self.sizes.append(len(counts))
        self.cells += len(counts)

    @property
    def full(self) -> bool:
        return self.cells >= CELLS or len(self.doc_ids) >= DOCUMENTS

    def done(self) -> pa.RecordBatch:
        rows, impacts = np.concatenate(self.rows), np.concatenate(self.impacts)
        dfs = np.bincount(rows, minlength=len(self.numbers))
        order = np.argsort(-dfs, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        names = list(self.numbers)
        height = max(1, (len(names) - 1).bit_length(), (len(self.doc_ids) - 1).bit_length())
        keys = (spread(place[rows]) << np.uint64(1)) | spread(np.repeat(np.arange(len(self.sizes)), self.sizes))
        sort = np.argsort(keys)
        keys, most = keys[sort], impacts[sort]
        bits, falls, levels = [], [], []
        for _ in range(height):
            parent = keys >> np.uint64(2)
            first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            above = np.maximum.reduceat(most, first)
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
            filled = np.zeros(4 * len(first), bool)
            filled[4 * of + (keys & np.uint64(3)).astype(np.int64)] = True
            bits.append(filled)
            falls.append(above[of] - most)
            levels.append(len(keys))
            keys, most = parent[first], above
        falls = np.concatenate([most, *falls[::-1]]).astype("<u4")  # the root holds its greatest impact itself
        columns = [
            pa.array([self.doc_ids], pa.list_(pa.int64())),
            pa.array([[names[i] for i in order.tolist()]], pa.list_(pa.binary())),
            pa.array([dfs[order].tolist()], pa.list_(pa.int32())),
            pa.array([height], pa.int32()),
            pa.array([levels[::-1]], pa.list_(pa.int32())),
            pa.array([np.packbits(np.concatenate(bits[::-1])).tobytes()], pa.binary()),
            # The four bytes of all differences in planes: the upper ones are mostly zeros and compress.
            pa.array([falls.view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCK.split(", ")])


def build(docs: DataFrame, path: str) -> DataFrame:
    """Write the blocks of docs (doc_id, text) to `path` and read them: one row a block."""
    spark = docs.sparkSession
    bounded_batches(spark)
    documents, terms = corpus_size(docs)

    def run(stream):
        block = Builder()
        for batch in stream:
            for (first, n), texts in text_slices(batch, 1):
                for doc_id, text in zip(batch.column(0).slice(first, n).to_pylist(), texts, strict=True):
                    counts, size = counted(text)
                    if size:
                        block.add(doc_id, counts, 50 + 50 * size * documents // terms)
                        if block.full:
                            yield block.done()
                            block = Builder()
        if block.cells:
            yield block.done()

    # A row group for each block. Left to its sizes, the writer looks at them every 100 rows only, so all blocks of a
    # task would be one group, which a reader takes as a whole.
    docs.select("doc_id", "text").mapInArrow(run, BLOCK).write.options(**{"parquet.block.row.count.limit": "1", "compression": "zstd"}).parquet(path)
    return spark.read.schema(BLOCK).parquet(path)


class Block:
    """A block as read: `child` has the four quarters of each inner cell, `most` the greatest impact of each cell.

    Cells are numbered level by level; the last number stands for an empty one, which has empty quarters.
    """

    def __init__(self, row: dict):
        self.doc_ids, self.terms, self.height = row["doc_ids"], row["terms"], row["height"]
        levels = [1, *row["levels"]]
        inner = sum(levels[:-1])
        # Whole levels are several MB: what stands beside the block while it is made is kept to four bytes a cell.
        at = np.flatnonzero(np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=4 * inner).view(bool)).astype(np.int32 if 4 * inner < 1 << 31 else np.int64)
        self.empty = len(at) + 1
        # Only inner cells have quarters: leaves are never opened, and the empty cell has the place after the last inner one.
        self.inner, self.most = inner, np.zeros(self.empty + 1, np.float32)  # impacts are below 10**6, so exact
        falls, start = np.frombuffer(row["falls"], np.uint8).reshape(4, -1), 0
        for size in levels:
            told = np.ascontiguousarray(falls[:, start : start + size].T).view("<u4")[:, 0].astype(np.float32)
            self.most[start : start + size] = self.most[at[start - 1 : start - 1 + size] // 4] - told if start else told
            start += size
        self.child = np.full(4 * inner + 4, self.empty, np.int32)
        self.child[at] = np.arange(1, len(at) + 1, dtype=np.int32)
        self.ids = np.array([-1 if x is None else x for x in self.doc_ids], np.int64)
        self.null = np.array([x is None for x in self.doc_ids], bool)

    def best(self, rows: np.ndarray, weights: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(columns, scores, ranges opened): all columns that may be among the `depth` best with a score of `least` or more.

        `rows` are the query's terms. Many terms go over few documents at a time, so what is held stays bounded.
        """
        width, opened = self.height, 0
        while width and len(rows) << width > HELD and len(rows) * min(1 << width, len(self.ids)) > HELD:
            width -= 1
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for first in range(0, len(self.ids), 1 << width):
            columns, values, n = self.within(rows, weights, depth, least, first, min(len(self.ids), first + (1 << width)))
            found, scores, opened = np.append(found, columns), np.append(scores, values), opened + n
            if len(scores) > depth:
                least = max(least, int(np.partition(scores, len(scores) - depth)[len(scores) - depth]))
                found, scores = found[scores >= least], scores[scores >= least]
        return found, scores, opened

    def within(self, rows: np.ndarray, weights: np.ndarray, depth: int, least: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, int]:
        """As `best`, for the columns from `low` to below `high`."""
        height, width = self.height, len(rows)
        # What has been reached, in order of arrival: level, first column's prefix, cells on the paths.
        level, prefix, paths = np.zeros(1024, np.int8), np.zeros(1024, np.int64), np.zeros((1024, width), np.int32)
        halves = 2 * ((rows[None, :] >> np.arange(height - 1, -1, -1)[:, None]) & 1)
        # Sums are exact in doubles below 2**53; else they are made in integers.
        whole = float(self.most[0]) * float(weights.sum()) >= 1 << 53
        factors = weights if whole else weights.astype(float)
        used, opened = 1, 0
        waiting, bounds = np.zeros(1, np.int64), np.array([int(self.most[0]) * int(weights.sum())])
        found, scores = [], []
        while len(waiting):
            keep = bounds >= least
            waiting, bounds = waiting[keep], bounds[keep]
            if len(waiting) > OPENED:
                split = np.argpartition(-bounds, OPENED)
                taken, waiting = waiting[split[:OPENED]], waiting[split[OPENED:]]
                bound, bounds = bounds[split[:OPENED]], bounds[split[OPENED:]]
            else:
                taken, bound = waiting, bounds
                waiting, bounds = waiting[:0], bounds[:0]
            leaf = level[taken] == height
            if leaf.any():
                found.append(prefix[taken[leaf]])
                scores.append(bound[leaf])
                if sum(map(len, scores)) >= depth:
                    all_scores = np.concatenate(scores)
                    least = max(least, int(np.partition(all_scores, len(all_scores) - depth)[len(all_scores) - depth]))
                taken = taken[~leaf]
            if not len(taken):
                continue
            opened += len(taken)
            at = level[taken]
            below = height - 1 - at.astype(np.int64)
            quarter = 4 * np.minimum(paths[taken], self.inner) + halves[at]
            cells = np.concatenate([self.child[quarter], self.child[quarter + 1]])
            column = np.concatenate([2 * prefix[taken], 2 * prefix[taken] + 1])
            reach = self.most[cells]
            bound = (reach.astype(factors.dtype) @ factors).astype(np.int64)
            size = np.concatenate([below, below])
            keep = (bound >= least) & (column << size < high) & ((column + 1) << size > low)
            n = int(keep.sum())
            while used + n > len(level):
                level, prefix, paths = (np.concatenate([x, np.zeros_like(x)]) for x in (level, prefix, paths))
            new = np.arange(used, used + n)
            level[new], prefix[new], paths[new] = height - size[keep], column[keep], cells[keep]
            used += n
            waiting, bounds = np.append(waiting, new), np.append(bounds, bound[keep])
        return np.concatenate(found) if found else np.zeros(0, np.int64), np.concatenate(scores) if scores else np.zeros(0, np.int64), opened


def best_of(queries: list[tuple[int, list[bytes], list[int]]], depth: int):
    """A mapInArrow function: blocks to the best (query, doc_id, score) of a task."""

    def run(stream):
        wanted = list({t for _, terms, _ in queries for t in terms})
        number = {t: i for i, t in enumerate(wanted)}
        asked = [(np.array([number[t] for t in terms], np.int64), np.array(weights, np.int64)) for _, terms, weights in queries]
        wanted = pa.array(wanted, pa.binary())
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in queries]
        for batch in stream:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                block = Block({k: v.values if k == "terms" else v.as_buffer() if k in ("bits", "falls") else v.as_py() for k, v in row.items()})
                rows = pc.fill_null(pc.index_in(wanted, value_set=block.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                for q, (terms, weights) in enumerate(asked):
                    here = rows[terms] >= 0
                    if not here.any():
                        continue
                    scores, null, ids = best[q]
                    columns, values, _ = block.best(rows[terms][here], weights[here], depth, max(1, int(scores[-1]) if len(scores) >= depth else 1))
                    scores, null, ids = np.append(scores, values), np.append(null, block.null[columns]), np.append(ids, block.ids[columns])
                    order = np.lexsort((ids, null, -scores))[:depth]
                    best[q] = scores[order], null[order], ids[order]
        keys = np.repeat(np.array([key for key, _, _ in queries], np.int64), [len(x[0]) for x in best])
        scores, null, ids = (np.concatenate(x) for x in zip(*best, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids, mask=null), pa.array(scores)], names=["query", "doc_id", "score"])

    return run


def terms_of(stream):
    """A mapInArrow function: (query, item_id, text) to (query, item_id, term) for each different term."""
    for batch in stream:
        for (first, n), texts in text_slices(batch, 2):
            for i, text in enumerate(texts):
                terms = list(counted(text)[0])
                if terms:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[first + i].as_py()] * len(terms), pa.int64()), pa.array([batch.column(1)[first + i].as_py()] * len(terms), pa.int64()), pa.array(terms, pa.binary())], names=["query", "item_id", "term"])


def search(blocks: DataFrame, items: DataFrame, scratch: Scratch, depth: int = DEPTH, chunk_bytes: int = CHUNK) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the `depth` best documents with a score above 0 for each row of items (item_id, text)."""
    spark = blocks.sparkSession
    bounded_batches(spark)
    numbered = items.select(F.monotonically_increasing_id().alias("query"), "item_id", "text")
    terms = scratch.keep(numbered.mapInArrow(terms_of, "query long, item_id long, term binary"))
    documents = blocks.agg(F.sum(F.size("doc_ids"))).first()[0] or 0
    counts = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    counts = counts.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1).cast("double")))
    chunks = max(1, -(-(terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) // chunk_bytes))
    asked = scratch.keep(terms.join(counts.select("term", weight.alias("weight")), "term").where("weight > 0").groupBy("query").agg(F.collect_list(F.struct("term", "weight")).alias("terms")).withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks))))
    found = None
    for chunk in range(chunks):
        queries = [(r.query, [bytes(t.term) for t in r.terms], [t.weight for t in r.terms]) for r in asked.where(F.col("chunk") == chunk).select("query", "terms").collect()]
        if queries:
            some = blocks.mapInArrow(best_of(queries, depth), "query long, doc_id long, score long").withColumn("part", F.spark_partition_id() % 64)
            found = some if found is None else found.unionByName(some)
    if found is None:
        return terms.selectExpr("item_id", "1 as rank", "bigint(null) as doc_id", "bigint(null) as score").where("false")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    first = found.withColumn("place", F.row_number().over(W.partitionBy("query", "part").orderBy(*order))).where(F.col("place") <= depth)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= depth)
    return ranked.join(terms.select("query", "item_id").distinct(), "query").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark, sf_dir):
    scratch = Scratch(spark, "lexical")
    blocks = build(table(spark, sf_dir, "documents"), scratch.path())
    return search(blocks, table(spark, sf_dir, "benchmark"), scratch)


QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLES = {
    "op11_ranked_search": r"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS terms FROM documents),
        sized AS (SELECT row, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
        corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sized),
        cells AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM cells GROUP BY term), corpus),
        asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark)),
        scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score FROM asked JOIN cells USING (term) JOIN weights USING (term) JOIN sized USING (row), corpus GROUP BY item_id, row, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 50
    """
}
