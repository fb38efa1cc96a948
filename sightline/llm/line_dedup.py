r"""Line dedup by a deletion-neighbourhood join: of equal lines, and of lines within the edit bound, the earliest stays.

A line is the text between newlines, read as its words; lines without a word are left alone. A line goes if an earlier
one (by doc_id, then place in the text) has the same words, whatever their number; or if both have at least `min_words`
words and the earlier one's are within `max_edits` insertions, deletions or replacements of words (with the five words
and one edit of the defaults, what is left in common is at least 0.8 of a line).

1. Every line becomes 128 bits of hash of its words; equal lines are aggregated to their earliest place.
2. For a bound of one edit: different lines within it share their first or their last half, for a common base length.
   Lines whose halves no other line has are set aside: they have no neighbour, and emit nothing. For larger bounds all
   different lines emit; their variants grow as the words to the power of the bound.
3. The lines emit all variants with up to `max_edits` words deleted as hashed keys, each with the places of its gaps (the
   number of kept words before each deleted one). Keys of one line alone are set aside. For a bound of one edit a variant
   is joined to the earliest variant of its key and gap and to the line that its key is, and a line to the earliest
   variant of its key: three joins by equality, so neither a template that fills in one word differently a million
   times nor a line of one word a million times makes more than rows in proportion. (All variants of such a line are
   emitted: their gaps differ, and each may be what another line has there.) For larger bounds variants meet by key.
4. Each proposed pair is verified on the words; verified lines and repeats of equal lines are dropped.

Two lines that share a key are at most as many edits apart as their gaps, the common ones counted once; all lines of one
key and set of gaps are alike in that, so taking the earliest of them loses no neighbour.

Nulls: a null text has no lines and stays null; rows with a null doc_id are passed through as they are, and drop
nothing. Ties: equal lines at one place of one doc_id (repeated rows) both stay. Long texts are cut at newlines. An
empty table gives an empty result. All columns are kept; `n_lines` (lines with a word) and `n_dropped` are added
(replacing columns so named).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from sightline.llm.kernels import PIECE, SEQ, SEQ2, hash_spans, inverse, mix, powers, prefix_sums, sequence_hash, spans, text_slices
from sightline.tables import Scratch, bounded_batches, table

MIN_WORDS = 5


def line_blocks(texts: list[bytes], size: int = PIECE):
    """(bytes, [(index of the text, its first line, lines)]) of about `size` bytes, cut at newlines only."""
    block, meta, total = [], [], 0
    for i, text in enumerate(texts):
        at = line = 0
        while True:
            end = len(text)
            if end - at > size:
                cut = text.rfind(b"\n", at, at + size)
                cut = cut if cut >= 0 else text.find(b"\n", at + size)
                end = cut if cut >= 0 else end
            part = text[at:end]
            lines = part.count(b"\n") + 1
            block.append(part)
            meta.append((i, line, lines))
            total += len(part) + 1
            line += lines
            if total >= size:
                yield b"\n".join(block), meta
                block, meta, total = [], [], 0
            if end == len(text):
                break
            at = end + 1
    if block:
        yield b"\n".join(block), meta


class Lines:
    """Words and hashes of the lines of a block."""

    def __init__(self, raw: bytes):
        data = np.frombuffer(raw, np.uint8)
        starts, ends = spans(data)
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, starts)
        self.counts = np.bincount(line, minlength=len(breaks) + 1)
        self.at = np.concatenate([[0], np.cumsum(self.counts)])
        self.words = hash_spans(data, starts, ends)
        self.sums = prefix_sums(self.words, SEQ)
        self.hash = sequence_hash(self.sums, self.at[:-1], self.at[1:], SEQ)

    def second(self) -> np.ndarray:
        return sequence_hash(prefix_sums(mix(self.words), SEQ2), self.at[:-1], self.at[1:], SEQ2)

    def halves(self, which: np.ndarray) -> np.ndarray:
        """Four keys of each chosen line: first and last part for its own length as base length, and for one less."""
        a, b, n = self.at[:-1][which], self.at[1:][which], self.counts[which]
        out = np.zeros((len(n), 4), np.uint64)
        for k, base in enumerate((n, n - 1)):
            head = base // 2
            tail = base - head
            out[:, 2 * k] = mix(sequence_hash(self.sums, a, a + head, SEQ) + (base * 2).astype(np.uint64))
            out[:, 2 * k + 1] = mix(sequence_hash(self.sums, b - tail, b, SEQ) + (base * 2 + 1).astype(np.uint64))
        return out

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, key, place) of each line itself (place -1) and of each line without one word (that word's place)."""
        line = np.repeat(np.arange(len(self.counts)), self.counts)
        first, last, i = self.at[:-1][line], self.at[1:][line], np.arange(len(self.words))
        less = (self.sums[i] - self.sums[first]) + (self.sums[last] - self.sums[i + 1]) * inverse(SEQ)
        keys = np.concatenate([self.hash, less * powers(inverse(SEQ), len(self.sums))[first]])
        return np.concatenate([np.arange(len(self.counts)), line]), keys, np.concatenate([np.full(len(self.counts), -1), i - first])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def hashed_lines(min_words: int, with_keys: bool):
    """mapInArrow: (doc_id, text) to (doc_id, line_no, h, g, near, keys); near: whether the line has min_words words."""

    def run(stream):
        for batch in stream:
            for (first, rows), texts in text_slices(batch, 1):
                ids = batch.column(0).slice(first, rows)
                for raw, meta in line_blocks(texts):
                    lines = Lines(raw)
                    owner = np.repeat([m[0] for m in meta], [m[2] for m in meta])
                    number = np.concatenate([np.arange(m[1], m[1] + m[2]) for m in meta])
                    chosen = np.flatnonzero(lines.counts)
                    near = lines.counts[chosen] >= min_words
                    keys = lines.halves(chosen[near]) if with_keys else np.zeros((near.sum(), 0), np.uint64)
                    offsets = np.concatenate([[0], np.cumsum(near * keys.shape[1])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner[chosen])), pa.array(number[chosen].astype(np.int32)), signed(lines.hash[chosen]), signed(lines.second()[chosen]), pa.array(near), pa.ListArray.from_arrays(pa.array(offsets), signed(np.ascontiguousarray(keys).ravel()))], names=["doc_id", "line_no", "h", "g", "near", "keys"])

    return run


def chosen_lines(stream):
    """mapInArrow: (text, wanted) to (h, g, words) of the wanted lines; wanted: list<struct<line_no, h, g>>."""
    for batch in stream:
        for (first, rows), texts in text_slices(batch, 0):
            found = []
            for text, wanted in zip(texts, batch.column(1).slice(first, rows).to_pylist(), strict=True):
                at = {(w["line_no"], w["h"]): w["g"] for w in wanted}
                for raw, meta in line_blocks([text]):
                    lines, body, start = Lines(raw), raw.split(b"\n"), meta[0][1]
                    found += [(h, at[k + start, h], b" ".join(body[k].split())) for k, h in enumerate(lines.hash.view(np.int64).tolist()) if (k + start, h) in at]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2].decode() for f in found])], names=["h", "g", "words"])


def one_deleted(stream):
    """mapInArrow: (h, g, words) to (key, gaps, h, g): a line itself (gaps null), and without one word (its place)."""
    for batch in stream:
        for (first, rows), texts in text_slices(batch, 2):
            h, g = (np.asarray(batch.column(k).slice(first, rows)) for k in (0, 1))
            for raw, meta in line_blocks(texts):
                own = np.array([m[0] for m in meta])
                line, keys, place = Lines(raw).variants()
                yield pa.RecordBatch.from_arrays([signed(keys), pa.array(place.astype(np.int32), mask=place < 0), pa.array(h[own][line]), pa.array(g[own][line])], names=["key", "gaps", "h", "g"])


def many_deleted(max_edits: int):
    """mapInArrow: (h, g, words) to (key, gaps, h, g) of all variants with up to max_edits words deleted.

    A gap is the number of kept words before it, with the number of words deleted there so far in its low bits.
    """

    def run(stream):
        base, modulus = int(SEQ), (1 << 64) - 1
        for batch in stream:
            for h, g, words in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                hashes = Lines(words.encode()).words.tolist()
                rows = []
                for count in range(min(max_edits, len(hashes)) + 1):
                    for gone in combinations(range(len(hashes)), count):
                        key, power, gaps, left = 0, 1, [], set(gone)
                        for i, x in enumerate(hashes):
                            if i in left:
                                gap = (i - len(gaps)) << 4
                                gaps.append(gap + sum(y >> 4 == gap >> 4 for y in gaps))
                            else:
                                key, power = (key + x * power) & modulus, (power * base) & modulus
                        rows.append((key - (1 << 63), gaps))
                    if len(rows) > 20_000:
                        yield variants_batch(rows, h, g)
                        rows = []
                yield variants_batch(rows, h, g)

    return run


def variants_batch(rows: list[tuple], h: int, g: int) -> pa.RecordBatch:
    same = lambda x: pa.array([x] * len(rows), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), same(h), same(g)], names=["key", "gaps", "h", "g"])


def within(a: list, b: list, most: int) -> bool:
    """Whether two word lists are at most `most` insertions, deletions or replacements apart (a band of the edit table)."""
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = i if j == 0 else min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
        row = new
        if min(row.values()) > most:
            return False
    return row[len(b)] <= most


def within_one(a: list, b: list) -> bool:
    """`within` for one edit, in time in proportion to the words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def verified(max_edits: int):
    """mapInArrow: (h, g, mine, theirs) to (h, g) where the two are within the bound."""
    near = within_one if max_edits == 1 else lambda a, b: within(a, b, max_edits)

    def run(stream):
        for batch in stream:
            keep = [near(a.split(" "), b.split(" ")) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS, max_edits: int = 1) -> tuple[DataFrame, DataFrame]:
    """(totals, gone): rows (doc_id, n_lines) of lines with a word, and (doc_id, line_no, h) of those that go."""
    if max_edits < 0:
        raise ValueError("max_edits is at least 0")
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "line-dedup")
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    every = scratch.keep(rows.mapInArrow(hashed_lines(min_words, max_edits == 1), "doc_id long, line_no int, h long, g long, near boolean, keys array<long>"))
    place = F.struct("doc_id", "line_no")
    lines = scratch.keep(every.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.any_value("near").alias("near"), F.any_value("keys").alias("keys")))
    close = neighbours(rows, lines.where("near"), scratch, max_edits) if max_edits else lines.select("h", "g").limit(0)
    marked = lines.select("h", "g", "first", "n").join(close.withColumn("close", F.lit(True)), ["h", "g"], "left").where("n > 1 or close").select("h", "g", "first", "close")
    gone = every.select("doc_id", "line_no", "h", "g").join(marked, ["h", "g"]).where(F.col("close").isNotNull() | (place > F.col("first")))
    gone = scratch.keep(gone.select("doc_id", "line_no", "h"))
    totals = scratch.keep(every.groupBy("doc_id").agg(F.count("*").alias("n_lines")))
    for done in (every, lines, close):
        scratch.drop(done)
    return totals, gone


#: Entries of the smaller side of a hash join in one partition, some 50 MB.
ENTRIES = 1 << 20


def in_memory(rows: DataFrame, small: DataFrame, key: str, how: str, entries: int) -> DataFrame:
    """A join by a hash table of the smaller side, which has each key once, so that texts are not sorted.

    The table cannot spill, so the partitions follow its measured entries: none holds more than about `ENTRIES`.
    """
    n = -(-entries // ENTRIES)
    if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows, small = rows.repartition(n, key), small.repartition(n, key)
    return rows.join(small.hint("shuffle_hash"), key, how)


def neighbours(docs: DataFrame, lines: DataFrame, scratch: Scratch, max_edits: int) -> DataFrame:
    """Rows (h, g) of the different lines that have an earlier one within the bound."""
    some = lines.select("h", "g", "first")
    if max_edits == 1:
        keys = lines.select("h", "g", F.explode("keys").alias("half"))
        halves = scratch.keep(keys.groupBy("half").agg(F.count("*").alias("k")).where("k > 1").select("half"))
        found = in_memory(keys, halves, "half", "left_semi", halves.count()).select("h", "g").distinct()
        some = scratch.keep(some.join(found, ["h", "g"], "left_semi"))
    wanted = some.groupBy("first.doc_id").agg(F.collect_list(F.struct("first.line_no", "h", "g")).alias("wanted"))
    bodies = in_memory(docs, wanted, "doc_id", "inner", some.count()).select("text", "wanted").mapInArrow(chosen_lines, "h long, g long, words string")
    bodies = scratch.keep(bodies.dropDuplicates(["h", "g"]))
    kind = "int" if max_edits == 1 else "array<int>"
    emitted = bodies.mapInArrow(one_deleted if max_edits == 1 else many_deleted(max_edits), f"key long, gaps {kind}, h long, g long")
    emitted = scratch.keep(emitted.join(some, ["h", "g"]).select("key", "gaps", F.struct(F.col("first.doc_id"), F.col("first.line_no"), "h", "g").alias("own")))
    shared = scratch.keep(emitted.groupBy("key").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("key"))
    few = scratch.keep(emitted.join(shared, "key", "left_semi"))
    scratch.drop(emitted)
    earlier = F.struct("other.doc_id", "other.line_no") < F.struct("own.doc_id", "own.line_no")
    if max_edits == 1:
        whole, any_ = F.lit(-1), F.lit(-2)
        hubs = few.groupBy("key", F.coalesce("gaps", whole).alias("kind")).agg(F.min("own").alias("other"))
        hubs = scratch.keep(hubs.unionByName(few.where("gaps is not null").groupBy("key").agg(F.min("own").alias("other")).withColumn("kind", any_)))
        met = few.select("key", "own", F.explode(F.when(F.col("gaps").isNull(), F.array(any_)).otherwise(F.array("gaps", whole))).alias("kind")).join(hubs, ["key", "kind"])
    else:
        hubs = few.groupBy("key", F.col("gaps").alias("theirs")).agg(F.min("own").alias("other"))
        mine, theirs = F.col("gaps"), F.col("theirs")
        met = few.join(hubs, "key").where(F.size(mine) + F.size(theirs) - F.size(F.array_intersect(mine, theirs)) <= max_edits)
    pairs = met.where(earlier).select("own.h", "own.g", F.col("other.h").alias("oh"), F.col("other.g").alias("og"))
    pairs = scratch.keep(pairs.distinct())
    scratch.drop(few)
    both = pairs.join(bodies.withColumnRenamed("words", "mine"), ["h", "g"]).join(bodies.select(F.col("h").alias("oh"), F.col("g").alias("og"), F.col("words").alias("theirs")), ["oh", "og"])
    out = scratch.keep(both.select("h", "g", "mine", "theirs").mapInArrow(verified(max_edits), "h long, g long").distinct())
    for done in (pairs, bodies):
        scratch.drop(done)
    return out


def without_lines(place: int):
    """mapInArrow: drop the lines listed in the last column from the text in column `place`."""

    def run(stream):
        for batch in stream:
            for (first, rows), texts in text_slices(batch, place):
                part = batch.slice(first, rows)
                gone, body = part.column(part.num_columns - 1).to_pylist(), part.column(place)
                if any(gone):
                    known = body.is_valid().to_pylist()
                    for k, lost in enumerate(gone):
                        if lost:
                            at, left = {(x["line_no"], x["h"]) for x in lost}, []
                            for raw, meta in line_blocks([texts[k]]):
                                hashes, start = Lines(raw).hash.view(np.int64).tolist(), meta[0][1]
                                left += [line for i, line in enumerate(raw.split(b"\n")) if (i + start, hashes[i]) not in at]
                            texts[k] = b"\n".join(left)
                    body = pa.array([t.decode() if ok else None for t, ok in zip(texts, known, strict=True)], pa.string())
                columns = part.columns[:-1]
                columns[place] = body
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return run


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, max_edits: int = 1) -> DataFrame:
    """`docs` with their texts less the dropped lines, n_lines (lines with a word) and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    totals, gone = dropped_lines(docs, min_words, max_edits)
    lost = gone.count()
    gone = gone.groupBy("doc_id").agg(F.count("*").alias("n_dropped"), F.collect_set(F.struct("line_no", "h")).alias("__gone"))
    counted = totals.join(gone, "doc_id", "left")
    out = in_memory(docs, counted, "doc_id", "left", lost + totals.count())
    out = out.select(*docs.columns, F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "__gone")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema.fields[:-1]])
    return out.mapInArrow(without_lines(docs.columns.index("text")), schema)


def op3_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")


QUERIES = {"op3_line_dedup": op3_line_dedup}

ORACLE = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, ls[i] AS line, list_filter(regexp_split_to_array(ls[i], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS u(i)
), e AS (SELECT *, row(doc_id, line_no) AS pos FROM l WHERE len(w) >= 5
), x AS (SELECT row(doc_id, line_no) AS pos, array_to_string(w, ' ') AS key FROM l WHERE len(w) > 0
), xm AS (SELECT key, min(pos) AS m FROM x GROUP BY 1
), f AS (SELECT pos, array_to_string(w, ' ') AS key FROM e
), v AS (SELECT pos, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS key, i AS place FROM e, unnest(range(1, len(w) + 1)) AS u(i)
), fm AS (SELECT key, min(pos) AS m FROM f GROUP BY 1
), vp AS (SELECT key, place, min(pos) AS m FROM v GROUP BY 1, 2
), vk AS (SELECT key, min(m) AS m FROM vp GROUP BY 1
), gone AS (
  SELECT pos FROM x JOIN xm USING (key) WHERE m < pos UNION SELECT pos FROM v JOIN vp USING (key, place) WHERE m < pos
  UNION SELECT pos FROM v JOIN fm USING (key) WHERE m < pos UNION SELECT pos FROM f JOIN vk USING (key) WHERE m < pos
), per AS (
  SELECT l.doc_id, count(*) FILTER (len(w) > 0) AS n_lines, count(g.pos) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (g.pos IS NULL), '') AS text
  FROM l LEFT JOIN gone g ON g.pos = row(l.doc_id, l.line_no) GROUP BY 1
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(per.text, d.text) AS text FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id
"""

ORACLES = {"op3_line_dedup": ORACLE}
