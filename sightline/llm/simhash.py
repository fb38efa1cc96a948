"""SimHash near-duplicates by anchor-point covering.

Fingerprints of one or more 64-bit words link where at most `bits` bits differ. The anchors are the codewords of the
perfect Hamming code [31, 26] (covering radius 1), used on 31 bits of each half of each word. A fingerprint is at home at
the single anchor within the radius and is replicated to every anchor within radius plus threshold (2 bits: 1 or 16
anchors of a half); two fingerprints with at most one difference in a half meet at the home anchor of either. At an
anchor, home fingerprints are compared with all, over all bits.

- `CONTRACT`: one word from three-word shingles, repeats included, 3 bits. Of 3 differing bits, one of the two halves has
  at most 1, so every link is found.
- `SIMILAR`: eighteen words from the different five-word shingles, for a similarity (shared of all shingles) of 0.8: there
  the share of differing bits is acos(8/9)/pi, 174 of 1152, and `bits` adds 3.3 standard deviations. Fingerprints that
  meet within the bits are candidates only: links are those whose shingles, all of them, are similar enough (`verified`).
  Candidates need not share an anchor: a half of 31 bits differs in few places only by chance. Of pairs of similarity
  0.8 to 0.85, 97 in 100 meet in one of the 36 halves, above that more; tests measure it.

Only different fingerprints are placed; copies are carried by the least doc_id of their fingerprint. Replicas at anchors
where nothing is at home are dropped before anything is compared. An anchor with many fingerprints is cut into blocks of
bounded size that different tasks compare (n fingerprints of one anchor make about n * n / `BLOCK` rows), and a block
yields a spanning set of its links (fewer than its rows), never all pairs, so the links form the same components.
Components come from star contraction.

Nulls: a null text has no words, as an empty one: fingerprint zero, linked like any other. Rows with a null doc_id get
a fingerprint and join their component, but never name it. Repeated rows are kept. Very long texts are read in pieces.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sightline.llm.kernels import LOWER, SEQ, hash_spans, mix, pieces, prefix_sums, sequence_hash, spans, text_slices
from sightline.operators.components import connected_components
from sightline.tables import Scratch, bounded_batches, table


@dataclass(frozen=True)
class Kind:
    """How fingerprints are made and which link: words of 64 bits, words of a shingle, most differing bits."""

    words: int
    shingle: int
    bits: int


CONTRACT = Kind(1, 3, 3)
SIMILAR = Kind(18, 5, 214)
SIMILARITY = 0.8
#: Rounds in which candidates are held against a leader, before what is left is compared group by group.
ROUNDS = 3

SEED = 42  # fixed value of the contract
BLOCK = 1024


def normal_pieces(text: bytes, keep: int):
    """(joined words, starts, ends) of each piece of a text, A-Z lowered, words joined by one space.

    Each piece after the first begins with the last `keep` words before it, so that windows run across the cuts.
    """
    tail = b""
    for a, b in pieces(text):
        data = LOWER[np.frombuffer(tail + b" " + text[a:b] if tail else text[a:b], np.uint8)]
        starts, ends = spans(data)
        if not len(starts):
            continue
        raw = data.tobytes()
        joined = b" ".join([raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)])
        size = ends - starts + 1
        stop = np.cumsum(size) - 1
        begin = stop - size + 1
        yield joined, begin, stop
        if keep:
            tail = joined[int(begin[max(0, len(begin) - keep)]) :]


def fingerprint(text: bytes, width: int = CONTRACT.shingle) -> int:
    """Bits set in over half of the XXH64 hashes of the word shingles, repeats included."""
    counts, n = np.zeros(64, np.int64), 0
    short, digest = b"", xxhash.xxh64_intdigest
    for joined, begin, stop in normal_pieces(text, width - 1):
        if len(begin) < width:
            short = joined
            continue
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begin[: len(begin) - width + 1].tolist(), stop[width - 1 :].tolist(), strict=True)), np.uint64)
        counts += set_bits(hashes[:, None])
        n += len(hashes)
    if not n and short:
        return digest(short, SEED)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def set_bits(rows: np.ndarray) -> np.ndarray:
    """How many rows have each bit set; rows of 64-bit words."""
    out = np.zeros(64 * rows.shape[1], np.int64)
    for k in range(0, len(rows), 255 * 16):
        bits = np.unpackbits(np.ascontiguousarray(rows[k : k + 255 * 16]).view(np.uint8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            out += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return out


def shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes of the different word shingles; of the whole sequence, if it is shorter; none for a text without words."""
    words = []
    for a, b in pieces(text):
        data = LOWER[np.frombuffer(text[a:b], np.uint8)]
        words.append(hash_spans(data, *spans(data)))
    word = np.concatenate(words) if words else np.zeros(0, np.uint64)
    if not len(word):
        return word
    size = min(width, len(word))
    at = np.arange(len(word) - size + 1)
    return np.unique(mix(sequence_hash(prefix_sums(word, SEQ), at, at + size, SEQ)))


def wide_fingerprint(text: bytes, kind: Kind) -> bytes:
    """Bits set in over half of the hashes of the different shingles, `kind.words` hashes for each."""
    found = shingles(text, kind.shingle)
    salts = mix(np.arange(1, kind.words + 1, dtype=np.uint64))
    counts = np.zeros(64 * kind.words, np.int64)
    for k in range(0, len(found), 1 << 14):
        counts += set_bits(mix(found[k : k + (1 << 14), None] + salts[None, :]))
    return np.packbits(2 * counts > len(found), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, kind: Kind = CONTRACT) -> DataFrame:
    """Rows (doc_id, t, fp): t is a hash of the text, fp the little-endian bytes of the fingerprint."""

    def run(stream):
        for batch in stream:
            for (first, rows), texts in text_slices(batch, 2):
                if kind.words == 1:
                    fps = [fingerprint(t, kind.shingle).to_bytes(8, "little") for t in texts]
                else:
                    fps = [wide_fingerprint(t, kind) for t in texts]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, rows) for k in (0, 1)), pa.array(fps, pa.binary())], names=["doc_id", "t", "fp"])

    return docs.select("doc_id", text_key().alias("t"), "text").mapInArrow(run, "doc_id long, t long, fp binary")


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def syndrome(word: np.ndarray) -> np.ndarray:
    """Exclusive or of the places (1 to 31) of the set bits: zero for codewords, else the place of the nearest one's flip."""
    out = np.zeros(len(word), np.uint32)
    for place in range(1, 32):
        out ^= np.where(word >> np.uint32(place - 1) & np.uint32(1), np.uint32(place), np.uint32(0))
    return out


#: For each syndrome, the flips of at most two bits that lead to a codeword: none, or one single bit and 15 pairs.
FLIPS = [np.array([0], np.uint32)] + [np.array([1 << (s - 1)] + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i < i ^ s], np.uint32) for s in range(1, 32)]


def as_words(column: pa.Array, words: int) -> np.ndarray:
    """Rows of 64-bit words of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def anchors(fps: np.ndarray, home: bool) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) of the home places, or of all others; the bits from 31 on name the half."""
    index, anchor = [], []
    for half in range(2 * fps.shape[1]):
        word = (fps[:, half // 2] >> np.uint64(32 * (half % 2)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
        found = syndrome(word)
        for s in range(32):
            mine, flips = np.flatnonzero(found == s), FLIPS[s][:1] if home else FLIPS[s][1:]
            if len(mine) and len(flips):
                index.append(np.repeat(mine, len(flips)))
                anchor.append((word[mine, None] ^ flips[None, :]).ravel().astype(np.int64) | half << 31)
    return (np.concatenate(index), np.concatenate(anchor)) if index else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def place(words: int, home: bool):
    """mapInArrow: (id, fp) to (anchor, id)."""

    def run(stream):
        for batch in stream:
            size = 8192 // words
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                index, anchor = anchors(as_words(part.column(1), words), home)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), part.column(0).take(pa.array(index))], names=["anchor", "id"])

    return run


def near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return out <= bits


def spanning_links(links: np.ndarray, home_ids: np.ndarray, other_ids: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ids that join what is linked between two sets, fewer than their members together.

    Labels spread over the 0/1 matrix of links until they settle; each member then names its component's least member.
    """
    rows, cols = links.any(axis=1), links.any(axis=0)
    if not rows.any():
        return []
    links = links[rows][:, cols]
    left, right = home_ids[rows], other_ids[cols]
    a, b = np.arange(len(left)), np.zeros(len(right), np.int64)
    while True:
        b = np.where(links, a[:, None], len(left)).min(axis=0)
        new = np.minimum(a, np.where(links, b[None, :], len(left)).min(axis=1))
        new = new[new]
        if (new == a).all():
            break
        a = new
    pairs = {(int(x), int(left[k])) for x, k in zip(left, a, strict=True)} | {(int(x), int(left[k])) for x, k in zip(right, b, strict=True)}
    return [(x, y) for x, y in pairs if x != y]


def by_first(work):
    """mapInArrow over rows sorted by their first column: `work` on the table of each value."""

    def run(stream):
        rest = None
        for batch in stream:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            starts = [0, *(np.flatnonzero(np.diff(rows.column(0).to_numpy())) + 1).tolist()]
            for a, b in zip(starts, starts[1:], strict=False):
                yield work(rows.slice(a, b - a))
            rest = rows.slice(starts[-1])
        if rest is not None and rest.num_rows:
            yield work(rest)

    return run


def compare(kind: Kind):
    """mapInArrow over rows (block, id, fp, home) sorted by block: spanning links of each block."""

    def links_of(rows: pa.Table) -> pa.RecordBatch:
        ids, fps, home = rows["id"].to_numpy(), as_words(rows["fp"], kind.words), rows["home"].to_numpy()
        mine, others = home != 1, home != 0
        pairs = spanning_links(near(fps[mine], fps[others], kind.bits), ids[mine], ids[others])
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return by_first(links_of)


def blocks(placed: DataFrame, counts: DataFrame, block: int) -> DataFrame:
    """Rows (block long, id, home): home 0 is compared as at home, 1 as other, 2 as both.

    An anchor with up to `block` members is one block. A larger one is cut into k parts by a hash of the fingerprint;
    home members of part i meet all members of part j in block (i, j).
    """
    few = counts.select("anchor", F.ceil(F.col("n") / block).cast("int").alias("k"))
    joined = placed.join(few, "anchor").withColumn("part", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    whole = lambda i, j: F.xxhash64("anchor", i, j)
    steps = F.sequence(F.lit(0), F.col("k") - 1)
    single = F.array(F.struct(whole(F.lit(0), F.lit(0)).alias("block"), F.when(F.col("home"), 2).otherwise(1).alias("home")))
    as_other = F.transform(steps, lambda i: F.struct(whole(i, F.col("part")).alias("block"), F.lit(1).alias("home")))
    as_home = F.when(F.col("home"), F.transform(steps, lambda j: F.struct(whole(F.col("part"), j).alias("block"), F.lit(0).alias("home")))).otherwise(F.array().cast("array<struct<block:bigint,home:int>>"))
    rows = F.when(F.col("k") == 1, single).otherwise(F.concat(as_other, as_home))
    return joined.select("id", F.explode(rows).alias("r")).select("r.block", "id", "r.home")


def dealt(prints: DataFrame, scratch: Scratch, kind: Kind, block: int) -> DataFrame:
    """Rows (block, home, ..) of prints (id, fp, ..), those of a block together."""
    bare = prints.select("id", "fp")
    homes = scratch.keep(bare.mapInArrow(place(kind.words, True), "anchor long, id long"))
    others = bare.mapInArrow(place(kind.words, False), "anchor long, id long")
    others = scratch.keep(others.join(homes.select("anchor").distinct(), "anchor", "left_semi"))
    placed = homes.withColumn("home", F.lit(True)).unionByName(others.withColumn("home", F.lit(False)))
    counts = placed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    rows = blocks(placed, counts, block).join(prints, "id").withColumn("home", F.col("home").cast("int"))
    return rows.repartition("block").sortWithinPartitions("block")


def links(prints: DataFrame, scratch: Scratch, kind: Kind = CONTRACT, block: int = BLOCK) -> DataFrame:
    """Rows (u, v) of ids of linked fingerprints, enough to join every component; prints: distinct rows (id, fp)."""
    rows = dealt(prints.select("id", "fp"), scratch, kind, block).select("block", "id", "fp", "home")
    return rows.mapInArrow(compare(kind), "u long, v long").distinct()


def candidate_groups(kind: Kind):
    """mapInArrow over rows (block, id, fp, home, part) sorted by block: (gathering, id) of what may link across parts.

    The gathering is a hash of its ids, so that what meets at several anchors alike is compared once.
    """

    def groups_of(rows: pa.Table) -> pa.RecordBatch:
        ids, fps, home, part = rows["id"].to_numpy(), as_words(rows["fp"], kind.words), rows["home"].to_numpy(), rows["part"].to_numpy()
        mine, others = home != 1, home != 0
        open_ = near(fps[mine], fps[others], kind.bits) & (part[mine][:, None] != part[others][None, :])
        least: dict[int, int] = {}
        for x, y in spanning_links(open_, ids[mine], ids[others]):
            least[x], least[y] = y, y
        members: dict[int, list[int]] = {}
        for x in sorted(least):
            members.setdefault(least[x], []).append(x)
        names = [xxhash.xxh64_intdigest(np.array(m, np.int64).tobytes()) - (1 << 63) for m in members.values()]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), [len(m) for m in members.values()])), pa.array([x for m in members.values() for x in m], pa.int64())], names=["gathering", "id"])

    return by_first(groups_of)


def exact_links(similarity: float):
    """mapInArrow over rows (gathering, id, part, shingles) sorted by gathering: links that join its parts.

    Each member in turn is held against all that are not yet in one part with it, by their shingles.
    """

    def links_of(rows: pa.Table) -> pa.RecordBatch:
        ids, part = rows["id"].to_pylist(), rows["part"].to_numpy().copy()
        sets = [np.sort(np.asarray(x, np.int64)) for x in rows["shingles"].to_numpy()]
        sizes, out = np.array(list(map(len, sets))), []
        for i in range(len(ids) - 1):
            rest = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
            if not len(rest):
                if (part[i:] == part[i]).all():
                    break
                continue
            theirs, mine = np.concatenate([sets[j] for j in rest]), sets[i]
            at = np.minimum(np.searchsorted(mine, theirs), max(0, len(mine) - 1))
            found = np.concatenate([[0], np.cumsum(mine[at] == theirs if len(mine) else np.zeros(len(theirs), bool))])
            ends = np.cumsum(sizes[rest])
            shared = found[ends] - found[ends - sizes[rest]]
            every = sizes[rest] + len(mine) - shared
            for j in rest[(every > 0) & (shared / np.maximum(every, 1) >= similarity)].tolist():
                out.append((ids[i], ids[j]))
                part[part == part[j]] = part[i]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return by_first(links_of)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """Rows (id, size, shingles) of docs (id, text): hashes of the different shingles."""

    def run(stream):
        for batch in stream:
            for (first, rows), texts in text_slices(batch, 1):
                found = [shingles(t, width).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array([len(x) for x in found], pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["id", "size", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "id long, size int, shingles array<long>")


def verified(prints: DataFrame, candidates: DataFrame, sets: DataFrame, scratch: Scratch, kind: Kind, similarity: float, rounds: int = ROUNDS, block: int = BLOCK, salt: int = 4096) -> DataFrame:
    """Rows (node, component) by links of enough similarity only; candidates: (node, component) by links within the bits.

    Of each candidates' component a leader is held against all its other members, in rounds: those that are similar
    enough join its part. Then what may still link across the parts meets at its anchors again, in gatherings of bounded
    size, and each of those is compared until it is one part or all its pairs are told apart. So all pairs of one
    candidates' component that share an anchor within the bits are judged, but for those already joined; and every link
    stands on the shingles themselves. Leaders of large components are copied for each `salt` members.
    """
    state = scratch.keep(candidates.select(F.col("node").alias("id"), F.col("component").alias("cand"), F.col("node").alias("part"), F.lit(False).alias("led"), F.lit(False).alias("done")))
    apart = lambda rows: rows.where("not done").groupBy("cand").agg(F.count_distinct("part").alias("parts"), F.count("*").alias("n"), F.min(F.struct("led", "id"))["id"].alias("leader")).where("parts > 1")
    for _ in range(rounds):
        leaders = scratch.keep(apart(state).join(state.select(F.col("id").alias("leader"), F.col("part").alias("own")), "leader"))
        if leaders.isEmpty():
            break
        copies = F.ceil(F.col("n") / salt).cast("int")
        theirs = leaders.join(sets.select(F.col("id").alias("leader"), F.col("size").alias("m"), F.col("shingles").alias("s")), "leader").select("cand", "own", "m", "s", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
        mine = state.join(leaders.select("cand", copies.alias("copies")), "cand").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int")).select("id", "cand", "part", "salt")
        met = mine.join(sets, "id").join(theirs, ["cand", "salt"]).where("part <> own")
        shared = F.size(F.array_intersect("shingles", "s"))
        won = met.where(shared / F.greatest(F.col("size") + F.col("m") - shared, F.lit(1)) >= similarity).select("cand", "own", "part").distinct()
        joined = won.select("cand", "part").unionByName(leaders.select("cand", F.col("own").alias("part"))).distinct()
        least = joined.groupBy("cand").agg(F.min("part").alias("new"))
        moved = joined.join(least, "cand")
        heads = leaders.select(F.col("leader").alias("id"), F.lit(True).alias("head"))
        new = state.join(moved, ["cand", "part"], "left").join(heads, "id", "left")
        before, state = state, scratch.keep(new.select("id", "cand", F.coalesce("new", "part").alias("part"), (F.col("led") | F.col("new").isNotNull()).alias("led"), (F.col("done") | F.coalesce("head", F.lit(False))).alias("done")))
        scratch.drop(before)
    left = scratch.keep(state.where("not done").join(apart(state).select("cand"), "cand", "left_semi").select("id", "part"))
    edges = state.select(F.col("id").alias("u"), F.col("part").alias("v"))
    if not left.isEmpty():
        rows = dealt(prints.select("id", "fp").join(left, "id"), scratch, kind, block).select("block", "id", "fp", "home", "part")
        met = scratch.keep(rows.mapInArrow(candidate_groups(kind), "gathering long, id long").distinct())
        full = met.join(left, "id").join(sets, "id").select("gathering", "id", "part", "shingles").repartition("gathering").sortWithinPartitions("gathering", "id")
        edges = edges.unionByName(full.mapInArrow(exact_links(similarity), "u long, v long"))
    return connected_components(edges)


def components(docs: DataFrame, kind: Kind = CONTRACT, similarity: float | None = None) -> DataFrame:
    """Rows (doc_id, t, fp, component, component_id): component_id is the least doc_id reachable by links, its own included.

    With a similarity, links within the bits count only if their texts' shingles are that similar.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(fingerprints(docs, kind))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")
    groups = scratch.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), first).withColumn("id", F.monotonically_increasing_id()))
    parts = connected_components(links(groups, scratch, kind))
    if similarity is not None:
        parts = scratch.keep(parts)
        told = groups.join(parts.select(F.col("node").alias("id")), "id").select("id", F.col("first.doc_id").alias("__d"), F.col("first.t").alias("__t"))
        rows = docs.select("doc_id", "text", text_key().alias("t"))
        texts = rows.join(told, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("t") == F.col("__t"))).groupBy("id").agg(F.first("text").alias("text"))
        sets = scratch.keep(shingle_sets(texts, kind.shingle))
        parts = verified(groups, parts, sets, scratch, kind, similarity)
    named = groups.join(parts.withColumnRenamed("node", "id"), "id", "left").select("fp", "least", F.coalesce("component", "id").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(ids, "component").select("fp", "component", "component_id"), "fp")


def first_of_each(docs: DataFrame, kind: Kind = SIMILAR, similarity: float | None = SIMILARITY) -> DataFrame:
    """One row of each component: the one with the least doc_id (null last), then the least hash of its text.

    Rows of one doc_id stay apart where their texts do; of rows equal in doc_id and text, the least in all columns stays.
    """
    names = docs.columns
    found = Scratch(docs.sparkSession, "simhash").keep(components(docs, kind, similarity).select("doc_id", "t", "component"))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("f"), F.count("*").alias("n"))
    won = first.select(F.col("f.doc_id").alias("__d"), F.col("f.t").alias("__t"))
    again = found.groupBy(F.col("doc_id").alias("__d"), F.col("t").alias("__t")).agg(F.count("*").alias("n")).where("n > 1").select("__d", "__t")
    row = docs.withColumn("__k", text_key())
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__k") == F.col("__t"))
    chosen = row.join(won, same, "left_semi")
    single = chosen.join(again, same, "left_anti").select(names)
    one = chosen.join(again, same, "left_semi").groupBy("doc_id", "__k").agg(F.min(F.struct(*names)).alias("r"))
    return single.unionByName(one.select("r.*"))


def hex16(fp: Column) -> Column:
    """Hexadecimal digits of a fingerprint of one word, the highest first."""
    return F.concat(*[F.substring(F.lower(F.hex(fp)), 2 * k + 1, 2) for k in reversed(range(8))])


def op9_simhash(spark, sf_dir):
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
