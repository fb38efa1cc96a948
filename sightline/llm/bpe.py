"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pre-tokens of a batch that are no tokens themselves lie end to end in one doubly linked list of symbols; nothing is
merged across the places where one begins. Each adjacent pair whose concatenation is in the vocabulary stands in the
bucket of its rank; a three-level bitmap over the ranks marks the buckets that hold something, so find-first-set gives
the next rank in three steps whatever the length. A bucket yields its leftmost position first; entries whose pair has
meanwhile changed are stale and are skipped when met. One merge costs O(1) amortised, so a pre-token of millions of
bytes takes time in proportion to its length. Pre-tokens do not see each other's merges, so their ids are those of
each alone.

Texts run through `mapInArrow` in slices of bounded size. They are cut where a match of the pattern surely begins (see
`parts`; `cut=False` for patterns of which that is not true), and a worker remembers what short parts came to, within a
bound in bytes. Ids become decimals and bytes again by one look-up of the whole slice in the vocabulary.

Nulls: a null text encodes as an empty one (no ids). Ids of documents are passed through, null or repeated. Very long
texts are one slice each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sightline.llm.kernels import byte_slices, text_slices
from sightline.llm.parts import Memory
from sightline.tables import bounded_batches, table

QUEUE = 1 << 18  # bytes of pre-tokens that one queue takes, if there are several


#: Parts that are one match where texts may be cut: ASCII letters, perhaps after a space.
PLAIN = re.compile(rb" ?[A-Za-z]+").fullmatch


class RankQueue:
    """Ranks below `size` as a bitmap of three levels of 64-way words; buckets hold list positions, the leftmost last."""

    def __init__(self, size: int):
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = positions
            a, b = rank >> 6, rank >> 12
            self.low[a] |= 1 << (rank & 63)
            self.mid[b] |= 1 << (a & 63)
            self.top |= 1 << b
        else:
            bucket += positions

    def first(self) -> int:
        """The least rank in the queue, or -1."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = (b << 6) + (m & -m).bit_length() - 1
        w = self.low[a]
        return (a << 6) + (w & -w).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Remove the bucket of a rank and return its positions, the leftmost last."""
        a, b = rank >> 6, rank >> 12
        self.low[a] ^= 1 << (rank & 63)
        if not self.low[a]:
            self.mid[b] ^= 1 << (a & 63)
            if not self.mid[b]:
                self.top ^= 1 << b
        out = self.buckets.pop(rank)
        out.sort(reverse=True)
        return out


class Coder:
    """Encoder and decoder of one rank file (base64 token and rank a line), splitting by `pattern`."""

    def __init__(self, path: str, pattern: str, cut: bool = True):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes_of = pa.array(self.tokens, pa.large_binary())
        self.decimals = pa.array([f"{i} ".encode() for i in range(size)], pa.large_binary())
        self.pairs = np.array([self.ranks.get(bytes([i >> 8, i & 255]), -1) for i in range(1 << 16)], np.int32)
        # White space is the Unicode property, as in the engine that the public library uses.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.queue = RankQueue(size)
        self.memory, self.cut = Memory(self.encode_parts), cut

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens, as little-endian 32-bit integers."""
        get, queue = self.ranks.get, self.queue
        data, n = b"".join(pieces), sum(map(len, pieces))
        starts = np.cumsum([0, *map(len, pieces)])
        raw = np.frombuffer(data, np.uint8)
        known = np.full(n, -1, np.int32)
        known[:-1] = self.pairs[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        known[starts[1:] - 1] = -1
        prior = np.arange(-1, n - 1, dtype=np.int32)
        prior[starts[:-1]] = -1
        # The symbol at a position ends at ends[position]; 0 marks one that was merged away.
        pair, before, ends = known.tolist(), prior.tolist(), list(range(1, n + 1))
        begins = bytearray(n + 1)
        for i in starts.tolist():
            begins[i] = 1
        at = np.flatnonzero(known >= 0)[::-1]
        at = at[np.argsort(known[at], kind="stable")]
        ranks, firsts = np.unique(known[at], return_index=True)
        at, firsts = at.tolist(), [*firsts.tolist(), len(at)]
        for k, rank in enumerate(ranks.tolist()):
            queue.push(rank, at[firsts[k] : firsts[k + 1]])
        buckets, low, mid = queue.buckets, queue.low, queue.mid
        while (rank := queue.first()) >= 0:
            bucket = queue.take(rank)
            while bucket:
                i = bucket.pop()
                if pair[i] != rank or not (j := ends[i]):
                    continue  # stale
                ends[i] = k = ends[j]
                ends[j] = 0
                pair[i] = pair[j] = -1
                least = rank
                # The new pairs on either side go into their buckets. The queue's push stands inline: calls would take most of the time.
                if not begins[k]:
                    before[k] = i
                    if (r := get(data[i : ends[k]])) is not None:
                        pair[i] = r
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            buckets[r] = [i]
                            low[r >> 6] |= 1 << (r & 63)
                            mid[r >> 12] |= 1 << (r >> 6 & 63)
                            queue.top |= 1 << (r >> 12)
                        if r < rank:
                            least = r
                if (p := before[i]) >= 0:
                    if (r := get(data[p:k])) is None:
                        pair[p] = -1
                    else:
                        pair[p] = r
                        if r in buckets:
                            buckets[r].append(p)
                        else:
                            buckets[r] = [p]
                            low[r >> 6] |= 1 << (r & 63)
                            mid[r >> 12] |= 1 << (r >> 6 & 63)
                            queue.top |= 1 << (r >> 12)
                        if r < least:
                            least = r
                if least < rank and bucket:
                    queue.push(rank, bucket)  # a new pair of smaller rank goes first; what is left waits
                    break
        ends = np.array(ends)
        at = np.flatnonzero(ends)
        ids = np.fromiter((self.ranks[data[i:j]] for i, j in zip(at.tolist(), ends[at].tolist(), strict=True)), "<i4", len(at)).tobytes()
        stops = (4 * np.searchsorted(at, starts)).tolist()
        return [ids[i:j] for i, j in zip(stops, stops[1:], strict=False)]

    def encode_parts(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part: those of its pre-tokens, of which the new ones share queues."""
        split = [[p] if self.cut and PLAIN(p) else [t.encode() for t in self.pattern.findall(p.decode())] for p in parts]
        known = {t: self.ranks.get(t) for s in split for t in s}
        wait = [t for t, rank in known.items() if rank is None]
        known |= {t: rank.to_bytes(4, "little") for t, rank in known.items() if rank is not None}
        for a, b in byte_slices(list(map(len, wait)), QUEUE):
            known |= zip(wait[a:b], self.merge(wait[a:b]), strict=True)
        return [known[s[0]] if len(s) == 1 else b"".join([known[t] for t in s]) for s in split]

    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)"""
        return self.memory.texts(texts, lambda _: not self.cut)

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text.encode()])[0].tolist()

    def looked_up(self, ids: np.ndarray, words: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The words of the ids in a row, and where each begins."""
        found = words.take(pa.array(ids))
        return memoryview(found.buffers()[2] or b""), np.frombuffer(found.buffers()[1], np.int64)[: len(ids) + 1]

    def decode(self, ids: list[int]) -> bytes:
        return bytes(self.looked_up(np.array(ids, np.int32), self.bytes_of)[0])


_coders: dict[tuple, Coder] = {}


def coder(path: str, pattern: str, cut: bool = True) -> Coder:
    if (path, pattern, cut) not in _coders:
        _coders.clear()  # one vocabulary at a time
        _coders[path, pattern, cut] = Coder(path, pattern, cut)
    return _coders[path, pattern, cut]


def digests(words: memoryview, at: np.ndarray, ends: np.ndarray, less: int) -> list[str]:
    """sha256 of the words of each text, without the last `less` bytes."""
    stops = at[ends].tolist()
    return [hashlib.sha256(words[i : max(i, j - less)]).hexdigest() for i, j in zip(stops, stops[1:], strict=False)]


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True, cut: bool = True) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(stream):
        made = coder(path, pattern, cut)
        for batch in stream:
            for rows, texts in text_slices(batch, 1, 1 << 20):
                ids, counts = made.encode_texts(texts)
                ends = np.cumsum([0, *counts])
                columns = [batch.column(0).slice(*rows), pa.array(counts, pa.int64()), pa.array(digests(*made.looked_up(ids, made.decimals), ends, 1), pa.string()), pa.array(digests(*made.looked_up(ids, made.bytes_of), ends, 0), pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, data binary) of rows (doc_id, ids)."""

    def run(stream):
        made = coder(path, pattern)
        for batch in stream:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([made.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def op10_byte_level_bpe(spark, sf_dir):
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


QUERIES = {"op10_byte_level_bpe": op10_byte_level_bpe}
ORACLES: dict[str, str] = {}
