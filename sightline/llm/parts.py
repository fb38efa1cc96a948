"""Texts in parts that tokenizers encode as they encode the whole, and a memory of parts in a worker.

For patterns in which runs of letters match apart from white space and marks, as those of byte-level BPE do, a text may
be cut before a space or newline that stands between a character that is no white space and a letter, and before a mark
that follows a letter: a match always begins there. Most parts are a word, and words repeat: a worker remembers what
parts came to, in two generations within a bound in bytes (what was not met in one generation is forgotten in the next),
or, where lookups would cost as much as encoding, in numpy arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from sightline.llm.kernels import lut, mix

MEMORY = 96 << 20  # bytes of remembered parts in a worker
ENTRY = 190  # bytes that an entry takes besides its part and its ids
SHORT = 64  # longest part that is remembered
SOLID, LETTER, BLANK = lut(bytes(range(0x21, 0x7F))), lut(bytes([*range(65, 91), *range(97, 123)])), lut(b" \n")
OPENS = BLANK | lut(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'")


def cuts(a: np.ndarray) -> np.ndarray:
    """Places where a part begins, besides the first. Letters are ASCII ones and U+00C0 to U+00FF."""
    n = len(a)
    at = np.flatnonzero(OPENS[a])
    at = at[(at > 0) & (at < n - 1)]
    here, before, after, then = a[at], a[at - 1], a[at + 1], a[np.minimum(at + 2, n - 1)]
    wide = (before >= 0x80) & (a[np.maximum(at - 2, 0)] == 0xC3) & (before != 0x97) & (before != 0xB7)
    letter = LETTER[after] | ((after == 0xC3) & (then != 0x97) & (then != 0xB7))
    return at[np.where(BLANK[here], (SOLID[before] | wide) & letter, LETTER[before] | wide)]


def safe_parts(raw: bytes) -> list[bytes]:
    at = [0, *cuts(np.frombuffer(raw, np.uint8)).tolist(), len(raw)]
    return [raw[i:j] for i, j in zip(at, at[1:], strict=False)]


#: A part that begins and ends as parts do between two cuts, with a letter or mark at its end.
FOLLOWS = re.compile(rb"(?s)(?=[ \n](?:[A-Za-z]|\xc3[^\x97\xb7])|[!-/:-@[-`{-~]).*(?:[!-~]|\xc3.)\Z")


def packed(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of at most 16 bytes as two 64-bit numbers, filled up with zeros; 16 more bytes follow the last span."""
    words = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    size = ends - starts
    return words[starts] & mask[np.minimum(size, 8)], words[starts + 8] & mask[np.clip(size - 8, 0, 8)]


def laid(texts: list[bytes], cut: Callable[[np.ndarray], np.ndarray], whole: Callable[[bytes], bool]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts in a row, starts and ends of their parts there, the text that each part is from)"""
    raw = b"\0".join(texts) + bytes(17)
    data = np.frombuffer(raw, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + 1) - sizes - 1
    at = cut(data[: len(raw) - 17])
    uncut = np.array([whole(t) for t in texts], bool)
    if uncut.any():
        at = at[~uncut[np.searchsorted(begins, at, "right") - 1]]
    starts = np.sort(np.concatenate([at, begins]))
    owner = np.searchsorted(begins, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(raw)), (begins + sizes)[owner])
    solid = ends > starts
    starts, ends, owner = starts[solid], ends[solid], owner[solid]
    return raw, starts, ends, owner


def key_of(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(low + mix(high ^ np.uint64(0x9E3779B97F4A7C15)) + size.astype(np.uint64))


def different(texts: list[bytes], cut: Callable[[np.ndarray], np.ndarray], whole: Callable[[bytes], bool]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(the different parts of all texts, which of them each part in a row is, the text that it is from).

    Parts of up to 16 bytes are told apart as pairs of 64-bit numbers, so that Python sees each different one once.
    """
    raw, starts, ends, owner = laid(texts, cut, whole)
    short = np.flatnonzero(ends - starts <= 16)
    low, high = packed(raw, starts[short], ends[short])
    key = key_of(low, high, (ends - starts)[short])
    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
    if not ((low == low[first][kind]) & (high == high[first][kind]) & ((ends - starts)[short] == (ends - starts)[short][first][kind])).all():
        first, kind = np.arange(len(short)), np.arange(len(short))  # two parts of one key: each for itself
    long = np.flatnonzero(ends - starts > 16)
    which = np.zeros(len(starts), np.int64)
    which[short], which[long] = kind, len(first) + np.arange(len(long))
    some = np.concatenate([short[first], long])
    return [raw[i:j] for i, j in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], which, owner


def places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1], and so on."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Memory:
    """Ids (little-endian 32-bit integers) of parts; `encode` gives those of a list of different parts."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], limit: int = MEMORY):
        self.encode, self.limit = encode, limit // 2
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    def of(self, parts: list[bytes]) -> list[bytes]:
        ids = list(map(self.young.get, parts))
        missed = [p for p, x in zip(parts, ids, strict=True) if x is None]
        if not missed:
            return ids
        found = list(map(self.old.get, missed)) if self.old else [None] * len(missed)
        new = list(dict.fromkeys([p for p, x in zip(missed, found, strict=True) if x is None]))
        made = dict(zip(new, self.encode(new), strict=True))
        found = [made[p] if x is None else x for p, x in zip(missed, found, strict=True)]
        kept = dict(zip(missed, found, strict=True))
        if max(map(len, missed)) > SHORT:
            kept = {p: x for p, x in kept.items() if len(p) <= SHORT}
        more = sum(map(len, kept)) + sum(map(len, kept.values())) + ENTRY * len(kept)
        if self.size + more > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        if more <= self.limit:
            self.young |= kept
            self.size += more
        rest = iter(found)
        return [next(rest) if x is None else x for x in ids]

    def texts(self, texts: list[bytes], whole: Callable[[bytes], bool] = lambda _: False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); texts for which `whole` says so are not cut."""
        parts, which, owner = different(texts, cuts, whole)
        ids = self.of(parts)
        upto = np.cumsum([0, *map(len, ids)]) // 4
        count = np.diff(upto)[which]
        return np.frombuffer(b"".join(ids), "<i4")[places(upto[which], count)], np.bincount(owner, count, len(texts)).astype(np.int64)


def split(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Little-endian 32-bit integers of each run of ids."""
    raw, at = ids.astype("<i4", copy=False).tobytes(), np.cumsum([0, *(4 * counts)]).tolist()
    return [raw[i:j] for i, j in zip(at, at[1:], strict=False)]


def room(a: np.ndarray, n: int) -> np.ndarray:
    """The array, with space for n values."""
    if n <= len(a):
        return a
    out = np.empty(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class PackedMemory:
    """Ids of parts; `encode` gives (ids of a list of different parts in a row, number of ids of each).

    Parts of up to 16 bytes are rows of numpy arrays, found by a hash table with open addressing, all
    parts of some texts at once: Python sees only those not met before. Where rows or ids run out of space, rows that
    were met again since the last time stay, if they are half of all or less. Other parts have a `Memory`.
    """

    ROW = 64  # bytes of a row: its part and key, where its ids begin, up to four slots of the table, four ids or so

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = MEMORY):
        self.encode, self.limit = encode, limit * 3 // 4 // self.ROW
        self.others = Memory(lambda parts: split(*encode(parts)), limit // 4)
        self.mask = (1 << (2 * self.limit).bit_length()) - 1
        self.rows = 0
        self.low, self.high, self.key = (np.zeros(1, np.uint64) for _ in range(3))
        self.met, self.starts, self.ids = np.zeros(1, bool), np.zeros(1, np.int64), np.zeros(1, np.int32)
        self.table = np.full(self.mask + 1, -1, np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at = (key & np.uint64(self.mask)).astype(np.int64)
        row = self.table[at]
        left = np.flatnonzero((row >= 0) & (self.key[row] != key))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            row[left] = now = self.table[at[left]]
            left = left[(now >= 0) & (self.key[now] != key[left])]
        return row

    def enter(self, first: int, last: int) -> None:
        """Put rows, whose keys are different and not in the table, into it."""
        row = np.arange(first, last, dtype=np.int32)
        at = (self.key[first:last] & np.uint64(self.mask)).astype(np.int64)
        while len(row):
            free = self.table[at] < 0
            self.table[at[free]] = row[free]
            lost = self.table[at] != row
            row, at = row[lost], (at[lost] + 1) & self.mask

    def add(self, parts: list[bytes], low: np.ndarray, high: np.ndarray, key: np.ndarray) -> None:
        """Lay down new rows behind the others."""
        a, b = self.rows, self.rows + len(parts)
        ids, counts = self.encode(parts)
        start = int(self.starts[a])
        self.ids = room(self.ids, start + len(ids))
        self.ids[start : start + len(ids)] = ids
        self.starts = room(self.starts, b + 1)
        self.starts[a + 1 : b + 1] = start + np.cumsum(counts)
        self.low, self.high, self.key, self.met = (room(x, b) for x in (self.low, self.high, self.key, self.met))
        self.low[a:b], self.high[a:b], self.key[a:b], self.met[a:b] = low, high, key, False

    def forget(self) -> None:
        kept, counts = self.met[: self.rows], np.diff(self.starts[: self.rows + 1])
        if 2 * kept.sum() > self.limit or 2 * counts[kept].sum() > 4 * self.limit:
            kept[:] = False
        self.ids = np.append(self.ids[: self.starts[self.rows]][np.repeat(kept, counts)], np.int32(0))
        self.starts = np.concatenate([[0], np.cumsum(counts[kept])])
        self.low, self.high, self.key = (np.append(x[: self.rows][kept], np.uint64(0)) for x in (self.low, self.high, self.key))
        self.rows = int(kept.sum())
        self.met = np.zeros(self.rows + 1, bool)
        self.table[:] = -1
        self.enter(0, self.rows)

    def texts(self, texts: list[bytes], whole: Callable[[bytes], bool] = lambda _: False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); texts for which `whole` says so are not cut."""
        raw, starts, ends, owner = laid(texts, cuts, whole)
        size = ends - starts
        short = np.flatnonzero(size <= 16)
        low, high = packed(raw, starts[short], ends[short])
        key = key_of(low, high, size[short])
        row = self.find(key)
        unknown = np.flatnonzero(row < 0)
        found, new, kind = np.unique(key[unknown], return_index=True, return_inverse=True)
        new, more = unknown[new], len(new)
        if more:
            self.add([raw[i:j] for i, j in zip(starts[short[new]].tolist(), ends[short[new]].tolist(), strict=True)], low[new], high[new], found)
            row[unknown] = self.rows + kind
        # Parts of one key and equal numbers have equal sizes; those with another part's key go with the long ones.
        right = (self.low[row] == low) & (self.high[row] == high)
        self.met[row[right & (row < self.rows)]] = True
        other = np.ones(len(size), bool)
        other[short[right]] = False
        other = np.flatnonzero(other)
        apart = self.others.of([raw[i:j] for i, j in zip(starts[other].tolist(), ends[other].tolist(), strict=True)])
        upto = int(self.starts[self.rows + more])
        rest = np.frombuffer(b"".join(apart), "<i4")
        first, count = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        begins = self.starts[row[right]]
        first[short[right]], count[short[right]] = begins, self.starts[row[right] + 1] - begins
        count[other] = np.fromiter(map(len, apart), np.int64, len(apart)) // 4
        first[other] = upto + np.cumsum(count[other]) - count[other]
        self.ids = room(self.ids, upto + len(rest))
        self.ids[upto : upto + len(rest)] = rest
        ids = self.ids[places(first, count)]
        if self.rows + more <= self.limit and upto <= 4 * self.limit:
            self.enter(self.rows, self.rows + more)
            self.rows += more
        else:
            self.forget()
        return ids, np.bincount(owner, count, len(texts)).astype(np.int64)
