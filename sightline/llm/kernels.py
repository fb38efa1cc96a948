"""Word and window hashing of Arrow string columns with numpy, for use inside tasks.

Texts are cut into pieces of bounded size at white space, so memory does not grow with the longest text (only with its
longest word); what is kept per text is eight bytes a word. Hashes are polynomials modulo 2**64 with odd bases. They
propose candidates or identify sequences in pairs (128 bits); where rows are dropped on their account the callers
verify or use both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The ASCII white space that separates words.
SPACES = b" \t\n\x0b\x0c\r"
PIECE = 1 << 18
BASE, BASE2, SEQ, SEQ2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def lut(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


IS_SPACE = lut(SPACES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64; grown as needed and kept by the worker."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(have)
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def text_slices(batch: pa.RecordBatch, place: int, size: int = PIECE) -> Iterator[tuple[tuple[int, int], list[bytes]]]:
    """((first row, rows), UTF-8 of their texts) of runs of rows of about `size` bytes; null counts as empty.

    What a kernel holds beside the batch itself is thus bounded by bytes (or the longest text), whatever the batch.
    """
    column = batch.column(place)
    column = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    for a, b in byte_slices(np.diff(offsets).tolist(), size):
        yield (a, b - a), [x or b"" for x in column.slice(a, b - a).to_pylist()]


def pieces(text: bytes, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """(start, end) of parts of about `size` bytes that end at ASCII white space or at the text's end."""
    at, n = 0, len(text)
    while n - at > size:
        cut = max(text.rfind(c, at, at + size) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            ends = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := text.find(c, at + size)) >= 0]
            if not ends:
                break
            cut = min(ends)
        yield at, cut + 1
        at = cut + 1
    yield at, n


def spans(data: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of bytes outside `space`."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~space[data]
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=sums[1:])
    out = (sums[ends] - sums[starts]) * powers(inverse(base), len(data) + 1)[starts]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def prefix_sums(words: np.ndarray, base: np.uint64) -> np.ndarray:
    """sums[j] - sums[i], times base ** -i, is the hash of the sequence words[i:j]."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(base, len(words)), out=sums[1:])
    return sums


def sequence_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    return (sums[ends] - sums[starts]) * powers(inverse(base), len(sums))[starts]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_slices(lengths: list[int], size: int = PIECE) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of rows of about `size` bytes together."""
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield first, i
            first, total = i, 0
        total += n
    if lengths:
        yield first, len(lengths)
