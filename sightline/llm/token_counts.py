"""Token counts: batch encoding in Arrow functions that return lengths only.

`count_tokens` takes the library that a vocabulary file is for: sentencepiece for .model, tokenizers for .json. Batches
are balanced by bytes, not rows. Texts, long ones above all, are split at safe boundaries, at which no token can run
across; a worker encodes each different part once and remembers its length, within a bound in bytes. Nothing but counts
leaves the worker.

A piece model's text may be split before a space that follows something else, if none of its pieces has the space mark
behind another character and its normaliser leaves texts alone but for the mark it puts in front: a part's own space is
then the mark that the library puts before each part. A byte-level .json is split as in `parts`; texts that hold an
added token's string, and those of any other kind of file, are encoded whole.

Nulls: a null text counts as an empty one (no bytes, no tokens); ids pass through, null or repeated, a row for each
document. Very long texts are encoded in pieces of about a megabyte wherever a safe boundary allows. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightline.llm.kernels import byte_slices, text_slices
from sightline.llm.parts import cuts, different
from sightline.llm.token_files import Encoder
from sightline.tables import bounded_batches, table

#: Bytes of text that are encoded together.
BATCH = 2 << 20
#: Bytes of remembered parts in a worker, what an entry takes besides its part, and the longest part that is remembered.
MEMORY, ENTRY, SHORT = 96 << 20, 170, 64
#: Fixed value: the character that stands for a space in pieces.
MARK = "▁"
LIMIT = 4096


def space_cuts(a: np.ndarray) -> np.ndarray:
    """Places of spaces that follow neither a space nor a mark, and are not the last byte of a text."""
    at = np.flatnonzero(a[1:-1] == 32) + 1 if len(a) > 2 else np.zeros(0, np.int64)
    before = a[at - 1]
    mark = (before == 0x81) & (a[at - 2] == 0x96) & (a[np.maximum(at - 3, 0)] == 0xE2)
    return at[(before != 32) & ~mark & (a[at + 1] != 0)]


def pieces(text: bytes, cut, size: int) -> list[bytes]:
    """Runs of about `size` bytes that end where the text may be cut."""
    if len(text) <= size:
        return [text]
    at = np.append(cut(np.frombuffer(text, np.uint8)), len(text))
    out, start = [], 0
    while start < len(text):
        k = np.searchsorted(at, start + size, "right") - 1
        end = int(at[k]) if k >= 0 and at[k] > start else int(at[np.searchsorted(at, start, "right")])
        out.append(text[start:end])
        start = end
    return out


class Counter:
    """Lengths of texts in tokens of one vocabulary file."""

    def __init__(self, path: str):
        self.lead, self.cut, self.whole = b"", None, lambda _: False
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

            self.made = SentencePieceProcessor(model_file=path)
            model = sentencepiece_model_pb2.ModelProto()
            model.ParseFromString(self.made.serialized_model_proto())
            how, kinds = model.normalizer_spec, type(model).SentencePiece
            plain = how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces and not how.precompiled_charsmap and not model.trainer_spec.treat_whitespace_as_suffix and not model.denormalizer_spec.precompiled_charsmap
            if plain and not any(p.type == kinds.USER_DEFINED or MARK in p.piece.lstrip(MARK) for p in model.pieces):
                self.lead, self.cut = b" ", space_cuts
            self.count = self.of_pieces
        else:
            self.made = Encoder(path).made
            with open(path, encoding="utf-8") as file:
                shape = json.load(file)
            if not shape.get("normalizer") and (shape.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not shape["pre_tokenizer"].get("add_prefix_space"):
                added = [t.content.encode() for t in self.made.get_added_tokens_decoder().values()]
                self.cut, self.whole = cuts, lambda text: any(t in text for t in added)
            self.count = self.of_tokens
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.size = 0

    def of_pieces(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.made.encode(texts, num_threads=1)]

    def of_tokens(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.made.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, parts: list[bytes]) -> list[int]:
        """Lengths of parts; what stands for the leading mark is taken off."""
        out, skip = [], len(self.lead)
        for a, b in byte_slices(list(map(len, parts)), BATCH):
            for i in range(a, b, 4096):
                out += self.count([p[skip:].decode() for p in parts[i : min(b, i + 4096)]])
        return out

    def lengths(self, parts: list[bytes]) -> list[int]:
        """Lengths of different parts: two generations are remembered, what was not met in one is forgotten in the next."""
        found = list(map(self.young.get, parts))
        missed = [p for p, n in zip(parts, found, strict=True) if n is None]
        if not missed:
            return found
        older = list(map(self.old.get, missed)) if self.old else [None] * len(missed)
        new = iter(self.encoded([p for p, n in zip(missed, older, strict=True) if n is None]))
        older = [next(new) if n is None else n for n in older]
        kept = {p: n for p, n in zip(missed, older, strict=True) if len(p) <= SHORT}
        size = sum(map(len, kept)) + ENTRY * len(kept)
        if self.size + size > MEMORY // 2:
            self.old, self.young, self.size = self.young, {}, 0
        if size <= MEMORY // 2:
            self.young |= kept
            self.size += size
        rest = iter(older)
        return [next(rest) if n is None else n for n in found]

    def of(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text."""
        if self.cut is None:
            return self.encoded(texts)
        split = [[t] if self.whole(t) else pieces(self.lead + t, self.cut, BATCH) if t else [] for t in texts]
        rows, owner = [p for s in split for p in s], np.repeat(np.arange(len(texts)), list(map(len, split)))
        out = np.zeros(len(texts), np.int64)
        for a, b in byte_slices(list(map(len, rows)), BATCH):
            parts, which, row = different(rows[a:b], self.cut, self.whole)
            if parts:
                np.add.at(out, owner[a:b], np.bincount(row, np.array(self.lengths(parts))[which], b - a).astype(np.int64))
        return out.tolist()


_counters: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    if path not in _counters:
        _counters.clear()  # one vocabulary at a time
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit) of docs (doc_id, text); over_limit: more than `limit` tokens."""
    bounded_batches(docs.sparkSession)

    def run(stream):
        made = counter_of(path)
        for batch in stream:
            for rows, texts in text_slices(batch, 1, BATCH):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(*rows), pa.array(map(len, texts), pa.int64()), pa.array(made.of(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op13_token_counts": op13_token_counts}
ORACLES: dict[str, str] = {}
