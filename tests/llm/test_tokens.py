import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sightline.llm import bpe, parts as P, token_files as F

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, tokens string"


@pytest.fixture(scope="module")
def made():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ours():
    return bpe.Coder(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


BITS = ["it's", "ab", " ", "  ", "\n", "é", "don't", " x", "9", "!", ",", ".\n", "'s", "\u3000", "×", "÷y", " à", "\x1c", "\u00a0", "\0"]


def test_safe_parts_keep_the_ids(made):
    R = random.Random(1)
    for _ in range(3000):
        text = "".join(R.choice(BITS) for _ in range(80))
        parts = P.safe_parts(text.encode())
        assert b"".join(parts) == text.encode()
        assert [i for p in parts for i in made.encode(p.decode(), add_special_tokens=False).ids] == made.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [0, 3000, 10**6])
def test_memory_is_bounded_and_does_not_change_the_ids(made, limit):
    R = random.Random(6)
    ours = F.Encoder(JSON)
    ours.memory = P.Memory(ours.parts, limit)
    for _ in range(300):
        texts = ["".join(R.choice([*BITS, "<|endoftext|>"] if R.random() < 0.1 else BITS + ["".join(R.choice("abcé") for _ in range(R.randint(1, 50)))]) for _ in range(R.randint(0, 30))) for _ in range(3)]
        ids, counts = ours.texts([t.encode() for t in texts])
        want = [made.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
        assert ours.memory.size <= limit


@pytest.mark.parametrize("limit", [0, 3000, 20_000, 10**6])
def test_packed_memory_is_bounded_and_does_not_change_the_ids(made, limit):
    R = random.Random(8)
    ours = F.Encoder(JSON)
    ours.memory = P.PackedMemory(ours.coded, limit)
    for _ in range(300):
        texts = ["".join(R.choice([*BITS, "\0\0", " a\0", "<|endoftext|>"] if R.random() < 0.1 else BITS + ["".join(R.choice("abcé") for _ in range(R.randint(1, 50)))]) for _ in range(R.randint(0, 30))) for _ in range(3)]
        ids, counts = ours.texts([t.encode() for t in texts])
        want = [made.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
        assert 64 * ours.memory.rows <= limit and ours.memory.starts[ours.memory.rows] <= limit // 16


def test_known_parts_are_not_encoded_again(made):
    """A part that was met is found in the memory, also after parts that were met once were forgotten."""
    ours, seen = F.Encoder(JSON), []
    ours.memory = P.PackedMemory(lambda parts: (seen.extend(parts), ours.coded(parts))[1], 100_000)
    often = [f" w{chr(97 + i)}x".encode() for i in range(26)]
    for k in range(200):
        words = [*often, *(f" once{chr(97 + i)}{''.join(chr(97 + int(d)) for d in str(k))}".encode() for i in range(20))]
        ids, _ = ours.texts([b"".join(words)])
        assert ids.tolist() == made.encode(b"".join(words).decode(), add_special_tokens=False).ids
    assert all(seen.count(w) == 1 for w in often[1:]) and len(seen) > 4000 > ours.memory.rows


def test_parts_of_one_key_stay_apart(made, monkeypatch):
    monkeypatch.setattr(P, "key_of", lambda low, high, size: low & np.uint64(0xFFFF))
    ours = F.Encoder(JSON)
    for text in ["one two three tune two", "ones tomb three two", "one two"] * 2:
        assert ours.texts([text.encode()])[0].tolist() == made.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_read_as_the_library_reads_them(made):
    ours = F.Encoder(JSON)
    for text in ["abc <|endoftext|> def", "<|endoftext|>", "x<|endoftext|>\n\nThe end. <|endoftext|>"]:
        assert ours.texts([text.encode()])[0].tolist() == made.encode(text, add_special_tokens=False).ids
    assert 50256 in made.encode("abc <|endoftext|> def", add_special_tokens=False).ids


def test_null_and_repeated_ids(spark, made, tmp_path):
    path = f"file://{tmp_path}/tokens"
    rows = [(None, "no id"), (3, "one"), (3, "another text"), (3, "one"), (2, None), (None, None)]
    F.write_tokens(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), path, JSON)
    got = sorted((r.start, str(r.doc_id), r.n_tokens) for r in F.read_checksums(spark, path).collect())
    ids = lambda t: len(made.encode(t or "", add_special_tokens=False).ids) + 1
    assert sorted((d, n) for _, d, n in got) == sorted((str(d), ids(t)) for d, t in rows)
    assert [d for _, d, _ in got] == ["None", "None", "2", "3", "3", "3"]
    assert [s for s, _, _ in got] == [sum(n for _, _, n in got[:k]) for k in range(6)]


def expected(made, rows):
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = made.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_files_round_trip(spark, made, tmp_path, encoding):
    R = random.Random(2)
    rows = [(i * 7 % 101, " ".join(R.choice(["the", "of", "Zug", "été", "42"]) for _ in range(R.randint(0, 50)))) for i in range(101)] + [(-5, None), (500, ""), (501, "long text " * 100_000)]
    path = f"file://{tmp_path}/tokens"
    F.write_tokens(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), path, JSON, encoding=encoding)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in F.read_checksums(spark, path).collect())
    assert got == expected(made, rows)
    whole = {r.doc_id: (r.start, r.tokens) for r in F.read_tokens(spark, path).collect()}
    assert {d: (s, n) for d, s, n, _ in got} == {d: (v[0], len(v[1])) for d, v in whole.items()}
    assert whole[501][1] == made.encode("long text " * 100_000, add_special_tokens=False).ids + [0]
    plan = F.read_tokens(spark, path).select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "tokens#" not in plan.replace("n_tokens#", "")


def test_file_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    R = random.Random(7)
    rows = [(i, " ".join(R.choice(["some", "words", "und", "mehr", "été", "of", "them"]) for _ in range(300)), "x") for i in range(2400)]
    F.write_tokens(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/tokens", JSON, row_group_bytes=64 << 10, page_bytes=8 << 10)
    file = next(p for p in (tmp_path / "tokens").iterdir() if p.suffix == ".parquet")
    meta = pq.ParquetFile(file).metadata
    column = next(meta.row_group(0).column(k) for k in range(meta.num_columns) if "tokens.list" in meta.row_group(0).column(k).path_in_schema)
    assert meta.num_row_groups > 1 and "DELTA_BINARY_PACKED" in column.encodings and column.has_offset_index


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    F.write_tokens(spark.createDataFrame([], SCHEMA), path, JSON)
    assert F.read_checksums(spark, path).count() == 0


def test_bpe_equals_the_public_library(ours, theirs):
    R = random.Random(3)
    alphabet = "abABstllve019 '\t\n\r\x0b\x1c\x85\xa0 ñéß中文\U0001f600!?|<>"
    for _ in range(3000):
        text = "".join(R.choice(alphabet) for _ in range(R.randint(0, 60)))
        ids = ours.encode(text)
        assert ids == theirs.encode_ordinary(text) and ours.decode(ids) == text.encode()


def test_very_long_pretokens(ours, theirs):
    R = random.Random(4)
    for text in ["a" * 30_000, "ab" * 20_000, "".join(R.choice("aeistrn") for _ in range(30_000))]:
        assert ours.encode(text) == theirs.encode_ordinary(text)


def test_queue_order():
    queue = bpe.RankQueue(70_000)
    R = random.Random(5)
    items = [(R.randrange(70_000), i) for i in range(2000)] + [(5, 9999), (5, 3)]
    for rank, at in items:
        queue.push(rank, [at])
    out = []
    while (rank := queue.first()) >= 0:
        out += [(rank, at) for at in reversed(queue.take(rank))]
    assert out == sorted(items)


def test_encode_and_decode_frames(spark, theirs):
    rows = [(1, "The cat's 3 hats"), (1, "The cat's 3 hats"), (None, "x"), (2, None), (3, ""), (4, "word " * 9000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    want = sorted((str(d), len(i := theirs.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded.collect()) == want
    back = bpe.decode(coded, RANKS, public_tokenizers.PATTERN)
    assert sorted((str(r.doc_id), bytes(r.data).decode()) for r in back.collect()) == sorted((str(d), t or "") for d, t in rows)
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_queries_match_the_public_libraries(spark, sf, made, theirs):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in F.op2_token_files(spark, sf).collect()) == expected(made, rows)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op10_byte_level_bpe(spark, sf).collect()}
    for d, t in rows:
        ids = theirs.encode_ordinary(t)
        assert got[d] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
