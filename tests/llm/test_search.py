"""Ranked search, clustering and token counts against plain versions."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sightline.llm import lexical as L, orchard as O, token_counts as T
from sightline.tables import Scratch

# Ranked lexical search

DOCS = "doc_id long, text string, term string, rank int"
ITEMS = "item_id long, text string, doc_id string"


def terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def brute_search(docs, items, depth=50):
    """All documents for each item, by the formula as stated."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:depth])]
    return out


def searched(spark, docs, items, depth=50, **how):
    scratch = Scratch(spark, "test-search")
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    blocks = L.build(frame, scratch.path())
    got = L.search(blocks, spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS), scratch, depth, **how)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()]


def key(rows):
    return sorted(rows, key=str)


def corpus(rng, n, words=60):
    vocabulary = [f"w{i}" for i in range(words)] + ["é", "Naïve", "ЯЗЫК", "1", "zz9"]
    pick = lambda: vocabulary[min(int(rng.expovariate(0.12)), len(vocabulary) - 1)]
    return [(i, rng.choice([" ", "\n", ", "]).join(pick() for _ in range(rng.choice([1, 3, 20, 80])))) for i in range(n)]


@pytest.mark.parametrize("cells,documents,opened", [(1 << 20, 1 << 13, 256), (40, 1 << 13, 3), (1 << 20, 5, 1)])
def test_search_equals_brute_force(spark, monkeypatch, cells, documents, opened):
    rng = random.Random(3)
    docs = corpus(rng, 300)
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # ties beyond the depth
    docs += [(None, docs[7][1]), (5, "W1 w1 W1"), (5, "W1 w1 W1"), (2000, None), (2001, ""), (2002, " .,!")]
    items = [(i, " ".join(rng.choice(docs)[1].split()[:12]) if i % 4 else rng.choice(docs)[1]) for i in range(25)] + [(100, None), (101, ""), (102, "unheard of"), (None, "w1 w2"), (7, "w3"), (7, "w3")]
    rng.shuffle(docs)
    items = [(i, t) for i, t in items if (i, t) != (None, None)]
    for name, value in (("CELLS", cells), ("DOCUMENTS", documents), ("OPENED", opened)):
        monkeypatch.setattr(L, name, value)
    assert key(searched(spark, docs, items)) == key(brute_search(docs, items))
    assert key(searched(spark, docs, items[:9], 3, chunk_bytes=60)) == key(brute_search(docs, items[:9], 3))


def test_search_of_many_terms_holds_little(spark, monkeypatch):
    """A query of very many terms goes over few documents at a time; one very long document is a block of its own."""
    rng = random.Random(4)
    docs = [(0, " ".join(f"t{i}" for i in range(5000)))] + [(i, " ".join(f"t{rng.randrange(5000)}" for _ in range(30))) for i in range(1, 200)]
    items = [(1, docs[0][1]), (2, docs[3][1])]
    monkeypatch.setattr(L, "HELD", 1 << 14)
    assert key(searched(spark, docs, items)) == key(brute_search(docs, items))


def test_a_block_is_a_row_group(spark, tmp_path):
    """Readers take a row group as a whole, so it must not hold all blocks of a task."""
    import pyarrow.parquet as pq

    docs = spark.range(0, 2 * L.DOCUMENTS + 5, 1, 1).selectExpr("id as doc_id", "concat('w', id % 7, ' all') as text")
    blocks = L.build(docs, f"file://{tmp_path}/blocks")
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "blocks").glob("*.parquet")]
    assert blocks.count() == 3 and [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)] == [1] * 3


def test_reading_a_block_holds_little():
    """Beside the block as stored and its quarters and impacts, about four bytes a cell."""
    import tracemalloc

    rng, block = random.Random(11), L.Builder()
    for i in range(2000):
        block.add(i, Counter({f"t{rng.randrange(20_000)}".encode(): 1 for _ in range(150)}), 100)
    batch = block.done()
    row = {name: (batch.column(k)[0].values if name == "terms" else batch.column(k)[0].as_py()) for k, name in enumerate(batch.schema.names)}
    tracemalloc.start()
    read = L.Block(row)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    cells = len(read.most)
    assert cells > 800_000 and held < 22 * cells and most < held + 14 * cells


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a b")], []) == []
    assert searched(spark, [(1, None), (2, "")], [(1, "a")]) == []


def test_best_first_leaves_ranges_unopened(monkeypatch):
    """Where a few documents stand out, most ranges are never opened, and the columns are right all the same."""
    monkeypatch.setattr(L, "OPENED", 4)
    block = L.Builder()
    rng = random.Random(5)
    for i in range(4000):
        block.add(i, Counter({b"rare": 3} if i in (17, 3003) else {f"w{rng.randrange(300)}".encode(): 1 for _ in range(20)}), 60)
    batch = block.done()
    read = L.Block({name: (batch.column(k)[0].values if name == "terms" else batch.column(k)[0].as_py()) for k, name in enumerate(batch.schema.names)})
    row = read.terms.to_pylist().index(b"rare")
    columns, scores, opened = read.best(np.array([row]), np.array([9000]), 2, 1)
    assert sorted(columns.tolist()) == [17, 3003] and opened < 60
    assert set(scores.tolist()) == {9000 * (10**9 * 3 // (3000 + 20 * 60))}


def test_scores_beyond_doubles_are_whole():
    """Sums of 2**53 or more are made in integers."""
    block = L.Builder()
    for i in range(3):
        block.add(i, Counter({b"a": 10**6 + i, b"b": 1}), 50)
    batch = block.done()
    read = L.Block({name: (batch.column(k)[0].values if name == "terms" else batch.column(k)[0].as_py()) for k, name in enumerate(batch.schema.names)})
    at, weight = read.terms.to_pylist(), 2**36 + 1
    columns, scores, _ = read.best(np.array([at.index(b"a"), at.index(b"b")]), np.array([weight, weight]), 3, 1)
    want = {i: weight * (10**9 * (10**6 + i) // (1000 * (10**6 + i) + 1000)) + weight * (10**9 // 2000) for i in range(3)}
    assert dict(zip(columns.tolist(), scores.tolist(), strict=True)) == want and min(want.values()) > 2**53


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in L.op11_ranked_search(spark, sf).collect()]
    assert key(got) == key(brute_search(docs, items))


# Orchard clustering

VECTORS = "vec_id long, embedding array<double>, cluster int"


def brute_clusters(rows, dims, k, rounds, scale=1024, seed="3"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    near = [(i, v) for i, v in kept if all(abs(x) < O.FAR for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in near if i is not None)[:k]
    centroids = [v for _, v in first]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min((square(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        mine = [[] for _ in centroids]
        for _, v in near:
            mine[place(v)[1]].append(v)
        centroids = [[math.floor(Fraction(sum(x), len(m))) for x in zip(*m, strict=True)] if m else c for m, c in zip(mine, centroids, strict=True)]
    out = [(i, *place(v)[::-1]) for i, v in near] if centroids else [(i, None, None) for i, _ in near]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d or 0
    said = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rest = [(i, None, None, None, None, None) for i, v in kept if (i, v) not in near]
    return key([(i, c, d, None if c is None else inertia[c], None if c is None else sum(inertia.values()), None if c is None else said[c]) for i, c, d in out] + rest)


def clustered(spark, rows, *how):
    got = O.cluster(spark.createDataFrame([(i, v, 9) for i, v in rows], VECTORS), *how)
    return key([(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect()])


def test_clusters_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(rng.choice([-1, 0, 1]), 0.2) for _ in range(4)]) for i in range(200)]
    rows += [(500 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(90)] + [(3, rows[3][1]), (None, [0.1] * 4), (None, [0.1] * 4)]
    rows += [(600, [1.0] * 3), (601, None), (602, [1.0, None, 1.0, 1.0]), (603, [1.0, math.nan, 1.0, 1.0]), (604, [1.0, math.inf, 1.0, 1.0]), (605, []), (606, [1e9, 0.0, 0.0, 0.0]), (607, [-131072.0, 0.0, 0.0, 0.0])]
    for k, rounds in ((1, 3), (5, 10), (12, 4)):
        assert clustered(spark, rows, 4, k, rounds) == brute_clusters(rows, 4, k, rounds)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [4.0, 1.0])]
    assert clustered(spark, rows, 2, 8, 10) == brute_clusters(rows, 2, 8, 10)
    assert clustered(spark, [], 2, 8, 10) == [] and clustered(spark, [(None, [1.0, 2.0])], 2, 8, 10) == [(None, None, None, None, None, None)]


def test_orchard_finds_the_nearest_with_ties():
    rng = np.random.default_rng(7)
    for _ in range(60):
        k = int(rng.integers(1, 40))
        centroids = rng.integers(-6, 7, (k, 3))
        vectors = np.concatenate([rng.integers(-6, 7, (300, 3)), centroids])
        search = O.Search(centroids)
        at, distance = search.nearest(vectors)
        every = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
        assert (at == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()  # argmin: the smaller number
    far = np.array([[O.FAR - 1] * 64, [-O.FAR] * 64])
    at, distance = O.Search(far).nearest(far[::-1].copy())
    assert at.tolist() == [1, 0] and distance.tolist() == [0, 0]
    assert O.Search(far[:1]).nearest(far[1:])[1].tolist() == [64 * (2 * O.FAR - 1) ** 2]


def test_orchard_measures_less_than_all():
    rng = np.random.default_rng(8)
    centroids = rng.integers(-10**6, 10**6, (200, 2))
    vectors = centroids[rng.integers(0, 200, 5000)] + rng.integers(-2000, 2000, (5000, 2))
    search = O.Search(centroids)
    search.nearest(vectors)
    assert search.measured < 0.5 * 5000 * 200


# Token counts

COUNTS = "doc_id long, text string, n_tokens string"
BITS = [" ", "  ", "▁", " ▁", "▁ ", "\n", " a", "a", "the", "é", "\0", " \0", "\0 ", "x ", "　", "<s>", "</s>", "<0x41>", "12", "\t", "🙂", "’", "▁▁", "<|endoftext|>"]


def whole(path):
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        made = SentencePieceProcessor(model_file=path)
        return lambda text: len(made.encode(text))
    made = Tokenizer.from_file(path)
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_equal_the_library(name, monkeypatch):
    path, rng = public_tokenizers.path(name), random.Random(11)
    ours, theirs = T.Counter(path), whole(path)
    for batch, memory in ((T.BATCH, T.MEMORY), (40, 4000)):
        monkeypatch.setattr(T, "BATCH", batch)
        monkeypatch.setattr(T, "MEMORY", memory)
        for _ in range(300):
            texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(5)]
            assert ours.of([t.encode() for t in texts]) == [theirs(t) for t in texts]
            assert ours.size <= T.MEMORY


def test_long_texts_and_edges(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = {1: None, 2: "", 3: " ", 4: "word " * 400_000, 5: "x" * 30_000, 6: "▁" * 3000 + " a", 7: "a b", 8: "a" + " " * 5000 + "b "}
    rows = [(i, t, "x") for i, t in texts.items()] + [(7, "a b", "y"), (None, "c", "z")]
    got = T.count_tokens(spark.createDataFrame(rows, COUNTS), path)
    count = whole(path)
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 4096) for i, t, _ in rows]
    assert key(tuple(r) for r in got.collect()) == key(want)
    assert T.count_tokens(spark.createDataFrame([], COUNTS), path).count() == 0


def test_pieces_are_the_text_and_break_only_at_spaces():
    rng = random.Random(12)
    for _ in range(300):
        text = ("".join(rng.choice(BITS) for _ in range(200))).encode()
        parts = T.pieces(b" " + text, T.space_cuts, 30)
        assert b"".join(parts) == b" " + text and all(p.startswith(b" ") for p in parts)


def test_counts_of_the_query(spark, sf):
    count = whole(public_tokenizers.path("piece_bpe_32k.model"))
    want = {r.doc_id: (len((r.text or "").encode()), count(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = T.op13_token_counts(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and all(r.over_limit == (r.n_tokens > 4096) for r in got) and len(got) == len(want)
