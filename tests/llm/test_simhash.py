import random

import numpy as np
import pytest
import xxhash

from sightline.llm import simhash as S
from sightline.tables import Scratch

SCHEMA = "doc_id long, text string, extra string"


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_pieces_do_not_change_the_fingerprint(monkeypatch):
    R = random.Random(3)
    text = " ".join("".join(R.choice("abcXYZé") for _ in range(R.randint(1, 9))) + R.choice(["", "\n", "\t "]) for _ in range(3000))
    want = brute_fingerprint(text)
    assert S.fingerprint(text.encode()) == want
    monkeypatch.setattr(S, "pieces", lambda t: __import__("sightline.llm.kernels", fromlist=["pieces"]).pieces(t, 100))
    assert S.fingerprint(text.encode()) == want


def test_edge_fingerprints():
    for text in ["", " \n\t", "one", "one two", "One  two\nTHREE", "a b c a b c"]:
        assert S.fingerprint(text.encode()) == brute_fingerprint(text)


def test_anchors_meet():
    """Any two fingerprints within 3 bits share the home anchor of one of them."""
    R = np.random.default_rng(1)
    a = R.integers(0, 1 << 63, 3000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in R.choice(64, R.integers(0, 4), replace=False)) for _ in a], dtype=np.uint64)
    b = a ^ flips
    homes, every = {}, {}
    for out, fps, kinds in ((homes, a, (True,)), (every, b, (True, False))):
        for kind in kinds:
            for i, x in zip(*S.anchors(fps[:, None], kind)):
                out.setdefault(int(i), set()).add(int(x))
    assert all(homes[i] & every[i] for i in range(len(a)))
    assert all(len(x) <= 34 for x in every.values())


def test_components_match_brute_force(spark):
    R = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    texts = {}
    for i in range(120):
        base = [R.choice(words) for _ in range(300)]
        for k in range(R.randint(1, 5)):
            copy = list(base)
            for _ in range(k):
                copy[R.randrange(300)] = R.choice(words)
            texts[len(texts)] = " ".join(copy)
    texts |= {5000: None, 5001: "", 5002: "x y"}
    rows = [(i, t, "e") for i, t in texts.items()]
    got = {r.doc_id: (r.fp, r.component_id) for r in S.components(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: int.from_bytes(v[0], "little") for i, v in got.items()} == fps
    assert {i: v[1] for i, v in got.items()} == brute_components(fps)


def test_dense_blocks_match_brute_force(spark):
    """Thousands of fingerprints around one centre, in small blocks: same components as all pairs."""
    R = np.random.default_rng(2)
    centre = int(R.integers(0, 1 << 62))
    fps = sorted({centre ^ sum(1 << int(b) for b in R.choice(64, R.integers(0, 9), replace=False)) for _ in range(700)})
    prints = spark.createDataFrame([(i, x.to_bytes(8, "little")) for i, x in enumerate(fps)], "id long, fp binary")
    for block in (32, 4096):
        pairs = [(fps[r.u], fps[r.v]) for r in S.links(prints, Scratch(spark, "test"), block=block).collect()]
        assert all((a ^ b).bit_count() <= 64 for a, b in pairs)
        up = {x: x for x in fps}

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in pairs:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        assert {x: find(x) for x in fps} == brute_components({x: x for x in fps})


def test_empty_table_and_repeats(spark):
    assert S.components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a b c d", "x"), (0, "q r s t", "x")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in S.components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(False, 0, 0), (False, 1, 1), (False, 1, 1), (True, 0, 1)]


def test_query_matches_brute_force(spark, sf):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op9_simhash(spark, sf).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}




def jaccard(a, b):
    cut = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b)


def family(R, base, count, least, most):
    """Copies of a text with some words replaced."""
    words = base.split(" ")
    out = []
    for _ in range(count):
        copy = list(words)
        for _ in range(R.randint(least, most)):
            copy[R.randrange(len(copy))] = f"x{R.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def true_components(texts, similarity=0.8):
    """Components by the similarity of all pairs."""
    sets = [{tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and both / (len(a) + len(sets[j]) - both) >= similarity:
                a_, b_ = find(i), find(j)
                up[max(a_, b_)] = min(a_, b_)
    return [find(i) for i in range(len(texts))], sets


def test_similar_documents_link(spark):
    """Pairs by similarity: at least 95 in 100 link from 0.8 on, none below; and one row of each group stays."""
    R = random.Random(8)
    words = ["w%d" % i for i in range(3000)]
    texts, pairs = [], []
    for i in range(1000):
        base = [R.choice(words) for _ in range(R.randint(60, 400))]
        copy = list(base)
        if i % 2:
            for _ in range(R.randint(1, max(1, len(base) // 40))):
                copy[R.randrange(len(base))] = R.choice(words)
        else:
            copy += [R.choice(words) for _ in range(int(len(base) * (0.1 + R.random() * 0.3)))]
        pairs.append((len(texts), len(texts) + 1, jaccard(" ".join(base), " ".join(copy))))
        texts += [" ".join(base), " ".join(copy)]
    rows = [(i, t, "e") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    part = {r.doc_id: r.component for r in S.components(docs, S.SIMILAR, 0.8).collect()}
    linked = lambda low, high: [part[a] == part[b] for a, b, s in pairs if low <= s < high]
    close, edge, far = linked(0.85, 1.01), linked(0.8, 0.85), linked(0, 0.8)
    assert len(close) > 200 and np.mean(close) >= 0.99
    assert len(edge) > 150 and np.mean(edge) >= 0.95
    assert len(far) > 150 and not any(far)
    left = {r.doc_id for r in S.first_of_each(docs).collect()}
    assert left == {min(i for i in part if part[i] == c) for c in set(part.values())}


@pytest.mark.parametrize("rounds,block,salt", [(3, 1024, 4096), (0, 1024, 4096), (0, 16, 7), (1, 16, 7)])
def test_families_of_near_copies_equal_all_pairs(spark, rounds, block, salt):
    """Families whose members are near 0.8 to each other: leaders, gatherings and both find what all pairs find.

    Candidates are all pairs that share a shingle, so that nothing is left to whether fingerprints meet.
    """
    R = random.Random(9)
    words = ["w%d" % i for i in range(3000)]
    texts = []
    for k in range(5):
        base = " ".join(R.choice(words) for _ in range(200))
        texts += family(R, base, [2, 25, 60, 40, 30][k], 1, [2, 4, 3, 6, 9][k])
    want, sets = true_components(texts)
    assert 10 < len(set(want)) < len(texts) - 40
    scratch, kind = Scratch(spark, "test-verified"), S.Kind(18, 5, 400)
    prints = spark.createDataFrame([(i, S.wide_fingerprint(t.encode(), kind)) for i, t in enumerate(texts)], "id long, fp binary")
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    ends = np.cumsum([2, 25, 60, 40, 30])
    candidates = spark.createDataFrame([(i, int(np.searchsorted(ends, i, "right"))) for i in range(len(texts))], "node long, component long")
    got = {r.node: r.component for r in S.verified(prints, candidates, scratch.keep(S.shingle_sets(frame, 5)), scratch, kind, 0.8, rounds, block, salt).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want


def test_near_copies_of_the_given_documents(spark, sf):
    """Against all pairs of the given table: no link below 0.8, and nearly all from there on."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = list(texts)
    want, _ = true_components(list(texts.values()))
    part = {r.doc_id: r.component for r in S.components(docs, S.SIMILAR, 0.8).collect()}
    mine = {frozenset(i for i in ids if part[i] == c) for c in set(part.values())}
    true = {frozenset(ids[k] for k, c in enumerate(want) if c == d) for d in set(want)}
    assert all(any(g <= t for t in true) for g in mine)
    assert len(mine - true) <= 0.02 * len(true)


def test_rows_that_share_an_id_stay_apart(spark):
    rows = [(1, "a b c d", "y"), (1, "a b c d", "x"), (1, "quite another text that is long", "x"), (2, "A b c d", "x"), (None, "a b c d", "x"), (None, "alone", "x"), (3, None, "x"), (4, "", "x")]
    got = sorted((str(r.doc_id), r.text, r.extra) for r in S.first_of_each(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", "a b c d", "x"), ("1", "quite another text that is long", "x"), ("3", None, "x"), ("None", "alone", "x")]
