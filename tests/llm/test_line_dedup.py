import random

import numpy as np
import pytest

from sightline.llm import kernels as K
from sightline.llm import line_dedup as L

SCHEMA = "doc_id long, text string, n_lines string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(line):
    return [w for w in line.translate({k: " " for k in (9, 11, 12, 13)}).split(" ") if w]


def brute(docs, least=5, most=1):
    lines = [(d, k, words(x)) for d, t in docs if t is not None and d is not None for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    near = lambda v, w: v == w or (min(len(v), len(w)) >= least and abs(len(v) - len(w)) <= most and distance(v, w) <= most)
    gone = {(d, k) for d, k, w in lines if any((e, j) < (d, k) and near(v, w) for e, j, v in lines)}
    return [(d, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)) for d, t in docs]


def run(spark, docs, **bounds):
    return [(r.doc_id, r.text) for r in L.dedup_lines(spark.createDataFrame([(d, t, "clash") for d, t in docs], SCHEMA), **bounds).collect()]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_matches_brute_force(spark, most):
    R = random.Random(1)
    vocabulary = ["w%d" % i for i in range(12)]
    bases = [[R.choice(vocabulary) for _ in range(R.randint(1, 9))] for _ in range(25)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(R.randint(0, 6)):
            line = list(R.choice(bases))
            for _ in range(R.randint(0, 2)):
                at = R.randrange(len(line) + 1)
                line[at : at + R.randint(0, 1)] = [R.choice(vocabulary)] if R.random() < 0.6 else []
            lines.append(R.choice([" ", "  ", "\t"]).join(line))
        docs.append((i, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "one two three four five")]
    assert sorted(run(spark, docs, max_edits=most), key=str) == sorted(brute(docs, most=most), key=str)


def test_short_lines_go_when_they_repeat(spark):
    docs = [(1, "Subscribe now\nAll rights reserved"), (2, "All  rights reserved\nSubscribe\n\nSubscribe now"), (3, "Subscribe later")]
    assert sorted(run(spark, docs)) == [(1, "Subscribe now\nAll rights reserved"), (2, "Subscribe\n"), (3, "Subscribe later")]


def test_templates_runs_and_repeats(spark):
    docs = [(i, f"the page number {i} of the long report\n" + "a " * 7 + f"\nown line of document {i} with word{i} more{i}") for i in range(40)]
    docs += [(7, docs[7][1]), (None, "the page number 1 of the long report")]
    assert sorted(run(spark, docs), key=str) == sorted(brute(docs), key=str)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_within_one():
    R = random.Random(2)
    for _ in range(3000):
        a = [R.choice("xy") for _ in range(R.randint(0, 6))]
        b = [R.choice("xy") for _ in range(R.randint(0, 6))]
        assert L.within_one(a, b) == (distance(a, b) <= 1)
        assert all(L.within(a, b, n) == (distance(a, b) <= n) for n in range(5))


def test_long_texts_are_cut_at_newlines():
    text = "\n".join(f"line number {i} of a text" for i in range(5000)).encode()
    whole = L.Lines(text).hash
    parts = list(L.line_blocks([text, b"", b"x"], 1000))
    assert len(parts) > 50
    assert np.array_equal(np.concatenate([L.Lines(raw).hash for raw, _ in parts])[: len(whole)], whole)
    assert sum(m[2] for _, meta in parts for m in meta) == 5002


def test_pieces_cover_the_text():
    text = b"word " * 1000 + b"x" * 5000 + b" end"
    cuts = list(K.pieces(text, 64))
    assert b"".join(text[a:b] for a, b in cuts) == text and all(b - a <= 64 or b"x" * 64 in text[a:b] for a, b in cuts)


def test_query_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    # Brute force by lines with equal word counts or one off, sharing a first or last word sequence, would repeat the
    # method; so all lines are compared, fast, by common ends.
    lines = [(d, k, words(x)) for d, t in docs for k, x in enumerate((t or "").split("\n"))]
    lines = sorted((x for x in lines if x[2]), key=lambda x: x[:2])
    by_size, gone = {}, set()
    for d, k, w in lines:
        if w in by_size.get(len(w), []) or len(w) >= 5 and any(L.within_one(v, w) for n in (len(w) - 1, len(w), len(w) + 1) if n >= 5 for v in by_size.get(n, [])):
            gone.add((d, k))
        by_size.setdefault(len(w), []).append(w)
    want = {d: "\n".join(x for k, x in enumerate((t or "").split("\n")) if (d, k) not in gone) for d, t in docs}
    assert {r.doc_id: r.text for r in L.op3_line_dedup(spark, sf).collect()} == want


def test_lines_of_one_word_many_times(spark):
    """Their variants are all equal: rows in proportion, not pairs; what differs in one place among them is found."""
    import time

    began = time.time()
    n = 100_000
    got = run(spark, [(1, "ha " * n), (2, "ha " * (n + 1)), (3, "ha " * (n + 3)), (4, "ha " * 20 + "x " + "ha " * (n - 21)), (5, "ha " * 20 + "x y " + "ha " * (n - 22))])
    assert [i for i, t in got if t] == [1, 3] and time.time() - began < 90


@pytest.mark.parametrize("seed", range(3))
def test_repetitive_lines_match_brute_force(spark, seed):
    R = random.Random(seed)
    docs = [(i, "\n".join(" ".join(R.choice("aab") for _ in range(R.randint(4, 9))) for _ in range(3))) for i in range(60)]
    assert sorted(run(spark, docs)) == sorted(brute(docs))
