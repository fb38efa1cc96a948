import hashlib

import corpus_pipeline as P
import public_tokenizers

from sightline.llm import bpe, quality_model as Q
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_line_dedup import words
from tests.llm.test_quality_model import plain
from tests.llm.test_simhash import true_components
from sightline.llm.line_dedup import within_one


def stages(spark, docs, sf):
    out = [docs]
    for _, f in P.STAGES:
        out.append(f(spark, out[-1], sf).cache())
    return out


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def test_every_stage_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = stages(spark, docs, sf)
    assert all(s.columns == P.COLUMNS for s in steps[1:-1])
    scored = Q.score(docs, Q.fit(docs)).where("kept")
    assert sorted(pairs(steps[1])) == sorted((r.doc_id, r.text) for r in scored.collect())
    seen, want = [], []
    for d, t in sorted(pairs(steps[1])):
        left = []
        for x in t.split("\n"):
            w = words(x)
            if not w or not any(v == w or min(len(v), len(w)) >= 5 and within_one(v, w) for v in seen):
                left.append(x)
            if w:  # a line that goes is as much an earlier line as one that stays
                seen.append(w)
        if len(left) == len(t.split("\n")) or words(" ".join(left)):
            want.append((d, "\n".join(left)))
    assert sorted(pairs(steps[2])) == want
    # The least of each component of all pairs by their shingles stays; what is near 0.8 may not meet, but nothing goes below it.
    before, left = sorted(pairs(steps[2])), {d for d, _ in pairs(steps[3])}
    part, _ = true_components([t for _, t in before])
    true_first = {before[k][0] for k, c in enumerate(part) if c == k}
    assert true_first <= left and len(left - true_first) <= 0.01 * len(before)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, _ in leaks(pairs(steps[3]), bench)}
    assert sorted(pairs(steps[4])) == sorted((d, t) for d, t in pairs(steps[3]) if d not in bad)
    coder = bpe.coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r, (d, t) in zip(sorted(steps[5].collect()), sorted(pairs(steps[4])), strict=True):
        assert (r.doc_id, r.n_tokens, r.decoded_sha256) == (d, len(coder.encode(t)), hashlib.sha256(t.encode()).hexdigest())


def test_nulls_repeats_and_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = plain(1)
    rows = [(10**6, None, None, None, None), (10**6, None, None, None, None), (10**6 + 1, "", None, None, None), (None, text, "en", "s", 0), (10**6 + 2, text, "en", "s", len(text)), (10**6 + 2, text, "en", "s", len(text))]
    odd = spark.createDataFrame([(*r, "clash", "clash") for r in rows], docs.schema.add("n_lines", "string").add("score", "string"))
    steps = stages(spark, odd, sf)
    assert all(s.columns == P.COLUMNS for s in steps[1:-1])
    kept = {(r.doc_id, r.text) for r in steps[1].collect()}
    # Without votes of both kinds the classifier keeps all; repeats and the row without an id lose no lines to each other.
    assert kept == {(r[0], r[1]) for r in rows} and steps[1].count() == len(rows)
    assert sorted(pairs(steps[2]), key=str) == sorted([(r[0], r[1]) for r in rows], key=str)
    # Null and empty texts are copies of each other; of the equal texts the row with an id stays, once.
    assert sorted(pairs(steps[3])) == [(10**6, None), (10**6 + 2, text)] and sorted(pairs(steps[4])) == sorted(pairs(steps[3]))
    assert sorted((r.doc_id, r.n_tokens > 0) for r in steps[5].collect()) == [(10**6, False), (10**6 + 2, True)]
    none = stages(spark, odd.limit(0), sf)
    assert all(s.count() == 0 for s in none) and all(s.columns == P.COLUMNS for s in none[1:-1])
