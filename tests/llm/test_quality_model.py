import numpy as np

from sightline.llm import quality_model as Q


def test_expectation_maximisation_recovers_accuracies():
    R = np.random.default_rng(4)
    truth = R.random(20_000) < 0.7
    accuracy = [0.95, 0.8, 0.7, 0.9]
    votes = np.stack([np.where(R.random(len(truth)) < 0.3, 0, np.where(R.random(len(truth)) < a, 1, -1) * np.where(truth, 1, -1)) for a in accuracy], axis=1)
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    found = Q.expectation_maximisation(rows, counts.astype(float))
    assert abs(found.good - 0.7) < 0.03
    assert np.abs(found.accuracies() - accuracy).max() < 0.03


def test_patterns_round_trip():
    stats = Q.Reading(b"word " * 60).stats
    pattern = Q.vote(stats)
    assert [f(stats) for f in Q.LABELLERS.values()] == Q.votes_of(np.array([pattern]))[0].tolist()


def test_held_out_accuracy(spark):
    """Labels are never used in training, so all of them are held out."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.kept for r in Q.op6_quality_classifier(spark, sf).collect()}
    gold = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    good = [got[d] for d, q in gold.items() if q == 1]
    bad = [got[d] for d, q in gold.items() if q == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def plain(seed):
    R = np.random.default_rng(seed)
    return " ".join("Some " + " ".join("".join(R.choice(list("abcdefgh"), 5)) for _ in range(9)) + "." for _ in range(9))


def test_nulls_repeats_clashes_and_empty_tables(spark):
    junk = "Of%%% the*** and&&& " * 30
    rows = [(i, plain(i), "a") for i in range(40)] + [(100 + i, junk + f"Word{i}### " * i, "a") for i in range(20)] + [(100, junk, "a"), (201, None, "a"), (202, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = Q.score(docs, Q.fit(docs))
    assert out.columns == ["doc_id", "text", "score", "kept"]
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert out.count() == len(rows) and not any(kept[100 + i] for i in range(20)) and all(kept[i] for i in range(40))
    none = docs.limit(0)
    assert Q.score(none, Q.fit(none)).count() == 0


def test_pieces_do_not_change_the_reading(monkeypatch):
    from sightline.llm import kernels

    text = ("Some Words| | here!! and there. " * 200).encode()
    whole = Q.Reading(text)
    monkeypatch.setattr(Q, "pieces", lambda t: kernels.pieces(t, 64))
    cut = Q.Reading(text)
    assert np.allclose(whole.stats, cut.stats) and np.array_equal(np.sort(whole.forms), np.sort(cut.forms))


def plain_stats(text):
    """The statistics, word by word and character by character."""
    data = text.encode()
    words = [w for w in data.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    body = b"".join(words)
    n, per = len(words), max(len(words), 1)
    count = lambda members: sum(b in members for b in data)
    upper, digits = count(range(65, 91)), count(range(48, 58))
    letters = count([*range(65, 91), *range(97, 123), *range(128, 256)])
    runs = [words[k : k + 200] for k in range(0, n, 200)]
    share = np.mean([len(set(r)) / len(r) for r in runs]) if runs else 1.0
    same = np.mean([a == b for a, b in zip(words, words[1:], strict=False)]) if n > 1 else 0.0
    return [n, len(body) / per, count(b"#*$%&|<>{}\\^~=_@") / per, upper / max(letters, 1), count(b"!") / per, sum(w == b"|" for w in words) / per, share, same, count(b".!?") / per, letters / max(len(body) - digits, 1)]


def plain_votes(s):
    """Each labeller as a sentence: good, bad or nothing."""
    between = lambda x, good, bad: 1 if x <= good else -1 if x > bad else 0
    above = lambda x, bad, good, least: 0 if s[0] < least else -1 if x < bad else 1 if x >= good else 0
    return (between(s[2], 0.05, 0.3), between(s[5], 0.02, 0.1), between(s[3], 0.15, 0.4), between(s[4], 0.05, 0.3), above(s[6], 0.3, 0.45, 50), between(s[7], 0.05, 0.2), above(s[9], 0.7, 0.85, 5), above(s[8], 0.01, 0.03, 40), between(s[1], 11, 16))


def plain_maximisation(votes, rounds=200):
    """Expectation-maximisation, document by document."""
    p = [0.1 if -1 in v else 0.9 for v in votes]
    for _ in range(rounds):
        good, bad = sum(p), sum(1 - x for x in p)
        share = (good + 1) / (good + bad + 2)
        rate = []
        for k in range(len(votes[0])):
            up = [sum((x if c else 1 - x) for v, x in zip(votes, p, strict=True) if v[k] == 1) for c in (0, 1)]
            down = [sum((x if c else 1 - x) for v, x in zip(votes, p, strict=True) if v[k] == -1) for c in (0, 1)]
            rate.append([(u + 1) / (u + d + 2) for u, d in zip(up, down, strict=True)])
        new = []
        for v in votes:
            odds = [1 - share, share]
            for k, x in enumerate(v):
                for c in (0, 1):
                    odds[c] *= rate[k][c] if x == 1 else 1 - rate[k][c] if x == -1 else 1
            new.append(odds[1] / sum(odds))
        done = max(abs(a - b) for a, b in zip(p, new, strict=True)) < 1e-9
        p = new
        if done:
            break
    return p


def test_query_equals_a_plain_recomputation(spark, sf):
    """Statistics, votes, posteriors and scores of every document, from the texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    stats = {i: plain_stats(t) for i, t in texts.items()}
    assert all(np.allclose(Q.Reading(t.encode()).stats, stats[i]) for i, t in texts.items())
    votes = {i: plain_votes(s) for i, s in stats.items()}
    model = Q.fit(docs)
    posterior = dict(zip(votes, plain_maximisation(list(votes.values())), strict=True))
    assert np.allclose(model.labels.posterior(np.array(list(votes.values()))), list(posterior.values()), atol=1e-6)
    got = {r.doc_id: (r.score, r.kept) for r in Q.op6_quality_classifier(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        which, value = Q.Reading(t.encode()).features()
        margin = sum(model.weights[b] * v for b, v in zip(which.tolist(), value.tolist(), strict=True))
        assert abs(got[i][0] - 1 / (1 + np.exp(-margin))) < 2e-6 and got[i][1] == (got[i][0] >= 0.5)
    # The scorer has learned what the labellers say.
    assert np.mean([got[i][1] == (posterior[i] >= 0.5) for i in texts]) > 0.97


def test_equal_scores_at_the_threshold_are_kept(spark):
    docs = spark.createDataFrame([(1, "some words here"), (1, "some words here"), (2, "others")], "doc_id long, text string")
    model = Q.Model(Q.WeakLabels(0.5, np.full((9, 2), 0.5)), np.zeros(1 << Q.HASH))
    assert [(r.score, r.kept) for r in Q.score(docs, model).collect()] == [(0.5, True)] * 3
