r"""Quality classifier from weak labels: overlapping heuristic labellers, expectation-maximisation, a hashed scorer.

1. Each labeller votes good (1), bad (-1) or abstains (0) on every document. Documents are counted by vote pattern in
   Spark: a pattern has at most 3 ** number of labellers values, so what reaches the driver is bounded at any size.
2. Expectation-maximisation over the counted patterns estimates the share of good documents and how each labeller
   votes on good and on bad ones, and gives every pattern the posterior probability of being good.
3. A logistic model over hashed features (word shapes, text statistics in bins) learns the posteriors from about
   `sample` different texts, chosen by a hash of the text and each taken once; `sample` bounds what the driver trains
   on, also where one text is held by a third of all documents.
4. Every document is scored in one narrow pass with the weights (2 ** `HASH` numbers, broadcast).

No gold label is used in training; tests compare with `labels`.

Nulls: a null text is an empty one, which is scored as any other (no words: the empty-text feature). Repeated rows get
equal scores; ties at the threshold are kept. Very long texts are read in pieces. With no documents, or none with votes of both kinds, all are kept. Extra
columns are kept; `score` and `kept` are added (replacing columns so named).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from sightline.llm.kernels import IS_SPACE, hash_spans, lut, mix, pieces, spans, text_slices
from sightline.tables import bounded_batches, table

HASH = 14
SAMPLE = 20_000

#: Byte classes of word shapes. Letters beyond ASCII count as small letters.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[128:] = SHAPE[97:123] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("0")
UPPER, MARKS, LETTERS = lut(bytes(range(65, 91))), lut(b"#*$%&|<>{}\\^~=_@"), lut(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
ENDS, DIGITS = lut(b".!?"), lut(b"0123456789")

#: Statistics of a text, in the order of `statistics`.
STATS = ["words", "bytes_a_word", "marks_a_word", "upper_share", "shouts_a_word", "bars_a_word", "distinct_share", "same_as_before", "ends_a_word", "letter_share"]


def bucket_hashes(*parts: np.ndarray) -> np.ndarray:
    total = np.zeros(1, np.uint64)
    for p in parts:
        total = mix(total * np.uint64(0x100000001B3) + p.astype(np.uint64))
    return (total & np.uint64((1 << HASH) - 1)).astype(np.int64)


def shapes(data: np.ndarray) -> np.ndarray:
    """Hash of each word's shape: byte classes with runs of one class as one."""
    kind = SHAPE[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | IS_SPACE[kind[1:]]
    short = kind[keep]
    return hash_spans(short, *spans(short))


class Reading:
    """Statistics of one text and its hashed features."""

    def __init__(self, text: bytes):
        totals = np.zeros(8, np.int64)
        words, forms = [], []
        for a, b in pieces(text):
            data = np.frombuffer(text[a:b], np.uint8)
            starts, ends = spans(data)
            if len(starts):
                words.append(hash_spans(data, starts, ends))
                forms.append(shapes(data))
                bare = (ends - starts == 1) & (data[starts] == ord("|"))
                totals += [(ends - starts).sum(), MARKS[data].sum(), UPPER[data].sum(), (data == ord("!")).sum(), bare.sum(), ENDS[data].sum(), LETTERS[data].sum(), DIGITS[data].sum()]
        word = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.forms = np.concatenate(forms) if forms else np.zeros(0, np.uint64)
        n, size = len(word), int(totals[0])
        # Words repeat more in longer texts: distinctness is the mean over runs of 200 words.
        share = np.mean([len(np.unique(word[k : k + 200])) / len(word[k : k + 200]) for k in range(0, n, 200)]) if n else 1.0
        same = (word[1:] == word[:-1]).mean() if n > 1 else 0.0
        per, letters = max(n, 1), max(int(totals[6]), 1)
        self.stats = np.array([n, size / per, totals[1] / per, totals[2] / letters, totals[3] / per, totals[4] / per, share, same, totals[5] / per, totals[6] / max(size - int(totals[7]), 1)])

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, value): shares of word shapes, and one feature for each statistic's bin."""
        which, count = np.unique(self.forms, return_counts=True)
        shape = bucket_hashes(np.full(1, 1), which)
        bins = np.searchsorted([0.001, 0.01, 0.03, 0.07, 0.15, 0.25, 0.35, 0.5, 0.7, 0.9, 1.5, 3, 5, 8, 12, 20, 50, 200, 1000], self.stats, side="right")
        bins = bucket_hashes(np.full(1, 2), np.arange(len(bins)), bins)
        bias = bucket_hashes(np.full(1, 3))
        return np.concatenate([shape, bins, bias]), np.concatenate([np.sqrt(count / max(len(self.forms), 1)), np.ones(len(bins) + 1)])


def _between(low: str, good: float, bad: float):
    """Good up to one value, bad above another, else no vote."""
    k = STATS.index(low)
    return lambda s: 1 if s[k] <= good else -1 if s[k] > bad else 0


def _above(name: str, bad: float, good: float, least_words: int):
    k = STATS.index(name)
    return lambda s: 0 if s[0] < least_words else -1 if s[k] < bad else 1 if s[k] >= good else 0


#: Labellers by name. They overlap: one kind of junk is seen by several, and each abstains where it cannot tell.
LABELLERS = {
    "marks": _between("marks_a_word", 0.05, 0.3),
    "bars": _between("bars_a_word", 0.02, 0.1),
    "capitals": _between("upper_share", 0.15, 0.4),
    "shouting": _between("shouts_a_word", 0.05, 0.3),
    "variety": _above("distinct_share", 0.3, 0.45, 50),
    "stutter": _between("same_as_before", 0.05, 0.2),
    "letters": _above("letter_share", 0.7, 0.85, 5),
    "sentences": _above("ends_a_word", 0.01, 0.03, 40),
    "word_length": _between("bytes_a_word", 11, 16),
}


def vote(stats: np.ndarray) -> int:
    """The votes as digits in base 3 (1 added to each)."""
    out = 0
    for labeller in LABELLERS.values():
        out = 3 * out + labeller(stats) + 1
    return out


def votes_of(pattern: np.ndarray) -> np.ndarray:
    """Matrix of votes (-1, 0, 1), a row for each pattern."""
    m = len(LABELLERS)
    return np.stack([pattern // 3 ** (m - 1 - k) % 3 - 1 for k in range(m)], axis=1)


@dataclass
class WeakLabels:
    """Estimates of expectation-maximisation: share of good, and P(good vote | class, some vote) by labeller.

    Whether a labeller abstains says nothing about the class (short texts abstain more, good or bad), so abstentions
    are missing votes.
    """

    good: float
    table: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = (votes == 1) @ np.log(self.table) + (votes == -1) @ np.log(1 - self.table) + np.log([1 - self.good, self.good])
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))

    def accuracies(self) -> np.ndarray:
        """Share of right votes among each labeller's votes."""
        return (1 - self.table[:, 0]) * (1 - self.good) + self.table[:, 1] * self.good


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, smooth: float = 1.0) -> WeakLabels:
    """Two-class model of counted vote patterns, started from: bad if any labeller says so."""
    p = np.where((votes == -1).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts], axis=1)
        total = weight.sum(axis=0)
        ups, downs = (votes == 1).T @ weight, (votes == -1).T @ weight
        out = WeakLabels(float((total[1] + smooth) / (total.sum() + 2 * smooth)), (ups + smooth) / (ups + downs + 2 * smooth))
        new = out.posterior(votes)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return out


def train(rows: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, rounds: int = 300, decay: float = 1e-5) -> np.ndarray:
    """Logistic weights by full-batch gradient steps of adaptive size; target: probabilities."""
    weights, squares = np.zeros(1 << HASH), np.full(1 << HASH, 1e-8)
    if not rows:
        return weights
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column, value = np.concatenate(rows), np.concatenate(values)
    for _ in range(rounds):
        margin = np.bincount(owner, weights[column] * value, len(rows))
        wrong = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target
        slope = np.bincount(column, wrong[owner] * value, 1 << HASH) / len(rows) + decay * weights
        squares += slope**2
        weights -= 0.3 * slope / np.sqrt(squares)
    return weights


def patterns(stream):
    """mapInArrow: (text) to (pattern)."""
    for batch in stream:
        for _, texts in text_slices(batch, 0):
            yield pa.RecordBatch.from_arrays([pa.array([vote(Reading(t).stats) for t in texts], pa.int64())], names=["pattern"])


def sampled(stream):
    """mapInArrow: (text) to (pattern, buckets, values)."""
    for batch in stream:
        for _, texts in text_slices(batch, 0):
            readings = [Reading(t) for t in texts]
            features = [r.features() for r in readings]
            yield pa.RecordBatch.from_arrays([pa.array([vote(r.stats) for r in readings], pa.int64()), pa.array([f[0] for f in features], pa.list_(pa.int64())), pa.array([f[1] for f in features], pa.list_(pa.float64()))], names=["pattern", "buckets", "values"])


@dataclass
class Model:
    labels: WeakLabels | None
    weights: np.ndarray


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Estimate labellers on all documents, and train the scorer on about `sample` of them."""
    bounded_batches(docs.sparkSession)
    counted = docs.select("text").mapInArrow(patterns, "pattern long").groupBy("pattern").agg(F.count("*").alias("n")).toPandas()
    counts = counted["n"].to_numpy(np.float64)
    votes = votes_of(counted["pattern"].to_numpy(np.int64))
    if not len(counts) or not (votes == -1).any():
        return Model(None, np.zeros(1 << HASH))
    labels = expectation_maximisation(votes, counts)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    chosen, different = docs.select("text", key.alias("t")), docs.agg(F.approx_count_distinct(key)).first()[0]
    if different > sample:
        chosen = chosen.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < F.lit(int((1 << 30) * sample / different)))
    chosen = chosen.groupBy("t").agg(F.first("text").alias("text")).select("text")
    rows = chosen.mapInArrow(sampled, "pattern long, buckets array<long>, values array<double>").toPandas()
    target = labels.posterior(votes_of(rows["pattern"].to_numpy(np.int64)))
    order = np.argsort(rows["pattern"].to_numpy(), kind="stable")
    return Model(labels, train([rows["buckets"][i] for i in order], [rows["values"][i] for i in order], target[order]))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """`docs` with score (probability of being good, 6 places) and kept."""
    docs = docs.drop("score", "kept")
    place, weights, known = docs.columns.index("text"), model.weights, model.labels is not None

    bounded_batches(docs.sparkSession)

    def run(stream):
        for batch in stream:
            for (first, rows), texts in text_slices(batch, place):
                margins = []
                for t in texts:
                    bucket, value = Reading(t).features()
                    margins.append(float(weights[bucket] @ value) if known else 50.0)
                scores = np.round(1 / (1 + np.exp(-np.clip(margins, -50, 50))), 6)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, rows).columns, pa.array(scores), pa.array(scores >= threshold)], names=[*batch.schema.names, "score", "kept"])

    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]))


def op6_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs)).select("doc_id", "score", "kept")


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict[str, str] = {}
