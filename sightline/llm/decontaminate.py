r"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised words inside a sentence) and units after numbers turn into typed
placeholders, other words are lowered; neighbouring placeholders of one type count as one slot. Windows of `WIDTH`
template tokens, of which at least half are words, are hashed. Document windows that an exact bitmap of the
benchmark's hashes admits (a fixed 2 MB, no false negatives) are joined to the benchmark's windows by hash. The slots
of the joined windows must be filled consistently: one name or unit of the item stands for one of the document, and the
other way round. Numbers may come to be equal by chance, in the item or in the copy, so of their different pairs only a
share of `NUMBERS` must be so. Numbers are digits or number words. A document is contaminated by an item when windows of it cover at least `COVER` of the item's
different windows and their slots are consistent; so a question with other numbers or names is caught, and one that
shares phrases is not. The windows are all of the document's or, where those are at odds, the ones of one occurrence:
for a shift (place in the document less place in the item), the nearest window for each place of the item, within a
band of 0, a window's or the item's length. So what else a document holds does not clear a copy in it.

A capitalised word that begins a sentence may be a name or not. Texts are read both ways, all such words as words and
all as names; the windows of a reading meet those of the same reading only, and either can contaminate.
The cover is the first reading's where that contaminates.

An item none of whose windows has words enough is read as it stands: its windows of plain tokens, numbers and names as
they are, must be found in the document's; so an exact copy of an item made of numbers and names is found, and other
numbers make another item.

Items of fewer tokens than a window are one window. Very long texts are cut at white space and need eight bytes a word.
Nulls: null texts have no windows; rows with a null id are kept
and not judged, items with a null id are ignored. Repeated rows of one doc_id share one judgement; different texts of
one item_id are judged each for itself. Ties: of several items, the best covered is reported,
then the one with the least item_id. Empty documents or an empty benchmark contaminate nothing. Extra columns of the
documents are kept; `contaminated`, `item_id` and `cover` are added (replacing columns so named).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from sightline.llm.kernels import LOWER, hash_spans, lut, mix, pieces, prefix_sums, sequence_hash, spans, text_slices
from sightline.tables import Scratch, bounded_batches, table

WIDTH, COVER, NUMBERS = 5, 0.5, 0.5
BITMAP = 24  # log2 of the bits in the prefilter

#: Units that may follow a number.
UNITS = "mm cm m km in ft mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers mg g kg t lb lbs oz gram grams kilogram kilograms tonne tonnes pound pounds ml l litre litres liter liters s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents kmh mph degrees volt volts watt watts".split()

#: Words that stand for numbers.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()

WORD = ~lut(bytes(set(range(128)) - set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")))
STOPS, DIGIT, UPPER = lut(b".!?:;\n"), lut(b"0123456789"), lut(bytes(range(65, 91)))
NUM, NAME, UNIT = 1, 2, 3
#: Added to the keys of the second reading (initial names) and of the third (as it stands), to set them apart.
APART = [np.uint64(0), np.uint64(0x2545F4914F6CDD1D), np.uint64(0x8A5CD789635D2DFF)]
TAG = mix(np.array([0, 11, 22, 33], np.uint64))


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.sort(hash_spans(data, *spans(data)))


_units, _numbers = _hashes(UNITS), _hashes(NUMBER_WORDS)


def among(value: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value


class Template:
    """Tokens of a text: hashes, kinds (0 word, else placeholder), and hashes of what a placeholder stands for."""

    def __init__(self, text: bytes):
        kinds, values, initials = [], [], []
        begins, after_number = True, False  # whether a sentence begins, or a number stood, before the piece
        for a, b in pieces(text):
            data = np.frombuffer(text[a:b], np.uint8)
            starts, ends = spans(data, ~WORD)
            if not len(starts):
                begins |= bool(STOPS[data].any())
                continue
            value = hash_spans(LOWER[data], starts, ends)
            stops = np.concatenate([[0], np.cumsum(STOPS[data])])
            fresh = np.full(len(starts), begins or stops[starts[0]] > 0)
            fresh[1:] = stops[starts[1:]] > stops[ends[:-1]]
            number = DIGIT[data[starts]] | among(value, _numbers)
            second = data[np.minimum(starts + 1, len(data) - 1)]
            # À to Þ in UTF-8: a lead byte C3 and a second byte of 80 to 9E.
            accented = (data[starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E)
            follow = data[np.minimum(starts + 1 + accented, len(data) - 1)]
            capital = (UPPER[data[starts]] | accented) & (ends - starts > 1 + accented) & ~UPPER[follow] & ~DIGIT[follow]
            unit = among(value, _units)
            unit[1:] &= number[:-1]
            unit[0] &= after_number
            begins, after_number = bool(stops[-1] > stops[ends[-1]]), bool(number[-1])
            kinds.append(np.where(number, NUM, np.where(unit, UNIT, np.where(capital & ~fresh, NAME, 0))).astype(np.int8))
            values.append(value)
            initials.append(capital & fresh & (kinds[-1] == 0))
        kind = np.concatenate(kinds) if kinds else np.zeros(0, np.int8)
        value = np.concatenate(values) if values else np.zeros(0, np.uint64)
        self.read = kind, value, np.concatenate(initials) if initials else np.zeros(0, bool)
        self.join(kind, value, np.zeros(len(kind), bool))

    def as_it_stands(self) -> Template:
        """The reading without placeholders: every token for itself."""
        out = Template.__new__(Template)
        out.read, out.kind, out.value, out.token = self.read, np.zeros(len(self.read[0]), np.int8), self.read[1], self.read[1]
        return out

    def with_initial_names(self) -> Template:
        """The other reading: capitalised words that begin a sentence are names; a sentence's begin parts names."""
        kind, value, initial = self.read
        out = Template.__new__(Template)
        out.read = self.read
        out.join(np.where(initial, NAME, kind).astype(np.int8), value, initial)
        return out

    def join(self, kind: np.ndarray, value: np.ndarray, apart: np.ndarray) -> None:
        """Neighbouring placeholders of one kind become one token, but for those that stand apart from the one before."""
        first = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 0) | apart[1:]])) if len(kind) else np.zeros(0, np.int64)
        self.kind = kind[first]
        last = np.append(first[1:], len(kind))
        self.value = value[first]
        if len(first) < len(kind):
            run = sequence_hash(prefix_sums(value, np.uint64(0x9FB21C651E98DF25)), first, last, np.uint64(0x9FB21C651E98DF25))
            self.value = np.where(last - first > 1, mix(run), self.value)
        self.token = np.where(self.kind > 0, TAG[self.kind], self.value)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the windows of which at least half are words; a shorter text is one window."""
        n = len(self.token)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        size = min(width, n)
        starts = np.arange(n - size + 1)
        words = np.concatenate([[0], np.cumsum(self.kind == 0)])
        starts = starts[2 * (words[starts + size] - words[starts]) >= size]
        base = np.uint64(0xE7037ED1A0B428DB)
        return starts, mix(sequence_hash(prefix_sums(self.token, base), starts, starts + size, base) + np.uint64(size))

    def slots(self, start: int, width: int) -> tuple[list[int], list[int]]:
        part = slice(start, start + width)
        at = np.flatnonzero(self.kind[part])
        return self.kind[part][at].tolist(), self.value[part][at].view(np.int64).tolist()


WINDOWS = "row long, reading int, copy long, n int, start int, key long, kinds array<int>, slots array<long>"


def windows_of(width: int, sizes: list[int] | None, bitmap: np.ndarray | None, plain: bool = True):
    """mapInArrow: (row, text) to the windows, in all readings, that the bitmap admits; copy: text and reading; sizes: window sizes to form (None: width).

    Without a bitmap (items), the reading as it stands is for texts that have no windows in the first reading; with one,
    it is left out unless `plain`, which says that some item is read so.
    """

    def run(stream):
        for batch in stream:
            for (first, rows), texts in text_slices(batch, 1):
                out: list[tuple] = []
                for row, raw in zip(batch.column(0).slice(first, rows).to_pylist(), texts, strict=True):
                    made = Template(raw)
                    forms = [made, made.with_initial_names()]
                    if plain and (bitmap is not None or not len(made.windows(width)[0])):
                        forms.append(made.as_it_stands())
                    for reading, form in enumerate(forms):
                        n, copy = len(form.token), None
                        for size in sizes or [width]:
                            if sizes and n < size:
                                continue
                            starts, keys = form.windows(size)
                            keys = mix(keys + APART[reading]) if reading else keys
                            if bitmap is not None and len(keys):
                                low = (keys & np.uint64((1 << BITMAP) - 1)).astype(np.int64)
                                admitted = bitmap[low >> 3] >> (low & 7).astype(np.uint8) & 1 == 1
                                starts, keys = starts[admitted], keys[admitted]
                            if copy is None and len(keys):
                                copy = xxhash.xxh64_intdigest(raw, reading) - (1 << 63)
                            out += [(row, reading, copy, n, a, key, *form.slots(a, size)) for a, key in zip(starts.tolist(), keys.view(np.int64).tolist(), strict=True)]
                    if len(out) > 20_000:
                        yield rows_batch(out)
                        out = []
                if out:
                    yield rows_batch(out)

    return run


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["row", "reading", "copy", "n", "start", "key", "kinds", "slots"])


def consistent(slots: list[tuple[int, int, int]]) -> bool:
    """Whether slots (kind, item's value, document's) are filled alike: names and units one to one, numbers by a share."""
    found = set(slots)
    for kind in {k for k, _, _ in found}:
        mine = [(a, b) for k, a, b in found if k == kind]
        least = min(len({a for a, _ in mine}), len({b for _, b in mine}))
        if least < len(mine) * (NUMBERS if kind == NUM else 1):
            return False
    return True


def best_occurrence(at: np.ndarray, place: np.ndarray, key: list, slots: list, n: int, least: float, width: int) -> int:
    """Most different keys of one occurrence with consistent slots, 0 if none has `least`.

    Hits are windows `at` of a text that equal windows at `place` of an item of n tokens; slots: (kind, item's, document's).
    """
    shift = at - place
    order = np.lexsort((at, shift))
    shift, place, best = shift[order], place[order].tolist(), 0
    seeds = np.unique(shift)
    for band in (0, width, n):
        lows, highs = np.searchsorted(shift, seeds - band), np.searchsorted(shift, seeds + band, "right")
        for seed, a, b in zip(seeds, lows, highs, strict=True):
            if b - a <= best or b - a < least:
                continue
            chosen: dict[int, int] = {}
            for i in (a + np.argsort(np.abs(shift[a:b] - seed), kind="stable")).tolist():
                chosen.setdefault(place[i], order[i])
            keys = {key[i] for i in chosen.values()}
            if len(keys) > best and len(keys) >= least and consistent([x for i in chosen.values() for x in slots[i]]):
                best = len(keys)
    return best


def occurrences(width: int, cover: float):
    """applyInArrow over the hits of one text and one item's text: (doc_id, item_id, reading, cover) if an occurrence passes."""

    def run(hits: pa.Table) -> pa.Table:
        total, n = hits["total"][0].as_py(), hits["n"][0].as_py()
        slots = [list(zip(k, a, b, strict=True)) for k, a, b in zip(hits["kinds"].to_pylist(), hits["theirs"].to_pylist(), hits["slots"].to_pylist(), strict=True)]
        k = best_occurrence(hits["at"].to_numpy().astype(np.int64), hits["place"].to_numpy().astype(np.int64), hits["key"].to_pylist(), slots, n, total * cover, width)
        return hits.select(["doc_id", "item_id", "reading"]).slice(0, k > 0).append_column("cover", pa.array([k / total][: k > 0], pa.float64()))

    return run


def matches(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, width: int = WIDTH, cover: float = COVER) -> DataFrame:
    """Rows (doc_id, item_id, cover) of the contaminated pairs; docs (doc_id, text), benchmark (item_id, text)."""
    bounded_batches(scratch.spark)
    items = scratch.keep(benchmark.select("item_id", "text").where("item_id is not null").distinct().mapInArrow(windows_of(width, None, None), WINDOWS).withColumnsRenamed({"row": "item_id", "copy": "wording"}))
    item, pair = ["item_id", "reading", "wording"], ["doc_id", "item_id", "reading", "wording"]
    totals = items.groupBy(item).agg(F.count_distinct("key").alias("total"))
    # The bits of all keys' low ends, gathered in Spark: 2 MB at most, whatever the benchmark's size.
    low = F.col("key").bitwiseAND(F.lit((1 << BITMAP) - 1)) + 1
    parts = items.groupBy(F.bitmap_bucket_number(low).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(low)).alias("bits")).collect()
    bitmap = np.zeros(1 << BITMAP - 3, np.uint8)
    for part in parts:
        bitmap[(part["part"] - 1) * 4096 : part["part"] * 4096] = np.frombuffer(part["bits"], np.uint8)
    short = sorted({min(r["n"], width) for r in items.select(F.least("n", F.lit(width)).alias("n")).distinct().collect()})
    plain = not items.where("reading = 2").isEmpty()
    seen = docs.select("doc_id", "text").mapInArrow(windows_of(width, short or [width], bitmap, plain), WINDOWS).withColumnRenamed("row", "doc_id").withColumnRenamed("start", "at").drop("n", "reading")
    seen = scratch.keep(seen)
    # A contaminated document has one of the rarest keys of the item, all but as many as it may lack; windows that many
    # items share then meet candidates only.
    rare = items.groupBy("key").agg(F.count_distinct("item_id", "wording").alias("items"))
    w = W.partitionBy(item).orderBy("items", "key")
    ranked = items.select(*item, "key").distinct().join(rare, "key").join(totals, item).withColumn("rank", F.row_number().over(w))
    rarest = ranked.where(F.col("rank") <= F.col("total") - F.ceil(F.col("total") * cover) + 1).select(*item, "key")
    candidates = scratch.keep(seen.select("doc_id", "key").distinct().join(rarest, "key").select(pair).distinct())
    ours = items.select(*item, "n", "key", F.col("start").alias("place"), F.col("kinds").alias("their_kinds"), F.col("slots").alias("theirs"))
    hit = seen.join(candidates.join(ours, item), ["doc_id", "key"])
    hit = scratch.keep(hit.where(F.col("kinds") == F.col("their_kinds")).drop("their_kinds"))
    covered = scratch.keep(hit.groupBy(pair).agg(F.count_distinct("key").alias("k")).join(totals, item).where(F.col("k") >= F.col("total") * cover))
    slots = F.array_distinct(F.transform("kinds", lambda kind, i: F.struct(kind.alias("kind"), F.get("theirs", i).alias("a"), F.get("slots", i).alias("b"))))
    filled = hit.join(covered.select(pair), pair, "left_semi").select(*pair, F.explode(slots).alias("s")).distinct()
    ends = filled.groupBy(*pair, "s.kind").agg(F.count("*").alias("pairs"), F.least(F.count_distinct("s.a"), F.count_distinct("s.b")).alias("least"))
    odd = F.col("least") < F.col("pairs") * F.when(F.col("kind") == NUM, NUMBERS).otherwise(1.0)
    mixed = scratch.keep(ends.where(odd).select(pair).distinct().join(covered.select(*pair, "total"), pair))
    whole = covered.join(mixed, pair, "left_anti").select("doc_id", "item_id", "reading", (F.col("k") / F.col("total")).alias("cover"))
    parts = hit.join(mixed, pair).dropDuplicates([*pair, "copy", "at", "place"])
    one = parts.groupBy(*pair, "copy").applyInArrow(occurrences(width, cover), "doc_id long, item_id long, reading int, cover double")
    return whole.unionByName(one).groupBy("doc_id", "item_id").agg(F.max_by("cover", F.struct(-F.col("reading"), "cover")).alias("cover"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, cover: float = COVER) -> DataFrame:
    """`docs` with contaminated (boolean), item_id (of the best covered item) and cover."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    docs = docs.drop("contaminated", "item_id", "cover")
    found = matches(docs, benchmark, scratch, width, cover)
    best = found.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.struct("cover", (-F.col("item_id")).alias("item"))).alias("__b"))
    out = docs.join(best, F.col("doc_id") == F.col("__id"), "left")
    return out.select(*docs.columns, F.col("__b").isNotNull().alias("contaminated"), (-F.col("__b.item")).alias("item_id"), F.col("__b.cover").alias("cover"))


def op5_decontamination(spark, sf_dir):
    """One row for each contaminated document, with its best covered item and how many items it contains."""
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = matches(docs, benchmark, Scratch(spark, "decontaminate"))
    best = found.groupBy("doc_id").agg(F.max(F.struct("cover", (-F.col("item_id")).alias("item"))).alias("b"), F.count("*").alias("n_items"))
    return best.select("doc_id", (-F.col("b.item")).alias("item_id"), F.round("b.cover", 6).alias("cover"), "n_items")


QUERIES = {"op5_decontamination": op5_decontamination}

_UNITS_SQL, _NUMBERS_SQL = (", ".join(f"'{u}'" for u in words) for words in (UNITS, NUMBER_WORDS))
_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NUM_SQL = f"(regexp_matches({{0}}, '^[0-9]') OR {_LOWER_SQL.format('{0}')} IN ({_NUMBERS_SQL}))"


def _template_sql(name: str, table_: str, ident: str) -> str:
    """Common table expressions that end in {name} (id, n, i, tok, kind, val): the template tokens of a table's texts."""
    return rf"""
{name}0 AS (SELECT {ident} AS id, i, toks[i] AS s FROM (SELECT {ident}, regexp_extract_all(coalesce(text, ''), '[.!?:;\n]|[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+') AS toks FROM {table_} WHERE {ident} IS NOT NULL), unnest(range(1, len(toks) + 1)) AS u(i)),
{name}1 AS (SELECT *, NOT regexp_matches(s, '^[.!?:;\n]$') AS word, coalesce(regexp_matches(lag(s) OVER (PARTITION BY id ORDER BY i), '^[.!?:;\n]$'), true) AS fresh FROM {name}0),
{name}2 AS (SELECT id, i, s, fresh, {_LOWER_SQL.format("s")} AS val, {_NUM_SQL.format("s")} AS num, {_NUM_SQL.format("coalesce(lag(s) OVER (PARTITION BY id ORDER BY i), '')")} AS after FROM {name}1 WHERE word),
{name}3 AS (SELECT id, i, val, CASE WHEN num THEN 1 WHEN after AND val IN ({_UNITS_SQL}) THEN 3 WHEN NOT fresh AND regexp_matches(s, '^[A-Z\x{{C0}}-\x{{DE}}][^A-Z0-9]') THEN 2 ELSE 0 END AS kind FROM {name}2),
{name}4 AS (SELECT *, CASE WHEN kind > 0 AND kind = lag(kind) OVER (PARTITION BY id ORDER BY i) THEN 0 ELSE 1 END AS first FROM {name}3),
{name}5 AS (SELECT *, sum(first) OVER (PARTITION BY id ORDER BY i) AS g FROM {name}4),
{name} AS (SELECT id, g AS i, any_value(kind) AS kind, string_agg(val, ' ' ORDER BY i) AS val, CASE WHEN any_value(kind) > 0 THEN '<' || any_value(kind) || '>' ELSE any_value(val) END AS tok, count(*) OVER (PARTITION BY id) AS n FROM {name}5 GROUP BY id, g)"""


def _windows_sql(name: str, tokens: str, size: str) -> str:
    """Windows (id, key, vals, kinds) of `size` tokens, at least half of them words."""
    return f"""{name} AS (SELECT id, i, array_to_string(t, ' ') || '/' || len(t) AS key, k AS kinds, v AS vals FROM (SELECT id, i, list(tok) OVER w AS t, list(kind) OVER w AS k, list(val) OVER w AS v, {size} AS z FROM {tokens} WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
 WHERE len(t) = z AND 2 * len(list_filter(k, lambda x: x = 0)) >= z)"""


# Items shorter than a window are compared in tests; the given ones are longer, and so this speaks of windows of five.
ORACLE = f"""WITH {_template_sql("q", "(SELECT DISTINCT item_id, text FROM benchmark)", "item_id")}, {_template_sql("d", "documents", "doc_id")}, {_windows_sql("qw", "q", "5")}, {_windows_sql("dw", "d", "5")},
tot AS (SELECT id, count(DISTINCT key) AS total FROM qw GROUP BY 1), hit AS (SELECT dw.id AS doc_id, qw.id AS item_id, dw.key, qw.kinds, qw.vals AS a, dw.vals AS b FROM dw JOIN qw ON dw.key = qw.key AND dw.kinds = qw.kinds),
cov AS (SELECT doc_id, item_id, count(DISTINCT key) AS k, any_value(total) AS total FROM hit JOIN tot ON tot.id = item_id GROUP BY 1, 2 HAVING count(DISTINCT key) >= 0.5 * any_value(total)),
sl AS (SELECT DISTINCT doc_id, item_id, kinds[j] AS kind, a[j] AS x, b[j] AS y FROM hit SEMI JOIN cov USING (doc_id, item_id), unnest(range(1, 6)) AS u(j) WHERE kinds[j] > 0),
mix AS (SELECT DISTINCT doc_id, item_id FROM sl GROUP BY doc_id, item_id, kind HAVING least(count(DISTINCT x), count(DISTINCT y)) < count(*) * CASE kind WHEN 1 THEN 0.5 ELSE 1 END),
ok AS (SELECT * FROM cov ANTI JOIN mix USING (doc_id, item_id))
SELECT doc_id, arg_max(item_id, (k / total, -item_id)) AS item_id, round(max(k / total), 6) AS cover, count(*) AS n_items FROM ok GROUP BY 1"""

ORACLES = {"op5_decontamination": ORACLE}
