r"""Quotation linking: find what each message quotes, link it to the message it answers, and drop what was linked.

Built-in expressions and joins only. A line's quote level is the number of `>` before its text; a passage is a run of
lines of one level, one of its paragraphs, or one of its lines; so a reply that quotes some of several paragraphs,
wrapped to another width, is linked by each. The normal form of a passage (lower case, white space collapsed, so wrapping does not matter) is
hashed and joined, within the conversation, to the earliest message whose own text has that passage: as its whole
text, a paragraph or a line. Aggregating originals to the earliest per hash first keeps one row per passage, so a
phrase that every message of a huge conversation repeats makes no pairs.

A message answers the original of its least deep linked quote (of several: the one with most quoted words, then the
latest). Without a linked quote it answers the message at the turn before, if there is one; else it opens a thread.
As an answer always comes after what it answers, (conv_id, thread, turn) is reply order. Threads and depths come from
pointer doubling, log2(depth) joins.

Only what is linked goes from the text: the lines of each linked run, paragraph or line, and the line that introduces
it. Quotes of nothing in the conversation (a book, a prompt, code) stay as they stand. n_quotes and n_linked count runs.

Nulls: a null text is an empty message; rows with a null conv_id or turn link to nothing, keep their quotes and open a
thread at their own turn. Very long texts are cut in place; a deep chain costs its depth's logarithm in joins. Repeated rows of one (conv_id, turn) each get the same links. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightline.llm.quality_rules import let
from sightline.tables import Scratch, table

#: What stands before a quoted line, and a line that introduces a quote.
PREFIX = r"^[ >]*> ?"
ATTRIBUTION = r"^ *On .* wrote: *$"
PARAGRAPH = r"\n[ \t]*\n"


def normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def lines_of(text: Column) -> Column:
    """array<struct<level int, body string, line string>>; a line that introduces a quote has level -1."""

    def parse(line: Column) -> Column:
        mark = F.regexp_extract(line, PREFIX, 0)
        return F.struct((F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))).alias("level"), F.regexp_replace(line, PREFIX, "").alias("body"), line.alias("line"))

    def introduced(all_lines: Column) -> Column:
        after = lambda x, i: (x["level"] == 0) & x["body"].rlike(ATTRIBUTION) & (F.coalesce(F.get(all_lines, i + 1)["level"], F.lit(0)) > 0)
        return F.transform(all_lines, lambda x, i: F.struct(F.when(after(x, i), -1).otherwise(x["level"]).alias("level"), x["body"].alias("body"), x["line"].alias("line")))

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), parse), introduced)


def places(flags: Column) -> Column:
    """Where an array of booleans is true."""
    return F.filter(F.transform(flags, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())


def passages_of(lines: Column) -> Column:
    """array<struct<level, run, end, a, b, body>> of the quoted runs, of their paragraphs and of their lines where a run has several.

    The run goes from line run to before end, the passage from a to before b.
    """

    def passages(ls: Column) -> Column:
        n = F.size(ls)
        level = lambda i: F.coalesce(F.get(ls, i)["level"], F.lit(-2))
        full = lambda i: ~F.coalesce(F.get(ls, i)["body"].rlike(r"^[ \t]*$"), F.lit(True))
        row = lambda r, a, b: F.struct(level(a).alias("level"), r["a"].cast("int").alias("run"), r["b"].cast("int").alias("end"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.array_join(F.transform(F.slice(ls, a + 1, b - a), lambda x: x["body"]), "\n").alias("body"))
        new = places(F.transform(ls, lambda x, i: (i == 0) | (x["level"] != level(i - 1))))

        def cut(starts: Column) -> Column:
            bounds = F.filter(F.transform(starts, lambda a, k: F.struct(a.alias("a"), F.coalesce(F.get(starts, k + 1), n).alias("b"))), lambda r: level(r["a"]) > 0)
            # A paragraph begins at a line with text after one without, or at the run's first line.
            begins = places(F.transform(ls, lambda x, i: (x["level"] > 0) & full(i) & ((level(i - 1) != x["level"]) | ~full(i - 1))))
            ends = places(F.transform(ls, lambda x, i: (x["level"] > 0) & full(i) & ((level(i + 1) != x["level"]) | ~full(i + 1))))
            spans = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), (b + 1).alias("b")))

            def of_run(r: Column) -> Column:
                paragraphs = F.filter(spans, lambda p: (p["a"] >= r["a"]) & (p["b"] <= r["b"]))
                several = lambda ps: F.when(F.size(ps) > 1, F.transform(ps, lambda p: row(r, p["a"], p["b"]))).otherwise(F.array().cast(kind))
                single = F.when(r["b"] - r["a"] > 1, F.transform(F.sequence(r["a"], r["b"] - 1), lambda i: row(r, i, i + 1))).otherwise(F.array().cast(kind))
                return F.concat(F.array(row(r, r["a"], r["b"])), let(paragraphs, several), single)

            return F.flatten(F.transform(bounds, of_run))

        kind = "array<struct<level:int,run:int,end:int,a:int,b:int,body:string>>"
        return let(new, cut)

    return let(lines, passages)


def joined(lines: Column) -> Column:
    return F.btrim(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\n"))


def own_text(lines: Column) -> Column:
    """The text without quotes and their introductions."""
    return joined(F.filter(lines, lambda x: x["level"] == 0))


def unlinked(lines: Column, linked: Column) -> Column:
    """The text without the lines of linked passages (array<struct<a, b, run, end>>, or null) and what introduces them.

    Quoted lines without text go with anything that is linked of their run.
    """

    def gone(i: Column) -> Column:
        empty = F.get(lines, i)["body"].rlike(r"^[ \t]*$")
        return F.coalesce(F.exists(linked, lambda r: ((r["a"] <= i) & (i < r["b"])) | (empty & (r["run"] <= i) & (i < r["end"]))), F.lit(False))

    return joined(F.filter(lines, lambda x, i: (x["level"] == 0) | ((x["level"] > 0) & ~gone(i)) | ((x["level"] < 0) & ~gone(i + 1))))


def link(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n_quotes, n_linked, reply_to): texts without linked quotes, and who is answered."""
    cut = messages.select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("wording"), lines_of(F.col("text")).alias("lines"))
    cut = cut.withColumns({"own": own_text(F.col("lines")), "passages": passages_of(F.col("lines"))})
    each = cut.select("conv_id", "turn", "wording", F.explode("passages").alias("p")).select("conv_id", "turn", "wording", "p.level", "p.run", "p.end", "p.a", "p.b", normal(F.col("p.body")).alias("body")).where("body <> ''")
    quotes = each.select("conv_id", "turn", "wording", "level", "run", "end", "a", "b", F.md5("body").alias("hash"), F.size(F.split("body", " ")).alias("words")).distinct()
    quoting = quotes.select("conv_id").distinct()
    own = cut.join(quoting, "conv_id", "left_semi").where("own <> ''").select("conv_id", "turn", F.explode(F.array_distinct(F.concat(F.array("own"), F.split("own", "\n"), F.split("own", PARAGRAPH)))).alias("body"))
    first = own.select("conv_id", "turn", normal(F.col("body")).alias("body")).where("body <> ''").groupBy("conv_id", F.md5("body").alias("hash")).agg(F.min("turn").alias("origin"))
    linked = quotes.join(first, ["conv_id", "hash"]).where("origin < turn")
    best = F.max(F.struct((-F.col("level")).alias("level"), "words", "origin"))["origin"]
    answered = linked.groupBy("conv_id", "turn").agg(best.alias("quoted_turn"))
    # Of a run that is linked whole nothing smaller need be told.
    runs = linked.groupBy("conv_id", "turn", "wording", "run").agg(F.max(F.struct((F.col("b") - F.col("a")).alias("size"), "a", "b")).alias("most"), F.collect_set(F.struct("a", "b", "run", "end")).alias("spans"))
    told = F.when(F.col("most.a") == F.col("run"), F.filter("spans", lambda r: (r["a"] < F.col("most.a")) | (r["b"] > F.col("most.b")) | ((r["a"] == F.col("most.a")) & (r["b"] == F.col("most.b"))))).otherwise(F.col("spans"))
    covered = runs.groupBy("conv_id", "turn", "wording").agg(F.flatten(F.collect_list(told)).alias("linked"), F.count("*").alias("n_linked"))
    before = messages.where("conv_id is not null and turn is not null").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("follows")).distinct()
    out = cut.join(covered, ["conv_id", "turn", "wording"], "left").join(answered, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
    reply = F.coalesce("quoted_turn", F.when(F.col("follows"), F.col("turn") - 1))
    n_quotes = F.size(F.array_distinct(F.transform("passages", lambda p: p["run"]))).cast("long")
    return out.select("conv_id", "turn", "role", unlinked(F.col("lines"), F.col("linked")).alias("text"), n_quotes.alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), reply.alias("reply_to"))


def threads(linked: DataFrame, scratch: Scratch, max_rounds: int = 64) -> DataFrame:
    """Rows (conv_id, turn, thread, depth) for each distinct (conv_id, turn); thread: the turn that opened it.

    Rows that have reached their thread's first message are set aside, so a round costs what is left to do.
    """
    start = linked.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("up"))
    root = F.col("up").isNull()
    start = scratch.keep(start.select("conv_id", "turn", F.coalesce("up", "turn").alias("up"), F.when(root, 0).otherwise(1).cast("long").alias("depth"), root.alias("settled")))
    done, going = start.where("settled"), start.where("not settled")
    for _ in range(max_rounds):
        above = done.unionByName(going).select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), "settled")
        moved = going.drop("settled").join(above, ["conv_id", "up"])
        new = scratch.keep(moved.select("conv_id", "turn", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), "settled"))
        done, going = done.unionByName(new.where("settled")), new.where("not settled")
        if going.isEmpty():
            return done.select("conv_id", "turn", F.col("up").alias("thread"), "depth")
    raise RuntimeError(f"threads did not settle in {max_rounds} rounds")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, thread, turn, depth, reply_to, role, text, n_quotes, n_linked); sort by (conv_id, thread, turn)."""
    scratch = Scratch(messages.sparkSession, "quotation")
    linked = scratch.keep(link(messages))
    out = linked.join(threads(linked, scratch), ["conv_id", "turn"], "left")
    return out.select("conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", F.coalesce("depth", F.lit(0)).alias("depth"), "reply_to", "role", "text", "n_quotes", "n_linked")


def op7_quotation_linking(spark, sf_dir):
    return reply_ordered(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations
), l0 AS (
  SELECT rid, conv_id, turn, i, regexp_extract(ls[i], '^[ >]*> ?', 0) AS mark, regexp_replace(ls[i], '^[ >]*> ?', '') AS body
  FROM m, unnest(range(1, len(ls) + 1)) AS u(i)
), l1 AS (
  SELECT *, length(mark) - length(replace(mark, '>', '')) AS lv0 FROM l0
), l2 AS (
  SELECT *, CASE WHEN lv0 = 0 AND regexp_matches(body, '^ *On .* wrote: *$') AND coalesce(lead(lv0) OVER (PARTITION BY rid ORDER BY i), 0) > 0
            THEN -1 ELSE lv0 END AS level FROM l1
), l3 AS (
  SELECT *, i - row_number() OVER (PARTITION BY rid, level ORDER BY i) AS grp, regexp_matches(body, '^[ \t]*$') AS blank FROM l2
), l4 AS (
  SELECT *, min(i) OVER (PARTITION BY rid, level, grp) AS run, sum(blank::INT) OVER (PARTITION BY rid, level, grp ORDER BY i) AS para FROM l3 WHERE level > 0
), quoted AS (
  SELECT rid, conv_id, turn, level, run, min(i) AS a, max(i) AS b, string_agg(body, chr(10) ORDER BY i) AS body FROM l4 GROUP BY rid, conv_id, turn, level, run
  UNION ALL
  SELECT rid, conv_id, turn, level, run, min(i), max(i), string_agg(body, chr(10) ORDER BY i) FROM l4 WHERE NOT blank GROUP BY rid, conv_id, turn, level, run, para
  UNION ALL
  SELECT rid, conv_id, turn, level, run, i, i, body FROM l4
), nq AS (
  SELECT rid, count(DISTINCT run) AS n FROM l4 GROUP BY rid
), q AS (
  SELECT *, trim(regexp_replace(lower(body), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM quoted
), bare AS (
  SELECT rid, conv_id, turn, trim(string_agg(ls[i], chr(10) ORDER BY i), chr(10)) AS text FROM l2 JOIN (SELECT rid, ls FROM m) USING (rid) WHERE level = 0 GROUP BY rid, conv_id, turn
), piece AS (
  SELECT conv_id, turn, unnest(list_concat([text], string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t]*\n'))) AS body FROM bare WHERE text <> ''
), origin AS (
  SELECT conv_id, trim(regexp_replace(lower(body), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm, min(turn) AS origin FROM piece GROUP BY 1, 2
), hit AS (
  SELECT q.*, origin FROM q JOIN origin o ON q.conv_id = o.conv_id AND q.norm = o.norm AND q.norm <> '' AND o.origin < q.turn
), ans AS (
  SELECT conv_id, turn, arg_max(origin, (-level, len(string_split(norm, ' ')), origin)) AS quoted_turn FROM hit GROUP BY 1, 2
), nl AS (
  SELECT rid, count(DISTINCT run) AS n_linked FROM hit GROUP BY 1
), gone AS (
  SELECT DISTINCT l4.rid, l4.i FROM l4 JOIN hit ON hit.rid = l4.rid AND (l4.i BETWEEN hit.a AND hit.b OR l4.blank AND l4.run = hit.run)
), own AS (
  SELECT m.rid, m.conv_id, m.turn, m.role, trim(coalesce(o.t, ''), chr(10)) AS text
  FROM m LEFT JOIN (
    SELECT l2.rid, string_agg(m.ls[l2.i], chr(10) ORDER BY l2.i) AS t FROM l2 JOIN m USING (rid) LEFT JOIN gone ON gone.rid = l2.rid AND gone.i = CASE WHEN l2.level < 0 THEN l2.i + 1 ELSE l2.i END WHERE gone.i IS NULL OR l2.level = 0 GROUP BY l2.rid
  ) o USING (rid)
), prev AS (
  SELECT DISTINCT conv_id, turn + 1 AS turn FROM conversations
), linked AS (
  SELECT own.conv_id, own.turn, own.role, own.text, coalesce(nq.n, 0)::BIGINT AS n_quotes, coalesce(nl.n_linked, 0)::BIGINT AS n_linked,
         coalesce(quoted_turn, CASE WHEN prev.turn IS NOT NULL THEN own.turn - 1 END)::BIGINT AS reply_to
  FROM own LEFT JOIN nq USING (rid) LEFT JOIN nl USING (rid) LEFT JOIN ans ON ans.conv_id = own.conv_id AND ans.turn = own.turn
  LEFT JOIN prev ON prev.conv_id = own.conv_id AND prev.turn = own.turn
), node AS (
  SELECT conv_id, turn, min(reply_to) AS up FROM linked GROUP BY 1, 2
), tree AS (
  SELECT conv_id, turn, turn AS thread, 0::BIGINT AS depth FROM node WHERE up IS NULL
  UNION ALL
  SELECT n.conv_id, n.turn, t.thread, t.depth + 1 FROM node n JOIN tree t ON n.conv_id = t.conv_id AND n.up = t.turn
)
SELECT l.conv_id, thread, l.turn, depth, reply_to, role, text, n_quotes, n_linked
FROM linked l JOIN tree t ON t.conv_id = l.conv_id AND t.turn = l.turn
"""

QUERIES = {"op7_quotation_linking": op7_quotation_linking}
ORACLES = {"op7_quotation_linking": ORACLE}
