r"""WARC derivative builder: from response records, linked metadata and plain-text conversion records.

`derive` makes, for every response, one `metadata` record (application/warc-fields: status, source headers, digests,
title, counts) and one `conversion` record (text/plain). Both name the response in WARC-Refers-To and each other in
WARC-Concurrent-To, and carry the response's target URI, date and payload digest: the one that the source states, else
the sha256 of the payload's bytes. Record ids follow from the response's id, so a task that runs again makes the same
records. `write_warc` writes them as WARC/1.1 text through Spark's text writer. No shuffle, at any size: pages become
text in Arrow batches, in time in proportion to their length, and the records are built-in expressions.

A page is decoded by the charset of its Content-Type header, else of a meta tag in its first 1024 bytes, else as UTF-8;
what does not decode becomes U+FFFD. Comments and hidden elements go; where one is not closed, only its tag goes, as any
tag does. Character references that end in a semicolon are decoded once, by number or by the full table of names.

Nulls: a null payload is an empty one; a null target URI leaves the header out. Responses without an id get one from
their target and payload. Repeated responses give repeated records with equal ids, so there are no ties. Very long pages
are read whole, one at a time. An empty table gives no records. Extra columns of the responses are kept in `derive`'s
rows, save those whose names clash with a record's column.
"""

from __future__ import annotations

import re
from functools import cache
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from sightline.llm.kernels import text_slices
from sightline.tables import bounded_batches, table

#: Elements whose content is not text, and elements that break lines.
HIDDEN = ["script", "style", "noscript", "template", "head"]
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"

CLOSE = {name: re.compile(rf"</{name}\s*>", re.A | re.I) for name in HIDDEN} | {"!": re.compile("-->")}
BLOCK = re.compile(rf"</?(?:{BLOCKS})(?:\s[^>]*)?/?>", re.A | re.I)
TAG, OPEN_TAG = re.compile("</?[a-zA-Z!?][^>]*>"), re.compile("</?[a-zA-Z!?]")
BLOCK_NAME = re.compile(rf"</?(?:{BLOCKS})(?=[\s/>])", re.A | re.I)
BLANKS = re.compile("[\t\n\x0b\x0c\r ]+")
KEEPS = re.compile(r"<(pre|textarea)(?=[\s/>])", re.A | re.I)
KEPT = {name: re.compile(rf"</{name}\s*>", re.A | re.I) for name in ("pre", "textarea")}
#: A quoted attribute value with a > in it, or one that may have one; and what a tag's end is looked for among.
QUOTED, MARK = re.compile(r"""=\s*(?:"[^"<>]*>|'[^'<>]*>)"""), re.compile("[>\"']")
REFERENCE = re.compile("&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]{1,31}));")
CHARSET = re.compile(rb"""charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.I)


@cache
def opener(names: frozenset) -> re.Pattern:
    """Begin of a comment ("!") or of one of the hidden elements named."""
    parts = ["<!--"] * ("!" in names) + [rf"<({'|'.join(sorted(names - {'!'}))})(?:\s[^>]*)?>"] * bool(names - {"!"})
    return re.compile("|".join(parts), re.A | re.I)


def visible(body: str) -> str:
    """A text without comments and hidden elements. A kind of which none is closed any more is not looked for again."""
    out, at, names = [], 0, frozenset(CLOSE)
    start = 0
    while names and (found := opener(names).search(body, start)):
        name = (found[1] if found.lastindex else "!").lower()
        closed = CLOSE[name].search(body, found.end())
        if closed is None:
            names -= {name}
            start = found.start()
        else:
            out.append(body[at : found.start()])
            at = start = closed.end()
    return "".join([*out, body[at:]])


def character(found: re.Match) -> str:
    number, hexed, name = found.groups()
    if name:
        return html5.get(name + ";", found[0])
    code = int(number) if number else int(hexed, 16)
    return chr(code) if 1 <= code <= 0xD7FF or 0xE000 <= code <= 0x10FFFF else "\ufffd"


def unreferenced(text: str) -> str:
    return REFERENCE.sub(character, text) if "&" in text else text


def decoded(payload: bytes, head: str) -> str:
    """The characters of a page by its stated charset."""
    stated = CHARSET.search(head.encode()) or CHARSET.search(payload[:1024])
    try:
        return payload.decode(stated[1].decode() if stated else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def one_spaced(body: str) -> str:
    """A text with each run of white space as one space, but in elements that keep it."""
    out, at, names = [], 0, set(KEPT)
    while names and (found := KEEPS.search(body, at)):
        name = found[1].lower()
        closed = KEPT[name].search(body, found.end()) if name in names else None
        if closed is None:
            names.discard(name)
            out.append(BLANKS.sub(" ", body[at : found.end()]))
            at = found.end()
        else:
            out += [BLANKS.sub(" ", body[at : found.start()]), body[found.start() : closed.end()]]
            at = closed.end()
    return "".join([*out, BLANKS.sub(" ", body[at:])])


def untagged(body: str) -> str:
    """A text without its tags, block elements as line breaks."""
    if not QUOTED.search(body):
        return TAG.sub("", BLOCK.sub("\n", body))
    out, at, closing = [], 0, {'"': True, "'": True}  # whether there is a quote of the kind further on
    while found := OPEN_TAG.search(body, at):
        k = found.end()
        while mark := MARK.search(body, k):
            k = mark.end()
            if mark[0] == ">":
                break
            if closing[mark[0]] and body[found.start() : mark.start()].rstrip().endswith("="):
                end = body.find(mark[0], k)
                closing[mark[0]] = end >= 0
                k = end + 1 if end >= 0 else k
        if not mark:  # its end is within a quoted value: the first > ends it
            k = body.find(">", found.end()) + 1 or len(body)
        out += [body[at : found.start()], "\n" if BLOCK_NAME.match(body, found.start()) else ""]
        at = k
    return "".join([*out, body[at:]])


def page_text(html: str) -> tuple[str, str]:
    """(text, title) of an HTML page: hidden elements and comments go, block elements break lines, references are decoded."""
    stop = html.rfind(">") + 1  # no tag is closed beyond
    body = untagged(one_spaced(visible(html[:stop])))
    rest = BLANKS.sub(" ", html[stop:])
    if cut := OPEN_TAG.search(rest):
        rest = rest[: cut.start()]
    text = re.sub("[\\x09\\x0B-\\x0D\\x20\u00a0]+", " ", unreferenced(body + rest))
    text = re.sub(" ?\n[ \n]*", "\n", text).strip(" \n")
    title = ""
    if (begin := re.search("<title[^>]*>", html, re.I)) and (end := re.search("</title", html[begin.end() :], re.I)):
        title = re.sub("[\\x20\\x09-\\x0D]+", " ", unreferenced(html[begin.end() : begin.end() + end.start()])).strip(" ")
    return text, title


def with_text(responses: DataFrame) -> DataFrame:
    """Replace __payload (binary) and __head (string), the last columns, by __text and __title."""
    bounded_batches(responses.sparkSession)

    def run(stream):
        for batch in stream:
            n = batch.num_columns
            for (first, rows), payloads in text_slices(batch, n - 2):
                part = batch.slice(first, rows)
                made = [page_text(decoded(x, h or "")) for x, h in zip(payloads, part.column(n - 1).to_pylist(), strict=True)]
                columns = [pa.array([m[k].encode("utf-8", "replace").decode() for m in made], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[: n - 2], *columns], names=[*batch.schema.names[: n - 2], "__text", "__title"])

    fields = [T.StructField(f.name, f.dataType, True) for f in responses.schema.fields[:-2]]
    return responses.mapInArrow(run, T.StructType([*fields, T.StructField("__text", T.StringType()), T.StructField("__title", T.StringType())]))


def urn(seed: Column) -> Column:
    """A urn:uuid of the name-based kind from the md5 of a seed."""
    h = F.md5(seed)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def responses_of(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a crawl table (page_id, url, html), for stores that keep pages without records."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n"))
    return pages.select("page_id", urn(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), digest(body))).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), head.alias("http_head"), F.col("html").alias("payload"))


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response, record_type metadata and conversion.

    Reads record_id, target_uri, warc_date, http_head (status line and headers), payload (text or bytes) and, where they
    are there, source_payload_digest and source_block_digest. Adds: record_type, derived_id, refers_to, concurrent_to,
    content_type, block, block_digest, payload_digest (the response's), source_headers (as they came).
    """
    given = lambda name: F.col(name) if name in responses.columns else F.lit(None).cast("string")
    made = responses.withColumns({"__digest": F.coalesce(given("source_payload_digest"), digest(F.col("payload"))), "__source_block": given("source_block_digest")})
    own = F.coalesce("record_id", urn(F.concat_ws("|", F.coalesce("target_uri", F.lit("")), digest(F.col("payload")))))
    made = made.withColumns({"__id": own, "__heads": F.filter(F.split(F.coalesce("http_head", F.lit("")), "\r\n"), lambda x: x != "")})
    made = with_text(made.select(*[c for c in made.columns if c != "payload"], F.col("payload").cast("binary").alias("__payload"), F.col("http_head").alias("__head")))
    made = made.withColumns({"__meta_id": urn(F.concat(F.col("__id"), F.lit("|metadata"))), "__conv_id": urn(F.concat(F.col("__id"), F.lit("|conversion")))})
    header = F.array_join(F.transform(F.slice(F.col("__heads"), F.lit(2), F.greatest(F.size("__heads") - 1, F.lit(0))), lambda x: F.concat(F.lit("source-header: "), x, F.lit("\r\n"))), "")
    status = F.coalesce(F.get("__heads", F.lit(0)), F.lit(""))
    fields = F.concat(F.lit("source-status: "), status, F.lit("\r\n"), header, F.lit("source-payload-digest: "), F.col("__digest"), F.lit("\r\n"), F.when(F.col("__source_block").isNotNull(), F.concat(F.lit("source-block-digest: "), F.col("__source_block"), F.lit("\r\n"))).otherwise(""), F.lit("title: "), F.col("__title"), F.lit("\r\ntext-length: "), F.octet_length("__text").cast("string"), F.lit("\r\n"))
    record = lambda kind, own, other, mime, block: F.struct(F.lit(kind).alias("record_type"), F.col(own).alias("derived_id"), F.col(other).alias("concurrent_to"), F.lit(mime).alias("content_type"), block.alias("block"))
    both = F.array(record("metadata", "__meta_id", "__conv_id", "application/warc-fields", fields), record("conversion", "__conv_id", "__meta_id", "text/plain; charset=UTF-8", F.col("__text")))
    names = ["record_type", "derived_id", "concurrent_to", "content_type", "block"]
    fresh = {*names, "refers_to", "block_digest", "payload_digest", "source_headers", "record_id", "payload", "http_head", "source_payload_digest", "source_block_digest"}
    kept = [c for c in responses.columns if c not in fresh]
    out = made.select(*kept, F.col("__id").alias("refers_to"), F.col("__digest").alias("payload_digest"), F.col("http_head").alias("source_headers"), F.explode(both).alias("__r"))
    return out.select(*kept, "refers_to", "payload_digest", "source_headers", *[F.col(f"__r.{n}").alias(n) for n in names]).withColumn("block_digest", digest(F.col("block")))


def warc_text(records: DataFrame) -> DataFrame:
    """One string column `value`: each record as WARC/1.1 text, without the blank lines that end it."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    parts = [F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("derived_id")), line("WARC-Date", F.col("warc_date")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Refers-To", F.col("refers_to")), line("WARC-Concurrent-To", F.col("concurrent_to")), line("WARC-Payload-Digest", F.col("payload_digest")), line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.octet_length("block").cast("string"))]
    return records.select(F.concat(*parts, F.lit("\r\n"), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write derived records as gzipped WARC files, one per partition, by Spark's commit protocol."""
    warc_text(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read_responses(spark, path: str, version: str = "WARC/1.1") -> DataFrame:
    """Response records of WARC files: record_id, target_uri, warc_date, http_head, payload (bytes), complete,
    source_payload_digest, source_block_digest.

    Spark's text reader cuts the files at the version line, so plain files are split among tasks and gzipped ones are
    streamed; no file is held in memory. Payloads keep their bytes. `complete` is false where the block is shorter or
    longer than its Content-Length says, as when a payload holds a version line of its own; callers decide what to do
    with those.
    """
    raw = spark.read.option("lineSep", version + "\r\n").text(path).where("value <> ''")
    at = F.instr("value", "\r\n\r\n")
    cut = raw.where(at > 0).select(F.expr("left(value, instr(value, '\r\n\r\n') - 1)").alias("head"), F.expr("cast(substr(value, instr(value, '\r\n\r\n') + 4) AS binary)").alias("rest"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    seen = cut.where(F.lower(field("WARC-Type")) == "response").withColumn("size", field("Content-Length").try_cast("long"))
    # A record ends in two line ends, which a file's last record may lack.
    bare = F.expr("CASE WHEN right(hex(rest), 8) = '0D0A0D0A' THEN substring(rest, 1, octet_length(rest) - 4) ELSE rest END")
    whole = F.coalesce(F.octet_length("rest").isin(F.col("size"), F.col("size") + 4), F.lit(False))
    seen = seen.withColumns({"complete": whole, "block": F.when(whole, F.expr("substring(rest, 1, int(size))")).otherwise(bare)})
    split = F.expr("instr(decode(block, 'ISO-8859-1'), '\r\n\r\n')")  # one character a byte
    return seen.withColumn("split", split).select(
        field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("target_uri"), field("WARC-Date").alias("warc_date"),
        F.expr("decode(CASE WHEN split > 0 THEN substring(block, 1, split + 1) ELSE block END, 'ISO-8859-1')").alias("http_head"),
        F.expr("CASE WHEN split > 0 THEN substring(block, split + 4) ELSE X'' END").alias("payload"), "complete",
        field("WARC-Payload-Digest").alias("source_payload_digest"), field("WARC-Block-Digest").alias("source_block_digest"),
    )


def op1_warc_derivatives(spark, sf_dir):
    records = derive(responses_of(table(spark, sf_dir, "pages")))
    return records.select("page_id", "record_type", "derived_id", "refers_to", "concurrent_to", "target_uri", "content_type", "source_headers", "payload_digest", "block_digest", "block")


#: Comments and hidden elements, as one pattern.
_UNSEEN = "(?is)<!--.*?-->|" + "|".join(rf"<{name}(?:\s[^>]*)?>.*?</{name}\s*>" for name in HIDDEN)
_NAMES = [name for name in html5 if name.endswith(";")]
_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_TABLE = "MAP {" + ", ".join(f"{_QUOTED('&' + n)}: {_QUOTED(html5[n])}" for n in _NAMES) + "}"
_VALID = "n BETWEEN 1 AND 55295 OR n BETWEEN 57344 AND 1114111"
_CHAR = f"(SELECT CASE WHEN {_VALID} THEN chr(n::INT) ELSE chr(65533) END FROM (SELECT {{}} AS n))"
_PIECE = f"""CASE WHEN x[1] <> '&' OR x = '&' THEN x WHEN regexp_matches(x, '^&#[0-9]') THEN {_CHAR.format("TRY_CAST(x[3:-2] AS BIGINT)")}
 WHEN x[2] = '#' THEN {_CHAR.format("TRY_CAST('0x' || x[4:-2] AS BIGINT)")} ELSE coalesce(refs.t[x], x) END"""


def _unreferenced(text: str) -> str:
    found = f"regexp_extract_all({text}, '&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,31}});|[^&]+|&')"
    return f"(SELECT coalesce(string_agg({_PIECE}, '' ORDER BY i), '') FROM (SELECT unnest({found}) AS x, generate_subscripts({found}, 1) AS i), refs)"


# The given pages have neither elements that keep white space nor a > in attribute values; tests do.
_HTML = f"regexp_replace(coalesce(html, ''), '{_UNSEEN}', '', 'g')"
_HTML = rf"regexp_replace({_HTML}, '[\x09-\x0D\x20]+', ' ', 'g')"
_HTML = rf"regexp_replace({_HTML}, '(?i)</?(?:{BLOCKS})(?:\s[^>]*)?/?>', chr(10), 'g')"
_HTML = f"regexp_replace(regexp_replace({_HTML}, '</?[a-zA-Z!?][^>]*>', '', 'g'), '</?[a-zA-Z!?][^>]*$', '', 'g')"
_TITLE = "regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title', 1)"


def _urn(seed: str) -> str:
    return f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-8' || h[18:20] || '-' || h[21:32] || '>' FROM (SELECT md5({seed}) AS h))"


ORACLE = rf"""
WITH refs AS (SELECT {_TABLE} AS t), h AS (SELECT page_id, url, html, {_HTML} AS bare, {_TITLE} AS named FROM pages
), g AS (SELECT page_id, url, html, {_unreferenced("bare")} AS clean, {_unreferenced("named")} AS title FROM h
), a AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(clean, '[\x09\x0B-\x0D\x20\x{{A0}}]+', ' ', 'g'), '[ \n]*\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS txt,
         'sha256:' || sha256(coalesce(html, '')) AS dig, trim(regexp_replace(title, '[\x20\x09-\x0D]+', ' ', 'g')) AS title,
         'Content-Type: text/html; charset=utf-8' AS h1, 'Content-Length: ' || strlen(coalesce(html, '')) AS h2
  FROM g
), b AS (SELECT *, {_urn("coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '') || '|' || dig")} AS id FROM a
), c AS (SELECT *, {_urn("id || '|metadata'")} AS mid, {_urn("id || '|conversion'")} AS cid FROM b
), r AS (
  SELECT page_id, 'metadata' AS record_type, mid AS derived_id, id AS refers_to, cid AS concurrent_to, url AS target_uri, 'application/warc-fields' AS content_type,
         'HTTP/1.1 200 OK' || e'\r\n' || h1 || e'\r\n' || h2 || e'\r\n' AS source_headers, dig AS payload_digest,
         'source-status: HTTP/1.1 200 OK' || e'\r\n' || 'source-header: ' || h1 || e'\r\n' || 'source-header: ' || h2 || e'\r\n' || 'source-payload-digest: ' || dig || e'\r\n'
           || 'title: ' || title || e'\r\n' || 'text-length: ' || strlen(txt) || e'\r\n' AS block
  FROM c
  UNION ALL
  SELECT page_id, 'conversion', cid, id, mid, url, 'text/plain; charset=UTF-8', 'HTTP/1.1 200 OK' || e'\r\n' || h1 || e'\r\n' || h2 || e'\r\n', dig, txt FROM c
)
SELECT *, 'sha256:' || sha256(block) AS block_digest FROM r
"""

QUERIES = {"op1_warc_derivatives": op1_warc_derivatives}
ORACLES = {"op1_warc_derivatives": ORACLE}
