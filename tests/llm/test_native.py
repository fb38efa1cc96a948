"""Quality rules, quotation linking, WARC derivatives and URL rules: against DuckDB, brute force and edge cases."""

import gzip
import hashlib
import random
import re
import time
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sightline.llm import quality_rules as Q, quotation as T, registry, url_rules as U, warc as W
from sightline.tables import Scratch
from tests.compare import connect, rows, sql_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert rows(registry.QUERIES[name](spark, sf)) == sql_rows(connect(sf), registry.ORACLES[name])


# Quality rules


def repeated(words, width=3):
    seen = {}
    for i in range(len(words) - width + 1):
        seen.setdefault(tuple(words[i : i + width]), []).append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + width)})


def test_repeats_match_brute_force(spark):
    R = random.Random(1)
    texts = [" ".join(R.choice("abcdefg"[: R.randint(1, 7)]) for _ in range(R.randint(0, 90))) for _ in range(150)]
    texts += [None, "", " \n ", "a a a a", "x " * 3000, " ".join(map(str, range(2000))) + " " + " ".join(map(str, range(2000)))]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in Q.ledger(docs).collect()}
    assert got == {i: (len(w), repeated(w)) for i, t in enumerate(texts) for w in [re.findall(r"[^\x20\x09-\x0D]+", t or "")]}


def test_ledger_policies_and_ablation(spark):
    texts = ["plain words of a text go on and on here " * 2 + "one%s" % i for i in range(3)] + ["#$% " * 60, "SHOUT " * 80, "", None]
    book = Q.ledger(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).cache()
    for policy in Q.POLICIES:
        kept = {r.doc_id for r in Q.apply_policy(book, policy).where("kept").collect()}
        bits = {r.doc_id: r.fail_bits for r in book.collect()}
        assert kept == {d for d, b in bits.items() if not b & Q.mask(policy)}
        got = {r.rule: (r.failing, r.failing_alone, r.kept_without) for r in Q.ablation(book, policy).collect()}
        m = Q.mask(policy)
        for k, rule in enumerate(Q.RULES):
            if m >> k & 1:
                held = [b & m for b in bits.values()]
                assert got[rule.name] == (sum(b >> k & 1 for b in held), held.count(1 << k), sum(not b & ~(1 << k) for b in held))
    assert Q.ledger(book.select("doc_id", F.lit("x").alias("text")).limit(0)).count() == 0


# Quotation linking

MESSAGES = [
    (1, 0, "a", "Shall we meet?\nAt noon, by the big door."),
    (1, 1, "b", "> Shall we meet?\nYes."),
    (1, 2, "c", "On Monday b wrote:\n> > at NOON,  by the\n> > big door.\n> Yes.\nI come too."),
    (1, 3, "d", "> At noon, by the big door.\nToo early."),
    (1, 4, "e", "> something nobody said\nHm."),
    (1, 6, "f", "No quote and no message before."),
    (2, 0, "a", None), (2, 1, "b", ""), (2, 1, "b", ""), (2, 2, "c", ">>>\n> > >\nplain > text"),
    (None, 0, "x", "> a"), (3, None, "x", "alone"),
]


def test_quotes_link_to_their_messages(spark):
    out = T.reply_ordered(spark.createDataFrame([(*m, 1) for m in MESSAGES], "conv_id long, turn long, role string, text string, thread int")).collect()
    assert len(out) == len(MESSAGES)
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth, r.text) for r in out}
    assert got[1, 0] == (None, 0, 0, "Shall we meet?\nAt noon, by the big door.")
    assert got[1, 1] == (0, 0, 1, "Yes.")
    assert got[1, 2] == (1, 0, 2, "I come too.")
    assert got[1, 3] == (0, 0, 1, "Too early.")
    assert got[1, 4] == (3, 0, 2, "> something nobody said\nHm.")
    assert got[1, 6] == (None, 6, 0, "No quote and no message before.")
    assert got[2, 2][0] == 1 and got[2, 2][3] == ">>>\n> > >\nplain > text"
    assert got[None, 0] == (None, 0, 0, "> a") and got[3, None][:3] == (None, None, 0)


def test_quotation_equals_its_sql_on_quoting_mail(spark):
    R = random.Random(3)
    lines = ["alpha beta", "Gamma  delta", "one", "two words", "", "alpha"]
    mail = []
    for c in range(40):
        said = []
        for t in range(R.randint(1, 6)):
            body = []
            for _ in range(R.randint(0, 5)):
                x = R.choice(lines)
                body.append(R.choice(["", "> ", ">> ", "> > "]) + (R.choice(R.choice(said).split("\n")) if said and R.random() < 0.5 else x))
            if R.random() < 0.2:
                body.insert(0, "On Monday x wrote:")
            said.append("\n".join(body))
            mail.append((c, t, "user", said[-1]))
    import duckdb
    import pandas as pd

    db = duckdb.connect()
    db.register("conversations", pd.DataFrame(mail, columns=["conv_id", "turn", "role", "text"]))
    ours = rows(T.reply_ordered(spark.createDataFrame(mail, "conv_id long, turn long, role string, text string")))
    assert ours == sql_rows(db, T.ORACLE)


def test_some_paragraphs_quoted_at_another_width(spark):
    first = "One long paragraph that was\nwrapped here.\n\nA second one that\nnobody quotes.\n\nThe third paragraph, also\nof two lines."
    reply = "> One long paragraph\n> that was wrapped here.\n>\n> The third\n> paragraph, also of two lines.\nAgreed."
    mail = [(1, 0, "a", first), (1, 1, "b", "Something else."), (1, 2, "c", reply)]
    got = {r.turn: (r.reply_to, r.n_linked, r.text) for r in T.reply_ordered(spark.createDataFrame(mail, "conv_id long, turn long, role string, text string")).collect()}
    assert got[2] == (0, 1, "Agreed.")


def test_quotes_of_nothing_stay(spark):
    """Only linked lines go, with what introduces them; runs are counted, not their lines."""
    mail = [
        (1, 0, "a", "First line.\nSecond line.\nThird line."),
        (1, 1, "b", ">>> print(1)\n> a citation from a book nobody posted\nSo it is."),
        (1, 2, "c", "On Monday a wrote:\n> First line.\n> Second line.\n> Third line.\nOn Tuesday x wrote:\n> Never heard\nYes."),
        (1, 3, "d", "> Second line.\n> which I doubt\n>\n> Third line.\nNo."),
    ]
    got = {r.turn: (r.reply_to, r.n_quotes, r.n_linked, r.text) for r in T.reply_ordered(spark.createDataFrame(mail, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1] == (0, 2, 0, ">>> print(1)\n> a citation from a book nobody posted\nSo it is.")
    assert got[2] == (0, 2, 1, "On Tuesday x wrote:\n> Never heard\nYes.")
    assert got[3] == (0, 1, 1, "> which I doubt\nNo.")


def test_one_huge_conversation_and_a_deep_chain(spark):
    n = 700
    mail = [(1, t, "u", f"message {t} of the chain" if t == 0 else f"> message {t - 1} of the chain\nmessage {t} of the chain") for t in range(n)] + [(2, t, "u", "> hello all\nsame words" if t else "hello all") for t in range(n)]
    got = {(r.conv_id, r.turn): (r.thread, r.depth, r.reply_to) for r in T.reply_ordered(spark.createDataFrame(mail, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[1, t] == (0, t, t - 1 if t else None) for t in range(n))
    assert all(got[2, t] == (0, min(t, 1), 0 if t else None) for t in range(n))


def test_empty_conversations(spark):
    assert T.reply_ordered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# WARC

PAGE = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no --><p>One&nbsp;two<br>three &#233;&#xE9; &#0; &lt;b&gt;</p><script>var t='</p>';</script><div>four <i>five</i></div><p"


def test_plain_text():
    got = [W.page_text(x)[0] for x in (PAGE, "", "no tags", "&#38;lt;b&#38;gt; &#38;amp; &#1234567; &#x; &eacute;&rsquo;&Sum;&am &amp")]
    assert got == ["One two\nthree éé � <b>\nfour five", "", "no tags", "&lt;b&gt; &amp; � &#x; é’∑&am &amp"]
    assert W.page_text(PAGE)[1] == "A & B"


def test_records_refer_and_files_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/x", PAGE), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    records = W.derive(W.responses_of(pages).withColumns({"block": F.lit("clash"), "r": F.lit("clash")}))
    got = records.collect()
    assert len(got) == 6 and {r.record_type for r in got} == {"metadata", "conversion"}
    by_id = {r.derived_id: r for r in got}
    assert all(by_id[r.concurrent_to].refers_to == r.refers_to and by_id[r.concurrent_to].record_type != r.record_type for r in got)
    meta = next(r for r in got if r.page_id == 1 and r.record_type == "metadata")
    assert "source-header: Content-Type: text/html; charset=utf-8\r\n" in meta.block and "title: A & B\r\n" in meta.block and meta.payload_digest in meta.block
    W.write_warc(records.coalesce(1), f"file://{tmp_path}/warc")
    raw = b"".join(gzip.open(p).read() for p in (tmp_path / "warc").iterdir() if p.suffix == ".gz")
    at, seen = 0, []
    while at < len(raw):
        head, _, _ = raw[at:].partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        start = at + len(head) + 4
        body = raw[start : start + int(fields["Content-Length"])]
        assert raw[start + len(body) : start + len(body) + 4] == b"\r\n\r\n"
        seen.append((fields["WARC-Record-ID"], fields["WARC-Refers-To"], body.decode()))
        at = start + len(body) + 4
    assert sorted(seen) == sorted((r.derived_id, r.refers_to, r.block) for r in got)
    assert W.derive(W.responses_of(pages.limit(0))).count() == 0


def test_responses_read_from_files(spark, tmp_path):
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>one</p>\r\n\r\n<p>zwei ü</p>"
    record = lambda kind, i, block, n=None: f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{i}>\r\nWARC-Target-URI: http://a/{i}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {n or len(block.encode())}\r\n\r\n{block}\r\n\r\n"
    text = record("warcinfo", 0, "software: x\r\n") + record("response", 1, http) + record("request", 2, "GET / HTTP/1.1\r\n\r\n") + record("response", 3, "HTTP/1.1 204 No Content\r\n\r\n") + record("response", 4, http, 5)
    (tmp_path / "a.warc").write_bytes(text.encode())
    with gzip.open(tmp_path / "b.warc.gz", "wb") as f:
        f.write(text.replace("urn:x:", "urn:z:").encode())
    got = {r.record_id: r for r in W.read_responses(spark, f"file://{tmp_path}").collect()}
    assert len(got) == 6
    for kind in "xz":
        one = got[f"<urn:{kind}:1>"]
        assert one.complete and bytes(one.payload).decode() == "<p>one</p>\r\n\r\n<p>zwei ü</p>" and one.http_head == "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"
        assert one.target_uri == "http://a/1" and got[f"<urn:{kind}:3>"].payload == b"" and not got[f"<urn:{kind}:4>"].complete
    meta = W.derive(W.read_responses(spark, f"file://{tmp_path}")).where("record_type = 'metadata'").collect()
    assert all("source-header: Content-Type: text/html\r\n" in r.block for r in meta if r.refers_to.endswith(":1>"))


def test_source_digests_and_bytes_are_kept(spark, tmp_path):
    body = "<title>Caf\u00e9</title><p>\u00fcber</p>".encode("latin-1")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:1>\r\nWARC-Payload-Digest: sha1:PAY\r\nWARC-Block-Digest: sha1:BLK\r\nContent-Length: {len(http)}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(head.encode() + http + b"\r\n\r\n")
    seen = W.read_responses(spark, f"file://{tmp_path}")
    (r,) = seen.collect()
    assert bytes(r.payload) == body and r.complete and (r.source_payload_digest, r.source_block_digest) == ("sha1:PAY", "sha1:BLK")
    made = {x.record_type: x for x in W.derive(seen).collect()}
    assert made["conversion"].block == "Caf\u00e9\n\u00fcber" and made["conversion"].payload_digest == made["metadata"].payload_digest == "sha1:PAY"
    assert "source-payload-digest: sha1:PAY\r\nsource-block-digest: sha1:BLK\r\ntitle: Caf\u00e9\r\n" in made["metadata"].block
    bare = {x.payload_digest for x in W.derive(seen.drop("source_payload_digest", "source_block_digest")).collect()}
    assert bare == {"sha256:" + hashlib.sha256(body).hexdigest()}


@pytest.mark.parametrize("bit", ["<!--", "<script>", "<script ", "<p ", "<title>", "&#", "<", "</script", "<template><!-- "])
def test_long_pages_take_time_in_proportion(bit):
    began = time.process_time()
    W.page_text(bit * (1_000_000 // len(bit)) + ">")
    assert time.process_time() - began < 5


# URL rules


def brute_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in U.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits, key=len, default=None)


URLS = ["http://A.Example.com/en/7?x", "https://example.com/en/8#y", "x.com/en/", None, "http://com/en/", "ftp://notcom/en/", "http://a.net/de/8", "http://example.net/de/8/z", "http://q.org/es", "http://q.org/es/", "://", "a://b://c/d", "http://\u0130.com/en/", "http://h:80/p\nq?r"]


def test_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(0, URLS[0], "again")], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = U.judge(pages, labels).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule = brute_rule(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (U.RULES[rule] if rule else "allow")


def test_fixed_rules_are_those_of_the_contract(spark):
    """Each rule's word as the contract gives it, not as the code has it, whatever the labels say."""
    want = {"http://a.com/en/1": "block", "http://example.com/en/7": "allow", "http://a.net/de/1": "allow", "http://example.net/de/7": "allow", "http://example.net/de/8": "block", "http://org/es/": "block"}
    pages = spark.createDataFrame([*enumerate(want)] + [(i, f"http://a.net/de/{i}") for i in range(100, 200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(100, 190)] + [(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    assert {u: r.verdict for r in U.judge(pages, labels, min_lift=1.0).collect() for i, u in enumerate(want) if r.page_id == i} == want


def test_mined_rules_match_brute_force(spark):
    R = random.Random(2)
    pages, labels = [], []
    for i in range(1500):
        spam = R.random() < 0.3
        host = R.choice(["casino", "pills"]) + "-" + R.choice(["win", "cheap"]) if spam and R.random() < 0.8 else R.choice(["news", "blog", "win", "shop"])
        pages.append((i, f"https://{host}.site.io/{R.choice(['a', 'b'])}/{i}?id={i}"))
        if i % 2:
            labels.append((i, 0 if spam else 1, R.choice([0, None])))
    p, l = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([*labels, (1, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    scratch = Scratch(spark, "test")
    labelled = U.labelled_urls(p, l, 10_000)
    mined = [set(r["items"]) for r in U.mine(labelled, scratch).collect()]
    assert {"h:casino"} in mined and {"h:pills"} in mined and not any(a < b for a in mined for b in mined)
    tokens = {r.page_id: set(r.t) for r in p.select("page_id", U.tokens_of(F.col("url")).alias("t")).collect()}
    got = {r.page_id: r.verdict for r in U.judge(p, l).collect()}
    assert got == {i: "block" if any(m <= t for m in mined) else "allow" for i, t in tokens.items()}


def test_mining_matches_brute_force(spark):
    R = random.Random(5)
    rows = [(sorted({R.choice("abcdef") for _ in range(4)}), R.random() < 0.2) for _ in range(600)]
    rows = [(t, bad or {"a", "b"} <= set(t) or "f" in t and R.random() < 0.9) for t, bad in rows]
    often, with_bad = Counter(), Counter()
    for t, bad in rows:
        for size in range(1, len(t) + 1):
            for some in combinations(t, size):
                often[some] += 1
                with_bad[some] += bad
    n, all_bad = len(rows), sum(bad for _, bad in rows)
    sure = {s: with_bad[s] / often[s] for s in often if with_bad[s] >= 20 and with_bad[s] / often[s] >= 0.8 and with_bad[s] / often[s] * n / all_bad >= 1.2}
    want = {s for s in sure if not any(set(r) < set(s) and sure[r] >= sure[s] for r in sure)}
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    got = {tuple(r["items"]): (r.confidence, r.support) for r in U.mine(labelled, Scratch(spark, "test")).collect()}
    assert len(want) > 1 and set(got) == want
    assert all(got[s] == pytest.approx((sure[s], with_bad[s] / n)) for s in want)


def test_very_long_urls(spark):
    index = spark.createDataFrame([("p:x#", ["h:io", "p:x#"], "r1"), ("p:none", ["p:none"], "r2"), ("p:only", ["h:com", "p:only"], "r0")], "token string, items array<string>, rule_id string")
    long = "/".join("x" + chr(97 + i % 26) * (i // 26 + 1) for i in range(1500))
    urls = [f"https://a.io/{long}/x7777/only", f"https://a.io/{long}", None, "https://b.io/x7777"]
    got = {(r.url, r.mined_rule) for r in U.match(spark.createDataFrame([(u,) for u in urls * 2], "url string"), index).collect()}
    assert got == {(urls[0], "r1"), (urls[3], "r1")}


def test_query_over_the_table(spark, sf):
    got = {r.page_id: (r.host, r.path, r.rule) for r in U.op4_url_filters(spark, sf).collect()}
    assert got == {r.page_id: brute_rule(r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert U.judge(spark.createDataFrame([], "page_id long, url string"), spark.read.parquet(f"{sf}/labels.parquet")).count() == 0


def test_white_space_and_attribute_values():
    text = lambda html: W.page_text(html)[0]
    assert text("<p>one\ntwo\r\n three</p>four") == "one two three\nfour"
    assert text("a<pre>x\n  y</pre>b\nc <textarea>d\ne</textarea>f\ng") == "a\nx\ny\nb c d\nef g"
    assert text('<a title="x > y">z</a> <p class=\'a>b\'>q') == "z\nq"
    assert text('<p title="no end>one</p> two "three') == "three" or text('<p title="no end>one</p> two "three').endswith("three")
    assert text("<p don't>it's</p> <b x='1'>so</b>") == "it's\nso"
    assert text("<pre>a\nb") == "a b"
    assert text("3 < 4 and\n<i>5 > 4</i>") == "3 < 4 and 5 > 4"


def test_pages_of_open_quotes_take_time_in_proportion():
    import time

    began = time.time()
    for page in ('<a x="' * 200_000 + ">", "<pre>" * 200_000 + ">", "<a x='y\" =\">" * 100_000, '<a x = "' * 100_000 + '">' * 2):
        W.page_text(page)
    assert time.time() - began < 20
