"""Operators over pages, and the pipeline, against brute force."""

import base64
import hashlib

import pytest
from tokenizers import Tokenizer

from strandlake.llm import html_text, warc
from strandlake.session import ship

PAGES = [
    (0, "http://a/0", "<p>one</p>"),
    (1, "http://a/1", "<p>one</p>"),
    (2, None, None),
    (3, "http://a/3", ""),
    (4, "http://a/4\r\nX: y", "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"),
    (5, "http://a/5", "before WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nafter\r\n\r\n\n\n"),
    (6, "http://a/6", "WARC/1.1\r\n"),
    (7, "http://a/7", "WARC/1.1\r\nWARC/1.1\r\n\r\n\r\n"),
    (8, "http://a/8", "é日本\n\r\n" * 3000),
    (9, "http://a/9", "é日本\n\r\n" * 3000),
    (10, "http://a/10", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:0>\r\nContent-Length: 999999\r\n\r\n"),
] + [(k, f"http://a/{k}", f"<p>{k % 17}</p>") for k in range(11, 80)]


@pytest.fixture(scope="module")
def pages(spark):
    ship(spark)
    rows = [(*p, "x", 1) for p in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, id string, digest int").repartition(3)


def test_warc_round_trip(spark, pages, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_warc(pages, path)
    first = {}
    for i, _, h in PAGES:
        first.setdefault(h or "", i)
    want = {}
    for i, _, h in PAGES:
        raw = (h or "").encode()
        again = first[h or ""] != i
        want[str(i)] = ("revisit" if again else "response", str(first[h or ""]) if again else None, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(PAGES)
    assert {r["name"]: (r["type"], r["refers_name"], r["payload_bytes"], r["payload_digest"]) for r in got} == want


def test_warc_keeps_rows_apart_whose_identifiers_clash(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>a</p>"), (1, "http://a/1", "<p>a</p>"), (2, "http://a/2", "<p>a</p>"), (3, "http://a/3", "<p>b</p>"), (3, "http://a/3b", "<p>c</p>")]
    rows += [(None, None, "<p>b</p>"), (None, "u", "<p>d</p>"), (7, "http://a/7", None), (7, "http://b/7", ""), (7, "http://b/7", "")]
    path = str(tmp_path / "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    got = warc.read_warc(spark, path).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((r["name"], r["payload_digest"], r["payload_bytes"]) for r in got) == sorted((str(i or ""), sha(h), len(h or "")) for i, _, h in rows)
    by = {}
    for r in got:
        by.setdefault(r["payload_digest"], []).append((r["type"], r["name"], r["refers_name"]))
    first = {sha("<p>a</p>"): "1", sha("<p>b</p>"): "3", sha("<p>c</p>"): "3", sha("<p>d</p>"): "", sha(""): "7"}
    for digest, rs in by.items():
        assert [(n, f) for t, n, f in rs if t == "response"] == [(first[digest], None)]
        assert all(f == first[digest] for t, _, f in rs if t == "revisit")


def test_warc_least_bytes(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    path = str(tmp_path / "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, min_bytes=3)
    got = sorted((r["name"], r["type"], r["payload_bytes"]) for r in warc.read_warc(spark, path).collect())
    assert got == [("1", "response", 2), ("2", "response", 2), ("2", "response", 2), ("3", "response", 6), ("4", "revisit", 6)]


def test_warc_with_many_magics_in_payloads(spark, tmp_path):
    """Whole records inside payloads, one that ends where the outer record ends, and a magic at every edge."""
    inner = lambda n, body: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: {n}\r\n\r\n{body}"
    bodies = ["x", inner(2, "ab") + "\r\n\r\n", inner(2, "ab"), "pre" + inner(2, "ab") + "\r\n\r\n" + inner(1, "z") + "\r\n\r\n", "WARC/1.1\r\n" * 5, inner(10**6, "q"), inner(0, ""), "y", inner(2, "ab") * 3]
    rows = [(i, "u", b + ("" if i < 9 else str(i))) for i, b in enumerate(bodies * 4)]
    path = str(tmp_path / "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {str(i): (len(b.encode()), base64.b32encode(hashlib.sha1(b.encode()).digest()).decode()) for i, _, b in rows}
    assert len(got) == len(rows) and {r["name"]: (r["payload_bytes"], r["payload_digest"]) for r in got} == want


def test_warc_of_nothing(spark, pages, tmp_path):
    path = str(tmp_path / "none")
    warc.write_warc(pages.where("page_id < 0"), path)
    assert warc.read_warc(spark, path).collect() == []


def test_warc_stops_at_a_broken_record(spark, tmp_path):
    record = lambda i, n, body: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {n}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record(1, 3, "abc") + record(2, 3, "abcd") + record(3, 1, "z")).encode())
    assert sorted(r["name"] for r in warc.read_warc(spark, str(tmp_path)).collect()) == ["1", "2"]


ARTICLE = "<h1>Title &amp; more</h1><p>First   paragraph\nof the <b>text</b>, long enough to matter.<p>Second &eacute; one<br>with a break, and some more words.</p>"
WANT = "Title & more\nFirst paragraph of the text, long enough to matter.\nSecond é one with a break, and some more words."
HEAD = ARTICLE.index("<p>")
NOISE = '<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now</div><div id="sidebar">side</div><form><input>send</form><script>var a="</p><p>no";</script><!-- gone --><footer>&copy; end</footer>'


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("<html><head><title>t</title></head><body></body></html>", ""),
        (f"<body>{NOISE}<article>{ARTICLE}</article>{NOISE}</body>", WANT),
        (f"<html><body>{NOISE}<article>{ARTICLE}", WANT),
        (f'<body>{NOISE}<div class="wrap"><div class="post">{ARTICLE}</div><div class="comments"><p>I disagree with all of it.</p></div></div></body>', WANT),
        (f'<body><header><a href="/">Site</a></header><main><header>{ARTICLE[:HEAD]}</header>{ARTICLE[HEAD:]}<aside>see also</aside></main></body>', WANT),
        ("plain words only", "plain words only"),
        ("<p>a < b and &lt;c&gt;</p>", "a < b and <c>"),
        ("<p>" * 3000 + "deep", "deep"),
        ("<script>never closed <p>x", ""),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_extract(spark, pages):
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert set(got) == {p[0] for p in PAGES}
    assert got[2]["text"] == "" and got[2]["url"] is None and got[0]["text"] == "one" and got[0]["n_chars"] == 3
    assert html_text.extract(pages.where("page_id < 0")).collect() == []
    twice = html_text.extract(pages.union(pages)).collect()
    assert len(twice) == 2 * len(PAGES) and len({tuple(r) for r in twice}) == len({tuple(r) for r in got.values()})


def test_pipeline(spark, corpus, docs, vocabulary, tmp_path):
    """Every stage against its rule, on what the stage before it kept."""
    import corpus_pipeline
    from test_documents import brute_components, brute_removals

    ship(spark)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    cols, now = plain.columns, plain
    texts = dict(corpus)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == cols
        kept = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "exact_dedup":
            best = {}
            for i, t in texts.items():
                best[t or ""] = max(i, best.get(t or "", -1))
            assert set(kept) == set(best.values())
        elif name == "ngram_join":
            assert set(kept) == {c for _, c in brute_components(sorted(texts.items()), 5, 80).values()}
        elif name == "substring_dedup":
            want = brute_removals(sorted(texts.items()), 35)
            assert {i: " ".join(t.split()) for i, t in kept.items()} == {i: " ".join(v[3].split()) for i, v in want.items()}
        assert kept and set(kept) <= set(texts)
        texts = kept
        now = spark.createDataFrame([(i, t, None, None, None) for i, t in kept.items()], plain.schema)
    path = str(tmp_path / "documents.parquet")
    plain.write.parquet(path)
    tok = Tokenizer.from_file(vocabulary)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == want
