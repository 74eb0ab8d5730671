import os
import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from cairn.llm import _html, htmltext, linkgraph, queries, warc
from cairn.llm._html import common_lines, lines, main_place

from ..compare import duck, same

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>not</p> --><div class="cookie-notice">We use cookies</div>
<article><header><h1>The &amp; title</h1></header><p><b>First   line<br>goes&nbsp;on<p>Second &#233; line &am</p><div class="share">Share</div><form><input>Sign up</form>
<p hidden>gone</p><p title="a > b">Third</p></article><aside>Other</aside><section id="comments"><article class="comment">Me too</article></section><footer>&copy; x</footer></body>"""


def test_article_is_extracted(spark):
    pages = spark.createDataFrame([(1, "http://h/a", PAGE), (2, "http://h/b", PAGE), (3, "x", None), (4, None, ""), (5, "http://h/c", "<p>cut <b"), (6, "http://h/d", PAGE[:700])], "page_id long, url string, html string")
    got = {r.page_id: r for r in htmltext.extract(pages.withColumns({"host": F.lit(1), "path": F.lit(2), "text": F.lit("x")})).collect()}
    want = "The & title First line goes on Second é line &am Third"
    assert got[1].text == want and got[2].text == want  # copies don't delete each other
    assert (got[3].text, got[4].text, got[5].text) == ("", "", "cut") and got[1].n_chars == len(want)
    assert htmltext.extract(pages.where("page_id > 9")).count() == 0


def test_shared_lines_go_without_an_article(spark):
    frame = "<div>Welcome to the site</div><div>{}</div><div>{}</div><div>All rights reserved</div>"
    pages = [(i, f"http://host/{i:03d}", frame.format(f"story {i}", f"more of {i}")) for i in range(40)] + [(99, "http://alone/x", frame.format("a", "b"))]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story {i} more of {i}" for i in range(40))
    assert got[99] == "Welcome to the site a b All rights reserved"


def test_lines_of_the_main_element_stay(spark):
    """Neighbours that say the same sentence keep it; what is outside the element goes, shared or not."""
    page = "<div>Top of {}</div><article><p>Both say this</p><p>{}</p><div class='notice'>Sign up</div></article>"
    for kind in ("article", "main"):
        html = [page.replace("article", kind).format(i, f"a story of its own, number {i} of {i * 7919}") for i in range(6)]
        pages = [(i, f"http://{kind}/{i}", h) for i, h in enumerate(html)] + [(6 + i, f"http://copies/{i}", html[0]) for i in range(2)]
        got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
        assert all(got[i] == f"Both say this a story of its own, number {k} of {k * 7919}" for i, k in enumerate([*range(6), 0, 0]))


def test_no_line_of_an_article_is_lost(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.extract(rows).collect()}
    for r in rows.collect():
        own = [x for x in lines(r.html) if not x.aside]
        assert got[r.page_id] == " ".join(x.text for x in own if not main_place(own) or x.place & main_place(own))


def test_tags_that_stay_open_take_linear_time():
    n = 100_000
    for html in ("<span>" * n + "</b>" * n, "<p><button>" + "<span>" * n + "<p></p>" * n, "<div>" * n + "x" + "</div>" * n, "<i>" * n + "<ul>" + "</i>" * n):
        began = time.process_time()
        lines(html)
        assert time.process_time() - began < 20  # hours if each tag searched the stack
    assert [x.text for x in lines("<div>" * n + "deep" + "</div>" * n)] == ["deep"]


def test_alignment_takes_linear_space():
    rng = random.Random(1)
    a, b = ([f"line {rng.randrange(60_000)}" if rng.random() < 0.7 else "again" for _ in range(30_000)] for _ in range(2))
    tracemalloc.start()
    found, rest = common_lines(a, b), iter(b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and len(found) > 5000 and all(a[i] in rest for i in found)


@pytest.mark.parametrize("table", [1, 8, 64])
def test_halved_alignments_are_longest(monkeypatch, table):
    monkeypatch.setattr(_html, "_TABLE", table)
    monkeypatch.setattr(_html, "_OFTEN", 2)
    test_common_lines_are_longest()


def test_long_repeated_and_no_pages(spark):
    long = "<article>" + "<p>word after word</p>" * 100_000 + "</article>"
    rows = [(1, "http://h/a", long), (1, "http://h/a", long), (2, "http://h/b", "<p>x</p>"), (2, "http://h/b", "<p>x</p>"), (3, "http://h/c", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.n_chars) for r in htmltext.extract(df).collect())
    assert [g for g in got if g[0] == 1] == [(1, 100_000 * 16 - 1)] * 2 and len(got) == 5
    assert htmltext.extract(df.limit(0)).count() == 0


def test_every_page_meets_its_neighbour(spark):
    frame = "<div>Welcome to the site</div><div>story {}</div>"
    pages = [(i, f"http://host{i // 2:02d}/{i % 2}\"é", frame.format(i)) for i in range(40)] + [(None, None, None), (50, "http://host00/0", frame.format(50)), (50, "http://host00/0", frame.format(50))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(pages) and all(r.text == f"story {r.page_id}" for r in got if r.page_id is not None and 2 <= r.page_id < 40)


def lcs(a, b):
    """Indices of ``a`` in a longest common subsequence, by the plain table."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if table[i][j] == table[i][j - 1]:
            j -= 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return set(out)


@pytest.mark.parametrize("parts", [1, 4, 40, 400])
def test_equals_brute_force_for_any_number_of_partitions(spark, sf_dir, parts):
    """One sorted list of all pages, each aligned with the neighbour of the longer common path, by the plain table."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    frames = [(10_000 + i, f"http://host{i % 3}.org/{'abc'[i % 2]}/{i:03d}", f"<div>Welcome</div><div>Top {i % 2}</div><p>story {i}</p><div>All rights</div>") for i in range(60)]
    pages = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(frames, "page_id long, url string, html string"))
    rows = sorted((*(r.host, r.path), r.page_id, r.url, r.html) for r in pages.withColumns({"host": htmltext.host_of(F.col("url")), "path": htmltext.path_of(F.col("url"))}).collect())
    parsed, want, moved = [lines(r[4]) for r in rows], {}, 0
    for k, own in enumerate(parsed):
        near = {}
        for at in (k + 1, k - 1):
            if 0 <= at < len(rows) and rows[at][0] and rows[at][0] == rows[k][0]:
                near[at] = len(os.path.commonprefix([rows[at][1], rows[k][1]]))
        place = main_place(own)
        shared = lcs([x.text for x in own], [x.text for x in parsed[max(near, key=near.get)]]) if near and not place else set()
        want[rows[k][2]] = " ".join(x.text for i, x in enumerate(own) if i not in shared and not x.aside and (not place or x.place & place))
        moved += want[rows[k][2]] != " ".join(x.text for x in own if not x.aside and (not place or x.place & place))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want and moved >= 60


def test_common_lines_are_longest():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found, rest = common_lines(a, b), iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in rest for i in found)


def test_broken_markup():
    for html in ("<p>a<p>b", "<div><p>a</div>b", "<ul><li>a<li>b</ul>", '<p class="x>a', "a < b", "<>", "</p>a", "<script>x", "<!-- x", "<textarea><p>a", "<a" * 1000):
        assert all(x.text for x in lines(html))


def test_verdicts_equal_sql(spark, sf_dir):
    same(queries.op4_link_graph(spark, sf_dir), duck(sf_dir), queries.ORACLES["op4_link_graph"])


def test_propagation(spark):
    link = '<a href="http://{}/">x</a>'
    pages = [
        (1, "http://a.x.com/de/1", link.format("B.y.net")), (2, "http://b.y.net/de/1", '<a href=//c.z.org/>'), (3, "http://c.z.org/fr", None), (4, None, "x"), (5, "nope", link.format("b.y.net")),
        (6, "http://A.x.com/en/3", link.format("b.y.net")), (7, "http://q.example.com/en/77", link.format("t.info")), (8, "http://t.info/x", ""), (9, "HTTP://com/en/", ""), (10, "http://xcom/en/", ""), (11, "http://u@h:80?x#y", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit("z"), "rule": F.lit(1)})
    got = {r.page_id: r for r in linkgraph.judge(df, queries.URL_RULES).collect()}
    assert got[1].verdict == "block" and got[1].by == "graph"  # links to a blocked host, and half of its own is blocked
    assert (got[2].rule, got[2].verdict) == ("net/de/", "block") and got[3].verdict == "allow"
    assert (got[4].host, got[4].path, got[5].host) == ("", "", "") and got[6].rule == "com/en/"
    assert (got[7].rule, got[7].verdict) == ("example.com/en/7", "allow") and got[8].verdict == "allow"
    assert got[9].rule == "com/en/" and got[10].rule is None and (got[11].host, got[11].path) == ("u@h:80", "")
    assert linkgraph.judge(df.where("page_id > 99"), queries.URL_RULES).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/a", PAGE), (2, None, None), (None, "http://h/é", "<p>x</p>\r\n\r\nWARC/1.0")], "page_id long, url string, html string").withColumn("payload", F.lit(1))
    derived = warc.derive(warc.responses(pages))
    rows = derived.collect()
    assert len(rows) == 6 and len({r.record_id for r in rows}) == 6
    for compression in ("gzip", "none"):
        path = str(tmp_path / compression)
        warc.write(derived, path, compression)
        back = {r.headers["WARC-Record-ID"]: r for r in warc.read(spark, path).collect()}
        for r in rows:
            assert bytes(back[r.record_id].block).decode() == r.block and back[r.record_id].headers["WARC-Refers-To"] == r.refers_to
            assert warc.digest(bytes(back[r.record_id].block)) == r.block_digest == back[r.record_id].headers["WARC-Block-Digest"]
            assert {k: v for k, v in back[r.record_id].headers.items() if k.startswith("WARC-Source-")} == dict(("WARC-Source-" + x).split(": ", 1) for x in r.source_headers.split("\r\n"))
    assert all("Content-Type: text/html; charset=utf-8" in r.source_headers for r in rows)
    (meta,) = [r for r in rows if r.page_id == 1 and r.warc_type == "metadata"]
    assert '"Title": "T"' in meta.block and '"A@/href"' in meta.block and "text/html" in meta.block


def test_warc_responses_are_read(spark, tmp_path):
    import gzip

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<title>caf\xe9</title><p>a</p>"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://h/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: {len(http)}\r\n\r\n".encode()
    record = head + http + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record.replace(b"uuid:1", b"uuid:2")))
    (tmp_path / "b.warc").write_bytes(record.replace(b"uuid:1", b"uuid:3") + record[:-40])
    found = warc.responses_of(warc.read(spark, str(tmp_path)))
    got = warc.derive(found).collect()
    assert {r.refers_to for r in got} == {"<urn:uuid:1>", "<urn:uuid:2>", "<urn:uuid:3>"} and all("café" in r.block for r in got if r.warc_type == "metadata")
    assert {r.payload_digest for r in got} == {warc.digest(http.split(b"\r\n\r\n", 1)[1])} and {r.date for r in got} == {"2020-01-01T00:00:00Z"}


def test_warc_records_equal_plain_ones(spark, sf_dir):
    """Both records of every page of a whole table, made one by one."""
    import base64
    import hashlib
    import json

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    sha = lambda raw: "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
    got = {(r.page_id, r.warc_type): r for r in queries.op8_warc_derivatives(spark, sf_dir).collect()}
    assert len(got) == 2 * len(pages)
    for p in pages:
        meta, text = got[p.page_id, "metadata"], got[p.page_id, "conversion"]
        assert meta.refers_to == text.refers_to and meta.record_id != text.record_id and {meta.url, text.url} == {p.url}
        assert text.block == "\n".join(x.text for x in lines(p.html))
        for r in (meta, text):
            assert r.payload_digest == sha((p.html or "").encode()) and r.block_digest == sha(r.block.encode()) and r.content_length == len(r.block.encode())
        envelope = json.loads(meta.block)["Envelope"]
        assert envelope["WARC-Header-Metadata"]["WARC-Record-ID"] == meta.refers_to
        assert envelope["HTTP-Response-Metadata"]["Headers"]["Content-Length"] == str(len((p.html or "").encode()))
    assert len({r.refers_to for r in got.values()}) == len(pages)


def test_warc_edge_cases(spark):
    schema = "page_id long, url string, html string"
    assert warc.derive(warc.responses(spark.createDataFrame([], schema))).count() == 0
    twice = warc.derive(warc.responses(spark.createDataFrame([(1, "http://h/", "<p>a")] * 2, schema))).collect()
    assert len(twice) == 4 and len({r.record_id for r in twice}) == 2  # repeated pages give records of the same ids
    bare = spark.createDataFrame([(None, "<urn:uuid:9>", "", "", "", b"plain")], warc.RESPONSE)
    assert {(r.warc_type, r.source_headers) for r in warc.derive(bare).collect()} == {("metadata", ""), ("conversion", "")}


def test_repeated_pages_are_judged_each(spark):
    rows = [(1, "http://a.example.com/en/1", "<a href='http://b.org/'>x</a>")] * 3 + [(2, "http://b.org/", None), (3, None, "x"), (3, "nohost", None)]
    got = linkgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES).collect()
    assert len(got) == 6 and {r.verdict for r in got if r.page_id == 1} == {"block"} and {(r.host, r.path, r.verdict) for r in got if r.page_id == 3} == {("", "", "allow")}


def test_verdicts_are_the_contracts(spark, tmp_path):
    """each rule's word, in pages that a rule decides."""
    urls = ["http://a.com/en/1", "http://example.com/en/7x", "http://b.net/de/1", "http://example.net/de/8", "http://example.net/de/7", "http://c.org/es/"]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op4_link_graph(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(6)] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block")]


def test_differencing_shows_the_main_element(spark):
    """an article that every page of the site has is its frame; the text is where the pages differ."""
    page = "<article><p>Pick of the week</p></article><div class='content'><p>Both say this</p><p>{}</p></div>"
    pages = [(i, f"http://h/{i}", page.format(f"story {i}")) for i in range(4)] + [(9, "http://alone/x", page.format("story"))]
    got = {r.page_id: (r.text, r.n_shared) for r in htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == (f"Both say this story {i}", 1) for i in range(4))
    assert got[9] == ("Pick of the week", 0)
