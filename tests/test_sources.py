import json

from pyspark.sql import functions as F

from loomline.operators import cookies as C
from loomline.operators import crawl as W
from loomline.operators import runs as R
from loomline.plans import fetch
from loomline.sources import sinks, tables
from loomline.sources.runstore import RunStore
from loomline.streaming import frontier

LONG = "A sentence of an article that goes on for a while, with commas. " * 12


def test_run_store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    assert store.results().count() == 0
    store.start_run("r1", "2024-01-01T00:00:00")
    store.start_run("r2", "2024-02-01T00:00:00")
    store.record(spark.createDataFrame([(1, "r1", "A", "pass"), (2, "r2", "A", "fail")], "id long, run_id string, test_name string, status string"))
    store.end_run("r1", "2024-01-01T01:00:00", 1, 0)
    assert {(r.run_id, r.total_tests) for r in store.runs().collect()} == {("r1", 1), ("r2", None)}
    assert store.delete("2024-01-15", str(tmp_path / "t")) == 1
    assert [r.run_id for r in RunStore(spark, str(tmp_path / "t")).results().collect()] == ["r2"]


def test_site_names(spark):
    rows = spark.createDataFrame([("ExampleNews (latest)",), ("(latest) prefix",), ("Site (v2) (latest)",)], "n string")
    assert [r[0] for r in rows.select(R.base_site(F.col("n"))).collect()] == ["ExampleNews", "(latest) prefix", "Site (v2)"]


def test_site_config(spark):
    text = json.dumps({"A.com": {"userAgent": 5, "useNextData": True, "mobileApiConfig": {"apiUrl": "u"}}, "b.com": 3})
    rows = tables.site_config(spark, text).collect()
    assert [(r.domain, r.userAgent, r.useNextData, r.mobileApiConfig) for r in rows] == [("a.com", None, True, None)]
    assert tables.site_config(spark, "not json").count() == 0


def test_cookie_file(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# Netscape\n.x.com\tTRUE\t/\tTRUE\t0\ta\t1\n#HttpOnly_.x.com\tTRUE\t/\tFALSE\t0\tb\t2\n")
    rows = C.netscape(tables.cookie_lines(spark, str(tmp_path / "c.txt")))
    urls = spark.createDataFrame([("https://s.x.com/p",), ("http://x.com/",)], "url string")
    assert [(r.url, r["name"], r["value"]) for r in C.matching(urls, rows, 9).collect()] == [("https://s.x.com/p", "a", "1")]
    merged = rows.select(C.merged(F.create_map(F.lit("a"), F.lit("0"), F.lit("k"), F.lit("v")), F.create_map("name", "value")).alias("m")).first().m
    assert merged == {"a": "1", "k": "v"}


def test_fixtures(spark):
    rows = [{"site": "S", "priority": None, "tags": ["t"], "stable": {"url": "u1", "minWords": 5.0}, "latest": {"url": "u2", "minWords": None}, "fetch": {"minWords": 7.0}}]
    cases = tables.fixture_cases(spark.createDataFrame(rows, tables.FIXTURE))
    assert {(r["name"], r.min_words, r.priority) for r in cases.collect()} == {("S", 5.0, "standard"), ("S (latest)", 7.0, "standard")}
    assert tables.filter_cases(cases, sites=["LATEST"]).count() == 1
    assert tables.filter_cases(cases, priority=["critical"]).count() == 0
    assert tables.filter_cases(cases, priority=["standard"], tags=["t"]).count() == 2


def test_outputs(spark, tmp_path):
    rows = spark.createDataFrame([("https://x", "T", None, "md", "txt")], "url string, title string, byline string, markdown string, text string")
    assert sinks.page_output(rows).first().value == "Title: T\nURL: https://x\n---\nmd"
    assert sinks.page_output(rows, "text").first().value == "txt"
    sinks.write_crawl(rows, str(tmp_path / "u"), "urls")
    assert spark.read.text(str(tmp_path / "u")).first().value == "https://x"


def test_frontier_limits(spark):
    edges = [("http://s.com/", f"http://s.com/{i}", i) for i in range(8)] + [("http://s.com/1", "http://s.com/9", 0), ("http://s.com/0", "http://other.com/", 0)]
    e = spark.createDataFrame(edges, "src string, link string, pos int")
    got = W.crawl("http://s.com/", e, max_depth=1, max_pages=5).orderBy("seq").collect()
    assert [r.url for r in got] == ["http://s.com/"] + [f"http://s.com/{i}" for i in range(4)]
    assert W.crawl("http://s.com/", e, max_depth=2).count() == 10
    assert W.crawl("http://s.com/", e, max_depth=2, exclude=["/9"]).count() == 9
    rules = W.robots_rules(spark.createDataFrame([("http://s.com", "User-agent: *\nDisallow: /1")], "origin string, body string"))
    blocked = W.crawl("http://s.com/", e, max_depth=2, rules=rules)
    assert {r.url for r in blocked.filter("blocked").collect()} == {"http://s.com/1"}
    assert blocked.filter("url = 'http://s.com/9'").count() == 0


def test_sitemap_mode_is_depth_bound(spark):
    files = spark.createDataFrame([(f"http://a.com/{i}.xml", f"<sitemapindex><sitemap><loc>http://a.com/{i + 1}.xml</loc></sitemap></sitemapindex><urlset><url><loc>http://a.com/p{i}</loc></url></urlset>") for i in range(5)], "url string, body string")
    got = W.sitemap_pages(spark.createDataFrame([("http://a.com/0.xml",)], "url string"), files)
    assert [r["loc"] for r in got.collect()] == ["http://a.com/p0", "http://a.com/p1", "http://a.com/p2"]


def test_fetch_cascade(spark):
    wp = f'<html><head><link rel="alternate" type="application/json" href="https://x.com/wp-json/wp/v2/posts/7"></head><body>{"<p>x y z</p>" * 600}</body></html>'
    pages = spark.createDataFrame([(1, "https://x.com/a", wp, 200, "text/html"), (2, "https://x.com/b", "", 429, None), (3, "https://x.com/c", "<p>short</p>", 200, "text/html")], "page_id long, url string, html string, status int, content_type string")
    responses = spark.createDataFrame([("GET", "https://x.com/wp-json/wp/v2/posts/7?_embed", 200, json.dumps({"title": "T", "content": f"<p>{LONG}</p>"}))], "method string, url string, status int, body string")
    requests = fetch.api_requests(pages)
    assert [(r.page_id, r.kind) for r in requests.collect()] == [(1, "wp-rest-api")]
    answers = fetch.api_results(requests, responses)
    articles = spark.createDataFrame([(1, "readability", "d" * 600), (3, "readability", "short")], "page_id long, method string, text string")
    got = {r.page_id: r for r in fetch.fetched(pages, articles, answers).collect()}
    assert (got[1].success, got[1].method) == (True, "wp-rest-api")
    assert (got[2].error, got[2].action) == ("rate_limited", "wait_and_retry")
    assert (got[3].success, got[3].error) == (False, "body_too_small")


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT 'HTTP://X.com/a/' AS url, timestamp'2024-01-01 00:00:00' AS seen_at UNION ALL SELECT 'http://x.com/a', timestamp'2024-01-01 00:00:01' UNION ALL SELECT 'ftp://x', timestamp'2024-01-01 00:00:02'").write.parquet(src)
    stream = spark.readStream.schema("url string, seen_at timestamp").parquet(src)
    q = frontier.fresh_urls(stream).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.url for r in spark.sql("SELECT * FROM fresh").collect()] == ["http://x.com/a"]


def test_pdf_text(spark, tmp_path):
    import zlib

    from loomline.functions import pdf

    page = b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\)) Tj 0 -14 Td [(wor) 20 (ld) -300 (again)] TJ ET BT 0 0 Td <4869> Tj ET"
    packed = zlib.compress(page)
    data = b"%PDF-1.4\n1 0 obj << /Length 9 /Filter /FlateDecode >> stream\n" + packed + b"\nendstream endobj 2 0 obj << /Title (My \\(T\\)) /Author <FEFF0041> /CreationDate (D:20240131120000+02'00') >> endobj"
    (tmp_path / "a.pdf").write_bytes(data)
    (tmp_path / "b.pdf").write_bytes(b"%PDF broken")
    row = pdf.articles(tables.pdf_files(spark, str(tmp_path))).collect()
    assert [(r.title, r.byline, r.published_time, r.text, r.word_count) for r in row] == [("My (T)", "A", "2024-01-31T12:00:00+02:00", "Hello (PDF)\nworld again\nHi", 5)]
