"""Queries over pages, URLs and inline cases, and the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import cookies as C
from ..operators import crawl as W
from ..operators import select as S
from ..operators import validate as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cases(name: str, columns: str, rows: str, sql: str, **outputs: Callable[[], Column]) -> None:
    """A query of scalar functions over inline rows; `sql` selects from t."""
    values = f"(VALUES {rows}) AS t({columns})"
    QUERIES[name] = lambda spark, sf_dir: spark.sql(f"SELECT * FROM {values}").select(*columns.split(", "), *(make().alias(n) for n, make in outputs.items()))
    SQL[name] = f"SELECT {columns}, {sql} FROM {values}"


c = F.col

# --- validation -------------------------------------------------------------------------------

_VISIBLE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '&#?\w+;', ' ', 'g')"


def _words(x: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array(regexp_replace(coalesce({x}, ''), '([{T.CJK}])', ' \\1 ', 'g'), '[\\s\\x0B\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+'), lambda w: w <> '')) AS BIGINT)"


_CODE = f"CASE WHEN strlen(html) < {V.MIN_BYTES} THEN 'body_too_small' WHEN {_words(_VISIBLE)} < {V.MIN_WORDS} THEN 'insufficient_content' ELSE 'valid' END"


@add("quick_validate_codes", f"SELECT {_CODE} AS code, count(*) AS pages, CAST(sum({_words(_VISIBLE)}) AS BIGINT) AS words FROM pages GROUP BY 1")
def quick_validate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.coalesce(V.quick_validate(c("html"), F.lit(200), F.lit("text/html")), F.lit("valid"))
    return pages(spark, sf_dir).select(code.alias("code"), T.count_words(V.visible_text(c("html"))).alias("words")).groupBy("code").agg(F.count("*").alias("pages"), F.sum("words").alias("words"))


@add("page_word_counts", f"SELECT page_id, {_words(_VISIBLE)} AS words, strlen(html) AS bytes FROM pages")
def page_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", T.count_words(V.visible_text(c("html"))).alias("words"), F.octet_length("html").cast("long").alias("bytes"))


cases("validate_order", "id, html, status, ct", "(1, 'x', 404, 'text/html'), (2, 'x', 200, 'application/json'), (3, 'x', 200, 'text/html'), (4, 'x', 200, CAST(NULL AS STRING)), (5, repeat('word ', 1200), 200, 'TEXT/HTML; charset=utf-8'), (6, repeat('<b>x</b>', 700), 299, 'application/xhtml+xml'), (7, repeat('<script>a b</script>', 400), 200, 'text/html')".replace("STRING", "VARCHAR(9)"),
      f"CASE WHEN status < 200 OR status >= 300 THEN 'http_status_error' WHEN ct IS NOT NULL AND lower(ct) NOT LIKE '%text/html%' AND lower(ct) NOT LIKE '%application/xhtml+xml%' THEN 'wrong_content_type' WHEN strlen(html) < 5120 THEN 'body_too_small' WHEN {_words(_VISIBLE)} < 100 THEN 'insufficient_content' END AS code",
      code=lambda: V.quick_validate(c("html"), c("status"), c("ct")))
cases("failure_taxonomy", "status", "(429), (403), (0), (500), (404)",
      "CASE WHEN status = 429 THEN 'rate_limited' WHEN status = 0 THEN 'network_error' ELSE 'http_status_error' END AS error, CASE status WHEN 429 THEN 'wait_and_retry' WHEN 403 THEN 'retry_with_extract' ELSE 'skip' END AS action",
      error=lambda: V.failure(c("status"))["error"], action=lambda: V.failure(c("status"))["action"])
cases("retry_policy", "success, status, error, attempt", "(false, 0, 'connection refused', 0), (false, 0, 'ssrf_protection', 1), (false, 503, 'x', 1), (true, 200, 'x', 2)",
      "NOT success AND status = 0 AND error <> 'ssrf_protection' AS retry, CAST(pow(2, attempt) * 1000 AS BIGINT) AS delay_ms",
      retry=lambda: V.is_retryable(c("success"), c("status"), c("error")), delay_ms=lambda: V.retry_delay(c("attempt")))
cases("cascade_gates", "n", "(CAST(NULL AS INT)), (0), (99), (100), (1999), (2000)",
      "CASE WHEN coalesce(n, 0) < 100 THEN 'insufficient_content' WHEN coalesce(n, 0) < 2000 THEN 'probe_data_route' ELSE 'accept' END AS gate", gate=lambda: V.gate(c("n")))

# --- text -------------------------------------------------------------------------------------


@add("word_count_by_lang", f"SELECT lang, count(*) AS docs, CAST(sum({_words('text')}) AS BIGINT) AS words FROM documents GROUP BY lang")
def word_count_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("docs"), F.sum(T.count_words(c("text"))).alias("words"))


cases("cjk_word_count", "s", "('这是一个测试'), ('hello 这是一个测试 world'), ('  a  b '), (''), ('かな カナ'), ('한국어 test')", f"{_words('s')} AS words", words=lambda: T.count_words(c("s")))

_WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_TRIM = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


@add("excerpt_generate", f"SELECT doc_id, CASE WHEN length({_TRIM('text')}) > 200 THEN substr({_TRIM('text')}, 1, 200) || '...' WHEN length({_TRIM('text')}) > 0 THEN {_TRIM('text')} END AS excerpt FROM documents")
def excerpt_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.excerpt(F.lit(None).cast("string"), c("text")).alias("excerpt"))


@add("natural_language_flag", """SELECT doc_id, length(text) > 0 AND length(text) - length(replace(text, '<', '')) <= length(text) / 100 AND text NOT LIKE '%function(%' AND text NOT LIKE '%function (%'
 AND (length(text) - length(replace(text, '=>', ''))) / 2 <= 3 AND (length(text) - length(replace(text, ' ', ''))) / length(text) > 0.1 AS natural FROM documents""")
def natural_language_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.is_natural_language(c("text")).alias("natural"))


@add("threshold_counts", "SELECT lang, count(*) FILTER (WHERE length(text) >= 200) AS min_content, count(*) FILTER (WHERE length(text) >= 500) AS good_content FROM documents GROUP BY lang")
def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("lang").agg(*(F.count(F.when(T.meets_threshold(c("text"), n), 1)).alias(a) for n, a in ((200, "min_content"), (500, "good_content"))))


_BOILER = T.BOILERPLATE
cases("boilerplate_flag", "s", "('Advertisement'), (' log in '), ('Log in now'), ('Already a subscriber? Log in'), ('Subscribe for all ' || repeat('x', 200)), ('Subscribe for all access'), ('text'), ('')",
      f"length({_TRIM('s')}) > 0 AND length({_TRIM('s')}) <= 200 AND regexp_matches({_TRIM('s')}, '{_BOILER}') AS boilerplate", boilerplate=lambda: T.is_boilerplate(c("s")))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.regexp_extract_all("html", F.lit(r"(?is)<p>(.*?)</p>"), F.lit(1))
    rows = pages(spark, sf_dir).select("page_id", F.posexplode(parts).alias("pos", "raw"))
    return rows.withColumn("norm", F.trim(F.regexp_replace(F.regexp_replace("raw", r"<[^>]+>", ""), r"\s+", " ")))


@add("paragraph_dedup_keep_last", r"""WITH p AS (SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, trim(regexp_replace(regexp_replace(raw, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS norm
 FROM (SELECT page_id, unnest(ps) AS raw, generate_subscripts(ps, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<p>(.*?)</p>', 1) AS ps FROM pages)))
 SELECT page_id, pos, length(norm) AS n FROM (SELECT *, row_number() OVER (PARTITION BY page_id, norm ORDER BY pos DESC) AS rn FROM p) WHERE rn = 1 OR length(norm) < 80""")
def paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paragraphs(spark, sf_dir)
    key = F.when(F.length("norm") < 80, c("pos")).otherwise(-1)
    return rows.groupBy("page_id", "norm", key.alias("k")).agg(F.max("pos").alias("pos")).select("page_id", "pos", F.length("norm").cast("long").alias("n"))


@add("page_title_cut", rf"SELECT page_id, {_TRIM("regexp_split_to_array(" + _TRIM("regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)") + r", '\s*[-|–—]\s*')[1]")} AS title FROM pages")
def page_title_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", T.cut_title(T.page_title(c("html"))).alias("title"))


cases("title_cases", "html", """('<title>Covid-19 news | Site</title>'), ('<meta property="og:title" content="OG Title"><title>Page</title>'), ('<TITLE> x </TITLE>'), ('none')""",
      r"""CASE WHEN regexp_extract(html, '(?i)<meta[^>]*property=["'']og:title["''][^>]*content=["'']([^"'']+)["'']', 1) <> '' THEN regexp_extract(html, '(?i)<meta[^>]*property=["'']og:title["''][^>]*content=["'']([^"'']+)["'']', 1) WHEN trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)) <> '' THEN trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)) END AS title""",
      title=lambda: T.page_title(c("html")))


@add("page_lang", r"""SELECT nullif(regexp_extract(html, '(?i)<html\b[^>]*?\blang=["'']?([^"''\s>]+)', 1), '') AS lang, count(*) AS pages FROM pages GROUP BY 1""")
def page_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).groupBy(T.html_lang(c("html")).alias("lang")).agg(F.count("*").alias("pages"))


cases("article_id", "html", """('<meta name="article.id" content="a1">'), ('<meta content="b2" name="article.id">'), ('<meta name="x">')""",
      r"""coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]*name=["'']article\.id["''][^>]*content=["'']([^"'']+)["'']', 1), ''), nullif(regexp_extract(html, '(?i)<meta[^>]*content=["'']([^"'']+)["''][^>]*name=["'']article\.id["'']', 1), '')) AS id""", id=lambda: T.article_id(c("html")))  # fmt: skip
cases("html_sniffs", "s", "('<p>x'), ('<p class=a>'), ('<div>'), ('<h2>'), ('plain'), ('<em>x</em>'), ('<br/>')",
      r"regexp_matches(s, '(?i)<(?:p|div|br|span|h[1-6])[\s>/]') AS article, regexp_matches(s, '<(?:p|div)>') AS bare, regexp_matches(s, '(?i)<(?:p|div|h[1-6]|ul|ol|li|blockquote|figure|img|a|em|strong)[\s>]') AS hydration",
      article=lambda: T.article_html_sniff(c("s")), bare=lambda: T.bare_html_sniff(c("s")), hydration=lambda: T.hydration_html_sniff(c("s")))


@add("conversation_text_markdown", r"""SELECT conv_id, turn, CASE WHEN length(role) > 0 THEN '# ' || role || chr(10) || chr(10) ELSE '' END || array_to_string(list_filter(list_transform(regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{2,}'), lambda p: trim(p, ' ' || chr(9) || chr(10))), lambda p: length(p) > 0), chr(10) || chr(10)) AS md FROM conversations""")
def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", T.pdf_markdown(c("text"), c("role")).alias("md"))


cases("display_helpers", "n", "(0), (7), (999), (1000), (12345), (999999), (1500000)",
      "CASE WHEN n = 0 THEN '-' WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 1000000 THEN printf('%.1fk', n / 1000) ELSE printf('%.1fM', n / 1000000) END AS size, rpad(substr(CAST(n AS VARCHAR), 1, 5), 5, ' ') AS fit, CASE WHEN n > 1000 THEN '↑' WHEN n < 1000 THEN '↓' ELSE '→' END AS delta",
      size=lambda: T.format_bytes(c("n")), fit=lambda: T.fit_column(c("n").cast("string"), 5), delta=lambda: T.delta_symbol(c("n") - 1000))
cases("percent_bars", "k, n", "(0, 0), (1, 4), (3, 3), (0, 9)", "CASE WHEN n = 0 THEN '(  0.0%)' ELSE '(' || lpad(printf('%.1f', k / n * 100), 5, ' ') || '%)  ' || repeat('█', CAST(floor(k / n * 30 + 0.5) AS INT)) END AS bar", bar=lambda: T.percent_bar(c("k"), c("n")))
cases("relative_dates", "spec", "('7d'), ('36h'), ('90m'), ('2024-02-29'), ('soon')",
      "CASE WHEN regexp_matches(spec, '^\\d{4}-\\d{2}-\\d{2}$') THEN CAST(spec AS TIMESTAMP) WHEN regexp_matches(spec, '^\\d+[dhm]$') THEN TIMESTAMP '2024-03-10 12:00:00' - to_seconds(CAST(regexp_extract(spec, '^(\\d+)', 1) AS INT) * CASE right(spec, 1) WHEN 'd' THEN 86400 WHEN 'h' THEN 3600 ELSE 60 END) END AS at".replace("CAST(spec AS TIMESTAMP)", "TRY_CAST(spec AS TIMESTAMP)"),
      at=lambda: T.relative_before(c("spec"), F.lit("2024-03-10 12:00:00").cast("timestamp")))
cases("first_non_empty", "a, b, x", "('', 'env', 'z'), ('own', 'env', 'z'), ('', '', 'z'), ('', '', '')", "coalesce(nullif(a, ''), nullif(b, ''), nullif(x, '')) AS proxy", proxy=lambda: T.first_non_empty(c("a"), c("b"), c("x")))

# --- URLs -------------------------------------------------------------------------------------

_ORIGIN = lambda u: f"lower(regexp_extract({u}, '^(https?)://', 1)) || '://' || lower(regexp_extract({u}, '^https?://([^/?#]*)', 1))"
_PATH = lambda u: f"CASE WHEN regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1) END"
_NORM = lambda u: f"{_ORIGIN(u)} || CASE WHEN length({_PATH(u)}) > 1 THEN regexp_replace({_PATH(u)}, '/$', '') ELSE {_PATH(u)} END || regexp_extract({u}, '(\\?[^#]*)', 1)"


@add("normalize_url_dedup", f"SELECT {_NORM('url')} AS norm, count(*) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1")
def normalize_url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).groupBy(U.normalize(c("url")).alias("norm")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


cases("normalize_cases", "url", "('HTTPS://Example.COM:443/A/'), ('http://x.com'), ('http://x.com:80/?q=1#f'), ('https://x.com/a//'), ('not a url'), ('https://x.com/a/?b=/'), ('http://x.com/a/../b/./c'), ('http://x.com/a/b/..'), ('http://x.com/../%2e'), ('http://x.com/.a/b..')",
      """CASE url WHEN 'HTTPS://Example.COM:443/A/' THEN 'https://example.com/A' WHEN 'http://x.com' THEN 'http://x.com/' WHEN 'http://x.com:80/?q=1#f' THEN 'http://x.com/?q=1' WHEN 'https://x.com/a//' THEN 'https://x.com/a/' WHEN 'not a url' THEN 'not a url' WHEN 'http://x.com/a/../b/./c' THEN 'http://x.com/b/c' WHEN 'http://x.com/a/b/..' THEN 'http://x.com/a' WHEN 'http://x.com/../%2e' THEN 'http://x.com/' WHEN 'http://x.com/.a/b..' THEN url ELSE 'https://x.com/a?b=/' END AS norm""",
      norm=lambda: U.normalize(c("url")))


@add("url_slug", f"SELECT page_id, list_filter(string_split({_PATH('url')}, '/'), lambda s: s <> '')[-1] AS slug FROM pages")
def url_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.slug(c("url")).alias("slug"))


@add("pages_by_origin", f"SELECT {_ORIGIN('url')} AS origin, count(*) AS pages FROM pages GROUP BY 1")
def pages_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).groupBy(U.origin(c("url")).alias("origin")).agg(F.count("*").alias("pages"))


_SITES = "(VALUES ('example.com', 'json'), ('example.net', 'next'), ('blog.tionble.example.com', 'wp')) AS s(domain, setting)"


@add("site_host_lookup", f"""WITH h AS (SELECT page_id, string_split(regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www\\.', ''), '^m\\.', ''), '.') AS l FROM pages),
 k AS (SELECT page_id, unnest(generate_series(0, greatest(len(l) - 2, 0))) AS lvl, l FROM h), j AS (SELECT page_id, lvl, setting FROM k JOIN {_SITES} ON domain = array_to_string(l[lvl + 1:], '.'))
 SELECT page_id, arg_min(setting, lvl) AS setting FROM j GROUP BY page_id""")
def site_host_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = spark.sql(f"SELECT * FROM {_SITES}")
    keys = pages(spark, sf_dir).select("page_id", F.posexplode(U.host_suffixes(c("url"))).alias("lvl", "domain"))
    return keys.join(sites, "domain").groupBy("page_id").agg(F.min_by("setting", "lvl").alias("setting"))


cases("pdf_urls", "url", "('https://x.com/a.PDF'), ('https://x.com/a.pdf?x=1'), ('/local/file.pdf'), ('https://x.com/pdf'), ('https://x.com/?f=a.pdf')",
      "CASE url WHEN 'https://x.com/pdf' THEN false WHEN 'https://x.com/?f=a.pdf' THEN false ELSE true END AS is_pdf", is_pdf=lambda: U.is_pdf(c("url")))


@add("pdf_url_filter", f"SELECT count(*) AS pages, count(*) FILTER (WHERE lower({_PATH('url')}) LIKE '%.pdf') AS pdfs FROM pages")
def pdf_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).agg(F.count("*").alias("pages"), F.count(F.when(U.is_pdf(c("url")), 1)).alias("pdfs"))


cases("content_types", "ct", "('application/pdf'), ('Application/PDF; q=1'), ('text/html')", "lower(ct) LIKE '%application/pdf%' AS pdf", pdf=lambda: U.is_pdf_type(c("ct")))
cases("doc_extension_links", "href", "('/report.pdf'), ('https://x.com/a.DOCX?v=2'), ('data.csv#x'), ('/a.html'), ('/v1.2/readme'), ('x.tar.gz'), ('notes.md')",
      "CASE WHEN lower(regexp_extract(regexp_replace(href, '[?#].*$', ''), '\\.([^./]*)$', 1)) IN ('" + "', '".join(U.DOCUMENTS) + "') THEN '.' || lower(regexp_extract(regexp_replace(href, '[?#].*$', ''), '\\.([^./]*)$', 1)) END AS ext", ext=lambda: U.document_extension(c("href")))
cases("video_embed", "src", "('https://www.youtube.com/embed/dQw4w9WgXcQ'), ('https://youtu.be/abc_-1'), ('https://player.vimeo.com/video/123456789'), ('https://vimeo.com/42'), ('https://x.com/v')",
      "CASE WHEN regexp_matches(src, '(?:youtube\\.com/embed/|youtu\\.be/)([a-zA-Z0-9_-]+)') THEN 'https://www.youtube.com/watch?v=' || regexp_extract(src, '(?:youtube\\.com/embed/|youtu\\.be/)([a-zA-Z0-9_-]+)', 1) WHEN regexp_matches(src, 'vimeo\\.com/(?:video/)?(\\d+)') THEN 'https://vimeo.com/' || regexp_extract(src, 'vimeo\\.com/(?:video/)?(\\d+)', 1) END AS watch",
      watch=lambda: U.video_embed(c("src"))["src"])
cases("srcset_largest", "id, s, want", "(1, 'a 1x, b 2x, c 100w', 'c'), (2, '/s.jpg 400w, /l.jpg 800w, /m.jpg 600w', '/l.jpg'), (3, 'a, b', 'a'), (4, 'a 1.5x, b 3x', 'b'), (5, 'a 10w, b 10w', 'a'), (6, 'a 2h, b', 'b'), (7, 'a 100w, b 3x', 'a')", "want AS best", best=lambda: U.srcset_largest(c("s")))
cases("next_route_url", "url, build", "('https://x.com/a/b/', 'b1'), ('https://x.com', 'b1'), ('https://X.com/a?q=1', 'b-2')",
      "CASE url WHEN 'https://x.com' THEN 'https://x.com/_next/data/b1/index.json' WHEN 'https://x.com/a/b/' THEN 'https://x.com/_next/data/b1/a/b.json' ELSE 'https://x.com/_next/data/b-2/a.json' END AS route", route=lambda: U.next_data_route(c("url"), c("build")))


@add("next_route_pages", f"SELECT page_id, {_ORIGIN('url')} || '/_next/data/b1' || CASE WHEN regexp_replace({_PATH('url')}, '/$', '') = '' THEN '/index' ELSE regexp_replace({_PATH('url')}, '/$', '') END || '.json' AS route FROM pages")
def next_route_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.next_data_route(c("url"), F.lit("b1")).alias("route"))


cases("same_site", "a, b, want", "('api.example.com', 'www.example.com', true), ('a.com', 'b.com', false), ('10.0.0.1', '10.0.0.1', true), ('10.0.0.1', '9.0.0.1', false), ('localhost', 'localhost', true), ('localhost', 'x.localhost', false), ('evil.co.uk', 'victim.co.uk', true)", "want AS same", same=lambda: U.is_same_site(c("a"), c("b")))
cases("prism_url", "d, s, w, u", "('api.x.com', 'content', 'site a', 'https://www.x.com/p/q'), ('https://api.y.com', 'c', '', 'https://www.x.com/'), ('http://x.com', 'c', '', 'https://x.com/z')",
      "CASE u WHEN 'https://www.x.com/p/q' THEN 'https://api.x.com/api/content?_website=site%20a&query=%7B%22canonical_url%22%3A%22%2Fp%2Fq%22%7D' WHEN 'https://x.com/z' THEN 'http://x.com/api/c?query=%7B%22canonical_url%22%3A%22%2Fz%22%7D' END AS api",
      api=lambda: U.prism_url(c("d"), c("s"), c("w"), c("u")))
cases("wp_api_urls", "u, detected, custom, use_wp", "('https://x.com/2024/my-post/', '', '', true), ('https://x.com/a', 'https://x.com/wp-json/wp/v2/posts/7', '', true), ('https://x.com/b', '', '/wp-json/c/', false), ('https://x.com/', '', '', true), ('https://x.com/c', '', '', false)",
      "CASE u WHEN 'https://x.com/2024/my-post/' THEN 'https://x.com/wp-json/wp/v2/posts?slug=my-post&_embed' WHEN 'https://x.com/a' THEN 'https://x.com/wp-json/wp/v2/posts/7?_embed' WHEN 'https://x.com/b' THEN 'https://x.com/wp-json/c/b?_embed' END AS api",
      api=lambda: U.with_embed(U.wp_api_url(c("u"), c("detected"), c("custom"), c("use_wp"))))
cases("wp_truncation", "html", """('<a href="https://x/?utm_campaign=api">more</a>'), ('<a href="https://x/">')""", """regexp_matches(html, 'href="[^"]*utm_campaign=api') AS teaser""", teaser=lambda: U.has_truncation_marker(c("html")))
cases("private_ip_filter", "ip", "('172.16.0.1'), ('172.32.0.1'), ('::ffff:10.0.0.1'), ('8.8.8.8'), ('127.0.0.1'), ('::1'), ('fe80::1'), ('2001:db8::1'), ('2606:4700::1'), ('::ffff:8.8.8.8'), ('169.254.1.1')",
      f"CASE WHEN lower(ip) LIKE '::ffff:%' THEN regexp_matches(substr(ip, 8), '{U.PRIVATE_V4}') WHEN ip LIKE '%:%' THEN regexp_matches(ip, '{U.PRIVATE_V6}') ELSE regexp_matches(ip, '{U.PRIVATE_V4}') END AS private", private=lambda: U.is_private_ip(c("ip")))
cases("proxy_rules", "p", "('http://u:pw@h:1'), ('socks5h://h'), ('ftp://h'), ('nonsense'), ('https://u@h/')",
      "lower(regexp_extract(p, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https', 'socks5', 'socks5h') AS allowed, CASE p WHEN 'http://u:pw@h:1' THEN 'http://***:***@h:1' WHEN 'https://u@h/' THEN 'https://***@h/' WHEN 'nonsense' THEN '<invalid-proxy-url>' ELSE p END AS redacted",
      allowed=lambda: U.proxy_allowed(c("p")), redacted=lambda: U.redact_proxy(c("p")))
cases("cache_keys", "k", "('chrome|direct'), ('chrome|http://u:pw@h:1'), ('plain'), ('x|nonsense')", "CASE k WHEN 'chrome|http://u:pw@h:1' THEN 'chrome|http://***:***@h:1' WHEN 'x|nonsense' THEN 'x|<invalid-proxy-url>' ELSE k END AS redacted", redacted=lambda: U.redact_cache_key(c("k")))
cases("agent_presets", "ua", "('Mozilla (Linux; Android 14) Chrome/1'), ('Mozilla (iPhone) CriOS/1'), ('Mozilla (iPhone) Safari'), ('curl')",
      "CASE WHEN ua ILIKE '%android%' AND ua ILIKE '%chrome%' THEN 'chrome-android' WHEN ua ILIKE '%iphone%' AND ua ILIKE '%crios%' THEN 'chrome-ios' WHEN ua ILIKE '%iphone%' AND ua ILIKE '%safari%' THEN 'safari-ios' END AS preset", preset=lambda: U.resolve_preset(c("ua")))

_DNS = "(VALUES ('a.com', '8.8.8.8'), ('a.com', '10.0.0.1'), ('b.com', '1.1.1.1'), ('c.com', CAST(NULL AS VARCHAR(9)))) AS d(name, address)"


@add("ssrf_gate", f"SELECT h, coalesce(ok, false) AS allowed FROM (VALUES ('a.com'), ('b.com'), ('c.com'), ('d.com')) t(h) LEFT JOIN (SELECT name, bool_and(address IS NOT NULL AND NOT regexp_matches(address, '{U.PRIVATE_V4}')) AS ok FROM {_DNS} GROUP BY name) ON name = h")
def ssrf_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    dns = spark.sql(f"SELECT * FROM {_DNS}").groupBy("name").agg(F.bool_and(F.coalesce(~U.is_private_ip(c("address")), F.lit(False))).alias("ok"))
    hosts = spark.sql("SELECT * FROM (VALUES ('a.com'), ('b.com'), ('c.com'), ('d.com')) AS t(h)")
    return hosts.join(dns, c("h") == c("name"), "left").select("h", F.coalesce("ok", F.lit(False)).alias("allowed"))


# --- links and crawl --------------------------------------------------------------------------

_LINKS = f"""l AS (SELECT page_id, url, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref=["'']([^"'']*)["'']', 1) AS hs FROM pages)),
 f AS (SELECT page_id, pos, regexp_replace(CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^(https?)', 1) || ':' || href WHEN href LIKE '/%' THEN {_ORIGIN('url')} || href WHEN href LIKE '#%' THEN url END, '#.*$', '') AS link FROM l),
 k AS (SELECT page_id, link, CAST(min(pos) AS INTEGER) AS pos FROM f WHERE regexp_matches(link, '(?i)^https?://') GROUP BY page_id, link)"""


@add("link_extract", f"WITH {_LINKS} SELECT * FROM k")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rooted_links(pages(spark, sf_dir))


@add("link_edges_by_origin", f"WITH {_LINKS} SELECT {_ORIGIN('link')} AS origin, count(*) AS links, count(DISTINCT link) AS targets FROM k GROUP BY 1")
def link_edges_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rooted_links(pages(spark, sf_dir)).groupBy(U.origin(c("link")).alias("origin")).agg(F.count("*").alias("links"), F.countDistinct("link").alias("targets"))


@add("link_resolve_general", f"WITH {_LINKS} SELECT * FROM k")
def link_resolve_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.links(pages(spark, sf_dir))


_ROBOTS = "(VALUES ('http://a.com', 'User-agent: bot' || chr(10) || 'Disallow: /x' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /admin' || chr(10) || '# c' || chr(10) || 'Disallow:' || chr(10) || 'Disallow: /private/' || chr(10) || 'Sitemap: http://a.com/s.xml'), ('http://b.com', 'User-agent: *' || chr(10) || 'User-agent: bot' || chr(10) || 'Disallow: /y')) AS r(origin, body)"


@add("robots_parse", f"""WITH l AS (SELECT origin, trim(line) AS line, n FROM (SELECT origin, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM {_ROBOTS})),
 p AS (SELECT origin, n, lower(trim(split_part(line, ':', 1))) AS field, trim(regexp_replace(line, '^[^:]*:', '')) AS value FROM l WHERE line NOT LIKE '#%' AND line LIKE '%:%'),
 s AS (SELECT *, last_value(CASE WHEN field = 'user-agent' THEN value END IGNORE NULLS) OVER (PARTITION BY origin ORDER BY n) AS ua FROM p)
 SELECT origin, coalesce(string_agg(value, '|' ORDER BY n) FILTER (WHERE field = 'disallow' AND ua = '*' AND value <> ''), '') AS disallow, coalesce(string_agg(value, '|' ORDER BY n) FILTER (WHERE field = 'sitemap' AND value <> ''), '') AS sitemaps FROM s GROUP BY origin""")
def robots_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.robots_rules(spark.sql(f"SELECT * FROM {_ROBOTS}")).select("origin", F.array_join("disallow", "|").alias("disallow"), F.array_join("sitemaps", "|").alias("sitemaps"))


@add("robots_blocked", f"SELECT page_id, {_PATH('url')} LIKE '/fr%' OR {_PATH('url')} LIKE '/es/2%' AS blocked FROM pages")
def robots_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select("page_id", "url")
    files = rows.select(U.origin(c("url")).alias("origin")).distinct().withColumn("body", F.lit("User-agent: *\nDisallow: /fr\nDisallow: /es/2"))
    return W.robots_blocked(rows, W.robots_rules(files)).select("page_id", "blocked")


_MAPS = """(VALUES ('http://a.com/s.xml', '<sitemapindex><sitemap><loc>http://a.com/t.xml</loc></sitemap><sitemap><loc>http://other.com/u.xml</loc></sitemap></sitemapindex>'),
 ('http://a.com/t.xml', '<urlset><url><loc>http://a.com/1</loc><lastmod>2024-01-01</lastmod><priority>0.5</priority></url><url><loc> http://a.com/2?a=1&amp;b=2 </loc></url><url><loc>ftp://a.com/3</loc></url></urlset>'),
 ('http://other.com/u.xml', '<urlset><url><loc>http://other.com/1</loc></url></urlset>')) AS m(url, body)"""


@add("sitemap_pages", f"""WITH RECURSIVE e AS (SELECT url, unnest(regexp_extract_all(body, '<(?:url|sitemap)>.*?</(?:url|sitemap)>')) AS b FROM {_MAPS}),
 x AS (SELECT url, b LIKE '<sitemap>%' AS nested, replace(trim(regexp_extract(b, '<loc>(.*?)</loc>', 1)), '&amp;', '&') AS loc, nullif(regexp_extract(b, '<lastmod>(.*?)</lastmod>', 1), '') AS lastmod, TRY_CAST(nullif(regexp_extract(b, '<priority>(.*?)</priority>', 1), '') AS DOUBLE) AS priority FROM e),
 r(url, depth) AS (SELECT 'http://a.com/s.xml', 0 UNION SELECT loc, depth + 1 FROM r JOIN x USING (url) WHERE nested AND depth < 2 AND {_ORIGIN('loc')} = 'http://a.com')
 SELECT loc, lastmod, priority FROM r JOIN x USING (url) WHERE NOT nested AND regexp_matches(loc, '^https?://')""")
def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sitemap_pages(spark.sql("SELECT 'http://a.com/s.xml' AS url"), spark.sql(f"SELECT * FROM {_MAPS}"))


@add("glob_filter", f"SELECT page_id FROM pages WHERE regexp_matches({_PATH('url')}, '^/(?:en|fr)/[^/]*$') AND NOT regexp_matches({_PATH('url')}, '^/.*7$')")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.admitted(pages(spark, sf_dir).select("page_id", "url"), None, ["/{en,fr}/*"], ["/**7"]).select("page_id")


def _site_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as pages of one site, each linking to three others by arithmetic on its key."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(c("n_nationkey").alias("k"))
    rows = n.select("k", F.posexplode(F.array(*((c("k") * m + a) % 25 for m, a in ((2, 1), (3, 7), (1, 5))))).alias("pos", "to"))
    url = lambda x: F.concat(F.lit("http://s.com/p/"), x.cast("string"))
    return rows.select(url(c("k")).alias("src"), url(c("to")).alias("link"), "pos")


@add("frontier_bfs", """WITH RECURSIVE e AS (SELECT 'http://s.com/p/' || n_nationkey AS src, 'http://s.com/p/' || ((n_nationkey * m + a) % 25) AS link, pos FROM nation, (VALUES (2, 1, 0), (3, 7, 1), (1, 5, 2)) t(m, a, pos)),
 w(url, depth) AS (SELECT 'http://s.com/p/0', 0 UNION SELECT link, depth + 1 FROM w JOIN e ON url = src WHERE depth < 2) SELECT url, min(depth) AS depth FROM w GROUP BY url""")
def frontier_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.crawl("http://s.com/p/0", _site_graph(spark, sf_dir), max_depth=2).select("url", "depth")


@add("crawl_summary", """WITH RECURSIVE e AS (SELECT n_nationkey AS k, (n_nationkey * m + a) % 25 AS t FROM nation, (VALUES (2, 1), (3, 7), (1, 5)) t(m, a)),
 w(k, depth) AS (SELECT 0, 0 UNION SELECT t, depth + 1 FROM w JOIN e USING (k) WHERE depth < 3), p AS (SELECT least(count(DISTINCT k), 10) AS n FROM w) SELECT n AS pages_total, n AS pages_success, 0::BIGINT AS pages_failed, 0::BIGINT AS pages_blocked FROM p""")
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.runs import crawl_summary as summary

    rows = W.crawl("http://s.com/p/0", _site_graph(spark, sf_dir), max_depth=3, max_pages=10)
    return summary(rows.withColumn("success", F.lit(True)))


# --- cookies ----------------------------------------------------------------------------------

cases("cookie_parse", "h", "('a=1; b=2=3; a=9'), ('x'), ('=v; k= w ')", "CASE h WHEN 'a=1; b=2=3; a=9' THEN 'a:9|b:2=3' WHEN 'x' THEN '' ELSE 'k:w' END AS m",
      m=lambda: F.array_join(F.array_sort(F.transform(F.map_entries(C.parse_header(c("h"))), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), "|"))
_COOKIES = "(VALUES ('.example.com', true, '/', false, 0, 'a', '1', 0), ('example.com', false, '/api', false, 0, 'b', '2', 1), ('.example.com', true, '/', true, 0, 'c', '3', 2), ('.example.com', true, '/', false, 5, 'd', '4', 3), ('.example.com', true, '/', false, 0, 'a', '9', 4)) AS k(domain, subdomains, path, secure, expires, name, value, pos)"


@add("cookie_match", f"""WITH u AS (SELECT * FROM (VALUES ('https://example.com/api/x'), ('http://sub.example.com/apiv2'), ('https://badexample.com/'), ('http://example.com/apiv2')) t(url)),
 p AS (SELECT url, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host, {_PATH('url')} AS path, url LIKE 'https:%' AS tls FROM u)
 SELECT url, name, arg_max(value, pos) AS value FROM (SELECT p.url, k.name, k.value, k.pos FROM p JOIN {_COOKIES} ON (host = ltrim(domain, '.') OR subdomains AND host LIKE '%.' || ltrim(domain, '.')) AND (NOT secure OR tls) AND (expires = 0 OR expires >= 100) AND (p.path = k.path OR starts_with(p.path, k.path) AND (k.path LIKE '%/' OR substr(p.path, length(k.path) + 1, 1) = '/'))) GROUP BY url, name""")
def cookie_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.sql("SELECT * FROM (VALUES ('https://example.com/api/x'), ('http://sub.example.com/apiv2'), ('https://badexample.com/'), ('http://example.com/apiv2')) AS t(url)")
    return C.matching(asked, spark.sql(f"SELECT * FROM {_COOKIES}"), 100)


_JAR = "(VALUES " + ", ".join(f"({i}, replace('{v}', '~', chr(9)))" for i, v in enumerate(("# c", ".x.com~TRUE~/~FALSE~0~n~v", "", "bad~line", "#HttpOnly_.x.com~TRUE~/~FALSE~0~n~v", ".x.com~TRUE~/~FALSE~soon~n~v", "y.com~FALSE~/a~TRUE~99~m~w"))) + ") AS t(pos, value)"


@add("cookie_file", f"SELECT pos, f[1] AS domain, f[2] = 'TRUE' AS subdomains, f[3] AS path, f[4] = 'TRUE' AS secure, TRY_CAST(f[5] AS BIGINT) AS expires, f[6] AS name, f[7] AS value FROM (SELECT pos, string_split(value, chr(9)) AS f FROM {_JAR} WHERE value NOT LIKE '#%') WHERE len(f) = 7 AND TRY_CAST(f[5] AS BIGINT) IS NOT NULL")
def cookie_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.netscape(spark.sql(f"SELECT * FROM {_JAR}"))


# --- selection --------------------------------------------------------------------------------

_CANDS = """SELECT doc_id // 4 AS page_id, CASE doc_id % 4 WHEN 0 THEN 'readability' WHEN 1 THEN 'text-density' WHEN 2 THEN 'selector:article' ELSE 'next-rsc' END AS method, text,
 CASE WHEN doc_id % 3 = 0 THEN 'by ' || doc_id WHEN doc_id % 3 = 1 THEN '' END AS byline, CASE WHEN doc_id % 5 = 0 THEN 't' || doc_id END AS published_time, CASE WHEN doc_id % 2 = 0 THEN source END AS site_name, lang FROM documents"""
_WIN = f"""cand AS ({_CANDS}), m AS (SELECT *, coalesce(length(text), 0) AS n, CASE WHEN method LIKE 'selector:%' THEN 'selector' ELSE method END AS s FROM cand),
 g AS (SELECT page_id, max(n) FILTER (WHERE s = 'readability') AS r, max(n) FILTER (WHERE s = 'text-density') AS d, max(n) FILTER (WHERE s = 'next-rsc') AS q FROM m GROUP BY page_id),
 kept AS (SELECT m.* FROM m JOIN g USING (page_id) WHERE s <> 'readability' OR NOT coalesce(d > 2 * r AND d >= 500 OR q > 2 * r AND q >= 500, false)),
 tiered AS (SELECT *, CASE WHEN n >= 500 AND s <> 'selector' THEN 1 WHEN n >= 200 THEN 2 ELSE 3 END AS tier, list_position(['{"', '".join(S.PRIORITY)}'], s) AS place FROM kept),
 won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY tier, CASE WHEN tier = 1 THEN -n ELSE 0 END, place, method, text) AS rn FROM tiered) WHERE rn = 1)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("doc_id")
    return documents(spark, sf_dir).select(
        F.floor(k / 4).alias("page_id"), F.element_at(F.array(*map(F.lit, ("readability", "text-density", "selector:article", "next-rsc"))), (k % 4 + 1).cast("int")).alias("method"), "text",
        F.when(k % 3 == 0, F.concat(F.lit("by "), k.cast("string"))).when(k % 3 == 1, "").alias("byline"), F.when(k % 5 == 0, F.concat(F.lit("t"), k.cast("string"))).alias("published_time"), F.when(k % 2 == 0, c("source")).alias("site_name"), "lang",
    )


@add("comparator_2x", f"WITH {_WIN} SELECT page_id, method FROM kept")
def comparator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.suppressed(candidates(spark, sf_dir)).select("page_id", "method")


@add("winner_selection", f"WITH {_WIN} SELECT page_id, method, n AS chars, tier FROM won")
def winner_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.winners(S.suppressed(candidates(spark, sf_dir))).select("page_id", "method", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), "tier")


@add("compose_metadata", f"""WITH {_WIN}, o AS (SELECT m.page_id, CASE WHEN m.method = w.method THEN 0 ELSE 2 + list_position(['{"', '".join(S.LENDERS)}'], m.s) END AS ord, m.byline, m.published_time, m.site_name, m.lang FROM m JOIN won w USING (page_id)
 UNION ALL SELECT page_id, 1, 'ld ' || page_id, NULL, NULL, NULL FROM g WHERE page_id % 2 = 0)
 SELECT page_id, arg_min(byline, ord) FILTER (WHERE byline <> '') AS byline, arg_min(published_time, ord) FILTER (WHERE published_time <> '') AS published_time, arg_min(site_name, ord) FILTER (WHERE site_name <> '') AS site_name, arg_min(lang, ord) FILTER (WHERE lang <> '') AS lang FROM o GROUP BY page_id""")
def compose_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    ld = rows.filter("page_id % 2 = 0").select("page_id", F.concat(F.lit("ld "), c("page_id").cast("string")).alias("byline"), F.lit(None).cast("string").alias("published_time")).distinct()
    return S.composed(rows, S.winners(S.suppressed(rows)), ld)


@add("fast_path", f"""WITH m AS ({_CANDS}), n AS (SELECT page_id, replace(replace(method, 'next-rsc', 'next-data'), 'text-density', 'json-ld') AS method, text FROM m)
 SELECT page_id, arg_min(method, CASE method WHEN 'next-data' THEN 0 ELSE 1 END) AS method FROM n WHERE length(text) >= 500 AND (method = 'next-data' AND page_id % 2 = 0 OR method = 'json-ld' AND page_id % 3 = 0) GROUP BY page_id""")
def fast_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).withColumn("method", F.replace(F.replace("method", F.lit("next-rsc"), F.lit("next-data")), F.lit("text-density"), F.lit("json-ld")))
    settings = rows.select("page_id", (c("page_id") % 2 == 0).alias("use_next_data"), (c("page_id") % 3 == 0).alias("prefer_json_ld")).distinct()
    return S.fast_path(rows, settings).select("page_id", "method")


cases("wp_versus_dom", "page_id, wp_text, dom_text, wp_title, dom_title", "(1, repeat('w', 300), repeat('d', 700), 'W', 'D'), (2, repeat('w', 400), repeat('d', 700), CAST(NULL AS VARCHAR(1)), 'D'), (3, 'w', repeat('d', 499), 'W', 'D')",
      "CASE WHEN length(dom_text) > 2 * length(wp_text) AND length(dom_text) >= 500 THEN 'dom' ELSE 'wp' END AS body, coalesce(wp_title, dom_title) AS title")
_WP = SQL["wp_versus_dom"].partition(" FROM ")[2]
SQL["wp_versus_dom"] = "SELECT page_id, CASE WHEN length(dom_text) > 2 * length(wp_text) AND length(dom_text) >= 500 THEN 'dom' ELSE 'wp' END AS body, coalesce(wp_title, dom_title) AS title FROM " + _WP
QUERIES["wp_versus_dom"] = lambda spark, sf_dir: S.wp_or_dom(spark.sql(f"SELECT * FROM {_WP}")).select("page_id", "body", "title")
