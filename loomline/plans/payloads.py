"""Queries over embedded JSON, and the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsoncols as J
from .web import Query

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def cases(name: str, rows: list[str], sql: str, make: Callable[[Column], dict[str, Column]]) -> None:
    """A query over inline JSON texts `j`; `sql` selects from them."""
    values = "(VALUES " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(rows)) + ") AS t(id, j)"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = make(J.parsed(F.col("j")))
        return spark.sql(f"SELECT * FROM {values}").select("id", *(c.alias(n) for n, c in made.items()))

    QUERIES[name] = run
    SQL[name] = f"SELECT id, {sql} FROM {values}"


_STR = lambda p: f"CASE WHEN json_type(j, '{p}') = 'VARCHAR' THEN json_extract_string(j, '{p}') END"
_TYPE = f"coalesce({_STR('$.\"@type\"')}, {_STR('$.\"@type\"[0]')})"
_IS = f"coalesce({_TYPE} IN ('Article', 'NewsArticle', 'BlogPosting', 'WebPage', 'ReportageNewsArticle'), false)"

cases("json_nested_value", ['{"a": [{"b": "x"}], "c": {"d": 5}}', '{"a": "x"}', '{"__proto__": {"b": "y"}}', "[1]"],
      "json_extract_string(j, '$.a[0].b') AS ab, CAST(json_extract(j, '$.c.d') AS BIGINT) AS cd, CAST(NULL AS VARCHAR) AS proto",
      lambda v: {"ab": J.value(v, "a.0.b", "string"), "cd": J.value(v, "c.d", "long"), "proto": J.value(v, "__proto__.b", "string")})
cases("json_article_types", ['{"@type": "Article"}', '{"@type": ["NewsArticle", "Thing"]}', '{"@type": ["Thing", "Article"]}', '{"@type": "Product"}', "{}"],
      f"{_IS} AS article", lambda v: {"article": J.is_article(v)})
cases("json_authors", ['{"author": "A"}', '{"author": {"name": "B"}}', '{"author": [{"name": "C"}, {"name": "D"}]}', '{"author": ["E", "F"]}', '{"author": 5}', "{}"],
      f"coalesce({_STR('$.author')}, {_STR('$.author[0].name')}, {_STR('$.author.name')}) AS author", lambda v: {"author": J.author(v)})
cases("json_access", ['{"@type": "Article", "isAccessibleForFree": "False", "wordCount": "2000"}', '{"@type": "NewsArticle", "isAccessibleForFree": false, "wordCount": 0}', '{"@type": "Article", "isAccessibleForFree": true}', '{"@type": "Article"}', '{"@type": "Product", "isAccessibleForFree": false}', '{"@type": "Article", "isAccessibleForFree": false, "wordCount": "many"}'],
      f"CASE WHEN {_IS} AND lower(json_extract_string(j, '$.isAccessibleForFree')) = 'false' THEN false END AS free, CASE WHEN {_IS} AND lower(json_extract_string(j, '$.isAccessibleForFree')) = 'false' THEN TRY_CAST(json_extract_string(j, '$.wordCount') AS BIGINT) END AS words",
      lambda v: {"free": J.paid_words(v)["free"], "words": J.paid_words(v)["words"]})
cases("json_build_id", ['{"buildId": "ab_C-1"}', '{"buildId": "a/b"}', '{"buildId": 7}', "{}"],
      f"CASE WHEN regexp_matches({_STR('$.buildId')}, '^[A-Za-z0-9_-]+$') THEN {_STR('$.buildId')} END AS build", lambda v: {"build": J.build_id(v)})
cases("json_bylines", ['{"authors": [{"name": "A"}, {"name": ""}, {"name": "B"}, {"x": 1}]}', '{"authors": []}', '{"authors": "A"}'],
      "CASE id WHEN 0 THEN 'A, B' END AS byline", lambda v: {"byline": J.joined_names(v, "authors")})
cases("json_prism_config", ['{"runtimeConfig": {"CLIENT_SIDE_API_DOMAIN": "d", "CONTENT_SOURCE": "s", "ARC_SITE": "a"}, "query": {"_website": "w"}}', '{"props": {"runtimeConfig": {"CLIENT_SIDE_API_DOMAIN": "d", "CONTENT_SOURCE": "s", "WEBSITE": "b"}}}', '{"runtimeConfig": {"CLIENT_SIDE_API_DOMAIN": "", "CONTENT_SOURCE": "s"}}', "{}"],
      "CASE WHEN id < 2 THEN 'd' END AS domain, CASE id WHEN 0 THEN 'w' WHEN 1 THEN 'b' END AS website", lambda v: {"domain": J.prism(v)["domain"], "website": J.prism(v)["website"]})
cases("json_wp_post", ['[{"title": {"rendered": "T"}, "content": "c"}]', '{"posts": [{"title": "U", "content": {"rendered": "d"}}]}', '{"title": "V"}', "[]", '"x"'],
      "CASE id WHEN 0 THEN 'T' WHEN 1 THEN 'U' WHEN 2 THEN 'V' END AS title, CASE id WHEN 0 THEN 'c' WHEN 1 THEN 'd' END AS content", lambda v: {"title": J.wp_field(J.wp_post(v), "title"), "content": J.wp_field(J.wp_post(v), "content")})
cases("json_pmc_order", ['{"meta": {"pmc_list_order": [3, 1, 2]}}', '{"meta": {"pmc_list_order": []}}', '{"meta": {"pmc_list_order": [1, "x"]}}', "{}"],
      "CASE id WHEN 0 THEN '3,1,2' END AS items", lambda v: {"items": F.array_join(J.pmc_order(v).cast("array<string>"), ",")})
cases("json_mobile_text", ['{"screens": [{"frames": [{"title": {"text": "T"}}, {"body": {"text": "B"}, "title": {"text": "no"}}, {"x": 1}]}]}', '{"screens": []}'],
      "CASE id WHEN 0 THEN 'T' || chr(10) || chr(10) || 'B' END AS text", lambda v: {"text": J.mobile_text(v)})

_AJAX = "(VALUES (0, '\"<p>a</p>\"'), (1, '{\"data\": \"\", \"content\": \"<p>b</p>\"}'), (2, '<p>c</p>'), (3, '{\"other\": 1}')) AS t(id, j)"
QUERIES["json_ajax_unwrap"] = lambda spark, sf_dir: spark.sql(f"SELECT * FROM {_AJAX}").select("id", J.ajax_html(F.col("j")).alias("html"))
SQL["json_ajax_unwrap"] = f"SELECT id, CASE id WHEN 0 THEN '<p>a</p>' WHEN 1 THEN '<p>b</p>' ELSE j END AS html FROM {_AJAX}"


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at a path of every event's JSON."""
    v = J.parsed(F.col("props"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(J.kind_of(J.value(v, "k")).alias("kind")).agg(F.count("*").alias("events"), F.sum(J.value(v, "k", "long")).alias("total"))


QUERIES["json_event_props"] = _props
SQL["json_event_props"] = "SELECT CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'BIGINT' THEN 'BIGINT' END AS kind, count(*) AS events, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1"
