"""Queries over parsed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from .web import Query, pages

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@add("dom_tag_counts", r"SELECT tag, count(*) AS nodes, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)(?:\s[^>]*)?>', 1)) AS tag FROM pages) GROUP BY tag")
def dom_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.dom_nodes(pages(spark, sf_dir)).groupBy("tag").agg(F.count("*").alias("nodes"), F.countDistinct("page_id").alias("pages"))


@add("nav_links_below", r"SELECT page_id, CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a ')) AS BIGINT) AS links FROM pages")
def nav_links_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = X.dom_nodes(pages(spark, sf_dir))
    return X.below(nodes.filter("tag = 'nav'"), nodes).groupBy("page_id").agg(F.count(F.when(F.col("tag") == "a", 1)).alias("links"))


_ARTICLE = r"trim(replace(replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]+>', '', 'g'), '&quot;', '\"'), '&amp;', '&'))".replace('\\"', '"')


@add("selector_candidates", f"SELECT page_id, 'selector:article' AS method, {_ARTICLE} AS text FROM pages WHERE length({_ARTICLE}) >= 200")
def selector_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.candidates(pages(spark, sf_dir)).filter(F.col("method").startswith("selector:")).select("page_id", "method", "text")


@add("extract_candidates")
def extract_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.candidates(pages(spark, sf_dir)).select("page_id", "method", "title", F.length("text").alias("chars"))


@add("selected_html", "SELECT page_id, '<html><body>' || array_to_string(regexp_extract_all(html, '(?s)<title>.*?</title>|<h1>.*?</h1>'), chr(10)) || '</body></html>' AS html FROM pages")
def selected_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.selected(pages(spark, sf_dir), ["title", "h1"], [".ad", "nav"]).select("page_id", "html")


@add("articles_selected", f"SELECT page_id, {_ARTICLE} AS text FROM pages WHERE length({_ARTICLE}) >= 500")
def articles_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.candidates(X.selected(pages(spark, sf_dir), "article", ["footer", "form"]))
    return found.filter("method = 'selector:article' and length(text) >= 500").select("page_id", "text")


@add("articles")
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.articles(pages(spark, sf_dir))
