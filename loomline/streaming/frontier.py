"""Structured Streaming forms of the crawl's incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import count_words
from ..operators.validate import quick_validate, visible_text


def fresh_urls(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """URLs (url, seen_at) not seen within the watermark, in normal form. State is one row a URL
    and goes with the watermark."""
    rows = stream.withColumn("url", U.normalize(F.col("url"))).filter(U.is_http(F.col("url")))
    return rows.withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["url"])


def validated(stream: DataFrame) -> DataFrame:
    """Pages (url, html) with their validation code and words; stateless."""
    return stream.select("url", F.coalesce(quick_validate(F.col("html"), F.lit(200), F.lit("text/html")), F.lit("valid")).alias("code"), count_words(visible_text(F.col("html"))).alias("words"))


def run_rates(stream: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Pass counts per window of a stream of results (at, status); late rows count up to the watermark."""
    return stream.withWatermark("at", watermark).groupBy(F.window("at", window)).agg(F.count("*").alias("total"), F.count(F.when(F.col("status") == "pass", 1)).alias("passed")).select(F.col("window.start").alias("start"), "total", "passed")
