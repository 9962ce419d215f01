"""Cheap validation of a response before anything is parsed, and what follows from failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import count_words

MIN_BYTES, MIN_WORDS = 5120, 100
MIN_RESULT, ROUTE_PROBE = 100, 2000
SECURITY = ("ssrf_protection",)


def visible_text(html: Column) -> Column:
    """html without script and style elements, tags and character references."""
    plain = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>", "")
    return F.regexp_replace(F.regexp_replace(plain, r"<[^>]+>", " "), r"&#?\w+;", " ")


def quick_validate(html: Column, status: Column, content_type: Column) -> Column:
    """The first failing check's code, null if none: status, content type, size, words. The word
    count stands in the last branch, so only what passed the rest pays for it."""
    ct = F.lower(content_type)
    return (
        F.when((status < 200) | (status >= 300), "http_status_error")
        .when(ct.isNotNull() & ~F.contains(ct, F.lit("text/html")) & ~F.contains(ct, F.lit("application/xhtml+xml")), "wrong_content_type")
        .when(F.octet_length(F.coalesce(html, F.lit(""))) < MIN_BYTES, "body_too_small")
        .when(count_words(visible_text(html)) < MIN_WORDS, "insufficient_content")
    )


def is_retryable(success: Column, status: Column, error: Column) -> Column:
    """Network failures without a status, never security errors."""
    return ~success & (status == 0) & ~F.coalesce(error.isin(*SECURITY), F.lit(False))


def retry_delay(attempt: Column) -> Column:
    return (F.pow(F.lit(2.0), attempt) * 1000).cast("long")


def failure(status: Column) -> Column:
    """struct(error, action) of a failed response."""
    return (
        F.when(status == 429, F.struct(F.lit("rate_limited").alias("error"), F.lit("wait_and_retry").alias("action")))
        .when(status == 403, F.struct(F.lit("http_status_error").alias("error"), F.lit("retry_with_extract").alias("action")))
        .when(status == 0, F.struct(F.lit("network_error").alias("error"), F.lit("skip").alias("action")))
        .otherwise(F.struct(F.lit("http_status_error").alias("error"), F.lit("skip").alias("action")))
    )


def gate(text_length: Column) -> Column:
    """What the cascade does with a result of a length: fail, probe the data route, or accept."""
    n = F.coalesce(text_length, F.lit(0))
    return F.when(n < MIN_RESULT, "insufficient_content").when(n < ROUTE_PROBE, "probe_data_route").otherwise("accept")
