"""The functions that SQL may call, once registered with a session."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import dom as D

ARTICLE = "method string, title string, byline string, excerpt string, site_name string, published_time string, lang string, content string, text string, markdown string"


@F.pandas_udf(StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    """Markdown of markup; null for null."""
    return html.map(lambda h: None if h is None else D.markdown(h))


@F.udtf(returnType=ARTICLE)
class ExtractFromHtml:
    """extract_from_html(html, url): one row with a page's best candidate, or none."""

    def eval(self, html: str, url: str) -> Iterator[tuple[Any, ...]]:
        from ..operators.extract import candidates_of
        from ..operators.select import best

        found, facts = candidates_of(html)
        row = best(found, facts)
        if row:
            marks = D.markdown(row["content"]) if "<" in row.get("content", "") else row.get("text")
            yield (*(row.get(c.split()[0]) for c in ARTICLE.split(", ")[:-1]), marks)


#: Word counts need column functions of one argument: SQL bodies over built-in functions.
COUNT_WORDS = "size(filter(split(regexp_replace(coalesce(t, ''), '([{cjk}])', ' $1 '), '{white}+'), w -> w <> ''))"


def register(spark: SparkSession) -> None:
    """Makes html_to_markdown, extract_from_html and count_words callable from SQL."""
    from .text import CJK, WHITE

    spark.udf.register("html_to_markdown", html_to_markdown)
    spark.udtf.register("extract_from_html", ExtractFromHtml)
    body = COUNT_WORDS.format(cjk=CJK, white=WHITE).replace("\\", "\\\\")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION count_words(t STRING) RETURNS BIGINT RETURN {body}")
