"""Output modes of crawls and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def header(row: DataFrame) -> Column:
    """The default text output: a line for each field there is, a rule, and the Markdown."""
    lines = [F.when(F.length(c) > 0, F.concat(F.lit(f"{label}: "), F.col(c))) for label, c in (("Title", "title"), ("Author", "byline"), ("Site", "site_name"), ("Published", "published_time"), ("Language", "lang"), ("URL", "url")) if c in row.columns]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n---\n"), F.coalesce("markdown", "text", F.lit("")))


def page_output(rows: DataFrame, mode: str = "default") -> DataFrame:
    """One column `value`: default, json, raw, text or quiet (Markdown alone)."""
    value = {"default": header(rows), "json": F.to_json(F.struct(*rows.columns)), "raw": F.col("html") if "html" in rows.columns else F.lit(None).cast("string"), "text": F.col("text"), "quiet": F.coalesce("markdown", "text")}[mode]
    return rows.select(value.alias("value"))


def write_crawl(rows: DataFrame, path: str, mode: str = "json") -> None:
    """Crawl results as JSON lines, URLs alone, or text."""
    if mode == "json":
        rows.write.json(path)
    elif mode == "urls":
        rows.select("url").write.text(path)
    else:
        page_output(rows).write.text(path)
