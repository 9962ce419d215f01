"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_CONTENT, GOOD_CONTENT, EXCERPT = 200, 500, 200
#: Scripts whose every character counts as a word.
CJK = "　-〿぀-ゟ゠-ヿ一-鿿가-힯＀-￯"
#: Paragraphs that are no content.
BOILERPLATE = r"(?i)^thank you for your patience|^already a subscriber|^skip advertisement$|^advertisement$|^subscribe for all|^log in$"
MAX_BOILERPLATE = 200
WHITE = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: code points and one more for each outside the basic plane."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def count_words(text: Column) -> Column:
    """Words between white space, each CJK character a word; null and empty have none."""
    padded = F.regexp_replace(F.coalesce(text, F.lit("")), f"([{CJK}])", " $1 ")
    return F.regexp_count(padded, F.lit(WHITE.replace("[\\s", "[^\\s") + "+")).cast("long")


def naive_word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WHITE.replace("[\\s", "[^\\s") + "+")).cast("long")


def excerpt(given: Column, text: Column) -> Column:
    body = trimmed(text)
    cut = F.when(F.length(body) > EXCERPT, F.concat(F.substring(body, 1, EXCERPT), F.lit("..."))).otherwise(body)
    return F.when(F.length(given) > 0, given).when(F.length(body) > 0, cut)


def meets_threshold(text: Column, least: int) -> Column:
    return F.coalesce(F.length(text), F.lit(0)) >= least


def is_boilerplate(text: Column) -> Column:
    body = trimmed(text)
    return F.coalesce((F.length(body) > 0) & (F.length(body) <= MAX_BOILERPLATE) & body.rlike(BOILERPLATE), F.lit(False))


def occurrences(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def is_natural_language(text: Column) -> Column:
    n = F.length(text)
    js = F.contains(text, F.lit("function(")) | F.contains(text, F.lit("function ("))
    return F.coalesce((n > 0) & (occurrences(text, "<") <= n / 100) & ~js & (occurrences(text, "=>") <= 3) & (occurrences(text, " ") / n > 0.1), F.lit(False))


def pdf_markdown(text: Column, title: Column) -> Column:
    """Paragraphs of extracted text under an optional heading."""
    lines = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\r", "\n")
    paragraphs = F.filter(F.transform(F.split(lines, r"\n{2,}"), trimmed), lambda p: F.length(p) > 0)
    head = F.when(F.length(title) > 0, F.array(F.concat(F.lit("# "), title))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, paragraphs), "\n\n")


def article_html_sniff(text: Column) -> Column:
    return text.rlike(r"(?i)<(?:p|div|br|span|h[1-6])[\s>/]")


def bare_html_sniff(text: Column) -> Column:
    """Only `<p>` and `<div>` without attributes count."""
    return text.rlike(r"<(?:p|div)>")


def hydration_html_sniff(text: Column) -> Column:
    return text.rlike(r"(?i)<(?:p|div|h[1-6]|ul|ol|li|blockquote|figure|img|a|em|strong)[\s>]")


def page_title(html: Column) -> Column:
    """og:title by pattern, else the title element; null if neither."""
    og = F.regexp_extract(html, r"(?i)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']+)[\"']", 1)
    own = trimmed(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1))
    return F.when(F.length(og) > 0, og).when(F.length(own) > 0, own)


def cut_title(title: Column) -> Column:
    """A title element up to its first separator; what stands before a leading one is nothing."""
    return trimmed(F.element_at(F.split(title, r"\s*[-|–—]\s*"), 1))


def article_id(html: Column) -> Column:
    a = F.regexp_extract(html, r"(?i)<meta[^>]*name=[\"']article\.id[\"'][^>]*content=[\"']([^\"']+)[\"']", 1)
    b = F.regexp_extract(html, r"(?i)<meta[^>]*content=[\"']([^\"']+)[\"'][^>]*name=[\"']article\.id[\"']", 1)
    return F.when(F.length(a) > 0, a).when(F.length(b) > 0, b)


def html_lang(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang=[\"']?([^\"'\s>]+)", 1), F.lit(""))


def format_bytes(n: Column) -> Column:
    return F.when(n.isNull() | (n == 0), "-").when(n < 1000, F.floor(n + 0.5).cast("string")).when(n < 1_000_000, F.concat(F.format_string("%.1f", n / 1000), F.lit("k"))).otherwise(F.concat(F.format_string("%.1f", n / 1_000_000), F.lit("M")))


def fit_column(text: Column, width: int) -> Column:
    return F.rpad(F.substring(text, 1, width), width, " ")


def percent_bar(count: Column, total: Column, width: int = 30) -> Column:
    bar = F.repeat(F.lit("\u2588"), F.floor(count / total * width + 0.5).cast("int"))
    return F.when(total == 0, "(  0.0%)").otherwise(F.concat(F.lit("("), F.lpad(F.format_string("%.1f", count / total * 100), 5, " "), F.lit("%)  "), bar))


def delta_symbol(delta: Column) -> Column:
    return F.when(delta > 0, "\u2191").when(delta < 0, "\u2193").otherwise("\u2192")


def relative_before(spec: Column, now: Column) -> Column:
    """`Nd`, `Nh` or `Nm` before a timestamp, or an ISO day at midnight; else null."""
    n = F.regexp_extract(spec, r"^(\d+)([dhm])$", 1).try_cast("int")
    letter = F.regexp_extract(spec, r"^(\d+)([dhm])$", 2)
    seconds = n * F.when(letter == "d", 86400).when(letter == "h", 3600).when(letter == "m", 60)
    day = F.when(spec.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(spec, F.lit("yyyy-MM-dd")))
    return F.coalesce(day.cast("timestamp_ntz"), F.timestamp_seconds(F.unix_timestamp(now) - seconds).cast("timestamp_ntz"))


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))
