"""Embedded JSON as column expressions over variants; null where the shape is another.

The forms that need no recursion; walks of unknown depth are in jsonwalk.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsonwalk import ARTICLES, BLOCKED


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def path_of(dotted: str) -> str:
    """A dotted path as a variant path; numbers index lists."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f'["{p}"]' for p in dotted.split("."))


def value(v: Column, dotted: str, kind: str = "variant") -> Column:
    """The value at a dotted path, null if a name on it is blocked."""
    if set(dotted.split(".")) & BLOCKED:
        return F.lit(None).cast(kind)
    return F.try_variant_get(v, path_of(dotted), kind)


def kind_of(v: Column) -> Column:
    """STRING, BIGINT, ARRAY, OBJECT and so on."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def string(v: Column, dotted: str) -> Column:
    """The value at a path if it is a string."""
    return F.when(kind_of(value(v, dotted)) == "STRING", value(v, dotted, "string"))


def is_article(item: Column) -> Column:
    first = F.coalesce(string(item, "@type"), string(item, "@type.0"))
    return F.coalesce(first.isin(*sorted(ARTICLES)), F.lit(False))


def author(item: Column) -> Column:
    """A string, or the name of an object or a list's first object."""
    return F.coalesce(string(item, "author"), string(item, "author.0.name"), string(item, "author.name"))


def paid_words(item: Column) -> Column:
    """struct(free, words) of an article that says it is not free."""
    said = F.lower(F.coalesce(value(item, "isAccessibleForFree", "string"), F.lit("")))
    words = F.when(F.trim(value(item, "wordCount", "string")).rlike(r"^\d+$"), F.trim(value(item, "wordCount", "string")).cast("long"))
    return F.when(is_article(item) & (said == "false"), F.struct(F.lit(False).alias("free"), words.alias("words")))


def build_id(data: Column) -> Column:
    b = string(data, "buildId")
    return F.when(b.rlike(r"^[A-Za-z0-9_-]+$"), b)


def joined_names(data: Column, dotted: str) -> Column:
    """Non-empty names of a list of objects, joined by a comma and a space."""
    names = F.transform(value(data, dotted, "array<variant>"), lambda a: string(a, "name"))
    return F.nullif(F.array_join(F.filter(names, lambda n: n.isNotNull() & (n != "")), ", "), F.lit(""))


def prism(data: Column) -> Column:
    """struct(domain, source, website) of a content API."""
    at = lambda name: F.coalesce(string(data, f"runtimeConfig.{name}"), string(data, f"props.runtimeConfig.{name}"))
    domain, source = F.nullif(at("CLIENT_SIDE_API_DOMAIN"), F.lit("")), F.nullif(at("CONTENT_SOURCE"), F.lit(""))
    site = F.nullif(F.coalesce(string(data, "query._website"), at("ARC_SITE"), at("WEBSITE")), F.lit(""))
    return F.when(domain.isNotNull() & source.isNotNull(), F.struct(domain.alias("domain"), source.alias("source"), site.alias("website")))


def wp_post(data: Column) -> Column:
    """The post of an answer: a list's first, an envelope's first, or the object itself."""
    kind = kind_of(data)
    inner = value(data, "posts")
    return F.when(kind == "ARRAY", value(data, "0")).when((kind == "OBJECT") & (kind_of(inner) == "ARRAY"), value(data, "posts.0")).when(kind == "OBJECT", data)


def wp_field(post: Column, name: str) -> Column:
    return F.coalesce(string(post, name), string(post, f"{name}.rendered"))


def pmc_order(post: Column) -> Column:
    """A list order that is not empty and holds numbers only."""
    items = value(post, "meta.pmc_list_order", "array<variant>")
    numbers = F.forall(items, lambda i: kind_of(i).isin("BIGINT", "DOUBLE", "DECIMAL"))
    return F.when((F.size(items) > 0) & numbers, F.transform(items, lambda i: F.try_variant_get(i, "$", "long")))


def ajax_html(body: Column) -> Column:
    """Markup of an answer: a JSON string, an object's data, content or html, or the body itself."""
    data = parsed(body)
    text = F.when(kind_of(data) == "STRING", F.try_variant_get(data, "$", "string"))
    inner = [F.nullif(string(data, k), F.lit("")) for k in ("data", "content", "html")]
    return F.coalesce(text, *inner, body)


def mobile_text(data: Column) -> Column:
    frames = value(data, "screens.0.frames", "array<variant>")
    lines = F.transform(frames, lambda f: F.coalesce(F.nullif(string(f, "body.text"), F.lit("")), F.nullif(string(f, "title.text"), F.lit(""))))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n\n")
