"""Robots, sitemaps, links and the breadth-first frontier as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as U

MAX_DEPTH, MAX_PAGES, QUEUE_FACTOR = 3, 100, 10
SITEMAP_ENTRIES, SITEMAP_DEPTH = 100_000, 2


def robots_rules(files: DataFrame) -> DataFrame:
    """origin, disallow and sitemaps of robots files (origin, body).

    Each User-agent line replaces the state for the lines after it; Disallow counts where the state
    is `*`, Sitemap counts anywhere. The state of a line is the last agent among those up to it.
    """
    lines = F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(x)), lambda x: ~x.startswith("#") & F.contains(x, F.lit(":")))
    told = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("field"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    rows = files.select("origin", told.alias("told"))
    agents = F.transform("told", lambda t, i: F.when(t["field"] == "user-agent", F.struct(i.alias("i"), (t["value"] == "*").alias("star"))))
    rows = rows.withColumn("agents", F.filter(agents, lambda a: a.isNotNull()))
    star = lambda i: F.coalesce(F.array_max(F.filter("agents", lambda a: a["i"] < i))["star"], F.lit(False))
    disallow = F.filter("told", lambda t, i: (t["field"] == "disallow") & (t["value"] != "") & star(i))
    sitemaps = F.filter("told", lambda t: (t["field"] == "sitemap") & (t["value"] != ""))
    return rows.select("origin", F.transform(disallow, lambda t: t["value"]).alias("disallow"), F.transform(sitemaps, lambda t: t["value"]).alias("sitemaps"))


def blocked_by(path: Column, disallow: Column) -> Column:
    """A path begins with a disallowed prefix; an unparsable URL is blocked."""
    return path.isNull() | F.coalesce(F.exists(disallow, lambda d: path.startswith(d)), F.lit(False))


def robots_blocked(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (url) with blocked; an equi-join on origin, so no pairwise comparison of all rules."""
    joined = pages.withColumn("origin", U.origin(F.col("url"))).join(rules.select("origin", "disallow"), "origin", "left")
    return joined.withColumn("blocked", blocked_by(U.path(F.col("url")), F.col("disallow"))).drop("disallow")


def sitemap_entries(files: DataFrame) -> DataFrame:
    """url, kind (page, sitemap), loc, lastmod and priority of sitemap files (url, body)."""
    block = F.regexp_extract_all("body", F.lit(r"(?is)<(?:url|sitemap)>.*?</(?:url|sitemap)>"), F.lit(0))
    rows = files.select("url", F.posexplode(block).alias("at", "b"))
    inner = lambda tag: F.nullif(F.trim(F.regexp_extract("b", rf"(?is)<{tag}>\s*(.*?)\s*</{tag}>", 1)), F.lit(""))
    out = rows.select("url", "at", F.when(F.col("b").rlike(r"(?i)^<sitemap>"), "sitemap").otherwise("page").alias("kind"), inner("loc").alias("loc"), inner("lastmod").alias("lastmod"), inner("priority").try_cast("double").alias("priority"))
    return out.withColumn("loc", F.replace("loc", F.lit("&amp;"), F.lit("&"))).filter(U.is_http(F.col("loc")))


def sitemap_pages(seeds: DataFrame, responses: DataFrame, depth: int = SITEMAP_DEPTH, most: int = SITEMAP_ENTRIES) -> DataFrame:
    """Pages reached from sitemap URLs (seeds: url) through nested sitemaps of the seeds' origins."""
    return sitemap_found(seeds, responses, depth, most).select("loc", "lastmod", "priority")


def sitemap_found(seeds: DataFrame, responses: DataFrame, depth: int = SITEMAP_DEPTH, most: int = SITEMAP_ENTRIES) -> DataFrame:
    """As sitemap_pages, with the order of the pages as (level, from, at); a bounded loop of joins
    with responses (url, body)."""
    origins = seeds.select(U.origin(F.col("url")).alias("origin")).distinct()
    frontier, seen, found = seeds.select("url"), seeds.select("url"), None
    for level in range(depth + 1):
        entries = sitemap_entries(frontier.join(responses, "url"))
        pages = entries.filter("kind = 'page'").select("loc", "lastmod", "priority", F.lit(level).alias("level"), F.col("url").alias("from"), "at")
        found = pages if found is None else found.unionByName(pages)
        nested = entries.filter("kind = 'sitemap'").select(F.col("loc").alias("url")).distinct()
        nested = nested.join(origins, U.origin(F.col("url")) == F.col("origin"), "left_semi").join(seen, "url", "left_anti")
        frontier, seen = nested, seen.unionByName(nested)
    return found.orderBy("level", "from", "at").limit(most)


def links(pages: DataFrame) -> DataFrame:
    """page_id, position and link of each distinct link of pages (page_id, url, html): resolved,
    http only, without fragment, first occurrence."""
    href = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?\bhref=[\"']([^\"']*)[\"']"), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(href).alias("pos", "href"))
    out = rows.withColumn("link", F.regexp_replace(U.resolve("url", F.replace("href", F.lit("&amp;"), F.lit("&"))), r"#.*$", "")).filter(U.is_http(F.col("link")))
    return out.groupBy("page_id", "link").agg(F.min("pos").alias("pos"))


def rooted_links(pages: DataFrame) -> DataFrame:
    """As links(), in column expressions alone: for absolute, //host, /path and #fragment links."""
    href = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?\bhref=[\"']([^\"']*)[\"']"), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(href).alias("pos", "href"))
    h, base = F.col("href"), F.col("url")
    full = F.when(h.rlike(r"(?i)^https?://"), h).when(h.startswith("//"), F.concat(U.scheme(base), F.lit(":"), h)).when(h.startswith("/"), F.concat(U.origin(base), h)).when(h.startswith("#"), base)
    out = rows.withColumn("link", F.regexp_replace(full, r"#.*$", "")).filter(U.is_http(F.col("link")))
    return out.groupBy("page_id", "link").agg(F.min("pos").alias("pos"))


def admitted(candidates: DataFrame, start_origin: str | None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Candidates (url) that the frontier's filters let in: parse, origin, include, exclude."""
    url = F.col("url")
    keep = U.origin(url).isNotNull()
    if start_origin:
        keep &= U.origin(url) == start_origin
    if include:
        keep &= U.path(url).rlike("|".join(f"(?:{U.glob_regex(g)})" for g in include))
    if exclude:
        keep &= ~U.path(url).rlike("|".join(f"(?:{U.glob_regex(g)})" for g in exclude))
    return candidates.filter(keep)


def crawl(start: str, edges: DataFrame, max_depth: int = MAX_DEPTH, max_pages: int = MAX_PAGES, same_origin: bool = True, include: list[str] | None = None, exclude: list[str] | None = None, rules: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """url, depth, seq and blocked of the pages a breadth-first crawl dequeues, in order.

    edges: src, link, pos with normalised URLs. One round a depth, at most max_depth of them: links
    of the level, filters, first occurrence by (parent, position), anti-join with the visited,
    and the budget. The queue's cap, QUEUE_FACTOR times the budget, is never smaller than what the
    budget leaves, so it decides only what is dropped beyond it. Blocked pages take budget and
    yield no links. Levels are checkpointed where a checkpoint folder is set. seeds (url, and what
    they are ordered by) stand beside the start.
    """
    spark = edges.sparkSession
    begin = spark.range(1).select(U.normalize(F.lit(start)).alias("url"))
    origin = begin.select(U.origin(F.col("url"))).first()[0] if same_origin else None
    level = admitted(begin, origin, include, exclude).select("url", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("seq"))
    if seeds is not None:
        order = F.struct(*(n for n in seeds.columns if n != "url"))
        more = admitted(seeds.select(U.normalize(F.col("url")).alias("url"), order.alias("o")), origin, include, exclude).groupBy("url").agg(F.min("o").alias("o")).join(level.select("url"), "url", "left_anti")
        more = more.orderBy("o", "url").limit(max_pages - 1).withColumn("seq", F.row_number().over(Window.orderBy("o", "url")).cast("long"))
        level = level.unionByName(more.select("url", F.lit(0).alias("depth"), "seq"))
    has_folder = bool(spark.sparkContext._jsc.sc().getCheckpointDir().isDefined())
    out, used = None, 0
    for depth in range(max_depth + 1):
        if rules is not None:
            level = robots_blocked(level, rules).select("url", "depth", "seq", "blocked")
        else:
            level = level.withColumn("blocked", F.lit(False))
        level = level.checkpoint() if has_folder else level
        out = level if out is None else out.unionByName(level)
        used += level.count()
        if depth == max_depth or used >= max_pages:
            break
        found = level.filter("not blocked").join(edges, F.col("url") == F.col("src")).select(F.col("link").alias("url"), "seq", "pos")
        fresh = admitted(found, origin, include, exclude).groupBy("url").agg(F.min(F.struct("seq", "pos")).alias("first")).join(out.select("url"), "url", "left_anti")
        ranked = fresh.orderBy("first", "url").limit(max_pages - used)
        numbered = ranked.withColumn("n", F.row_number().over(Window.orderBy("first", "url")))
        level = numbered.select("url", F.lit(depth + 1).alias("depth"), (F.col("n") + used - 1).cast("long").alias("seq"))
    return out
