"""Cookies: headers, Netscape files, and which of them a request carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U


def parse_header(header: Column) -> Column:
    """map of `a=b; c=d`: split at the first =, control characters stripped from values, last wins."""
    pairs = F.filter(F.transform(F.split(header, ";"), lambda x: F.trim(x)), lambda p: F.instr(p, "=") > 1)
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_replace(F.regexp_replace(p, r"^[^=]*=", ""), r"[\r\n\x00]", "")).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(last)


def netscape(lines: DataFrame) -> DataFrame:
    """Cookies of tab-separated lines (value, pos): seven fields, an integer expiry; blank lines
    and those beginning with # are none."""
    f = F.split("value", "\t")
    rows = lines.filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#")).select("pos", f.alias("f")).filter((F.size("f") >= 7) & F.element_at("f", 5).rlike(r"^\d+$"))
    col = lambda i: F.element_at("f", i)
    return rows.select("pos", col(1).alias("domain"), (F.upper(col(2)) == "TRUE").alias("subdomains"), col(3).alias("path"), (F.upper(col(4)) == "TRUE").alias("secure"), col(5).cast("long").alias("expires"), F.trim(col(6)).alias("name"), F.trim(col(7)).alias("value"))


def matching(urls: DataFrame, cookies: DataFrame, now: int) -> DataFrame:
    """url, name and value of the cookies each URL carries; of one name the later line counts.

    An equi-join on the host's suffixes instead of a comparison of every cookie with every URL.
    """
    bare = F.lower(F.regexp_replace("domain", r"^\.", ""))
    c = cookies.withColumn("key", bare).filter((F.col("expires") == 0) | (F.col("expires") >= now)).withColumnRenamed("path", "cookie_path")
    labels = F.split(U.host(F.col("url")), r"\.")
    keys = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rows = urls.select("url", U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"), U.scheme(F.col("url")).alias("scheme"), F.explode(keys).alias("key")).join(c, "key")
    p, q = F.col("path"), F.col("cookie_path")
    under = (p == q) | (p.startswith(q) & (q.endswith("/") | p.startswith(F.concat(q, F.lit("/")))))
    rows = rows.filter(((F.col("host") == F.col("key")) | F.col("subdomains")) & (~F.col("secure") | (F.col("scheme") == "https")) & under)
    return rows.groupBy("url", "name").agg(F.max(F.struct("pos", "value")).getField("value").alias("value"))


def merged(file: Column, explicit: Column) -> Column:
    """Two maps in one; of one name the explicit cookie counts."""
    empty = F.create_map().cast("map<string,string>")
    own = F.coalesce(explicit, empty)
    return F.map_concat(F.map_filter(F.coalesce(file, empty), lambda k, v: ~F.map_contains_key(own, k)), own)
