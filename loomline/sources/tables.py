"""Readers of the engine's input tables and files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSES = "method string, url string, status int, headers map<string,string>, body string, error string"
SITE = "userAgent string, referer string, preferJsonLd boolean, useNextData boolean, nextDataPath string, notes string, useWpRestApi boolean, wpJsonApiPath string, mobileApiConfig struct<apiUrl:string,appIdentifier:string,token:string,tokenType:string>"
MAX_BODY = 10 << 20


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored HTTP answers; bodies over the size limit read as an error."""
    rows = spark.read.schema(RESPONSES).parquet(path)
    large = F.octet_length("body") > MAX_BODY
    return rows.withColumn("error", F.when(large, "response_too_large").otherwise(F.col("error"))).withColumn("body", F.when(~large, F.col("body")))


def site_config_path() -> str | None:
    """The settings file that the environment names, ~ expanded."""
    given = os.environ.get("LOOMLINE_SITES_JSON")
    return os.path.expanduser(given) if given else None


def site_config(spark: SparkSession, text: str | None) -> DataFrame:
    """domain and settings of a JSON object of sites; a field of the wrong type reads as null and
    an entry that is no object is dropped. An operator's parameter, so it is parsed on the driver."""
    kinds = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], SITE).schema}
    right = {"string": str, "boolean": bool}
    try:
        data = json.loads(text or "{}")
    except ValueError:
        data = {}
    rows = []
    for domain, own in data.items() if isinstance(data, dict) else []:
        if not isinstance(own, dict):
            continue
        row = {"domain": domain.lower()}
        for name, kind in kinds.items():
            value = own.get(name)
            if kind.startswith("struct"):
                full = isinstance(value, dict) and all(isinstance(value.get(k), str) for k in ("apiUrl", "appIdentifier", "token", "tokenType"))
                row[name] = {k: value[k] for k in ("apiUrl", "appIdentifier", "token", "tokenType")} if full else None
            else:
                row[name] = value if isinstance(value, right[kind]) else None
        rows.append(row)
    return spark.createDataFrame(rows, f"domain string, {SITE}")


def cookie_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a cookie file with their positions (a file is read in one piece)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path and bytes of PDF files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "length", "content")


FIXTURE = "site string, technique string, priority string, tags array<string>, expectedToFail boolean, stable struct<url:string,minWords:double>, latest struct<url:string,minWords:double>, fetch struct<minWords:double>"


def fixture_cases(fixtures: DataFrame) -> DataFrame:
    """One case per stable and latest URL of site fixtures; its least words come from the page, the
    fetch settings, or are 0."""
    base = fixtures.select("site", F.coalesce("priority", F.lit("standard")).alias("priority"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "fetch", F.explode(F.array(F.struct(F.lit("").alias("suffix"), F.col("stable").alias("p")), F.struct(F.lit(" (latest)").alias("suffix"), F.col("latest").alias("p")))).alias("c")).filter("c.p.url is not null")
    return base.select(F.concat("site", "c.suffix").alias("name"), F.col("c.p.url").alias("url"), "priority", "tags", F.coalesce("c.p.minWords", "fetch.minWords", F.lit(0.0)).alias("min_words"))


def filter_cases(cases: DataFrame, sites: list[str] | None = None, priority: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """Cases whose name holds one of `sites`; without sites, those of a priority and a tag given."""
    if sites:
        keep = F.lit(False)
        for s in sites:
            keep |= F.contains(F.lower("name"), F.lit(s.lower()))
        return cases.filter(keep)
    out = cases.filter(F.col("priority").isin(priority)) if priority else cases
    return out.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else out
