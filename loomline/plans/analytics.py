"""Queries over the run store, and the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs as R
from ..sources.runstore import results_from_events, runs_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The last two runs of the driver's events and the last five, by id.
BASE = """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
r AS (SELECT event_id AS id, 'run-' || strftime(ts, '%Y%m%d') AS run_id,
 'site-' || CAST(CAST(floor(user_id / 2) AS BIGINT) AS VARCHAR) || CASE WHEN user_id % 2 = 1 THEN ' (latest)' ELSE '' END AS test_name,
 'https://site' || user_id || '.example.com/' AS url, CASE WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END AS status,
 CASE event_type WHEN 'view' THEN 'readability' WHEN 'click' THEN 'json-ld' WHEN 'purchase' THEN 'text-density' WHEN 'signup' THEN 'wp-rest-api' END AS extract_strategy,
 CASE WHEN event_type <> 'error' THEN k * k * 7 END AS content_length, CAST(floor(value * 100) AS BIGINT) AS fetch_duration_ms,
 CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN 'network_error' WHEN 1 THEN 'http_status_error' ELSE 'insufficient_content' END END AS error_message,
 strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at FROM e),
runs AS (SELECT run_id, min(created_at) AS started_at, max(created_at) AS ended_at, count(*) AS total_tests,
 CAST(sum(CASE WHEN status = 'pass' THEN 1 ELSE 0 END) AS BIGINT) AS passed_tests, CAST(sum(CASE WHEN status = 'fail' THEN 1 ELSE 0 END) AS BIGINT) AS failed_tests FROM r GROUP BY run_id),
ranked AS (SELECT run_id, row_number() OVER (ORDER BY started_at DESC, run_id DESC) AS n FROM runs),
lastrow AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, test_name ORDER BY id DESC) AS rn FROM r) WHERE rn = 1),
prev AS (SELECT * FROM lastrow WHERE run_id = (SELECT run_id FROM ranked WHERE n = 2)),
curr AS (SELECT * FROM lastrow WHERE run_id = (SELECT run_id FROM ranked WHERE n = 1))
"""
_COUNT = "CAST(count(*) AS BIGINT) AS total_tests, CAST(sum(CASE WHEN status = 'pass' THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN status = 'fail' THEN 1 ELSE 0 END) AS BIGINT) AS failed"
_RATE = "round(100.0 * CAST(sum(CASE WHEN status = 'pass' THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE), {}) AS pass_rate"


def _mode(key: str, column: str, name: str) -> str:
    return f"""{name} AS (SELECT key, v FROM (SELECT {key} AS key, {column} AS v, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {column}) AS n
 FROM r WHERE {column} IS NOT NULL GROUP BY {key}, {column}) WHERE n = 1)"""


def add(name: str, sql: str | None = None, base: bool = True) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = (BASE if base else "") + sql
        return f

    return put


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def recent_ids(results: DataFrame, n: int) -> list[str]:
    """The newest n completed runs, oldest first: n ids come to the driver."""
    return [r["run_id"] for r in R.recent_runs(R.completed_runs(runs_of(results)), n).select("run_id").collect()][::-1]


def last_two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = store(spark, sf_dir)
    before, now = recent_ids(rows, 2)
    last = R.last_of(rows.filter(F.col("run_id").isin(before, now)))
    return last.filter(F.col("run_id") == before), last.filter(F.col("run_id") == now)


def _stats_sql(key: str, more: str = "") -> str:
    return f", {_mode(key, 'extract_strategy', 'ms')}, {_mode(key, 'error_message', 'me')}\nSELECT g.*, ms.v AS most_common_strategy, me.v AS most_common_error FROM (SELECT {key} AS {'url' if key == 'url' else 'site'}, {_COUNT}, {_RATE.format(2)}, round(avg(fetch_duration_ms), 2) AS avg_duration_ms, round(avg(content_length), 2) AS avg_content_length{more} FROM r GROUP BY 1) g LEFT JOIN ms ON ms.key = g.{'url' if key == 'url' else 'site'} LEFT JOIN me ON me.key = g.{'url' if key == 'url' else 'site'}"


SITE = "replace(test_name, ' (latest)', '')"


@add("url_stats", _stats_sql("url"))
def url_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.url_stats(store(spark, sf_dir))


@add("site_stats", _stats_sql(SITE, ", max(CASE WHEN test_name NOT LIKE '% (latest)' THEN url END) AS stable_url, max(CASE WHEN test_name LIKE '% (latest)' THEN url END) AS latest_url"))
def site_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.site_stats(store(spark, sf_dir))


@add("overall_stats", f"SELECT CAST(count(DISTINCT run_id) AS BIGINT) AS total_runs, CAST(count(DISTINCT url) AS BIGINT) AS unique_urls, {_COUNT}, {_RATE.format(2)} FROM r")
def overall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overall_stats(store(spark, sf_dir))


@add("strategy_distribution", "SELECT coalesce(extract_strategy, 'none') AS strategy, count(*) AS count, round(avg(content_length), 2) AS avg_content_length FROM r GROUP BY extract_strategy")
def strategy_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.strategy_distribution(store(spark, sf_dir))


@add("error_breakdown_top20", "SELECT error_message, count(*) AS count, count(DISTINCT url) AS urls_affected FROM r WHERE error_message IS NOT NULL GROUP BY error_message ORDER BY count DESC, error_message LIMIT 20")
def error_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.error_breakdown(store(spark, sf_dir))


@add("length_buckets", "SELECT CASE WHEN content_length IS NULL OR content_length = 0 THEN 'empty (0)' WHEN content_length < 500 THEN 'tiny (<500)' WHEN content_length < 2000 THEN 'short (500-2k)' WHEN content_length < 10000 THEN 'medium (2k-10k)' WHEN content_length < 50000 THEN 'long (10k-50k)' ELSE 'very long (50k+)' END AS bucket, count(*) AS count FROM r GROUP BY 1")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.length_buckets(store(spark, sf_dir))


@add("failed_urls_last", "SELECT url, fail_count, error_message AS last_error, extract_strategy AS last_strategy FROM (SELECT url, error_message, extract_strategy, count(*) OVER (PARTITION BY url) AS fail_count, row_number() OVER (PARTITION BY url ORDER BY id DESC) AS n FROM r WHERE status = 'fail') WHERE n = 1")
def failed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.failed_urls(store(spark, sf_dir))


@add("recent_runs", "SELECT run_id, started_at, ended_at, total_tests, passed_tests, failed_tests FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 20")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recent_runs(runs_of(store(spark, sf_dir)), 20)


@add("completed_runs_since", "SELECT run_id, started_at, ended_at, total_tests, passed_tests, failed_tests FROM runs WHERE total_tests > 0 AND started_at LIKE '____-__-__T%' AND started_at >= '2024-01-10T00:00:00'")
def completed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.completed_runs(runs_of(store(spark, sf_dir)), "2024-01-10T00:00:00")


def _flaky_sql(name: str) -> str:
    return f"SELECT *, round(100 - 2 * abs(pass_rate - 50), 1) AS flakiness FROM (SELECT {name} AS site, count(*) AS total_runs, CAST(sum(CASE WHEN status = 'pass' THEN 1 ELSE 0 END) AS BIGINT) AS passes, CAST(sum(CASE WHEN status = 'fail' THEN 1 ELSE 0 END) AS BIGINT) AS fails, {_RATE.format(1)} FROM r GROUP BY 1) WHERE passes > 0 AND fails > 0 AND total_runs >= 5 ORDER BY abs(pass_rate - 50), total_runs DESC, site LIMIT 30"


@add("flaky_sites", _flaky_sql(SITE))
def flaky_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.flaky(store(spark, sf_dir))


@add("flaky_tests", _flaky_sql("test_name"))
def flaky_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.flaky(store(spark, sf_dir), by_site=False)


@add("strategy_effectiveness", f"SELECT coalesce(extract_strategy, 'none') AS strategy, count(*) AS total, CAST(sum(CASE WHEN status = 'pass' THEN 1 ELSE 0 END) AS BIGINT) AS passes, {_RATE.format(1)}, round(avg(content_length)) AS avg_length, round(avg(fetch_duration_ms)) AS avg_duration, count(DISTINCT test_name) AS unique_sites FROM r GROUP BY extract_strategy")
def strategy_effectiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.strategy_effectiveness(store(spark, sf_dir))


@add("quality_by_strategy", "SELECT coalesce(extract_strategy, 'none') AS strategy, CAST(sum(CASE WHEN content_length < 500 THEN 1 ELSE 0 END) AS BIGINT) AS tiny, CAST(sum(CASE WHEN content_length >= 500 AND content_length < 2000 THEN 1 ELSE 0 END) AS BIGINT) AS short, CAST(sum(CASE WHEN content_length >= 2000 AND content_length < 10000 THEN 1 ELSE 0 END) AS BIGINT) AS medium, CAST(sum(CASE WHEN content_length >= 10000 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM r WHERE status = 'pass' GROUP BY extract_strategy")
def quality_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quality_by_strategy(store(spark, sf_dir))


_HISTORY = f"SELECT id, run_id, started_at, test_name, status, content_length, extract_strategy, error_message FROM r JOIN runs USING (run_id) WHERE {SITE} = 'site-7' ORDER BY started_at DESC, id DESC LIMIT 50"


@add("site_history", _HISTORY)
def site_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir)
    return R.history(rows, runs_of(rows), "site-7")


@add("site_history_summary", f"SELECT count(*) AS total, CAST(sum(CASE WHEN status = 'pass' THEN 1 ELSE 0 END) AS BIGINT) AS passes, {_RATE.format(1)}, round(avg(content_length), 2) AS avg_length FROM ({_HISTORY})")
def site_history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir)
    return R.history_summary(R.history(rows, runs_of(rows), "site-7"))


@add("site_search", f"SELECT DISTINCT {SITE} AS site FROM r WHERE lower({SITE}) LIKE '%' || lower('Site-1') || '%' ORDER BY site LIMIT 10")
def site_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search_sites(store(spark, sf_dir), "Site-1")


@add("last_result_per_test", "SELECT run_id, test_name, id, status, content_length FROM lastrow")
def last_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_of(store(spark, sf_dir)).select("run_id", "test_name", "id", "status", "content_length")


_BASE_SITE = "regexp_replace(test_name, ' \\(latest\\)$', '')"


@add("site_group_status", f"SELECT run_id, {_BASE_SITE} AS site, CASE WHEN bool_and(status = 'pass') THEN 'pass' ELSE 'fail' END AS status, max(content_length) AS content_length FROM lastrow GROUP BY 1, 2")
def site_group_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.site_status(store(spark, sf_dir))


@add("site_pairs", f"SELECT run_id, {_BASE_SITE} AS site, max(CASE WHEN test_name NOT LIKE '% (latest)' THEN status END) AS stable, max(CASE WHEN test_name LIKE '% (latest)' THEN status END) AS latest FROM lastrow GROUP BY 1, 2")
def site_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.site_pairs(store(spark, sf_dir))


_COMPARE = """SELECT {k}, p.status AS prev, c.status AS curr, CASE WHEN p.status IS NULL THEN 'new' WHEN c.status IS NULL THEN 'removed' WHEN p.status = 'pass' AND c.status = 'fail' THEN 'regression'
 WHEN p.status = 'fail' AND c.status = 'pass' THEN 'fix' WHEN c.status = 'fail' THEN 'still_failing' ELSE 'still_passing' END AS category FROM {p} p FULL JOIN {c} c USING ({k})"""


@add("two_run_compare", _COMPARE.format(k="test_name", p="prev", c="curr"))
def two_run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.compare(*last_two(spark, sf_dir), "test_name")


@add("two_run_compare_sites", ", " + ", ".join(f"s{t} AS (SELECT {_BASE_SITE} AS site, CASE WHEN bool_and(status = 'pass') THEN 'pass' ELSE 'fail' END AS status FROM {t} GROUP BY 1)" for t in ("prev", "curr")) + "\n" + _COMPARE.format(k="site", p="sprev", c="scurr"))
def two_run_compare_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.compare(*(R.site_status(x) for x in last_two(spark, sf_dir)), "site")


@add("two_run_net_change", ", d AS (" + _COMPARE.format(k="test_name", p="prev", c="curr") + ") SELECT category, count(*) AS count, CAST(sum(CASE category WHEN 'fix' THEN 1 WHEN 'regression' THEN -1 ELSE 0 END) AS BIGINT) AS net FROM d GROUP BY category")
def two_run_net_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.compare(*last_two(spark, sf_dir), "test_name")
    return rows.groupBy("category").agg(F.count("*").alias("count"), F.sum(F.when(F.col("category") == "fix", 1).when(F.col("category") == "regression", -1).otherwise(0)).alias("net"))


@add("two_run_content_change", """SELECT *, CASE WHEN curr_len < 2000 OR full_pct < -50 THEN 'degraded' WHEN full_pct > 50 AND curr_len > 2000 THEN 'improved' ELSE 'changed' END AS kind FROM (
 SELECT *, round(full_pct, 4) AS pct FROM (SELECT test_name, coalesce(p.content_length, 0) AS prev_len, coalesce(c.content_length, 0) AS curr_len, c.extract_strategy, coalesce(c.content_length, 0) - coalesce(p.content_length, 0) AS delta,
 CASE WHEN coalesce(p.content_length, 0) > 0 THEN CAST(coalesce(c.content_length, 0) - coalesce(p.content_length, 0) AS DOUBLE) / p.content_length * 100 WHEN coalesce(c.content_length, 0) > 0 THEN 100.0 ELSE 0.0 END AS full_pct
 FROM prev p JOIN curr c USING (test_name) WHERE p.status = 'pass' AND c.status = 'pass') WHERE abs(full_pct) > 20 OR abs(delta) > 2000)""".replace("SELECT *, CASE WHEN curr_len", "SELECT * EXCLUDE (full_pct), CASE WHEN curr_len"))
def two_run_content_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.content_change(*last_two(spark, sf_dir), "test_name")


@add("two_run_most_changed", f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY abs(pct) DESC, test_name) AS INTEGER) AS rank FROM ({SQL['two_run_content_change']}) WHERE kind IN ('degraded', 'improved')) WHERE rank <= CASE kind WHEN 'degraded' THEN 15 ELSE 10 END")
def two_run_most_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.most_changed(R.content_change(*last_two(spark, sf_dir), "test_name"))


@add("low_content_warning", "SELECT test_name, c.content_length AS curr_len, p.content_length AS prev_len, CAST(floor(c.content_length / 6 + 0.5) AS BIGINT) AS est_words FROM curr c LEFT JOIN prev p USING (test_name) WHERE c.status = 'pass' AND c.content_length > 0 AND c.content_length < 1200")
def low_content_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.low_content(*last_two(spark, sf_dir), "test_name")


@add("failure_persistence", "SELECT test_name, c.error_message, CASE p.status WHEN 'pass' THEN 'REGRESSED' WHEN 'fail' THEN 'PERSISTENT' ELSE 'NEW' END AS indicator FROM curr c LEFT JOIN prev p USING (test_name) WHERE c.status = 'fail'")
def failure_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.persistence(*last_two(spark, sf_dir), "test_name")


_LAST5 = ", w AS (SELECT test_name, status, 5 - n AS pos FROM lastrow JOIN ranked USING (run_id) WHERE n <= 5)"


@add("timeline_classes", _LAST5 + """ SELECT test_name, """ + " || ".join(f"coalesce(max(CASE WHEN pos = {i} THEN CASE status WHEN 'pass' THEN 'P' ELSE 'F' END END), '-')" for i in range(5)) + """ AS timeline,
 count(*) FILTER (WHERE status = 'pass') AS passes, count(*) FILTER (WHERE status = 'fail') AS fails,
 coalesce(min(pos) FILTER (WHERE status = 'pass') < max(pos) FILTER (WHERE status = 'fail'), false) AS regression, coalesce(min(pos) FILTER (WHERE status = 'fail') < max(pos) FILTER (WHERE status = 'pass'), false) AS fix,
 count(*) FILTER (WHERE status = 'fail') = 0 AS always_passing, count(*) FILTER (WHERE status = 'pass') = 0 AS always_failing,
 count(*) FILTER (WHERE status = 'pass') > 0 AND count(*) FILTER (WHERE status = 'fail') > 0 AND count(*) >= 3 AS flaky FROM w GROUP BY test_name""")
def timeline_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir)
    ids = recent_ids(rows, 5)
    return R.timeline(R.last_of(rows.filter(F.col("run_id").isin(ids))), ids, "test_name")


@add("export_pivot", _LAST5 + " SELECT test_name, " + ", ".join(f"max(CASE WHEN pos = {i} THEN CASE status WHEN 'pass' THEN 1 ELSE 0 END END) AS r{i}" for i in range(5)) + ", round(100.0 * CAST(sum(CASE WHEN status = 'pass' THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE), 1) AS pass_rate FROM w GROUP BY test_name")
def export_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir)
    ids = recent_ids(rows, 5)
    out = R.aligned(R.last_of(rows.filter(F.col("run_id").isin(ids))), ids, "test_name")
    return out.select("test_name", *(F.col(f"`{r}`").alias(f"r{i}") for i, r in enumerate(ids)), "pass_rate")


@add("export_summary", _LAST5 + """, t AS (SELECT test_name, count(*) FILTER (WHERE status = 'pass') AS p, count(*) FILTER (WHERE status = 'fail') AS f FROM w GROUP BY test_name)
 SELECT count(*) AS tests, count(*) FILTER (WHERE f = 0) AS always_passing, count(*) FILTER (WHERE p = 0) AS always_failing, count(*) FILTER (WHERE p > 0 AND f > 0 AND p + f >= 3) AS flaky FROM t""")
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline_classes(spark, sf_dir)
    return t.agg(F.count("*").alias("tests"), *(F.count(F.when(F.col(c), 1)).alias(c) for c in ("always_passing", "always_failing", "flaky")))


@add("run_summary", "SELECT * FROM runs")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(store(spark, sf_dir))


@add("retention_candidates", "SELECT run_id, started_at FROM runs WHERE started_at < '2024-01-15T00:00:00'")
def retention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(store(spark, sf_dir)).filter(F.col("started_at") < "2024-01-15T00:00:00").select("run_id", "started_at")
