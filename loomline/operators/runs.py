"""Analytics over test_runs and test_results.

All group-bys aggregate partially before they shuffle. The most common value of a group comes from
counts per (group, value) and a second aggregation, not from a window over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LATEST = " (latest)"


def _is(status: str) -> Column:
    return F.when(F.col("status") == status, 1).otherwise(0)


def rate(passed: Column, total: Column, places: int = 2) -> Column:
    return F.round(F.lit(100.0) * passed.cast("double") / total.cast("double"), places)


def site_name(name: Column) -> Column:
    """Every ` (latest)` taken out, as the store's SQL groups sites."""
    return F.replace(name, F.lit(LATEST), F.lit(""))


def base_site(name: Column) -> Column:
    """The suffix ` (latest)` taken off."""
    return F.regexp_replace(name, r" \(latest\)$", "")


def is_latest(name: Column) -> Column:
    return name.endswith(LATEST)


def counters() -> list[Column]:
    return [F.count("*").alias("total_tests"), F.sum(_is("pass")).alias("passed"), F.sum(_is("fail")).alias("failed")]


def most_common(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """key and its most frequent non-null value; of equally frequent ones the smallest."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("x")).select(key, F.col("x.v").alias(name))


def _stats(rows: DataFrame, key: str, *more: Column) -> DataFrame:
    own = rows.groupBy(key).agg(*counters(), F.avg("fetch_duration_ms").alias("avg_duration_ms"), F.avg("content_length").alias("avg_content_length"), *more)
    own = own.withColumn("pass_rate", rate(F.col("passed"), F.col("total_tests"))).withColumns({c: F.round(c, 2) for c in ("avg_duration_ms", "avg_content_length")})
    out = own.join(most_common(rows, key, "extract_strategy", "most_common_strategy"), key, "left")
    return out.join(most_common(rows, key, "error_message", "most_common_error"), key, "left")


def url_stats(results: DataFrame) -> DataFrame:
    return _stats(results, "url")


def site_stats(results: DataFrame) -> DataFrame:
    rows = results.withColumn("site", site_name(F.col("test_name")))
    latest = F.col("test_name").like("% (latest)")
    return _stats(rows, "site", F.max(F.when(~latest, F.col("url"))).alias("stable_url"), F.max(F.when(latest, F.col("url"))).alias("latest_url"))


def overall_stats(results: DataFrame) -> DataFrame:
    out = results.agg(F.countDistinct("run_id").alias("total_runs"), F.countDistinct("url").alias("unique_urls"), *counters())
    return out.withColumn("pass_rate", rate(F.col("passed"), F.col("total_tests")))


def strategy_distribution(results: DataFrame) -> DataFrame:
    """Rows by strategy; the null group is called none."""
    rows = results.groupBy("extract_strategy").agg(F.count("*").alias("count"), F.round(F.avg("content_length"), 2).alias("avg_content_length"))
    return rows.select(F.coalesce("extract_strategy", F.lit("none")).alias("strategy"), "count", "avg_content_length")


def error_breakdown(results: DataFrame, top: int = 20) -> DataFrame:
    rows = results.filter("error_message is not null").groupBy("error_message")
    return rows.agg(F.count("*").alias("count"), F.countDistinct("url").alias("urls_affected")).orderBy(F.desc("count"), "error_message").limit(top)


LENGTHS = ((0, "empty (0)"), (500, "tiny (<500)"), (2000, "short (500-2k)"), (10_000, "medium (2k-10k)"), (50_000, "long (10k-50k)"))


def length_bucket(n: Column) -> Column:
    out = F.when(n.isNull() | (n == 0), LENGTHS[0][1])
    for below, name in LENGTHS[1:]:
        out = out.when(n < below, name)
    return out.otherwise("very long (50k+)")


def length_buckets(results: DataFrame) -> DataFrame:
    return results.groupBy(length_bucket(F.col("content_length")).alias("bucket")).agg(F.count("*").alias("count"))


def failed_urls(results: DataFrame) -> DataFrame:
    """URLs with failures, with what the failure of the highest id says, null or not."""
    last = F.max(F.struct("id", "error_message", "extract_strategy")).alias("x")
    rows = results.filter("status = 'fail'").groupBy("url").agg(F.count("*").alias("fail_count"), last)
    return rows.select("url", "fail_count", F.col("x.error_message").alias("last_error"), F.col("x.extract_strategy").alias("last_strategy")).orderBy(F.desc("fail_count"), "url")


def completed_runs(runs: DataFrame, since: str | None = None) -> DataFrame:
    rows = runs.filter((F.col("total_tests").try_cast("int") > 0) & F.col("started_at").like("____-__-__T%"))
    return rows if since is None else rows.filter(F.col("started_at") >= since)


def recent_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def flaky(results: DataFrame, by_site: bool = True, least: int = 5, top: int = 30) -> DataFrame:
    name = site_name(F.col("test_name")) if by_site else F.col("test_name")
    rows = results.groupBy(name.alias("site")).agg(F.count("*").alias("total_runs"), F.sum(_is("pass")).alias("passes"), F.sum(_is("fail")).alias("fails"))
    rows = rows.filter((F.col("passes") > 0) & (F.col("fails") > 0) & (F.col("total_runs") >= least)).withColumn("pass_rate", rate(F.col("passes"), F.col("total_runs"), 1))
    rows = rows.withColumn("flakiness", F.round(100 - 2 * F.abs(F.col("pass_rate") - 50), 1))
    return rows.orderBy(F.abs(F.col("pass_rate") - 50), F.desc("total_runs"), "site").limit(top)


def strategy_effectiveness(results: DataFrame) -> DataFrame:
    rows = results.groupBy("extract_strategy").agg(F.count("*").alias("total"), F.sum(_is("pass")).alias("passes"), F.round(F.avg("content_length")).alias("avg_length"), F.round(F.avg("fetch_duration_ms")).alias("avg_duration"), F.countDistinct("test_name").alias("unique_sites"))
    named = rows.withColumn("strategy", F.coalesce("extract_strategy", F.lit("none"))).drop("extract_strategy")
    return named.withColumn("pass_rate", rate(F.col("passes"), F.col("total"), 1))


def quality_by_strategy(results: DataFrame) -> DataFrame:
    n = F.col("content_length")
    parts = {"tiny": n < 500, "short": (n >= 500) & (n < 2000), "medium": (n >= 2000) & (n < 10_000), "large": n >= 10_000}
    rows = results.filter("status = 'pass'").groupBy(F.coalesce("extract_strategy", F.lit("none")).alias("strategy"))
    return rows.agg(*(F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in parts.items()))


def history(results: DataFrame, runs: DataFrame, site: str, limit: int = 50) -> DataFrame:
    """A site's results with their runs, newest first."""
    own = results.filter(site_name(F.col("test_name")) == site)
    rows = own.join(runs.select("run_id", "started_at"), "run_id")
    return rows.select("id", "run_id", "started_at", "test_name", "status", "content_length", "extract_strategy", "error_message").orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def history_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.sum(_is("pass")).alias("passes"), rate(F.sum(_is("pass")), F.count("*"), 1).alias("pass_rate"), F.round(F.avg("content_length"), 2).alias("avg_length"))


def search_sites(results: DataFrame, text: str, limit: int = 10) -> DataFrame:
    name = site_name(F.col("test_name"))
    return results.filter(F.lower(name).contains(text.lower())).select(name.alias("site")).distinct().orderBy("site").limit(limit)


def last_of(results: DataFrame) -> DataFrame:
    """The row of the highest id of each (run_id, test_name): the last write counts."""
    rest = [c for c in results.columns if c not in ("run_id", "test_name", "id")]
    rows = results.groupBy("run_id", "test_name").agg(F.max(F.struct("id", *rest)).alias("x"))
    return rows.select("run_id", "test_name", "x.*")


def site_status(results: DataFrame) -> DataFrame:
    """Status of each site of each run: fail if its stable or its latest page fails."""
    rows = last_of(results).withColumn("site", base_site(F.col("test_name")))
    return rows.groupBy("run_id", "site").agg(F.when(F.bool_and(F.col("status") == "pass"), "pass").otherwise("fail").alias("status"), F.max("content_length").alias("content_length"))


def site_pairs(results: DataFrame) -> DataFrame:
    """stable and latest status of each site of each run, side by side."""
    rows = last_of(results)
    late = is_latest(F.col("test_name"))
    return rows.groupBy("run_id", base_site(F.col("test_name")).alias("site")).agg(F.max(F.when(~late, F.col("status"))).alias("stable"), F.max(F.when(late, F.col("status"))).alias("latest"))


def compare(previous: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    """category of every key of two runs: regression, fix, still_failing, still_passing, new, removed."""
    p, c = previous.select(key, F.col("status").alias("prev")), latest.select(key, F.col("status").alias("curr"))
    was, now = F.col("prev"), F.col("curr")
    kind = F.when(was.isNull(), "new").when(now.isNull(), "removed").when((was == "pass") & (now == "fail"), "regression").when((was == "fail") & (now == "pass"), "fix").when(now == "fail", "still_failing").otherwise("still_passing")
    return p.join(c, key, "full_outer").select(key, "prev", "curr", kind.alias("category"))


def content_change(previous: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    """Keys that pass in both runs and whose length changed by over 20 % or 2000."""
    p = previous.filter("status = 'pass'").select(key, F.coalesce("content_length", F.lit(0)).alias("prev_len"))
    c = latest.filter("status = 'pass'").select(key, F.coalesce("content_length", F.lit(0)).alias("curr_len"), "extract_strategy")
    rows = p.join(c, key).withColumn("delta", F.col("curr_len") - F.col("prev_len"))
    pct = F.when(F.col("prev_len") > 0, F.col("delta").cast("double") / F.col("prev_len") * 100).when(F.col("curr_len") > 0, 100.0).otherwise(0.0)
    rows = rows.withColumn("pct", pct).filter((F.abs("pct") > 20) | (F.abs("delta") > 2000))
    kind = F.when((F.col("curr_len") < 2000) | (F.col("pct") < -50), "degraded").when((F.col("pct") > 50) & (F.col("curr_len") > 2000), "improved").otherwise("changed")
    return rows.withColumn("kind", kind).withColumn("pct", F.round("pct", 4))


def most_changed(changes: DataFrame, degraded: int = 15, improved: int = 10) -> DataFrame:
    """The changes that a report names: the most degraded and the most improved, with their rank."""
    key = next(n for n in changes.columns if n not in ("prev_len", "curr_len", "extract_strategy", "delta", "pct", "kind"))
    parts = []
    for kind, n in (("degraded", degraded), ("improved", improved)):
        top = changes.filter(F.col("kind") == kind).orderBy(F.abs("pct").desc(), key).limit(n)
        parts.append(top.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("pct").desc(), key))))
    return parts[0].unionByName(parts[1])


def low_content(previous: DataFrame, latest: DataFrame, key: str, below: int = 1200) -> DataFrame:
    rows = latest.filter((F.col("status") == "pass") & (F.col("content_length") > 0) & (F.col("content_length") < below))
    rows = rows.join(previous.select(key, F.col("content_length").alias("prev_len")), key, "left")
    return rows.select(key, F.col("content_length").alias("curr_len"), "prev_len", F.floor(F.col("content_length") / 6 + 0.5).cast("long").alias("est_words"))


def persistence(previous: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    """Failures of the latest run: REGRESSED, PERSISTENT or NEW."""
    rows = latest.filter("status = 'fail'").join(previous.select(key, F.col("status").alias("prev")), key, "left")
    return rows.select(key, "error_message", F.when(F.col("prev") == "pass", "REGRESSED").when(F.col("prev") == "fail", "PERSISTENT").otherwise("NEW").alias("indicator"))


def timeline(results: DataFrame, run_ids: list[str], key: str) -> DataFrame:
    """Per key over runs in order: one status per run, and the classes they make."""
    position = F.create_map(*(x for i, r in enumerate(run_ids) for x in (F.lit(r), F.lit(i))))
    rows = results.filter(F.col("run_id").isin(run_ids)).withColumn("pos", position[F.col("run_id")])
    ok, bad = F.when(F.col("status") == "pass", F.col("pos")), F.when(F.col("status") == "fail", F.col("pos"))
    agg = rows.groupBy(key).agg(
        F.min(ok).alias("p0"), F.max(ok).alias("p1"), F.min(bad).alias("f0"), F.max(bad).alias("f1"), F.count(ok).alias("passes"), F.count(bad).alias("fails"),
        *(F.max(F.when(F.col("pos") == i, F.col("status"))).alias(f"s{i}") for i in range(len(run_ids))),
    )
    shown = F.concat(*(F.when(F.col(f"s{i}") == "pass", "P").when(F.col(f"s{i}") == "fail", "F").otherwise("-") for i in range(len(run_ids))))
    return agg.select(
        key, shown.alias("timeline"), "passes", "fails",
        F.coalesce(F.col("p0") < F.col("f1"), F.lit(False)).alias("regression"), F.coalesce(F.col("f0") < F.col("p1"), F.lit(False)).alias("fix"),
        ((F.col("passes") > 0) & (F.col("fails") == 0)).alias("always_passing"), ((F.col("fails") > 0) & (F.col("passes") == 0)).alias("always_failing"),
        ((F.col("passes") > 0) & (F.col("fails") > 0) & (F.col("passes") + F.col("fails") >= 3)).alias("flaky"),
    )


def aligned(results: DataFrame, run_ids: list[str], key: str) -> DataFrame:
    """One column a run: 1 pass, 0 fail, null absent; and the pass rate to one place."""
    rows = results.filter(F.col("run_id").isin(run_ids)).groupBy(key).pivot("run_id", run_ids).agg(F.max(_is("pass")))
    held = [F.col(f"`{r}`") for r in run_ids]
    present, passed = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in held), F.lit(0)), sum((F.coalesce(c, F.lit(0)) for c in held), F.lit(0))
    return rows.withColumn("pass_rate", F.when(present > 0, rate(passed, present, 1)).otherwise(0.0))


def export_csv(table: DataFrame, path: str) -> None:
    table.write.option("header", "true").option("nullValue", "").csv(path)


def export_json(table: DataFrame) -> DataFrame:
    return table.select(F.to_json(F.struct(*table.columns)).alias("value"))


def crawl_summary(results: DataFrame) -> DataFrame:
    """Counters of a crawl: total without blocked pages, success, failed, blocked."""
    ok, blocked = F.col("success"), F.col("blocked")
    return results.agg(F.count(F.when(~blocked, 1)).alias("pages_total"), F.count(F.when(~blocked & ok, 1)).alias("pages_success"), F.count(F.when(~blocked & ~ok, 1)).alias("pages_failed"), F.count(F.when(blocked, 1)).alias("pages_blocked"))

