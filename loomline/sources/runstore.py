"""The run store: test_runs and test_results as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "run_id string, git_commit string, run_type string, os string, network string, preset string, sites string, started_at string, ended_at string, total_tests int, passed_tests int, failed_tests int, created_at string"
RESULTS = "id long, run_id string, test_name string, url string, status string, http_status int, fetch_duration_ms long, extract_strategy string, content_length long, error_message string, archive_url string, created_at string"


def results_from_events(events: DataFrame) -> DataFrame:
    """A results table as a projection of an event stream; see the README for the rules."""
    error = F.col("event_type") == "error"
    k = F.get_json_object("props", "$.k").cast("long")
    strategy = F.when(F.col("event_type") == "view", "readability").when(F.col("event_type") == "click", "json-ld").when(F.col("event_type") == "purchase", "text-density").when(F.col("event_type") == "signup", "wp-rest-api")
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
        F.concat(F.lit("site-"), F.floor(F.col("user_id") / 2).cast("string"), F.when(F.col("user_id") % 2 == 1, " (latest)").otherwise("")).alias("test_name"),
        F.concat(F.lit("https://site"), F.col("user_id").cast("string"), F.lit(".example.com/")).alias("url"),
        F.when(error, "fail").otherwise("pass").alias("status"),
        strategy.alias("extract_strategy"),
        F.when(~error, k * k * 7).alias("content_length"),
        F.floor(F.col("value") * 100).cast("long").alias("fetch_duration_ms"),
        F.when(error, F.element_at(F.array(F.lit("network_error"), F.lit("http_status_error"), F.lit("insufficient_content")), (k % 3 + 1).cast("int"))).alias("error_message"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


def runs_of(results: DataFrame) -> DataFrame:
    """One row a run with its summary counters."""
    passed = F.sum(F.when(F.col("status") == "pass", 1).otherwise(0))
    return results.groupBy("run_id").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.count("*").alias("total_tests"), passed.alias("passed_tests"), (F.count("*") - passed).alias("failed_tests"))


class RunStore:
    """Append and read the store; columns added later read as null in older files."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        try:
            held = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return empty
            raise
        return empty.unionByName(held, allowMissingColumns=True)

    def runs(self) -> DataFrame:
        """The last state of every run."""
        rows = self._read("runs", RUNS)
        return rows.groupBy("run_id").agg(F.max_by(F.struct(*rows.columns), F.coalesce("ended_at", F.lit(""))).alias("r")).select("r.*")

    def results(self) -> DataFrame:
        return self._read("results", RESULTS)

    def start_run(self, run_id: str, started_at: str, **about: str) -> None:
        self._append("runs", [{"run_id": run_id, "run_type": "fetch", "started_at": started_at, "created_at": started_at} | about], RUNS)

    def end_run(self, run_id: str, ended_at: str, passed: int, failed: int) -> None:
        own = self.runs().filter(F.col("run_id") == run_id)
        done = own.withColumns({"ended_at": F.lit(ended_at), "total_tests": F.lit(passed + failed), "passed_tests": F.lit(passed), "failed_tests": F.lit(failed)})
        done.write.mode("append").parquet(f"{self.path}/runs")

    def record(self, rows: DataFrame) -> None:
        self.spark.createDataFrame([], RESULTS).unionByName(rows, allowMissingColumns=True).write.mode("append").parquet(f"{self.path}/results")

    def _append(self, name: str, rows: list[dict], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{self.path}/{name}")

    def expired(self, before: str | None) -> DataFrame:
        """Runs that a retention delete takes: those begun before a time, or with None all."""
        return self.runs() if before is None else self.runs().filter(F.col("started_at") < before)

    def delete(self, before: str | None, to: str) -> int:
        """Writes the store without the expired runs to `to`; how many runs went."""
        gone = self.expired(before).select("run_id")
        self.runs().join(gone, "run_id", "left_anti").write.parquet(f"{to}/runs")
        self.results().join(gone, "run_id", "left_anti").write.parquet(f"{to}/results")
        return gone.count()
