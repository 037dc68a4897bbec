"""Views over control tables: results, health, history and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEALTHY, ATTENTION = 95.0, 85.0


def results_by_dataset(results: DataFrame) -> DataFrame:
    status = lambda s: F.count_if(F.col("status") == s)
    return results.groupBy("dataset_name").agg(F.count("*").alias("runs"), status("PASS").alias("passed"), status("FAIL").alias("failed"), status("ERROR").alias("errors"), F.coalesce(F.sum("failed_count"), F.lit(0)).alias("failed_records"))


def totals(results: DataFrame) -> DataFrame:
    status = lambda s: F.count_if(F.col("status") == s)
    return results.agg(F.countDistinct("dataset_name").alias("datasets"), F.count("*").alias("runs"), status("PASS").alias("passed"), status("FAIL").alias("failed"), status("ERROR").alias("errors"), F.coalesce(F.sum("failed_count"), F.lit(0)).alias("failed_records"))


def latest_results(results: DataFrame) -> DataFrame:
    """The last result of each rule; of results at one time, the one with the largest id."""
    w = Window.partitionBy("rule_id").orderBy(F.desc("checked_at"), F.desc("result_id"))
    return results.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def health(latest: DataFrame, datasets: DataFrame) -> DataFrame:
    """(dataset_name, evaluated, passed, failed, errors, quality_score, health) for each of
    ``datasets`` (dataset_name, loaded). Errors count as evaluated."""
    status = lambda s: F.count_if(F.col("status") == s)
    own = latest.groupBy("dataset_name").agg(F.count("*").alias("evaluated"), status("PASS").alias("passed"), status("FAIL").alias("failed"), status("ERROR").alias("errors"))
    joined = datasets.join(own, "dataset_name", "left").fillna(0, ["evaluated", "passed", "failed", "errors"])
    score = F.when(F.col("evaluated") > 0, F.round(F.col("passed") / F.col("evaluated") * 100, 1))
    state = F.when(~F.col("loaded"), "Not Loaded").when(F.col("evaluated") == 0, "Not Yet Assessed").when(F.col("errors") > 0, "Evaluation Error").when(score >= HEALTHY, "Healthy").when(score >= ATTENTION, "Needs Attention").otherwise("At Risk")
    return joined.select("dataset_name", "evaluated", "passed", "failed", "errors", score.alias("quality_score"), state.alias("health"))


def all_runs_score(results: DataFrame) -> DataFrame:
    """The share of passes over all runs there have been, another figure than health()."""
    return results.agg(F.when(F.count("*") > 0, F.round(F.count_if(F.col("status") == "PASS") / F.count("*") * 100, 2)).alias("all_runs_score"))


def recent(df: DataFrame, time: str, key: str, rows: int = 25) -> DataFrame:
    """The last rows by time."""
    return df.orderBy(F.desc(time), F.desc(key)).limit(rows)


def results_with_rules(results: DataFrame, rules: DataFrame) -> DataFrame:
    return results.join(rules.select("rule_id", "rule_type", "rule_status"), "rule_id", "left")


def approved_latest(results: DataFrame, rules: DataFrame) -> DataFrame:
    return latest_results(results).join(rules.where("rule_status = 'approved'").select("rule_id", "rule_type"), "rule_id")


def failed_record_trace(failed: DataFrame, results: DataFrame, rules: DataFrame) -> DataFrame:
    """Failing rows with their result and, where it is still known, their rule."""
    return failed.join(results.select("result_id", "checked_at", "status"), "result_id").join(rules.select("rule_id", "rule_type"), "rule_id", "left")


def remediation_queue(remediations: DataFrame, failed: DataFrame, results: DataFrame, rules: DataFrame) -> DataFrame:
    own = remediations.select("remediation_id", "failed_record_id", "issue_type", F.col("status").alias("remediation_status"))
    return own.join(failed.select("failed_record_id", "result_id", "rule_id", "source_row_identifier"), "failed_record_id").join(results.select("result_id", "dataset_name"), "result_id").join(rules.select("rule_id", "rule_type"), "rule_id")


def change_history(changes: DataFrame, rules: DataFrame) -> DataFrame:
    return changes.join(rules.select("rule_id", "rule_type"), "rule_id")


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")


def inbox(rules: DataFrame, remediations: DataFrame, results: DataFrame) -> DataFrame:
    """One row of the counts that wait for a steward."""
    one = lambda df, cond, name: df.agg(F.count_if(F.expr(cond)).alias(name))
    return (
        one(rules, "rule_status = 'proposed'", "proposed_rules")
        .crossJoin(one(remediations, "status = 'proposed'", "proposed_remediations"))
        .crossJoin(one(remediations, "status = 'approved'", "approved_remediations"))
        .crossJoin(one(results, "status = 'ERROR'", "evaluation_errors"))
    )


def run_artifacts(run_id: int, rules: DataFrame, results: DataFrame, failed: DataFrame, remediations: DataFrame) -> DataFrame:
    """One row: what a stewardship run has made."""
    own = lambda df: df.where(F.col("stewardship_run_id") == run_id)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return (
        count(own(rules), "rules")
        .crossJoin(count(own(results), "results"))
        .crossJoin(count(failed.join(own(results).select("result_id"), "result_id"), "failed_records"))
        .crossJoin(count(own(remediations), "remediations"))
    )


def last_loaded(column: Column, now: Column, zone: str = "America/New_York") -> Column:
    """Today, Yesterday or the day, with the time, in a zone; null is Never."""
    here, today = F.from_utc_timestamp(column, zone), F.to_date(F.from_utc_timestamp(now, zone))
    day = F.to_date(here)
    name = F.when(day == today, "Today").when(day == F.date_sub(today, 1), "Yesterday").otherwise(F.date_format(here, "MMM d, yyyy"))
    return F.when(column.isNull(), "Never").otherwise(F.concat_ws(" ", name, F.date_format(here, "h:mm a")))


def load_history(runs: DataFrame) -> DataFrame:
    """Load runs with a label for their status and rounded durations."""
    label = F.when(F.col("status") == "completed", "Completed").when(F.col("status") == "failed", "Failed").when(F.col("status") == "running", "Running").otherwise(F.col("status"))
    return runs.withColumns({"status_label": label, "duration_seconds": F.round(F.col("duration_seconds").cast("double"), 2)})
