"""Telemetry of runs and attempts: counters, statuses, errors and rollups, always derived from rows, never updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What an attempt that a broken-off run leaves behind says.
ABORT_CATEGORY = "unknown"
ABORT_MESSAGE = "this provider's execution was aborted before completing"


def jobs_per_source(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("source").agg(F.count("*").alias("jobs"))


def counters(resolved: DataFrame, *by: str) -> DataFrame:
    """discovered, inserted, updated, errors and has_conflict of outcomes."""
    o = F.col("outcome")
    return resolved.groupBy(*by).agg(
        F.count("*").alias("discovered"),
        F.count_if(o.isin("INSERTED", "AMBIGUOUS")).alias("inserted"),
        F.count_if(o.isin("UPDATED", "ATTACHED", "QUARANTINED")).alias("updated"),
        F.count_if(o == "PARSE_ERROR").alias("errors"),
        F.bool_or(o.isin("QUARANTINED", "AMBIGUOUS")).alias("has_conflict"),
    )


def attempt_status(completed: Column, incomplete: Column) -> Column:
    return F.when(~completed, "failed").when(incomplete, "partial").otherwise("completed")


def attempt_error(category: Column, message: Column) -> Column:
    return F.when(category.isNotNull(), F.struct(category.alias("category"), F.nullif(F.btrim(message, F.lit(" \t\n\r")), F.lit("")).alias("message")))


def abort(attempts: DataFrame) -> DataFrame:
    """Attempts still running become failed, with a fixed error."""
    running = F.col("status") == "running"
    return attempts.withColumns({"error_category": F.when(running, ABORT_CATEGORY).otherwise(F.col("error_category")), "error_message": F.when(running, ABORT_MESSAGE).otherwise(F.col("error_message")), "status": F.when(running, "failed").otherwise(F.col("status"))})


def possibly_incomplete(stats: DataFrame, *by: str) -> DataFrame:
    return stats.groupBy(*by).agg((F.bool_or(F.col("errors") > 0) | F.bool_or(~F.col("completed")) | F.bool_or("incomplete")).alias("possibly_incomplete"))


def run_status(attempts: DataFrame, *by: str) -> DataFrame:
    """failed for runs that broke off, and for these alone; completed_with_errors if an attempt did not complete, or there were errors of
    postings or providers, conflicts or failures of planning; else completed.

    attempts: status and aborted; had_parse_error, had_conflict, had_error and planning_failed where there are such columns.
    """
    trouble = F.col("status") != "completed"
    for name in ("had_parse_error", "had_conflict", "had_error", "planning_failed"):
        if name in attempts.columns:
            trouble = trouble | F.coalesce(F.col(name), F.lit(False))
    return attempts.groupBy(*by).agg(F.when(F.bool_or("aborted"), "failed").when(F.bool_or(F.coalesce(trouble, F.lit(True))), "completed_with_errors").otherwise("completed").alias("run_status"))


def rollup(attempts: DataFrame, *by: str, columns=("discovered", "inserted", "updated")) -> DataFrame:
    return attempts.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def latest_error(errors: DataFrame, *by: str) -> DataFrame:
    """The error of greatest (occurred_at, idx): of equal times the later one."""
    rest = [c for c in errors.columns if c not in (*by, "occurred_at", "idx")]
    return errors.groupBy(*by).agg(F.max_by(F.struct("occurred_at", "idx", *rest), F.struct("occurred_at", "idx")).alias("e")).select(*by, "e.*")


def failures(errors: DataFrame, *by: str) -> DataFrame:
    """All errors in order, repeats kept."""
    rest = [c for c in errors.columns if c not in by and c != "idx"]
    return errors.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("idx", *rest))).alias("failures"))


def providers_attempted(attempts: DataFrame, *by: str) -> DataFrame:
    first = attempts.groupBy(*by, "provider").agg(F.min("idx").alias("idx"))
    return first.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "provider"))), lambda x: x["provider"]).alias("providers"))


def enforcement_map(plans: DataFrame, *by: str) -> DataFrame:
    """provider -> source -> sorted fields that are filtered locally."""
    one = plans.groupBy(*by, "provider").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", F.array_sort("fields"))))).alias("sources"))
    return one.groupBy(*by).agg(F.map_from_arrays(F.transform(F.sort_array(F.collect_list(F.struct("provider", F.to_json("sources").alias("s")))), lambda x: x["provider"]), F.transform(F.sort_array(F.collect_list(F.struct("provider", F.to_json("sources").alias("s")))), lambda x: x["s"])).alias("enforcement"))


def contract_violations(stats: DataFrame, jobs: DataFrame, requested: list[str], errors: DataFrame | None = None) -> DataFrame:
    """(source, violation) of a discovery result: sources declared twice, not asked for or missing, jobs or errors of sources that are not
    declared, jobs or incomplete results of sources that did not complete, and declared counts that differ from the jobs.

    stats: source, completed, declared, and incomplete where there is such a column.
    """
    counted = jobs_per_source(jobs)
    asked = stats.sparkSession.createDataFrame([(s,) for s in requested], "source string")
    say = lambda df, what: df.select("source", F.lit(what).alias("violation"))
    both = stats.join(counted, "source", "left").withColumn("n", F.coalesce("jobs", F.lit(0)))
    parts = [
        say(stats.groupBy("source").count().filter("count > 1"), "duplicate_source"),
        say(stats.join(asked, "source", "left_anti"), "source_not_requested"),
        say(asked.join(stats, "source", "left_anti"), "source_missing"),
        say(counted.join(stats, "source", "left_anti"), "jobs_of_unknown_source"),
        say(both.filter(F.col("n") != F.col("declared")), "count_differs"),
        say(both.filter(~F.col("completed") & ((F.col("declared") > 0) | (F.col("n") > 0))), "jobs_though_not_completed"),
    ]
    if "incomplete" in stats.columns:
        parts.append(say(stats.filter(~F.col("completed") & F.col("incomplete")), "incomplete_though_not_completed"))
    if errors is not None:
        parts.append(say(errors.select("source").join(stats, "source", "left_anti"), "error_of_unknown_source"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def attempt_trend(attempts: DataFrame, *by: str, value: str = "discovered", order: str = "started_at", last: int = 3) -> DataFrame:
    """Each attempt with the volume before it and the mean of up to ``last`` before it."""
    w = Window.partitionBy(*by).orderBy(order)
    return attempts.withColumns({"previous": F.lag(value).over(w), "mean_before": F.avg(value).over(w.rowsBetween(-last, -1))})
