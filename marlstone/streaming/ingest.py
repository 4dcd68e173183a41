"""Streaming: micro-batch resolution, and application statuses as a state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import resolve as R

# Statuses before and after an application.
BEFORE = ("interested", "not_interested")
AFTER = ("applied", "recruiter_contacted", "screening", "interviewing", "offer", "rejected_by_employer", "withdrawn_by_user")


def start_ingestion(postings: DataFrame, table: str, checkpoint: str):
    """Resolves each micro-batch against the newest snapshot below ``table`` and writes the next one; one writer at a time.

    A batch that runs again after a failure starts from the same snapshot and writes the same rows: ids are derived, and snapshot n is
    written by batch n alone.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = snapshot(spark, table, number)
        resolved = R.resolve(batch, stored, f"batch-{number}")
        resolved.write.mode("overwrite").parquet(f"{table}/outcomes/batch={number}")
        done = spark.read.parquet(f"{table}/outcomes/batch={number}")
        R.next_occurrences(done, stored).write.mode("overwrite").parquet(f"{table}/occurrences/v{number + 1}")

    return postings.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def snapshot(spark: SparkSession, table: str, number: int) -> DataFrame:
    if number == 0:
        return spark.createDataFrame([], R.OCCURRENCE)
    return spark.read.parquet(f"{table}/occurrences/v{number}")


def _known(events: DataFrame) -> DataFrame:
    """Events of a known status; another one is an error."""
    odd = F.raise_error(F.concat(F.lit("not a status: "), F.coalesce("status", F.lit("null")))).cast("string")
    return events.withColumn("status", F.when(F.col("status").isin(*BEFORE, *AFTER), F.col("status")).otherwise(odd))


def statuses(events: DataFrame) -> DataFrame:
    """The last state of each key in a batch of (key, at, idx, status), in closed form: applied_at is the time of the first event after
    the last one with a status of BEFORE, status_changed_at that of the first event after the last one with another status."""
    events = _known(events)
    last = events.groupBy("key").agg(F.max_by("status", F.struct("at", "idx")).alias("status"), F.max(F.when(F.col("status").isin(*BEFORE), F.struct("at", "idx"))).alias("reset"))
    told = events.withColumnRenamed("status", "then").join(last, "key")
    other = told.filter("then <> status").groupBy("key").agg(F.max(F.struct("at", "idx")).alias("other"))
    place = F.struct("at", "idx")
    since = lambda mark: F.min(F.when(F.col(mark).isNull() | (place > F.col(mark)), F.col("at")))
    times = told.join(other, "key", "left").groupBy("key").agg(since("reset").alias("applied_at"), since("other").alias("status_changed_at"))
    return last.select("key", "status").join(times, "key").select("key", "status", "applied_at", "status_changed_at")


def status_stream(events: DataFrame) -> DataFrame:
    """The same on a stream of (key, at, idx, status): the state of each key that changed, after each micro-batch."""
    state = "status string, applied_at timestamp, status_changed_at timestamp"

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        status, applied, changed = held.get if held.exists else (None, None, None)
        for e in pd.concat(list(frames)).sort_values(["at", "idx"]).itertuples():
            if e.status != status:
                changed = e.at.to_pydatetime()
                applied = None if e.status in BEFORE else (applied or changed)
                status = e.status
        held.update((status, applied, changed))
        yield pd.DataFrame({"key": [key[0]], "status": [status], "applied_at": [applied], "status_changed_at": [changed]})

    return _known(events).groupBy("key").applyInPandasWithState(step, f"key long, {state}", state, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events a window and type; rows later than the watermark are dropped by a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
