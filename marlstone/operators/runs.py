"""Runs: one provider's result, or all providers of a saved search one after another, through validation, landing, resolution and counts.

A store is a folder of Parquet tables.  Every write of a run goes to a folder named after the run and provider, so that a run that is
repeated under its name writes the same rows to the same place: ids are derived, times come from the caller.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import canonical_json_hash, derived_id
from ..plans import planner
from ..staging import PACKED
from . import resolve as R
from . import telemetry as T

ATTEMPT = "run_id string, provider string, source string, status string, discovered long, inserted long, updated long, retry_count int, rate_limited boolean, incomplete boolean, error_category string, error_message string, started_at timestamp, completed_at timestamp"
RUN = "run_id string, search_id string, status string, providers array<string>, enforced_locally string, failures array<struct<provider:string,source:string,category:string,retryable:boolean,detail:string,occurred_at:timestamp>>, discovered long, inserted long, updated long, started_at timestamp, completed_at timestamp, duration_ms long"
JOB = "job_id string, first_seen_at timestamp, last_seen_at timestamp"
STATS = "source string, completed boolean, declared long, incomplete boolean, retry_count int, rate_limited boolean"
ERRORS = "idx long, source string, category string, retryable boolean, detail string, occurred_at timestamp"
PARSE_MESSAGE = "posting has no resolvable identity"  # the same text for every posting


class ContractError(RuntimeError):
    """A result that contradicts itself or its query: nothing of it is kept."""


class SearchError(RuntimeError):
    """A saved search that cannot be run."""


@dataclass
class Discovery:
    """What a provider gives: postings (with seq and raw JSON), statistics of each source, and errors in order."""

    provider: str
    postings: DataFrame
    stats: DataFrame
    errors: DataFrame


@dataclass
class Provider:
    capabilities: planner.Capabilities
    discover: Callable[[planner.Plan], Discovery]


@dataclass
class Search:
    search_id: str
    fields: dict[str, object] = field(default_factory=dict)
    providers: list[str] | None = None  # None: all that are registered, by name
    sources: dict[str, list[str]] = field(default_factory=dict)  # provider to sources; a provider that is not named: all of them
    active: bool = True


class Store:
    """Tables raw, occurrences, jobs, conflicts, attempts and runs below a folder; occurrences and jobs are snapshots by number."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.version = spark, root, 0

    def table(self, name: str, schema: str) -> DataFrame:
        """All rows of a table that runs add to."""
        reader = self.spark.read.schema(schema).option("recursiveFileLookup", "true")
        return reader.parquet(f"{self.root}/{name}") if self._exists(name) else self.spark.createDataFrame([], schema)

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def snapshot(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{self.version}") if self.version else self.spark.createDataFrame([], schema)

    def put(self, df: DataFrame, name: str, part: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", PACKED).parquet(f"{self.root}/{name}/{part}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}/{part}")


def next_jobs(resolved: DataFrame, jobs: DataFrame) -> DataFrame:
    """The jobs after a batch: new ones for INSERTED and AMBIGUOUS; whatever was seen of a job, its last_seen_at only grows."""
    seen = resolved.filter("job_id is not null").groupBy("job_id").agg(F.max("observed_at").alias("latest"), F.min("observed_at").alias("first"))
    both = jobs.join(seen, "job_id", "full")
    return both.select("job_id", F.coalesce("first_seen_at", "first").alias("first_seen_at"), F.greatest("last_seen_at", "latest").alias("last_seen_at"))


def validate(found: Discovery, provider: str, sources: list[str]) -> None:
    """Raises ContractError with all violations of a result."""
    if found.provider != provider:
        raise ContractError(f"{provider}: the result is of another provider")
    foreign = found.postings.filter(~F.col("provider").eqNullSafe(F.lit(provider))).limit(1).count()
    broken = sorted((r.source, r.violation) for r in T.contract_violations(found.stats, found.postings, sources, found.errors).collect())  # a few rows a source
    if foreign:
        broken.append((provider, "jobs_of_another_provider"))
    if broken:
        raise ContractError("; ".join(f"{s}: {v}" for s, v in broken))


def execute(store: Store, run_id: str, provider: str, plan: planner.Plan, found: Discovery, observed_at: dt.datetime) -> DataFrame:
    """Takes one validated result into the store; returns (source, discovered, inserted, updated, errors, has_conflict) of its sources.

    Raw postings land before any identity is worked out; postings without identity stay there as parse errors.
    """
    part, c = f"run={run_id}/provider={provider}", F.col
    named = f"{run_id}/{provider}"
    postings, raw_id = found.postings, derived_id(F.lit(named), c("seq"), F.lit("raw"))
    raw = postings.select("seq", raw_id.alias("raw_id"), "provider", "source", c("source_job_id").alias("source_identifier"), c("discovered_at").cast("timestamp").alias("fetched_at"), "raw", canonical_json_hash(c("raw")).alias("hash"))
    raw = store.put(raw.select("seq", "raw_id", "provider", "source", "source_identifier", "fetched_at", "raw", c("hash.hash").alias("content_hash"), F.lit("fetched").alias("status")), "landed", part)
    rows = postings.select("seq", "provider", "source", "source_tenant_id", "source_job_id", c("requisition_id_raw").alias("requisition_id"), "source_url", "canonical_url", F.lit(observed_at).cast("timestamp").alias("observed_at"))
    resolved = store.put(R.resolve(rows, store.snapshot("occurrences", R.OCCURRENCE), named, provider), "outcomes", part)
    # hashes are shuffled as bytes, and ids that follow from seq not at all
    made = c("outcome").isin(*R.MADE)
    status = resolved.select("seq", made.alias("made"), F.when(~made, c("occurrence_id")).alias("occurrence_id"), R.raw_status(c("outcome")).alias("status"))
    done = raw.drop("raw_id", "status").withColumn("content_hash", F.unhex("content_hash")).join(status, "seq")
    done = done.withColumns({"raw_id": raw_id, "content_hash": F.lower(F.hex("content_hash")), "occurrence_id": F.when(c("made"), R.new_id(named, c("seq"), "occurrence")).otherwise(c("occurrence_id")), "error_message": F.when(c("status") == "parse_error", PARSE_MESSAGE)})
    store.put(done.select(*(n for n in raw.columns if n != "status"), "occurrence_id", "status", "error_message"), "raw", part)
    store.put(R.conflicts(resolved), "conflicts", part)
    occurrences, jobs = R.next_occurrences(resolved, store.snapshot("occurrences", R.OCCURRENCE), provider, at_once=True), next_jobs(resolved, store.snapshot("jobs", JOB))
    store.put(occurrences, "occurrences", f"v{store.version + 1}")
    store.put(jobs, "jobs", f"v{store.version + 1}")
    store.version += 1
    asked = store.spark.createDataFrame([(s,) for s in plan.sources], "source string")
    by_source = T.counters(resolved.select("source", "outcome"), "source")
    # a source is known under its canonical form after resolution
    counts = asked.withColumn("key", F.lower(F.btrim("source"))).join(by_source.withColumnRenamed("source", "key"), "key", "left").drop("key")
    return counts.select("source", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("discovered", "inserted", "updated", "errors")), F.coalesce("has_conflict", F.lit(False)).alias("has_conflict"))


def _attempts(store: Store, run_id: str, provider: str, found: Discovery, counts: DataFrame, started: dt.datetime, completed: dt.datetime) -> DataFrame:
    last = T.latest_error(found.errors, "source")
    error = T.attempt_error(F.col("category"), F.col("detail"))
    rows = counts.join(found.stats, "source", "left").join(last, "source", "left")
    return rows.select(F.lit(run_id).alias("run_id"), F.lit(provider).alias("provider"), "source", T.attempt_status(F.col("completed"), F.col("incomplete")).alias("status"), "discovered", "inserted", "updated", "retry_count", "rate_limited", "incomplete", error["category"].alias("error_category"), error["message"].alias("error_message"), F.lit(started).cast("timestamp").alias("started_at"), F.lit(completed).cast("timestamp").alias("completed_at"))


def _aborted(store: Store, run_id: str, provider: str, sources: list[str], started: dt.datetime, at: dt.datetime) -> DataFrame:
    """Attempts that were running when a run broke off."""
    rows = [(run_id, provider, s, "running", 0, 0, 0, 0, False, False, None, None, started, None) for s in sources]
    return T.abort(store.spark.createDataFrame(rows, ATTEMPT)).withColumn("completed_at", F.lit(at).cast("timestamp"))


def run_search(store: Store, search: Search, registry: dict[str, Provider], *, run_id: str, observed_at: dt.datetime, clock: Callable[[], dt.datetime]) -> DataFrame:
    """Runs all providers of a search, in order; returns the row of the run.

    A provider that is not registered, or a search that cannot be planned for it, is a failure of its own and the run goes on.  Any other
    error ends the run: attempts under way become failed, so does the run, with the sums of its attempts, and the error is raised.
    """
    if not search.active:
        raise SearchError("the search is paused")
    names = sorted(registry) if search.providers is None else list(search.providers)
    if any(not isinstance(n, str) or not planner.SLUG.fullmatch(n) for n in names):
        raise SearchError("a provider's name is no slug")
    if len(set(names)) != len(names):
        raise SearchError("a provider is named twice")
    began, tried, enforced, failures, troubled = clock(), [], {}, [], False
    now: tuple[str, list[str], dt.datetime] | None = None

    def finish(status: str) -> DataFrame:
        total = T.rollup(store.table("attempts", ATTEMPT).filter(F.col("run_id") == run_id)).first()
        ended = clock()
        row = (run_id, search.search_id, status, tried, planner.enforcement_json(enforced), failures, total.discovered, total.inserted, total.updated, began, ended, int((ended - began).total_seconds() * 1000))
        return store.put(store.spark.createDataFrame([row], RUN), "runs", f"run={run_id}")

    try:
        for name in names:
            if name not in registry:
                failures.append((name, None, "unknown", False, "provider is not registered", clock()))
                continue
            try:
                plan = planner.plan(search.fields, registry[name].capabilities, search.sources.get(name))
            except planner.PlanError as e:
                failures.append((name, None, "unknown", False, str(e), clock()))
                continue
            if plan is None:
                continue
            now = (name, plan.sources, clock())
            tried.append(name)
            enforced[name] = plan.residual
            found = registry[name].discover(plan)
            validate(found, name, plan.sources)
            counts = execute(store, run_id, name, plan, found, observed_at)
            counts = store.put(counts, "counts", f"run={run_id}/provider={name}")
            store.put(_attempts(store, run_id, name, found, counts, now[2], clock()), "attempts", f"run={run_id}/provider={name}")
            now = None
            told = [tuple(r) for r in found.errors.orderBy("idx").select(F.lit(name), "source", "category", "retryable", "detail", "occurred_at").collect()]
            failures += told
            flags = counts.agg(F.coalesce(F.max(F.col("errors") > 0), F.lit(False)).alias("e"), F.coalesce(F.bool_or("has_conflict"), F.lit(False)).alias("c")).first()
            partial = found.stats.filter(~F.col("completed") | F.col("incomplete")).limit(1).count() > 0
            troubled = troubled or bool(told) or flags.e or flags.c or partial
    except BaseException:
        if now is not None:
            store.put(_aborted(store, run_id, *now, clock()), "attempts", f"run={run_id}/provider={now[0]}")
        finish("failed")
        raise
    planned_all = not any(f[1] is None for f in failures)
    return finish("completed" if planned_all and not troubled else "completed_with_errors")


def run_provider(store: Store, provider: str, capabilities: planner.Capabilities, sources: list[str], discover: Callable[[planner.Plan], Discovery], *, run_id: str, observed_at: dt.datetime, clock: Callable[[], dt.datetime]) -> DataFrame:
    """One provider's run, outside any search."""
    search = Search(None, {}, [provider], {provider: sources})
    return run_search(store, search, {provider: Provider(capabilities, discover)}, run_id=run_id, observed_at=observed_at, clock=clock)
