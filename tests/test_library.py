"""Resolver against a sequential model, queries against DuckDB, sources, planner and streams."""

import datetime as dt
import json
import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from marlstone import catalog, catalog_more
from marlstone.functions import html, keys
from marlstone.operators import evaluate, integrity, ranking, resolve, runs, telemetry
from marlstone.plans import planner
from marlstone.sources import postings
from marlstone.staging import cut
from marlstone.streaming import ingest

POSTING = "seq long, provider string, source string, source_tenant_id string, source_job_id string, requisition_id string, source_url string, canonical_url string, observed_at timestamp"


def batch(seed, n):
    rnd = random.Random(seed)
    pick = lambda p, k, none: None if rnd.random() < none else p + str(rnd.randint(1, k))
    return [(i, "p", "s", pick("t", 3, 0.3), pick("j", 25, 0.2), pick("r", 4, 0.3), pick("https://h.x/s/", 20, 0.3), pick("https://h.x/c/", 5, 0.6), dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(n)]


def one_by_one(rows):
    """What a store that takes postings one after another does."""
    held, out = [], {}
    for seq, _, _, t, j, q, u, cu, _ in rows:
        key = (t, j) if j else (u,) if u else None
        if key is None:
            out[seq] = ("PARSE_ERROR", None, set())
            continue
        same = [o for o in held if o[0] == key]
        if same:
            out[seq] = ("QUARANTINED" if cu and same[0][2] and cu != same[0][2] else "UPDATED", same[0][1], set())
            continue
        jobs = {o[1] for o in held if o[2] == cu} if cu else {o[1] for o in held if (o[3], o[4]) == (t, q)} if t and q else set()
        out[seq] = ("INSERTED", seq, set()) if not jobs else ("ATTACHED", next(iter(jobs)), set()) if len(jobs) == 1 else ("AMBIGUOUS", seq, jobs)
        held.append((key, out[seq][1], cu, t, q))
    return out


def test_resolver_and_replay(spark):
    rows = batch(4, 70)
    df = spark.createDataFrame(rows, POSTING)
    empty = spark.createDataFrame([], resolve.OCCURRENCE)
    r = resolve.resolve(df, empty, "run").cache()
    names = {x.j: x.id for x in spark.range(70).select("id", keys.derived_id(F.lit("run"), F.col("id"), F.lit("job")).alias("j")).collect()}
    got = {x.seq: (x.outcome, names.get(x.job_id), {names[c] for c in x.candidates}) for x in r.collect()}
    assert got == one_by_one(rows)
    assert resolve.invariants(r).isEmpty()
    stored = resolve.next_occurrences(r, empty)
    again = {x.outcome for x in resolve.resolve(df, stored, "replay").collect()}
    assert again <= {"UPDATED", "QUARANTINED", "PARSE_ERROR"}  # a replay makes nothing new


FAST = [n for n in catalog.SQL if n == "run_search_attempts" or not n.startswith(("resolve", "outcome", "conflict", "raw_st", "run_search", "run_raw", "run_jobs", "run_provider"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows_of(frame):
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return "~"
        return f"{float(v):.6g}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", FAST)
def test_query_agrees_with_sql(spark, duck, name):
    assert rows_of(catalog.QUERIES[name](spark, DATA).toPandas()) == rows_of(duck.sql(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_source_prunes_and_filters(spark, tmp_path):
    for provider, source, ids in (("a", "x", ["1", "10", "9"]), ("a", "y", ["2"]), ("b", "x", ["3"])):
        folder = tmp_path / f"provider={provider}" / f"source={source}"
        folder.mkdir(parents=True)
        (folder / "f.json").write_text("".join(json.dumps({"source_job_id": i, "title": "T" + i, "raw": {"k": 1}}) + "\n" for i in ids))
    (tmp_path / "provider=b" / "source=x" / "g.json").write_text('[1]\n{"source_job_id": \n')
    postings.register(spark)
    assert postings.health(str(tmp_path)) is None and postings.health(str(tmp_path / "none")) == "no such folder"
    df = spark.read.format("postings").option("path", str(tmp_path)).load()
    assert df.filter("error is null").count() == 5 and df.filter("error is not null").count() == 2
    assert [r.source_job_id for r in df.filter("provider = 'a' and source = 'x' and title > 'T1'").orderBy("source_job_id").collect()] == ["10", "9"]
    reader = postings.PostingReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(reader.pushFilters([EqualTo(("provider",), "b"), GreaterThan(("title",), "T")])) == [GreaterThan(("title",), "T")]
    assert len(reader.partitions()) == 2
    assert ranking.representative(df.filter("source_job_id in ('9', '10')"), "source_job_id").first().source_job_id == "10"


def test_registry():
    r = postings.Registry({"b": object(), "a": object()})
    assert r.names() == ["a", "b"]
    with pytest.raises(ValueError):
        r.add("a", object())
    with pytest.raises(ValueError):
        r.add("No Slug", object())


def test_boards(spark):
    body = json.dumps({"jobs": [{"id": 7, "title": "T", "absolute_url": "https://X.example/j/7?utm_x=1", "first_published": "2024-01-02T03:04:05-05:00", "location": {"name": "Remote, US"}}, {"id": " ", "absolute_url": "https://x.example/"}, {"id": True, "absolute_url": "https://x.example/"}, {"id": 1.5, "absolute_url": "https://x.example/"}, {"id": 8, "absolute_url": "http://x.example/"}]})
    out = postings.board_postings(spark.createDataFrame([("acme", body), ("bad", "{")], "board string, body string"), "boards", dt.datetime(2024, 1, 3)).collect()
    assert sorted(str(r.error) for r in out) == ["None", "no https URL", "no jobs in response", "unusable id", "unusable id", "unusable id"]
    told = spark.createDataFrame([("a", body, 404, "application/json"), ("b", body, 200, "text/html"), ("c", body, 204, "application/json; charset=utf-8"), ("d", "x" * 5_000_001, 200, "application/json")], "board string, body string, code int, content_type string")
    assert {(r.source, r.error) for r in postings.board_postings(told, "boards", dt.datetime(2024, 1, 3)).collect()} >= {("a", "no success"), ("b", "no JSON by its type"), ("c", None), ("d", "response too large")}
    good = next(r for r in out if r.error is None)
    assert (good.source_job_id, good.canonical_url, good.location, good.posted_at) == ("7", "https://x.example/j/7", "Remote, US", dt.datetime(2024, 1, 2, 8, 4, 5))


def test_planner():
    caps = planner.Capabilities("p", (planner.Source("b", frozenset({"supports_location_filter"}), frozenset({"titles"})), planner.Source("a")))
    plan = planner.plan({"titles": ["x"], "locations": ["y"], "radius_miles": None, "seniority": []}, caps)
    assert plan.sources == ["a", "b"] and plan.residual == {"a": ["locations", "titles"]}
    assert planner.plan({}, caps, []) is None
    for search, selected in (({}, ["c"]), ({}, ["a", "a"]), ({"radius_miles": float("inf")}, None)):
        with pytest.raises(planner.PlanError):
            planner.plan(search, caps, selected)


def test_integrity(spark):
    df = spark.createDataFrame([(1, " a", 5, 3), (2, "b", None, 3), (3, "", 1, 2)], "k int, t string, lo int, hi int")
    bad = integrity.rejects(df, {"text": integrity.trimmed_or_null(F.col("t")), "range": integrity.ordered(F.col("lo"), F.col("hi"))})
    assert {r.k: sorted(r.broken) for r in bad.collect()} == {1: ["range", "text"], 3: ["text"]}
    assert integrity.restricted(df, spark.createDataFrame([(1,), (9,)], "k int"), "k").count() == 1


def test_status_stream_agrees_with_batch(spark, tmp_path):
    rnd = random.Random(2)
    schema = "key long, at timestamp, idx long, status string"
    rows = [(rnd.randint(1, 4), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i, rnd.choice(["interested", "applied", "offer", "screening"])) for i in range(60)]
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = ingest.status_stream(stream).writeStream.outputMode("update").format("memory").queryName("statuses").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.key, r.status, r.applied_at) for r in spark.table("statuses").collect()}
    assert {(r.key, r.status, r.applied_at) for r in ingest.statuses(spark.createDataFrame(rows, schema)).collect()} <= got


def test_ingestion_stream_agrees_with_batch(spark, tmp_path):
    rows = batch(7, 24)
    for part in (rows[:12], rows[12:]):
        spark.createDataFrame(part, POSTING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(POSTING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.start_ingestion(stream, str(tmp_path / "t"), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    n = ingest.snapshot(spark, str(tmp_path / "t"), 2).count()
    whole = resolve.resolve(spark.createDataFrame(rows, POSTING), spark.createDataFrame([], resolve.OCCURRENCE), "x")
    assert n == whole.filter("outcome in ('INSERTED', 'ATTACHED', 'AMBIGUOUS')").count()


def test_strict_corpus(spark, tmp_path):
    schema = "record_id string, n int, tags array<string>"

    def read(text, **more):
        path = tmp_path / f"c{abs(hash(text))}.json"
        path.write_text(text)
        return [tuple(r) for r in postings.read_corpus(spark, str(path), schema, **more).collect()]

    assert sorted(read('[{"record_id": "a", "n": 1, "tags": ["x"]}, {"record_id": "b"}]', id_col="record_id")) == [("a", 1, ["x"]), ("b", None, None)]
    for bad in ('[{"record_id": "a", "other": 1}]', '[{"record_id": "a", "record_id": "b"}]', '[{"record_id": "a", "n": "x"}]', '[{"record_id": "a"}, {"record_id": "a"}]', '[{"n": 1}]', "[", '{"record_id": "a"}'):
        with pytest.raises(Exception):  # noqa: B017
            read(bad, id_col="record_id")


def test_residual_filters(spark):
    rows = [
        {"source": "a", "title": "Senior Engineer (Remote)", "company": "Acme", "location": "Paris", "compensation_text": "$120,000 - $150,000 USD per year", "posted_at": "2024-01-02T00:00:00Z", "discovered_at": "2024-01-02T05:00:00Z"},
        {"source": "a", "title": "Engineer - Full-Time", "company": "Other", "location": "Rome", "compensation_text": "$80,000", "posted_at": "2024-01-01T00:00:00Z", "discovered_at": "2024-01-02T05:00:00Z"},
        {"source": "b", "title": "Cook", "company": "Acme"},
    ]
    df = postings.fixture(spark, rows)
    caps = planner.Capabilities("p", (planner.Source("a"), planner.Source("b", frozenset(planner.SWITCHES.values()), frozenset(planner.FIELDS))))
    for search, want in (
        ({}, ["Cook", "Engineer - Full-Time", "Senior Engineer (Remote)"]),
        ({"titles": ["senior"]}, ["Cook", "Senior Engineer (Remote)"]),
        ({"excluded_titles": ["senior"], "locations": ["rome"]}, ["Cook", "Engineer - Full-Time"]),
        ({"remote_ok": False}, ["Cook", "Engineer - Full-Time"]),
        ({"remote_ok": True, "company_filter": ["acme"]}, ["Cook", "Senior Engineer (Remote)"]),
        ({"salary_floor": 100_000}, ["Cook", "Senior Engineer (Remote)"]),
        ({"employment_types": ["full_time"]}, ["Cook", "Engineer - Full-Time"]),
        ({"seniority": ["senior"], "excluded_companies": ["other"]}, ["Cook", "Senior Engineer (Remote)"]),
        ({"posted_within_hours": 6}, ["Cook", "Senior Engineer (Remote)"]),
    ):
        assert sorted(r.title for r in planner.apply_residual(df, planner.plan(search, caps)).collect()) == want, search
    with pytest.raises(planner.PlanError):
        planner.apply_residual(df, planner.plan({"radius_miles": 5}, caps))


def discovery(spark, n=3, provider="p", **change):
    rows = [{"provider": provider, "source": "s", "source_job_id": str(i), "source_url": f"https://h.example/{i}", "discovered_at": "2024-01-01T00:00:00Z", "raw": "{}", "title": "T"} for i in range(n)]
    stats = {"source": "s", "completed": True, "declared": n, "incomplete": False, "retry_count": 0, "rate_limited": False} | change
    jobs = postings.fixture(spark, rows).withColumn("seq", F.col("source_job_id").cast("long"))
    return runs.Discovery(provider, jobs, spark.createDataFrame([tuple(stats.values())], runs.STATS), spark.createDataFrame([], runs.ERRORS))


def test_runs(spark, tmp_path):
    """A run, its replay, runs that break off, and searches that cannot be run."""
    t0, caps = dt.datetime(2024, 1, 1), planner.Capabilities("p", (planner.Source("s"),))
    store = runs.Store(spark, str(tmp_path / "store"))
    go = lambda run_id, found, **more: runs.run_search(store, runs.Search("x", **more), {"p": runs.Provider(caps, found)}, run_id=run_id, observed_at=t0, clock=lambda: t0).first()
    first = go("one", lambda plan: discovery(spark))
    assert (first.status, first.discovered, first.inserted, first.updated, first.providers) == ("completed", 3, 3, 0, ["p"])
    again = go("two", lambda plan: discovery(spark))
    assert (again.status, again.inserted, again.updated) == ("completed", 0, 3) and store.snapshot("jobs", runs.JOB).count() == 3

    def broken(plan):
        raise OSError("no answer")

    for run_id, found, error in (("three", broken, OSError), ("four", lambda plan: discovery(spark, declared=9), runs.ContractError), ("five", lambda plan: discovery(spark, provider="q"), runs.ContractError)):
        with pytest.raises(error):
            go(run_id, found)
        attempt = store.table("attempts", runs.ATTEMPT).filter(F.col("run_id") == run_id).first()
        assert (attempt.status, attempt.error_category, attempt.error_message) == ("failed", telemetry.ABORT_CATEGORY, telemetry.ABORT_MESSAGE)
        assert store.table("runs", runs.RUN).filter(F.col("run_id") == run_id).first().status == "failed"
    assert store.snapshot("jobs", runs.JOB).count() == 3
    for bad in ({"active": False}, {"providers": ["p", "p"]}, {"providers": ["No Slug"]}):
        with pytest.raises(runs.SearchError):
            go("six", lambda plan: discovery(spark), **bad)
    assert go("seven", lambda plan: discovery(spark), providers=[]).status == "completed"
    assert go("eight", lambda plan: discovery(spark), sources={"p": ["other"]}).status == "completed_with_errors"
    assert [tuple(r)[0] for r in postings.replay(discovery(spark, 1).postings, {"titles": []}).select("source").collect()] == ["s"]
    for fields, n in (({"titles": ["x"]}, 1), ({}, 2)):
        with pytest.raises(ValueError):
            postings.replay(discovery(spark, n).postings, fields)


def stages_of(spark, work):
    """What work() returns, and the stages that ran in it."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        all_of = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x for x in map(all_of.apply, range(all_of.length()))}

    old = set(stages())
    out = work()
    return out, [x for k, x in stages().items() if k not in old]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_runs_shuffle_few_rows(spark, duck, no_broadcast):
    got, stages = stages_of(spark, lambda: catalog.QUERIES["run_jobs"](spark, DATA).toPandas())
    assert rows_of(got) == rows_of(duck.sql(catalog.SQL["run_jobs"]).df())
    postings = duck.sql("select count(*) from orders where o_orderpriority[1] <> '4'").fetchall()[0][0]
    assert sum(x.shuffleWriteRecords() for x in stages) < 7 * postings


def test_raw_rows_shuffle_few_bytes(spark, no_broadcast):
    """Raw postings after a run have the ids and hashes of the landed ones and of their outcomes; the shuffles before are small."""
    store, stages = stages_of(spark, lambda: catalog_more._search(spark, DATA))
    read = lambda name: spark.read.parquet(f"{store.root}/{name}").drop("run")
    raw, landed, outcomes = read("raw"), read("landed"), read("outcomes")
    assert raw.columns == ["seq", "raw_id", "provider", "source", "source_identifier", "fetched_at", "raw", "content_hash", "occurrence_id", "status", "error_message"]
    same = [n for n in landed.columns if n != "status"]
    assert sorted(map(str, raw.select(same).collect())) == sorted(map(str, landed.select(same).collect()))
    ids = outcomes.select("provider", "seq", "occurrence_id", resolve.raw_status(F.col("outcome")).alias("status"))
    assert sorted(map(str, raw.select(ids.columns).collect())) == sorted(map(str, ids.collect()))
    assert sum(x.shuffleWriteBytes() for x in stages) < 250 * raw.count()


def test_tables_are_packed(spark, tmp_path):
    df = spark.range(20000).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    for work in (lambda: cut(df), lambda: runs.Store(spark, str(tmp_path)).put(df, "t", "a")):
        out, stages = stages_of(spark, work)
        assert out.exceptAll(df).isEmpty() and out.count() == 20000
        assert sum(x.outputBytes() for x in stages) < 40 * 20000  # of 64 digits each


def test_html_goes_to_python_in_small_batches(spark):
    """After the query is made, no Arrow batch holds more than 8 MB; references in long and many texts are resolved as before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    sizes = F.arrow_udf(lambda x: pa.array([x.nbytes] * len(x), pa.int64()), "long")
    spark.conf.unset(name)
    try:
        catalog.QUERIES["html_to_text"](spark, DATA)
        long = spark.range(0, 9000, 1, 1).select("id", F.concat(F.repeat(F.lit("x"), 4000), F.lit("&eacute;"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, "&#8212;")).alias("x"))
        assert long.select(sizes(F.coalesce("x", F.lit(""))).alias("n")).agg(F.max("n")).first()[0] < 9e6
        got = long.select("id", "x", html.html_to_text(F.col("x"))["text"].alias("t")).filter(~F.col("t").eqNullSafe(F.when(F.col("x").isNotNull(), F.concat(F.repeat(F.lit("x"), 4000), F.lit("\u00e9"), F.col("id").cast("string"), F.lit("\u2014")))))
        assert got.isEmpty()
    finally:
        spark.conf.unset(name)


def test_batches_of_providers(spark):
    """Stored keys and occurrences of other providers play no part, their jobs do."""
    at = dt.datetime(2024, 1, 1)
    row = lambda seq, provider, job, url, hours: (seq, provider, "s", None, job, None, None, url, at + dt.timedelta(hours=hours))
    batches = [("p", [row(1, "p", "a", None, 3), row(2, "p", "a", "https://h.x/1", 5), row(3, "p", "b", "https://h.x/2", 1), row(4, "p", "b", "https://h.x/3", 0)]), ("q", [row(1, "q", "a", "https://h.x/2", 9)]), ("p", [row(1, "p", "b", None, 7)])]
    for named in (False, True):
        stored, outcomes = spark.createDataFrame([], resolve.OCCURRENCE), []
        for n, (provider, rows) in enumerate(batches):
            r = resolve.resolve(spark.createDataFrame(rows, POSTING), stored, f"run{n}", provider if named else None)
            outcomes.append([x.outcome for x in r.orderBy("seq").collect()])
            stored = resolve.next_occurrences(r, stored, provider if named else None)
        assert outcomes == [["INSERTED", "UPDATED", "INSERTED", "QUARANTINED"], ["ATTACHED"], ["UPDATED"]]
        seen = {(x.provider, x.canonical_url): ((x.first_seen_at - at).seconds // 3600, (x.last_seen_at - at).seconds // 3600) for x in stored.collect()}
        assert seen == {("p", None): (3, 5), ("p", "https://h.x/2"): (1, 7), ("q", "https://h.x/2"): (9, 9)}
        assert stored.select("job_id").distinct().count() == 2


def test_label_corpus_errors(spark):
    packet = spark.createDataFrame([("r1", "a", "t"), ("r2", "b", "u")], "record_id string, employer string, text string")
    label = "record_id string, label_path string, outcome string, value string"
    one = [("r1", "title.name", "present_supported", "x"), ("r2", "title.name", "absent", None)]
    two = [("r1", "title.name", "present_supported", "y"), ("r2", "title.name", "absent", None)]
    ruled = [("r1", "title.name", "present_supported", "z")]
    bound = evaluate.packet_hash(packet, "record_id", "employer", "text")
    make = lambda a, b, r, h=bound: {(x.record_id, x.value, x.split) for x in evaluate.build_corpus(packet, *(spark.createDataFrame(t, label) for t in (a, b, r)), bound_to=h).collect()}
    assert make(one, two, ruled) == {("r1", "z", "dev"), ("r2", None, "holdout")}
    for bad in ((one, two, []), (one, one, ruled), (one, [("r1", "title.name", "absent", "x")], []), (one + one, two, ruled), (one, two, ruled, "0"), (one + [("r9", "title.name", "absent", None)], two + [("r9", "title.name", "absent", None)], ruled)):
        with pytest.raises(ValueError):
            make(*bad)


def test_patches_and_shapes(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k int, x string, y string")
    patches = spark.createDataFrame([(1, "n", ["y"])], "k int, x string, cleared array<string>")
    assert sorted(map(tuple, integrity.patched(rows, patches, "k", ["x", "y"]).collect())) == [(1, "n", None), (2, "c", "d")]
    with pytest.raises(ValueError):
        integrity.patched(rows, patches, "k", ["y"])
    for allowed, domains in ((["x"], None), (["x", "y"], {"x": ["m"]})):
        with pytest.raises(Exception):  # noqa: B017
            integrity.patched(rows, patches, "k", allowed, domains).collect()
    checks = {"pair": integrity.both_or_neither(F.col("x"), F.col("y")), "known": integrity.one_of(F.col("x"), "a", "c"), "iff": integrity.if_and_only_if(F.col("x") == "a", F.col("y") == "b"), "json": integrity.json_shape(F.lit("{}"), "object")}
    assert integrity.accept(rows, checks).count() == 2 and integrity.rejects(rows, checks).isEmpty()
    assert integrity.rejects(rows, {"json": integrity.json_shape(F.lit("[1]"), "object")}).count() == 2
    assert telemetry.ABORT_MESSAGE and keys.json_hash_of("[1]")
    files = spark.createDataFrame([("b", b"2"), ("a", b"1")], "path string, content binary")
    assert files.agg(keys.manifest_hash(files).alias("h")).first().h == files.orderBy("path").agg(keys.manifest_hash(files).alias("h")).first().h
    with pytest.raises(Exception):  # noqa: B017
        postings.create_only(rows, "/tmp")


def test_unknown_status_is_an_error(spark):
    e = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 1, "hired")], "key long, at timestamp, idx long, status string")
    with pytest.raises(Exception, match="not a status"):
        ingest.statuses(e).collect()


def test_constraints_of_unknown_values_hold(spark):
    from marlstone.operators import constraints

    assert sum(len(constraints.rules(t)) for t in constraints.TABLES) > 150
    for table in constraints.TABLES:
        columns = sorted({n for needed, _ in constraints.rules(table).values() for n in needed})
        row = spark.createDataFrame([(None,) * len(columns)], ", ".join(f"{n} string" for n in columns))
        assert constraints.rejects(row, table).isEmpty(), table
