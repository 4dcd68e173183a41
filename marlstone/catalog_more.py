"""More registered queries: runs, services, label building and integrity, each with the SQL that it is compared with."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import html, keys, primitives, urls
from .operators import constraints, evaluate, integrity, ranking, resolve, runs, telemetry
from .plans import planner
from .session import gentle, load
from .sources import postings
from .staging import cut, scratch

QUERIES, SQL = {}, {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- runs: orders as postings of two providers, priorities as sources
_START = dt.datetime(2024, 1, 1)
_PROVIDERS = ("alpha", "beta")


def _source():
    return F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1))


def _discovery(spark, d, provider: str) -> runs.Discovery:
    k = c("o_orderkey")
    orders = load(spark, d, "orders").filter(k % 2 == _PROVIDERS.index(provider))
    none = F.lit(None).cast("string")
    jobs = orders.filter(_source() != "p4").select(
        k.alias("seq"),
        F.lit(provider).alias("provider"),
        _source().alias("source"),
        none.alias("source_tenant_id"),
        F.when(k % 50 < 48, c("o_custkey").cast("string")).alias("source_job_id"),
        none.alias("requisition_id_raw"),
        F.when(k % 50 == 48, F.concat(F.lit("https://h.example/"), k.cast("string"))).alias("source_url"),
        none.alias("canonical_url"),
        F.lit("2024-01-01T00:00:00Z").alias("discovered_at"),
        F.concat(F.lit('{"id":'), k.cast("string"), F.lit("}")).alias("raw"),
    )
    seen = jobs.groupBy("source").agg(F.count("*").alias("n"))
    asked = spark.createDataFrame([(f"p{i}",) for i in range(1, 6)], "source string")
    stats = asked.join(seen, "source", "left").select("source", (c("source") != "p4").alias("completed"), F.coalesce("n", F.lit(0)).alias("declared"), (c("source") == "p5").alias("incomplete"), F.lit(1).alias("retry_count"), F.lit(False).alias("rate_limited"))
    rows = [(0, "p4", "timeout", True, " first ", _START), (1, "p4", "http_error", False, " later ", _START), (2, "p1", "parse", False, "  ", _START)]
    return runs.Discovery(provider, jobs, cut(stats), spark.createDataFrame(rows, runs.ERRORS))


def _clock():
    ticks = iter(_START + dt.timedelta(seconds=i) for i in range(1000))
    return lambda: next(ticks)


def _search(spark, d) -> runs.Store:
    store = runs.Store(spark, scratch(spark, "store"))
    caps = {p: planner.Capabilities(p, tuple(planner.Source(f"p{i}") for i in range(1, 6))) for p in _PROVIDERS}
    registry = {p: runs.Provider(caps[p], lambda plan, p=p: _discovery(spark, d, p)) for p in _PROVIDERS}
    search = runs.Search("s", {"titles": ["x"]}, ["beta", "gone", "alpha"])
    runs.run_search(store, search, registry, run_id="r", observed_at=_START, clock=_clock())
    return store


_RUN_SQL = """WITH o AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'alpha' ELSE 'beta' END AS provider, 'p' || substr(o_orderpriority, 1, 1) AS source, CASE WHEN o_orderkey % 50 < 48 THEN o_custkey::VARCHAR WHEN o_orderkey % 50 = 48 THEN 'u' || o_orderkey END AS key FROM orders),
n AS (SELECT provider, source, count(*) AS discovered, count(DISTINCT key) AS inserted, count(key) - count(DISTINCT key) AS updated FROM o WHERE source <> 'p4' GROUP BY 1, 2),
a AS (SELECT p.provider, s.source, CASE s.source WHEN 'p4' THEN 'failed' WHEN 'p5' THEN 'partial' ELSE 'completed' END AS status, coalesce(discovered, 0)::BIGINT AS discovered, coalesce(inserted, 0)::BIGINT AS inserted, coalesce(updated, 0)::BIGINT AS updated,
    CASE s.source WHEN 'p4' THEN 'http_error' WHEN 'p1' THEN 'parse' END AS error_category, CASE s.source WHEN 'p4' THEN 'later' END AS error_message
    FROM (VALUES ('alpha'), ('beta')) p(provider) CROSS JOIN (VALUES ('p1'), ('p2'), ('p3'), ('p4'), ('p5')) s(source) LEFT JOIN n ON n.provider = p.provider AND n.source = s.source) """


@query(_RUN_SQL + "SELECT * FROM a")
def run_search_attempts(spark, d):
    """Attempts of a search over two providers and one that is not registered, with sources that fail, are incomplete or report errors."""
    return _search(spark, d).table("attempts", runs.ATTEMPT).select("provider", "source", "status", "discovered", "inserted", "updated", "error_category", "error_message")


@query(_RUN_SQL + """SELECT 'completed_with_errors' AS status, 'beta,alpha' AS providers, '{"alpha":{"p1":["titles"],"p2":["titles"],"p3":["titles"],"p4":["titles"],"p5":["titles"]},"beta":{"p1":["titles"],"p2":["titles"],"p3":["titles"],"p4":["titles"],"p5":["titles"]}}' AS enforced_locally,
    'beta:p4:timeout,beta:p4:http_error,beta:p1:parse,gone::unknown,alpha:p4:timeout,alpha:p4:http_error,alpha:p1:parse' AS failures, sum(discovered)::BIGINT AS discovered, sum(inserted)::BIGINT AS inserted, sum(updated)::BIGINT AS updated FROM a""")
def run_search(spark, d):
    r = _search(spark, d).table("runs", runs.RUN)
    failures = F.array_join(F.transform("failures", lambda f: F.concat(f["provider"], F.lit(":"), F.coalesce(f["source"], F.lit("")), F.lit(":"), f["category"])), ",")
    return r.select("status", F.array_join("providers", ",").alias("providers"), "enforced_locally", failures.alias("failures"), "discovered", "inserted", "updated")


@query(_RUN_SQL + "SELECT CASE WHEN key IS NULL THEN 'parse_error' ELSE 'normalized' END AS status, CASE WHEN key IS NULL THEN 'posting has no resolvable identity' END AS error_message, count(*) AS postings FROM o WHERE source <> 'p4' GROUP BY 1, 2")
def run_raw_rows(spark, d):
    raw = _search(spark, d).table("raw", "seq long, raw_id string, status string, error_message string, content_hash string")
    return raw.filter("content_hash is not null").groupBy("status", "error_message").agg(F.count("*").alias("postings"))


@query(_RUN_SQL + "SELECT provider, count(DISTINCT (source, key)) AS jobs FROM o WHERE source <> 'p4' AND key IS NOT NULL GROUP BY 1")
def run_jobs(spark, d):
    """Jobs in the store after a run, by the provider of their occurrence."""
    s = _search(spark, d)
    jobs = s.snapshot("jobs", runs.JOB)
    return s.snapshot("occurrences", resolve.OCCURRENCE).join(jobs, "job_id").groupBy("provider").agg(F.count("*").alias("jobs"))


@query("SELECT 'alpha' AS provider, 'completed_with_errors' AS status, count(*) FILTER (o_orderpriority[1] <> '4') AS discovered FROM orders WHERE o_orderkey % 2 = 0")
def run_provider(spark, d):
    store = runs.Store(spark, scratch(spark, "store"))
    caps = planner.Capabilities("alpha", tuple(planner.Source(f"p{i}") for i in range(1, 6)))
    done = runs.run_provider(store, "alpha", caps, [f"p{i}" for i in range(1, 6)], lambda plan: _discovery(spark, d, "alpha"), run_id="one", observed_at=_START, clock=_clock())
    return done.select(c("providers")[0].alias("provider"), "status", "discovered")


# ---- attempts
def _told(spark, d) -> DataFrame:
    k = c("event_id")
    return load(spark, d, "events").select("event_id", "user_id", "event_type", F.when(k % 4 == 0, "running").when(k % 4 == 1, "failed").otherwise("completed").alias("status"), F.when(k % 4 == 1, "http_error").alias("error_category"), F.lit(None).cast("string").alias("error_message"), (k % 5).alias("errors"), (k % 3 != 0).alias("completed"), (k % 7 == 0).alias("incomplete"))


@query("SELECT event_id, CASE WHEN event_id % 4 <= 1 THEN 'failed' ELSE 'completed' END AS status, CASE event_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'http_error' END AS error_category, CASE WHEN event_id % 4 = 0 THEN 'this provider''s execution was aborted before completing' END AS error_message FROM events")
def abort_finalization(spark, d):
    return telemetry.abort(_told(spark, d)).select("event_id", "status", "error_category", "error_message")


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS category, CASE WHEN event_id % 3 = 1 THEN 'd' || event_id END AS message FROM events")
def attempt_error(spark, d):
    k = c("event_id")
    e = telemetry.attempt_error(F.when(k % 3 != 0, c("event_type")), F.when(k % 3 == 1, F.concat(F.lit(" \td"), k.cast("string"), F.lit("\n"))).otherwise(" \r\n"))
    return load(spark, d, "events").select("event_id", e["category"].alias("category"), e["message"].alias("message"))


@query("SELECT user_id, event_type, bool_or(event_id % 5 > 0 OR event_id % 3 = 0 OR event_id % 7 = 0) AS possibly_incomplete FROM events GROUP BY 1, 2")
def possibly_incomplete(spark, d):
    return telemetry.possibly_incomplete(_told(spark, d), "user_id", "event_type")


@query("""SELECT u AS user_id, string_agg(p || '=' || s, ';' ORDER BY p) AS enforcement FROM (SELECT u, p, string_agg(t || ':' || f, ',' ORDER BY t) AS s FROM (SELECT user_id % 10 AS u, 'p' || (event_id % 3) AS p, event_type AS t, string_agg(DISTINCT 'f' || (event_id % 4), '+' ORDER BY 'f' || (event_id % 4)) AS f FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""")
def enforcement_map(spark, d):
    k = c("event_id")
    plans = load(spark, d, "events").groupBy((c("user_id") % 10).alias("user_id"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("provider"), c("event_type").alias("source")).agg(F.collect_set(F.concat(F.lit("f"), (k % 4).cast("string"))).alias("fields"))
    m = telemetry.enforcement_map(plans, "user_id")
    entry = lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(F.array_sort(F.map_entries(F.from_json(e["value"], "map<string,array<string>>"))), lambda s: F.concat(s["key"], F.lit(":"), F.array_join(s["value"], "+"))), ","))
    return m.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("enforcement")), entry), ";").alias("enforcement"))


@query("SELECT DISTINCT source, 'error_of_unknown_source' AS violation FROM documents WHERE source >= 'src7' UNION ALL SELECT DISTINCT source, 'incomplete_though_not_completed' FROM documents WHERE source IN ('src1', 'src2') UNION ALL SELECT DISTINCT source, 'jobs_though_not_completed' FROM documents WHERE source IN ('src1', 'src2') UNION ALL SELECT DISTINCT source, 'jobs_of_unknown_source' FROM documents WHERE source >= 'src7' UNION ALL SELECT DISTINCT source, 'source_missing' FROM documents WHERE source >= 'src7'")
def discovery_violations(spark, d):
    docs = load(spark, d, "documents").select("source")
    names = [r.source for r in docs.distinct().collect()]
    bad = c("source").isin("src1", "src2")
    stats = telemetry.jobs_per_source(docs.filter("source < 'src7'")).select("source", (~bad).alias("completed"), c("jobs").alias("declared"), bad.alias("incomplete"))
    return telemetry.contract_violations(stats, docs, names, docs.filter("source >= 'src7'"))


# ---- services and histories
@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type <> 'error'")
def newest_first(spark, d):
    """Active rows of each key, the newest first: occurrences of a job, runs of a search, notes of an application."""
    e = load(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return ranking.newest_first(e, "user_id", "ts", "event_id", c("event_type") != "error").select("user_id", "event_id", "place")


@query("SELECT event_id, event_type FROM events WHERE user_id = 13")
def owned_rows(spark, d):
    return integrity.owned(load(spark, d, "events"), "user_id", 13).select("event_id", "event_type")


@query("""SELECT event_id, '{"a":' || event_id || ',"k":' || (props->>'k') || '}' AS kept FROM events""")
def allowed_fields(spark, d):
    text = F.concat(F.lit('{"z":[1],"a":'), c("event_id").cast("string"), F.lit(","), F.substring("props", 2, 100))
    return load(spark, d, "events").select("event_id", integrity.allowed_only(text, ["k", "a", "none"]).alias("kept"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def field_updates(spark, d):
    rows = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    k = c("c_custkey")
    patches = rows.filter((k % 2 == 0) | (k % 3 == 0) | (k % 5 == 0)).select("c_custkey", F.when(k % 3 == 0, "BUILDING").alias("c_mktsegment"), F.when(k % 2 == 0, c("c_acctbal") + 1).alias("c_acctbal"), F.when(k % 5 == 0, F.array(F.lit("c_mktsegment"))).otherwise(F.array().cast("array<string>")).alias("cleared"))
    return integrity.patched(rows, patches, "c_custkey", ["c_mktsegment", "c_acctbal"], {"c_mktsegment": ["BUILDING"]})


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0")
def association_violations(spark, d):
    """Postings whose raw row is of another source, dealt with, already attached, or missing."""
    k = c("o_orderkey")
    p = load(spark, d, "orders").select("o_orderkey", k.alias("raw_id"), F.lit("b").alias("provider"), c("o_orderpriority").alias("source"), F.sha2(k.cast("string"), 256).alias("content_hash"), c("o_orderdate").alias("fetched_at"), k.cast("string").alias("key_id"))
    raw = p.filter(k % 13 != 0).select("raw_id", "provider", F.when(k % 6 == 0, "x").otherwise(c("source")).alias("source"), "content_hash", "fetched_at", "key_id", F.when(k % 7 == 0, "normalized").otherwise("fetched").alias("status"), F.when(k % 11 == 0, "occ").alias("occurrence_id"))
    return integrity.associated(raw, p).select("o_orderkey")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM (SELECT DISTINCT o_custkey, (o_orderkey % 50)::VARCHAR AS o_orderkey FROM orders)) WHERE rank <= 3")
def distinct_first(spark, d):
    rows = load(spark, d, "orders").select("o_custkey", (c("o_orderkey") % 50).alias("o_orderkey"))
    return ranking.distinct_first(rows.union(rows), "o_custkey", "o_orderkey", 3).withColumn("rank", c("rank").cast("long"))


@query("SELECT doc_id, CASE WHEN n % 2 = 0 THEN 'a,,b' ELSE 'a,,b,' END AS lines FROM (SELECT doc_id, n_chars AS n FROM documents)")
def collapsed_blanks(spark, d):
    blank = F.when(c("n_chars") % 2 == 0, F.array(*[F.lit(x) for x in ("a", "", "  ", "", "b")])).otherwise(F.array(*[F.lit(x) for x in ("a", " ", "b", "", " ")]))
    return load(spark, d, "documents").select("doc_id", F.array_join(F.transform(ranking.collapse_blanks(blank), lambda x: F.btrim(x)), ",").alias("lines"))


@query("SELECT o_orderkey, CASE WHEN d = 0 THEN a::VARCHAR WHEN d <= 3 THEN CASE WHEN 10 - d = a THEN a || ',' || b ELSE a || ',' || b END END AS near FROM (SELECT o_orderkey, o_orderkey % 6 AS d, 10 - o_orderkey % 6 AS a, 10 + o_orderkey % 6 AS b FROM orders)")
def nearest_positions(spark, d):
    k = (c("o_orderkey") % 6).cast("int")
    near = ranking.nearest(F.array_distinct(F.array(F.lit(2), 10 - k, 10 + k, F.lit(99))), F.lit(10), 3)
    return load(spark, d, "orders").select("o_orderkey", F.nullif(F.array_join(F.transform(near, lambda x: x.cast("string")), ","), F.lit("")).alias("near"))


# ---- shapes
@query("SELECT o_orderkey, o_orderkey % 6 IN (0, 1) AS usable FROM orders")
def usable_ids(spark, d):
    k = c("o_orderkey")
    text = F.when(k % 6 == 0, k.cast("string")).when(k % 6 == 1, F.concat(F.lit('"j'), k.cast("string"), F.lit('"'))).when(k % 6 == 2, '" "').when(k % 6 == 3, "true").when(k % 6 == 4, "1.5").otherwise("null")
    return load(spark, d, "orders").select("o_orderkey", F.coalesce(primitives.is_usable_id(F.parse_json(text)), F.lit(False)).alias("usable"))


@query("SELECT page_id, starts_with(url, 'https://') AS https, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def url_shapes(spark, d):
    return load(spark, d, "pages").select("page_id", primitives.is_https_url(c("url")).alias("https"), urls.url_host(urls.normalize_url(F.upper("url"))).alias("host"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS at FROM events")
def aware_timestamps(spark, d):
    k = c("event_id")
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k % 4 == 0, F.concat(t, F.lit("Z"))).when(k % 4 == 1, F.concat(t, F.lit("+02:00"))).when(k % 4 == 2, t).otherwise("yesterday")
    return load(spark, d, "events").select("event_id", F.to_timestamp_ntz(F.date_format(primitives.aware_timestamp(text), "yyyy-MM-dd HH:mm:ss")).alias("at"))


@query("""SELECT page_id, sha256(unhex('0104') || unhex(printf('%08x', strlen(url))) || url::BLOB)[1:16] AS url_key,
    sha256(unhex('0105') || unhex('00000001') || 'p'::BLOB || unhex('00000001') || 's'::BLOB || unhex('00000001') || 't'::BLOB || unhex(printf('%08x', length(page_id::VARCHAR))) || (page_id::VARCHAR)::BLOB)[1:16] AS requisition_key FROM pages""")
def lock_keys(spark, d):
    shown = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return load(spark, d, "pages").select("page_id", shown(keys.url_hash(c("url"))).alias("url_key"), shown(keys.requisition_hash(F.lit("p"), F.lit("s"), F.lit("t"), c("page_id").cast("string"))).alias("requisition_key"))


@query("SELECT c_custkey, lower(c_name) || '@x.example' AS email, c_custkey || '|' || lower(c_mktsegment) || '.name' AS path FROM customer")
def emails_and_paths(spark, d):
    return load(spark, d, "customer").select("c_custkey", primitives.email(F.concat(F.lit(" \t"), c("c_name"), F.lit("@X.example\n"))).alias("email"), primitives.label_path(c("c_custkey").cast("string"), F.lower("c_mktsegment"), F.lit("name")).alias("path"))


@query("SELECT page_id, regexp_extract(html, '<h1>([^<&]*)</h1>', 1) AS title FROM pages WHERE regexp_matches(html, '<h1>[^<&]*</h1>')")
def html_headings(spark, d):
    """The heading of a page as text, found again by its place among the lines."""
    heading = F.regexp_extract("html", "<h1>([^<&]*)</h1>", 0)
    page = F.concat(F.lit("<div><script>x<p>1</script>"), heading, F.lit("<!-- <p>none</p> --><p>&amp;</div>"))
    text = html.html_to_text(page)["text"]
    return load(gentle(spark), d, "pages").filter(c("html").rlike("<h1>[^<&]*</h1>")).select("page_id", F.substring_index(text, "\n", 1).alias("title"))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN k % 7 = 0 THEN 'latitude_in_range' END, CASE WHEN k % 5 = 0 THEN 'latitude_with_longitude' END, CASE WHEN k % 3 = 0 THEN 'salary_min_up_to_salary_max' END, CASE WHEN k % 2 = 0 THEN 'title_trimmed' END], lambda x: x IS NOT NULL), ',') AS broken FROM (SELECT o_orderkey, o_orderkey AS k FROM orders) WHERE k % 7 = 0 OR k % 5 = 0 OR k % 3 = 0 OR k % 2 = 0""")
def job_constraints(spark, d):
    k = c("o_orderkey")
    jobs = load(spark, d, "orders").select("o_orderkey", F.when(k % 2 == 0, " Cook").otherwise("Cook").alias("title"), F.when(k % 3 == 0, 9).otherwise(1).alias("salary_min"), F.lit(5).alias("salary_max"), F.when(k % 7 == 0, 91.0).otherwise(45.0).alias("latitude"), F.when(k % 5 != 0, 7.0).alias("longitude"))
    return constraints.rejects(jobs, "job").select("o_orderkey", F.array_join("broken", ",").alias("broken"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'completed_at_fits_status' WHEN 2 THEN 'jobs_inserted_not_negative,status_known' ELSE 'failures_is_array,started_at_up_to_completed_at' END AS broken FROM events WHERE event_id % 4 <> 0""")
def run_constraints(spark, d):
    k = c("event_id") % 4
    rows = load(spark, d, "events").select("event_id", F.when(k == 2, "odd").otherwise("completed").alias("status"), F.when(k == 2, -1).otherwise(1).alias("jobs_inserted"), c("ts").alias("started_at"), F.when(k == 3, c("ts") - F.expr("interval 1 hour")).when(k == 0, c("ts")).alias("completed_at"), F.when(k == 3, "{}").otherwise("[]").alias("failures"))
    broken = constraints.rejects(rows, "collection_run").select("event_id", F.array_remove("broken", "").alias("broken"))
    fits = F.when(c("event_id") % 4 == 2, F.array_remove("broken", "completed_at_fits_status")).otherwise(c("broken"))  # of an unknown status no time fits
    return broken.select("event_id", F.array_join(fits, ",").alias("broken"))


# ---- labels
@query("SELECT l.doc_id::VARCHAR AS record_id, CASE WHEN quality = toxic THEN quality WHEN l.doc_id % 3 <> 0 THEN 7 END AS value, quality <> toxic AND l.doc_id % 3 = 0 AS missing FROM labels l")
def adjudicated_labels(spark, d):
    x = load(spark, d, "labels").select(c("doc_id").cast("string").alias("record_id"), F.lit("q").alias("label_path"), "quality", "toxic")
    agreed = evaluate.agreement(x.withColumnRenamed("quality", "value"), x.withColumnRenamed("toxic", "value"))
    ruled = x.filter("quality <> toxic and cast(record_id as long) % 3 <> 0").select("record_id", "label_path", F.lit(7).alias("value"))
    return evaluate.final_labels(agreed, ruled).select("record_id", "value", "missing")


@query("SELECT doc_id::VARCHAR AS record_id FROM labels WHERE quality <> toxic AND doc_id % 3 = 0")
def missing_adjudications(spark, d):
    x = load(spark, d, "labels").select(c("doc_id").cast("string").alias("record_id"), F.lit("q").alias("label_path"), "quality", "toxic")
    split = x.filter("quality <> toxic")
    return evaluate.missing(split, split.filter("cast(record_id as long) % 3 <> 0"), "record_id", "label_path").select("record_id")


@query("SELECT l.doc_id::VARCHAR AS record_id, quality::VARCHAR AS expected_value, CASE WHEN l.doc_id % 4 <> 0 THEN lang END AS value FROM labels l JOIN documents USING (doc_id)")
def expected_and_actual(spark, d):
    key = [F.lit("p").alias("parser"), F.lit("k").alias("component")]
    expected = load(spark, d, "labels").select(c("doc_id").cast("string").alias("record_id"), *key, F.lit("absent").alias("outcome"), c("quality").cast("string").alias("expected_value"))
    actual = load(spark, d, "documents").filter("doc_id % 4 <> 0").select(c("doc_id").cast("string").alias("record_id"), *key, c("lang").alias("value"), F.lit("inferred").alias("provenance"))
    return evaluate.facts(expected, actual).select("record_id", "expected_value", "value")


@query("SELECT l.doc_id::VARCHAR AS record_id, CASE WHEN quality = toxic THEN 'v' || quality ELSE 'ruled' END AS value, CASE WHEN source = (SELECT max(source) FROM documents) THEN 'holdout' ELSE 'dev' END AS split FROM labels l JOIN documents USING (doc_id)")
def label_corpus(spark, d):
    """A corpus from two passes and the rulings on what they disagree about."""
    docs = load(spark, d, "documents").select(c("doc_id").cast("string").alias("record_id"), c("source").alias("employer"), F.md5("text").alias("text"))
    x = load(spark, d, "labels").select(c("doc_id").cast("string").alias("record_id"), F.lit("title.name").alias("label_path"), F.lit("present_supported").alias("outcome"), "quality", "toxic")
    one = lambda name: x.select("record_id", "label_path", "outcome", F.concat(F.lit("v"), c(name).cast("string")).alias("value"))
    ruled = x.filter("quality <> toxic").select("record_id", "label_path", "outcome", F.lit("ruled").alias("value"))
    bound = evaluate.packet_hash(docs, "record_id", "employer", "text")
    return evaluate.build_corpus(docs, one("quality"), one("toxic"), ruled, bound_to=bound).select("record_id", "value", "split")


# ---- acquisition
@query("SELECT page_id::VARCHAR AS source_job_id, 'Cook [REDACTED_EMAIL]' AS title, 'Line ' || page_id || chr(10) || 'Call [REDACTED_PHONE] & more' AS description FROM pages WHERE page_id % 3 <> 0")
def sanitized_postings(spark, d):
    k = c("page_id")
    text = F.concat(F.lit("<p>Line  "), k.cast("string"), F.lit("</p><style>p{}</style><div>Call +1 (555) 010-9999 &amp; more</div>"))
    rows = load(spark, d, "pages").select(F.lit("s").alias("source"), k.cast("string").alias("source_job_id"), F.when(k % 3 == 0, " ").otherwise("Cook a.b@c.org").alias("title"), F.lit(None).cast("string").alias("location"), text.alias("description"), F.lit(None).cast("string").alias("compensation_text"))
    return postings.sanitized(rows).select("source_job_id", "title", "description")


@query("SELECT page_id AS seq, 'fetched' AS status FROM pages WHERE page_id % 2 = 0")
def landed_rows(spark, d):
    """Raw rows of one run, from a table that another run writes to as well."""
    at, rows = scratch(spark, "raw"), load(spark, d, "pages").select(c("page_id").alias("seq"), "url")
    postings.land_raw(rows.filter("seq % 2 = 1"), at, "other", _START)
    return postings.land_raw(rows.filter("seq % 2 = 0"), at, "own", _START).select("seq", "status")


@query("SELECT 'b' || (o_custkey % 5) AS board, o_orderkey::VARCHAR AS source_job_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey::VARCHAR) AS n FROM orders WHERE o_orderkey % 3 <> 0) WHERE n <= 10")
def acquired_postings(spark, d):
    k = c("o_orderkey")
    rows = load(spark, d, "orders").select(F.concat(F.lit("b"), (c("o_custkey") % 5).cast("string")).alias("board"), k.alias("source_job_id"), F.when(k % 3 == 0, "​ ").otherwise("Engineer").alias("title"), F.lit("text").alias("description"))
    return postings.acquired(rows.union(rows)).select("board", "source_job_id")


__all__ = ["QUERIES", "SQL"]
