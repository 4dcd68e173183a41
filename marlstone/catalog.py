"""The registered queries of the library, and the SQL that each is compared with.

The supplied tables hold no postings, so classifiers read texts that a query makes out of their columns; the SQL works the answer out from
those columns, not from the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_more
from .functions import arrangements, experience, html, keys, location, primitives, reconcile, salary, skills, taxonomy, titles, urls
from .operators import evaluate, integrity, ranking, resolve, telemetry
from .plans import planner
from .session import gentle, load
from .staging import cut
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "url_host_counts"
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- URLs, domains, keys
_URL_SQL = r"""
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1))
    || CASE WHEN regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') END
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END AS url
FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND lower(string_split(p, '=')[1]) NOT IN ('gh_src', 'lever-source', 'trk', 'li_fat_id', 'ref', 'fbclid', 'gclid', 'mc_cid', 'mc_eid')) AS kept FROM pages)
"""


@query(_URL_SQL)
def url_normalize(spark, d):
    return load(spark, d, "pages").select("page_id", urls.normalize_url(c("url")).alias("url"))


@query(f"SELECT regexp_extract(url, '^[a-z]+://([^/?]+)', 1) AS host, count(*) AS pages, count(DISTINCT url) AS urls, min(page_id) AS first_page FROM ({_URL_SQL}) GROUP BY 1")
def url_host_counts(spark, d):
    pages = load(spark, d, "pages").select("page_id", urls.normalize_url(c("url")).alias("url")).filter("url is not null")
    per_url = pages.groupBy("url").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))  # a distinct count without a wide expansion
    return per_url.groupBy(urls.url_host(c("url")).alias("host")).agg(F.sum("n").alias("pages"), F.count("*").alias("urls"), F.min("first").alias("first_page"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS domain FROM pages")
def domain_normalize(spark, d):
    return load(spark, d, "pages").select("page_id", urls.normalize_domain(c("url")).alias("domain"))


_KEYED = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Acme ' ELSE NULL END AS tenant, CASE WHEN o_orderkey % 5 <> 0 THEN ' ' || o_custkey::VARCHAR ELSE '  ' END AS job, CASE WHEN o_orderkey % 7 <> 0 THEN 'https://h.example/o/' || (o_orderkey % 1000)::VARCHAR END AS url FROM orders"


def _keyed(spark, d):
    o = load(spark, d, "orders")
    k = c("o_orderkey")
    tenant, job, url = F.when(k % 3 == 0, "Acme "), F.when(k % 5 != 0, F.concat(F.lit(" "), c("o_custkey").cast("string"))).otherwise("  "), F.when(k % 7 != 0, F.concat(F.lit("https://h.example/o/"), (k % 1000).cast("string")))
    return o.select("o_orderkey", keys.natural_key(F.lit(" Board "), F.lit("MAIN"), tenant, job, url).alias("key"))


@query(f"SELECT o_orderkey, CASE WHEN trim(job) <> '' AND tenant IS NOT NULL THEN 'tenant' WHEN trim(job) <> '' THEN 'no_tenant' WHEN url IS NOT NULL THEN 'url' END AS domain, nullif(trim(job), '') AS job_id FROM ({_KEYED}) WHERE trim(job) <> '' OR url IS NOT NULL")
def natural_key_domain(spark, d):
    return _keyed(spark, d).filter("key is not null").select("o_orderkey", c("key.domain").alias("domain"), c("key.job_id").alias("job_id"))


@query("SELECT o_orderkey, sha256(unhex('0101' || '00000005') || 'board'::BLOB || unhex('00000004') || 'main'::BLOB || unhex('00000004') || 'Acme'::BLOB || unhex(printf('%08x', length(o_custkey::VARCHAR))) || (o_custkey::VARCHAR)::BLOB)[1:16] AS prefix FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0")
def natural_key_hash(spark, d):
    """The 64-bit key hash in hexadecimal."""
    rows = _keyed(spark, d).filter("key.domain = 'tenant'")
    return rows.select("o_orderkey", F.lower(F.lpad(F.hex(keys.key_hash(c("key"))), 16, "0")).alias("prefix"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def doc_exact_hash(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("hash"))


@query("""SELECT event_id, sha256('{"k":' || (props->>'k') || '}') AS hash, NULL::VARCHAR AS error FROM events""")
def json_hash(spark, d):
    """Canonical JSON hashes of event properties."""
    h = keys.canonical_json_hash(c("props"))
    return load(spark, d, "events").select("event_id", h["hash"].alias("hash"), h["error"].alias("error"))


# ---- text
@query("SELECT doc_id, lower(trim(source)) AS source, nullif(trim(lang), '') AS lang, regexp_full_match(source, '[a-z0-9][a-z0-9._-]*') AS is_slug FROM documents")
def canonical_text(spark, d):
    return load(spark, d, "documents").select("doc_id", primitives.identifier(c("source")).alias("source"), primitives.nullable_text(c("lang")).alias("lang"), primitives.is_slug(c("source")).alias("is_slug"))


@query(r"SELECT doc_id, regexp_matches(text, '[^\s\p{Z}\p{Cf}\x{1c}-\x{1f}\x{85}\x{0b}]') AS meaningful FROM documents")
def meaningful_text(spark, d):
    return load(spark, d, "documents").select("doc_id", primitives.is_meaningful(c("text")).alias("meaningful"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[REDACTED_EMAIL]', 'g')) AS redacted FROM documents")
def redact_emails(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(F.regexp_replace("text", html.EMAIL, "[REDACTED_EMAIL]")).alias("redacted"))


@query()
def redact_contacts(spark, d):
    return load(spark, d, "documents").select("doc_id", html.redact_contacts(c("text")).alias("text"))


@query()
def html_to_text(spark, d):
    t = html.html_to_text(c("html"))
    return load(gentle(spark), d, "pages").select("page_id", t["text"].alias("text"), t["error"].alias("error"))


@query("SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS lookup, lower(regexp_replace(trim(p_brand), '[\\t\\n\\r ]+', ' ', 'g')) AS company FROM part")
def lookup_keys(spark, d):
    return load(spark, d, "part").select("p_partkey", primitives.lookup_key(c("p_name")).alias("lookup"), primitives.company_name(c("p_brand")).alias("company"))


# ---- classifiers
@query("""SELECT o_orderkey, CASE k WHEN 4 THEN NULL WHEN 3 THEN NULL ELSE amount END::INTEGER AS low, CASE k WHEN 2 THEN NULL WHEN 4 THEN NULL WHEN 1 THEN amount + 5000 ELSE amount END::INTEGER AS high,
    CASE k WHEN 0 THEN 'USD' WHEN 1 THEN 'GBP' WHEN 2 THEN NULL WHEN 3 THEN 'EUR' ELSE 'CAD' END AS currency, CASE k WHEN 0 THEN 'annual' WHEN 1 THEN 'hourly' ELSE NULL END AS period
    FROM (SELECT o_orderkey, o_orderkey % 5 AS k, 1000 + o_custkey % 200000 AS amount FROM orders)""")
def salary_classify(spark, d):
    k, n = c("o_orderkey") % 5, 1000 + c("o_custkey") % 200000
    t = lambda x: F.format_number(x, 0)
    text = (
        F.when(k == 0, F.concat(F.lit("Salary: $"), t(n), F.lit(" USD per year")))
        .when(k == 1, F.concat(F.lit("£"), n.cast("string"), F.lit(" - £"), (n + 5000).cast("string"), F.lit("/hr")))
        .when(k == 2, F.concat(F.lit("base pay $"), t(n), F.lit("+.")))
        .when(k == 3, F.concat(F.lit("up to €"), n.cast("string"), F.lit(".00")))
        .otherwise(F.concat(F.lit("CAD "), t(n), F.lit(" per week")))
    )
    r = load(spark, d, "orders").select("o_orderkey", salary.classify_salary(text).alias("r"))
    return r.select("o_orderkey", c("r.minimum.value").alias("low"), c("r.maximum.value").alias("high"), c("r.currency.value").alias("currency"), c("r.period.value").alias("period"))


@query("""SELECT c_custkey, CASE k WHEN 0 THEN 'TX' WHEN 1 THEN 'NY' WHEN 3 THEN 'CA' END AS state, CASE k WHEN 0 THEN 'United States' WHEN 1 THEN 'United States' WHEN 2 THEN 'Germany' WHEN 3 THEN 'United States' WHEN 4 THEN 'Canada' END AS country,
    CASE k WHEN 0 THEN printf('%05d', c_custkey % 100000) END AS postal_code, CASE k WHEN 0 THEN 'inferred' WHEN 1 THEN 'inferred' WHEN 5 THEN 'unavailable' ELSE 'parsed_description' END AS provenance FROM (SELECT c_custkey, c_custkey % 6 AS k FROM customer)""")
def location_classify(spark, d):
    k = c("c_custkey") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("Austin, TX "), F.lpad((c("c_custkey") % 100000).cast("string"), 5, "0")))
        .when(k == 1, "Remote - New York, ny")
        .when(k == 2, "Berlin, Germany (hybrid)")
        .when(k == 3, "San Jose, CA, U.S.")
        .when(k == 4, "Remote, Canada.")
        .otherwise("Denver, CO")
    )
    r = load(spark, d, "customer").select("c_custkey", location.classify_location(text).alias("r"))
    return r.select("c_custkey", c("r.state.value").alias("state"), c("r.country.value").alias("country"), c("r.postal_code.value").alias("postal_code"), c("r.country.provenance").alias("provenance"))


_TITLES = [("Senior Software Engineer", "software-engineer", "software_engineering", "matched"), ("Engineering Manager, Payments", "engineering-manager", "engineering_management", "matched"), ("Data Analyst", None, None, "unsupported"), ("Recruiter / Account Executive", None, None, "ambiguous"), ("", None, None, "no_title"), ("Director of Engineering (Remote)", "engineering-director", "engineering_management", "matched"), ("Product Security Engineer", None, None, "ambiguous")]


def _pick(column, values):
    """values[column % len(values)]."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (column % len(values) + 1).cast("int"))


def _apart(text, column):
    """A text with words of its own for each row, which change no answer: letters for digits."""
    word = F.translate(column.cast("string"), "0123456789", "bcdfghjklm")
    return F.when(text == "", text).otherwise(F.concat(text, F.lit(" (zq"), word, F.lit(")")))


def _sentence_apart(text, column):
    word = F.translate(column.cast("string"), "0123456789", "bcdfghjklm")
    return F.concat(text, F.when(text.rlike("[.!?]$"), " ").otherwise(". "), F.lit("Zq"), word, F.lit(" and nothing else."))


def _sql_pick(column: str, values) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


@query(f"SELECT p_partkey, {_sql_pick('p_partkey', [t[1] for t in _TITLES])} AS canonical_title, {_sql_pick('p_partkey', [t[2] for t in _TITLES])} AS role_family, {_sql_pick('p_partkey', [t[3] for t in _TITLES])} AS outcome FROM part")
def title_classify(spark, d):
    r = load(spark, d, "part").select("p_partkey", titles.classify_title(_apart(_pick(c("p_partkey"), [t[0] for t in _TITLES]), c("p_partkey"))).alias("r"))
    return r.select("p_partkey", c("r.canonical_title.value").alias("canonical_title"), c("r.role_family.value").alias("role_family"), c("r.outcome").alias("outcome"))


_CASES = {
    "remote_classify": (arrangements.classify_remote_type, [("Engineer (Remote)", None, "remote", "inferred"), ("Engineer", "This is a hybrid role.", "hybrid", "parsed_description"), (None, "This is not a remote position.", None, "unavailable"), ("Remote Engineer", "Not remote, onsite.", "onsite", "parsed_description"), ("Engineer, Remote", "hybrid schedule", None, "unavailable"), (None, "Work from home. Required to be in the office on Mondays", None, "unavailable")]),
    "employment_classify": (arrangements.classify_employment_type, [("Engineer - Full-Time", None, "full_time", "inferred"), ("Nurse", "A part-time position.", "part_time", "parsed_description"), (None, "Neither a seasonal job nor an internship program.", None, "unavailable"), ("Intern", "Internship program in summer", "internship", "parsed_description"), ("Contract, Full Time", None, "full_time", "inferred")]),
    "seniority_classify": (arrangements.classify_seniority, [("Senior Staff Engineer", None, "staff", "inferred"), ("Engineer", "We are hiring a senior engineer.", "senior", "parsed_description"), ("Senior Living Aide", None, None, "unavailable"), ("Jr. Analyst", "This is not a senior role", "entry_level", "inferred"), ("Junior Senior Engineer", None, None, "unavailable")]),
}


def _classified(name: str):
    fn, cases = _CASES[name]

    def run(spark, d):
        o = load(spark, d, "orders")
        k = c("o_orderkey")
        r = o.select("o_orderkey", fn(_apart(_pick(k, [x[0] for x in cases]), k), _sentence_apart(_pick(k, [x[1] for x in cases]), k)).alias("r"))
        return r.select("o_orderkey", c("r.value").alias("value"), c("r.provenance").alias("provenance"))

    run.__name__ = name
    query(f"SELECT o_orderkey, {_sql_pick('o_orderkey', [x[2] for x in cases])} AS value, {_sql_pick('o_orderkey', [x[3] for x in cases])} AS provenance FROM orders")(run)


for _name in _CASES:
    _classified(_name)


@query("""SELECT o_orderkey, CASE k WHEN 0 THEN n WHEN 1 THEN n WHEN 3 THEN 0 WHEN 4 THEN NULL ELSE NULL END::INTEGER AS low, CASE k WHEN 1 THEN n + 2 WHEN 2 THEN n ELSE NULL END::INTEGER AS high, CASE k WHEN 0 THEN 'inferred' WHEN 1 THEN 'parsed_description' WHEN 3 THEN 'parsed_description' ELSE 'unavailable' END AS provenance
    FROM (SELECT o_orderkey, o_orderkey % 5 AS k, o_custkey % 20 AS n FROM orders)""")
def experience_classify(spark, d):
    k, n = c("o_orderkey") % 5, (c("o_custkey") % 20).cast("string")
    title = F.when(k == 0, F.concat(F.lit("Engineer ("), n, F.lit("+ years)")))
    text = F.when(k == 1, F.concat(F.lit("This role requires "), n, F.lit(" to "), (c("o_custkey") % 20 + 2).cast("string"), F.lit(" years of experience."))).when(k == 2, F.concat(F.lit("We need candidates with up to "), n, F.lit(" yrs experience!"))).when(k == 3, "No prior experience required.").when(k == 4, F.concat(F.lit("Less than "), n, F.lit(" years of experience")))
    r = load(spark, d, "orders").select("o_orderkey", experience.classify_experience(_apart(title, c("o_orderkey")), _sentence_apart(text, c("o_orderkey"))).alias("r"))
    return r.select("o_orderkey", c("r.minimum.value").alias("low"), c("r.maximum.value").alias("high"), c("r.minimum.provenance").alias("provenance"))


_SKILL_TEXT = [("Go Developer", "We use Python, Docker and k8s."), ("Java Engineer", None), ("C++ / C#", "Skills: R, Go."), ("Analyst", "go there"), (None, "Proficient in Java, Go, Python."), ("Node Engineer", "TypeScript; MySQL; MONGO!")]
_SKILL_IDS = [["docker", "golang", "kubernetes", "python"], ["java"], ["cpp", "csharp", "golang", "rlang"], [], ["golang", "java", "python"], ["mongodb", "mysql", "typescript"]]


def _skills(spark, d):
    p = load(spark, d, "part")
    found = skills.classify_skills(_apart(_pick(c("p_partkey"), [t for t, _ in _SKILL_TEXT]), c("p_partkey")), _sentence_apart(_pick(c("p_partkey"), [t for _, t in _SKILL_TEXT]), c("p_partkey")))
    return p.select("p_partkey", "p_size", F.explode(found).alias("s")).select("p_partkey", "p_size", c("s.canonical_id").alias("skill"), c("s.provenance").alias("provenance"))


_SKILL_SQL = "SELECT p_partkey, p_size, unnest(CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN {x if x else '[]::VARCHAR[]'}" for i, x in enumerate(_SKILL_IDS)) + " END) AS skill FROM part"


@query(f"SELECT p_partkey, skill FROM ({_SKILL_SQL})")
def skills_explode(spark, d):
    return _skills(spark, d).select("p_partkey", "skill")


@query(f"SELECT skill, count(*) AS parts, sum(p_size)::BIGINT AS size FROM ({_SKILL_SQL}) GROUP BY 1")
def skill_counts(spark, d):
    return _skills(spark, d).groupBy("skill").agg(F.count("*").alias("parts"), F.sum(c("p_size").cast("long")).alias("size"))


_TOKENS = [" PYTHON ", "c++", "Node.js", "cobol", "Ｇｏ", "k8s"]


@query(f"SELECT l_orderkey, l_linenumber, {_sql_pick('(l_orderkey + l_linenumber)', ['python', 'cpp', 'node.js', None, 'golang', 'kubernetes'])} AS canonical_id FROM lineitem")
def taxonomy_lookup(spark, d):
    li = load(spark, d, "lineitem")
    return taxonomy.look_up(li, _pick(c("l_orderkey") + c("l_linenumber"), _TOKENS)).select("l_orderkey", "l_linenumber", "canonical_id")


@query("""SELECT o_orderkey, CASE WHEN t IS NULL OR s IS NULL OR t = s THEN coalesce(s, t) END AS value, CASE WHEN coalesce(CASE WHEN t IS NULL OR s IS NULL OR t = s THEN coalesce(s, t) END, '') = '' THEN 'unavailable' WHEN s IS NULL THEN 'inferred' ELSE 'parsed_description' END AS provenance
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS t, CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END END AS s FROM orders)""")
def reconcile_sources(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.when(c("o_orderkey") % 3 != 0, c("o_orderpriority")).alias("t"), F.when(c("o_orderkey") % 4 != 0, F.when(c("o_custkey") % 2 == 0, c("o_orderpriority")).otherwise(c("o_orderstatus"))).alias("s"))
    r = o.select("o_orderkey", reconcile.reconcile(c("t"), c("s")).alias("r"))
    return r.select("o_orderkey", "r.value", "r.provenance")


# ---- resolution: orders as postings, customers as requisitions
def _postings(spark, d):
    k, cust = c("o_orderkey"), c("o_custkey")
    none = F.lit(None).cast("string")
    return load(spark, d, "orders").select(
        k.cast("long").alias("seq"),
        F.lit("board").alias("provider"),
        F.lit("main").alias("source"),
        F.when(k % 2 == 0, F.concat(F.lit("t"), (cust % 25).cast("string"))).alias("source_tenant_id"),
        F.when(k % 10 != 3, (k % 2000).cast("string")).alias("source_job_id"),
        F.when(k % 3 == 0, (cust % 50).cast("string")).otherwise(none).alias("requisition_id"),
        F.when(k % 20 != 3, F.concat(F.lit("https://h.example/o/"), k.cast("string"))).alias("source_url"),
        F.when(k % 4 == 1, F.concat(F.lit("https://h.example/c/"), (cust % 300).cast("string"))).alias("canonical_url"),
        c("o_orderdate").cast("timestamp").alias("observed_at"),
    )


def _resolved(spark, d):
    return cut(resolve.resolve(_postings(spark, d), spark.createDataFrame([], resolve.OCCURRENCE), "run"))


_BASE = """WITH p AS (SELECT o_orderkey AS seq, o_orderdate AS at, CASE WHEN o_orderkey % 2 = 0 THEN 't' || (o_custkey % 25) END AS tenant, CASE WHEN o_orderkey % 10 <> 3 THEN (o_orderkey % 2000)::VARCHAR END AS job,
    CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 50)::VARCHAR END AS req, CASE WHEN o_orderkey % 20 <> 3 THEN 'https://h.example/o/' || o_orderkey END AS src, CASE WHEN o_orderkey % 4 = 1 THEN 'https://h.example/c/' || (o_custkey % 300) END AS url FROM orders),
k AS (SELECT *, CASE WHEN job IS NOT NULL THEN coalesce(tenant, '-') || '/' || job ELSE src END AS key FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn, first_value(url) OVER (PARTITION BY key ORDER BY seq) AS first_url FROM k WHERE key IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS un FROM r WHERE rn = 1),
t3 AS (SELECT f.seq, tenant, req, min(seq) OVER (PARTITION BY tenant, req) AS opener FROM f WHERE url IS NULL AND tenant IS NOT NULL AND req IS NOT NULL),
j2 AS (SELECT tenant, req, seq, min(seq) OVER (PARTITION BY url) AS job FROM f WHERE url IS NOT NULL AND tenant IS NOT NULL AND req IS NOT NULL),
d AS (SELECT t3.seq, t3.opener, (SELECT count(DISTINCT job) FROM j2 WHERE j2.tenant = t3.tenant AND j2.req = t3.req AND j2.seq < t3.seq) AS n2, (SELECT count(*) FROM j2 WHERE j2.tenant = t3.tenant AND j2.req = t3.req AND j2.seq < t3.opener) AS n0 FROM t3),
o3 AS (SELECT seq, CASE WHEN n0 = 0 AND seq = opener THEN 'INSERTED' WHEN n2 + CASE WHEN n0 = 0 THEN 1 ELSE 0 END >= 2 THEN 'AMBIGUOUS' ELSE 'ATTACHED' END AS outcome FROM d),
o AS (SELECT k.seq, k.at, CASE WHEN k.key IS NULL THEN 'PARSE_ERROR' WHEN r.rn > 1 THEN CASE WHEN r.url IS NOT NULL AND r.first_url IS NOT NULL AND r.url <> r.first_url THEN 'QUARANTINED' ELSE 'UPDATED' END
    WHEN r.url IS NOT NULL THEN CASE WHEN f.un = 1 THEN 'INSERTED' ELSE 'ATTACHED' END WHEN o3.outcome IS NOT NULL THEN o3.outcome ELSE 'INSERTED' END AS outcome FROM k LEFT JOIN r USING (seq) LEFT JOIN f USING (seq) LEFT JOIN o3 USING (seq)) """


_JOBS = _BASE + """, j3 AS (SELECT t3.seq, CASE WHEN n0 = 0 THEN t3.opener ELSE (SELECT arg_min(job, seq) FROM j2 WHERE j2.tenant = t3.tenant AND j2.req = t3.req) END AS job FROM t3 JOIN d USING (seq)),
made AS (SELECT r.key, r.seq, CASE WHEN o.outcome <> 'ATTACHED' THEN r.seq WHEN r.url IS NOT NULL THEN (SELECT min(f.seq) FROM f WHERE f.url = r.url) ELSE j3.job END AS job FROM r JOIN o USING (seq) LEFT JOIN j3 USING (seq) WHERE r.rn = 1) """


@query(_JOBS + "SELECT r.seq, made.job AS job_seq FROM r JOIN made USING (key)")
def resolve_jobs(spark, d):
    """The posting that opened the job of each posting."""
    p = _postings(spark, d)
    names = p.select(c("seq").alias("job_seq"), keys.derived_id(F.lit("run"), c("seq"), F.lit("job")).alias("job_id"))
    return _resolved(spark, d).select("seq", "job_id").join(names, "job_id").select("seq", "job_seq")


@query(_BASE + "SELECT seq, outcome FROM o")
def resolve_two_batches(spark, d):
    """The second half against the stored occurrences of the first: the outcomes are those of one batch."""
    p = _postings(spark, d)
    half = p.agg(F.max("seq")).first()[0] // 2
    none = spark.createDataFrame([], resolve.OCCURRENCE)
    first = cut(resolve.resolve(p.filter(c("seq") <= half), none, "one"))
    stored = cut(resolve.next_occurrences(first, none))
    return first.select("seq", "outcome").union(resolve.resolve(p.filter(c("seq") > half), stored, "two").select("seq", "outcome"))


@query(_BASE + "SELECT seq, outcome FROM o")
def resolve_outcomes(spark, d):
    return _resolved(spark, d).select("seq", "outcome")


@query(_BASE + "SELECT count(*) AS discovered, count(*) FILTER (outcome IN ('INSERTED', 'AMBIGUOUS')) AS inserted, count(*) FILTER (outcome IN ('UPDATED', 'ATTACHED', 'QUARANTINED')) AS updated, count(*) FILTER (outcome = 'PARSE_ERROR') AS errors, bool_or(outcome IN ('QUARANTINED', 'AMBIGUOUS')) AS has_conflict FROM o")
def outcome_counters(spark, d):
    return telemetry.counters(_resolved(spark, d))


@query(_BASE + """SELECT o.seq, CASE outcome WHEN 'QUARANTINED' THEN 'evidence_mismatch' ELSE 'ambiguous_match' END AS conflict_type, CASE outcome WHEN 'QUARANTINED' THEN '{"stored":"' || r.first_url || '","incoming":"' || r.url || '"}' END AS urls, CASE outcome WHEN 'AMBIGUOUS' THEN n2 + CASE WHEN n0 = 0 THEN 1 ELSE 0 END END AS candidates
    FROM o JOIN r USING (seq) LEFT JOIN d USING (seq) WHERE outcome IN ('QUARANTINED', 'AMBIGUOUS')""")
def conflict_rows(spark, d):
    r = resolve.conflicts(_resolved(spark, d))
    listed = F.size(F.from_json("evidence", "array<string>")).cast("long")
    return r.select("seq", "conflict_type", F.when(c("conflict_type") == "evidence_mismatch", c("evidence")).alias("urls"), F.when(c("conflict_type") == "ambiguous_match", listed).alias("candidates"))


@query(_BASE + "SELECT CASE WHEN outcome = 'PARSE_ERROR' THEN 'parse_error' WHEN outcome IN ('QUARANTINED', 'AMBIGUOUS') THEN 'identity_conflict' ELSE 'normalized' END AS status, count(*) AS postings FROM o GROUP BY 1")
def raw_statuses(spark, d):
    return _resolved(spark, d).groupBy(resolve.raw_status(c("outcome")).alias("status")).agg(F.count("*").alias("postings"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1")
def first_writer_dedupe(spark, d):
    return ranking.first_writers(load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey")


# ---- telemetry: users as runs, event types as providers
@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 5 = 0 THEN 'partial' ELSE 'completed' END AS status FROM events")
def attempt_status(spark, d):
    k = c("event_id")
    return load(spark, d, "events").select("event_id", telemetry.attempt_status(k % 7 != 0, k % 5 == 0).alias("status"))


def _attempts(spark, d):
    k = c("event_id")
    return load(spark, d, "events").select("event_id", "user_id", "event_type", "ts", telemetry.attempt_status(k % 7 != 0, k % 5 == 0).alias("status"), (k % 11).alias("discovered"), (k % 3).alias("inserted"), (k % 2).alias("updated"))


@query("SELECT user_id, CASE WHEN bool_or(event_id % 97 = 5) THEN 'failed' WHEN bool_or(event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 11 = 3) THEN 'completed_with_errors' ELSE 'completed' END AS run_status FROM events GROUP BY 1")
def run_status(spark, d):
    k = c("event_id")
    return telemetry.run_status(_attempts(spark, d).withColumns({"aborted": k % 97 == 5, "had_conflict": k % 11 == 3, "had_parse_error": F.lit(False)}), "user_id")


@query("SELECT user_id, coalesce(sum(event_id % 11), 0)::BIGINT AS discovered, coalesce(sum(event_id % 3), 0)::BIGINT AS inserted, coalesce(sum(event_id % 2), 0)::BIGINT AS updated FROM events GROUP BY 1")
def run_rollup(spark, d):
    return telemetry.rollup(_attempts(spark, d), "user_id")


@query("SELECT event_type, max(ts) AS occurred_at, arg_max(event_id, (ts, event_id)) AS idx, arg_max(user_id, (ts, event_id)) AS user_id FROM events WHERE event_id % 7 = 0 GROUP BY 1")
def latest_error(spark, d):
    errors = load(spark, d, "events").filter("event_id % 7 = 0").select("event_type", c("ts").alias("occurred_at"), c("event_id").alias("idx"), "user_id")
    return telemetry.latest_error(errors, "event_type")


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS failures FROM events WHERE event_id % 7 = 0 GROUP BY 1")
def ordered_failures(spark, d):
    errors = load(spark, d, "events").filter("event_id % 7 = 0").select("user_id", c("event_id").alias("idx"), c("event_type").alias("category"))
    return telemetry.failures(errors, "user_id").select("user_id", F.array_join(F.transform("failures", lambda f: f["idx"].cast("string")), ",").alias("failures"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY i) AS providers FROM (SELECT user_id, event_type, min(event_id) AS i FROM events GROUP BY 1, 2) GROUP BY 1")
def providers_attempted(spark, d):
    a = load(spark, d, "events").select("user_id", c("event_type").alias("provider"), c("event_id").alias("idx"))
    return telemetry.providers_attempted(a, "user_id").select("user_id", F.array_join("providers", ",").alias("providers"))


@query("SELECT event_id, lag(event_id % 11) OVER w AS previous, round(avg(event_id % 11) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS mean_before FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)")
def attempt_trend(spark, d):
    t = telemetry.attempt_trend(_attempts(spark, d), "user_id", "event_type", order="event_id")
    return t.select("event_id", "previous", F.round("mean_before", 6).alias("mean_before"))


@query("SELECT source, count(*) AS jobs FROM documents GROUP BY 1")
def jobs_per_source(spark, d):
    return telemetry.jobs_per_source(load(spark, d, "documents"))


@query("SELECT source, 'count_differs' AS violation FROM documents GROUP BY 1 HAVING count(*) <> 50 UNION ALL SELECT 'src99', 'source_missing'")
def contract_violations(spark, d):
    docs = load(spark, d, "documents")
    stats = docs.select("source").distinct().select("source", F.lit(50).alias("declared"), F.lit(True).alias("completed"))
    names = [r.source for r in stats.collect()]
    return telemetry.contract_violations(stats, docs, [*names, "src99"])


# ---- labels: documents with labels as records, sources as employers
def _facts(spark, d):
    x = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    o = F.element_at(F.array(*[F.lit(v) for v in evaluate.OUTCOMES]), (c("doc_id") % 4 + 1).cast("int"))
    return x.select(
        c("doc_id").cast("string").alias("record_id"),
        F.lit("quality").alias("parser"),
        c("lang").alias("component"),
        o.alias("outcome"),
        c("quality").cast("string").alias("expected_value"),
        F.lit("inferred").alias("expected_provenance"),
        F.when(c("n_chars") > 1000, "1").when(c("n_chars") > 200, "0").alias("value"),
        F.when(c("toxic") == 1, "inferred").otherwise("derived").alias("provenance"),
        c("source").alias("employer"),
        F.when(c("source") == "src9", "holdout").otherwise("dev").alias("split"),
    )


_FACTS = "SELECT doc_id, doc_id % 4 AS o, lang AS component, quality::VARCHAR AS e, CASE WHEN n_chars > 1000 THEN '1' WHEN n_chars > 200 THEN '0' END AS v, toxic, source FROM labels JOIN documents USING (doc_id)"


#: Counters as conditions of hits and totals over the facts.
_COUNTED = {
    "correct": ("o = 0 AND v = e", "o = 0"),
    "abstained": ("o = 0 AND v IS NULL", "o = 0"),
    "wrong": ("o = 0 AND v <> e", "o = 0"),
    "provenance": ("o = 0 AND v = e AND toxic = 1", "o = 0 AND v = e"),
    "absent_false_positive": ("o = 1 AND v IS NOT NULL", "o = 1"),
    "unsupported_abstained": ("o = 2 AND v IS NULL", "o = 2"),
    "unsupported_false_positive": ("o = 2 AND v IS NOT NULL", "o = 2"),
    "ambiguous_false_positive": ("o = 3 AND v IS NOT NULL", "o = 3"),
    "ambiguous_abstained": ("o = 3 AND v IS NULL", "o = 3"),
}
_CELLS = ", ".join(f"count(*) FILTER ({h}) AS {n}_hits, count(*) FILTER ({t}) AS {n}_total" for n, (h, t) in _COUNTED.items())


@query(f"SELECT component, slice, {_CELLS} FROM (SELECT *, unnest(['combined', CASE WHEN source = 'src9' THEN 'holdout' ELSE 'dev' END, 'employer:' || source]) AS slice FROM ({_FACTS})) GROUP BY 1, 2")
def eval_metrics(spark, d):
    return evaluate.score(_facts(spark, d)).drop("parser")


@query(f"SELECT slice || ' quality.' || component || ' ' || concat_ws(' ', {', '.join(f"'{n}=' || CASE WHEN {n}_total = 0 THEN 'N/A' ELSE {n}_hits || '/' || {n}_total END" for n in _COUNTED)}) AS line FROM (SELECT component, slice, {_CELLS} FROM (SELECT *, unnest(['combined', CASE WHEN source = 'src9' THEN 'holdout' ELSE 'dev' END, 'employer:' || source]) AS slice FROM ({_FACTS})) GROUP BY 1, 2)")
def eval_report(spark, d):
    return evaluate.report_lines(evaluate.score(_facts(spark, d)))


@query(f"SELECT component, count(*) FILTER (o = 0) AS present_supported, count(*) FILTER (o = 1) AS absent, count(*) FILTER (o = 2) AS present_unsupported_form, count(*) FILTER (o = 3) AS ambiguous FROM ({_FACTS}) GROUP BY 1")
def opportunity_matrix(spark, d):
    return evaluate.opportunity_matrix(_facts(spark, d)).drop("parser")


@query(f"SELECT doc_id::VARCHAR AS record_id, component, e AS expected_value, v AS value FROM ({_FACTS}) WHERE o = 0 AND v IS DISTINCT FROM e")
def eval_mismatches(spark, d):
    return evaluate.mismatches(_facts(spark, d)).drop("parser")


@query("SELECT l, o, source AS employer, r AS record_id FROM (SELECT lang AS l, doc_id % 4 AS o, source, min(doc_id::VARCHAR) AS r FROM documents GROUP BY 1, 2, 3 UNION SELECT lang, doc_id % 4, source, doc_id::VARCHAR FROM documents WHERE doc_id % 4 = 0)")
def stratified_audit(spark, d):
    rows = load(spark, d, "documents").select(c("lang").alias("label_path"), F.element_at(F.array(*[F.lit(v) for v in evaluate.OUTCOMES]), (c("doc_id") % 4 + 1).cast("int")).alias("outcome"), c("source").alias("employer"), c("doc_id").cast("string").alias("record_id"))
    number = F.array_position(F.array(*[F.lit(v) for v in evaluate.OUTCOMES]), c("outcome")) - 1
    return evaluate.audit_sample(rows).select(c("label_path").alias("l"), number.alias("o"), "employer", "record_id")


@query("SELECT doc_id, CASE WHEN source = (SELECT max(source) FROM documents) THEN 'holdout' ELSE 'dev' END AS split FROM documents")
def holdout_split(spark, d):
    return evaluate.holdout(load(spark, d, "documents"), "source").select("doc_id", "split")


@query("SELECT lang AS source FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT lang FROM documents WHERE doc_id % 2 = 1")
def split_overlap(spark, d):
    docs = load(spark, d, "documents").select("doc_id", c("lang").alias("source"))
    return evaluate.split_overlap(docs.withColumn("split", F.when(c("doc_id") % 2 == 0, "dev").otherwise("holdout")), "source")


@query("SELECT doc_id::VARCHAR AS record_id, (quality = toxic) AS agreed FROM labels")
def annotation_agreement(spark, d):
    x = load(spark, d, "labels").select(c("doc_id").cast("string").alias("record_id"), F.lit("q").alias("label_path"), "quality", "toxic")
    return evaluate.agreement(x.withColumnRenamed("quality", "value"), x.withColumnRenamed("toxic", "value")).select("record_id", "agreed")


@query("SELECT lang, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 = 0) AS hits, count(*) FILTER (doc_id % 2 = 0) AS labelled, count(*) FILTER (doc_id % 3 = 0) AS returned FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 GROUP BY 1")
def skill_precision_recall(spark, d):
    x = load(spark, d, "documents").select(c("doc_id").alias("record_id"), c("source").alias("skill"), "lang")
    return evaluate.skill_scores(x.filter("record_id % 2 = 0"), x.filter("record_id % 3 = 0"), "lang")


# ---- integrity, planning, ordering
@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_custkey % 3 = 0 THEN 'balance,segment' WHEN c_acctbal < 0 THEN 'balance' ELSE 'segment' END AS broken FROM customer WHERE c_acctbal < 0 OR c_custkey % 3 = 0")
def constraint_rejects(spark, d):
    checks = {"balance": c("c_acctbal") >= 0, "segment": integrity.trimmed_or_null(F.when(c("c_custkey") % 3 == 0, F.concat(F.lit(" "), c("c_mktsegment"))).otherwise(c("c_mktsegment")))}
    return integrity.rejects(load(spark, d, "customer"), checks).select("c_custkey", F.array_join("broken", ",").alias("broken"))


@query("SELECT o_custkey AS key0, count(*) AS count FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 1")
def unique_violations(spark, d):
    return integrity.duplicates(load(spark, d, "orders"), [c("o_custkey")], c("o_orderstatus") == "F")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)")
def foreign_key_maintenance(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    gone = load(spark, d, "customer").filter("c_custkey % 10 = 0").select(c("c_custkey").alias("o_custkey"))
    lines = load(spark, d, "lineitem").filter("l_linenumber = 7").select(c("l_orderkey").alias("o_orderkey"))
    return integrity.set_null(integrity.cascade(orders, lines, "o_orderkey"), gone, "o_custkey")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) = 5 AS all_priorities, count(DISTINCT o_orderpriority) < count(*) AS repeats, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) = 0 AS only_f_o FROM orders GROUP BY 1")
def set_relations(spark, d):
    g = load(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("p"), F.collect_set("o_orderstatus").alias("s"))
    five = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    return g.select("o_custkey", integrity.same_set(c("p"), five).alias("all_priorities"), integrity.has_duplicates(c("p")).alias("repeats"), integrity.subset(c("s"), F.array(F.lit("F"), F.lit("O"))).alias("only_f_o"))


@query("SELECT search_id, source, string_agg(field, ',' ORDER BY field) FILTER (supported) AS pushed, string_agg(field, ',' ORDER BY field) FILTER (NOT supported) AS residual FROM (SELECT n_nationkey AS search_id, unnest(['salary_floor', 'seniority', 'titles']) AS field FROM nation) CROSS JOIN (SELECT * FROM (VALUES ('a', 'titles', true), ('a', 'seniority', false), ('a', 'salary_floor', true), ('b', 'titles', false), ('b', 'seniority', false), ('b', 'salary_floor', false)) t(source, f, supported)) c WHERE c.f = field GROUP BY 1, 2")
def pushdown_residual(spark, d):
    caps = planner.Capabilities("p", (planner.Source("a", frozenset({"supports_salary_filter"}), frozenset({"titles"})), planner.Source("b")))
    searches = load(spark, d, "nation").select(c("n_nationkey").alias("search_id"), F.explode(F.array(*[F.lit(x) for x in ("salary_floor", "seniority", "titles")])).alias("field"))
    r = planner.pushdown(searches, planner.capability_rows(spark, [caps]))
    join = lambda x: F.nullif(F.array_join(x, ","), F.lit(""))
    return r.select("search_id", "source", join("pushed").alias("pushed"), join("residual").alias("residual"))


@query("SELECT user_id AS key, arg_max(s, event_id) AS status, min(event_id) FILTER (event_id > coalesce(reset, -1)) AS applied_at, max(event_id) FILTER (s IS DISTINCT FROM before) AS status_changed_at FROM (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS before, max(CASE WHEN s IN ('interested', 'not_interested') THEN event_id END) OVER (PARTITION BY user_id) AS reset FROM (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'interested' WHEN 1 THEN 'applied' WHEN 2 THEN 'screening' ELSE 'offer' END AS s FROM events)) GROUP BY 1")
def status_machine(spark, d):
    e = load(spark, d, "events").select(c("user_id").alias("key"), c("event_id").alias("at"), c("event_id").alias("idx"), _pick(c("event_id"), ["interested", "applied", "screening", "offer"]).alias("status"))
    return ingest.statuses(e)


@query("SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id::VARCHAR) AS rank FROM events) WHERE rank <= 10")
def topk_per_key(spark, d):
    """The first ten ids of each type, ids compared as text."""
    return ranking.top_k(load(spark, d, "events").select("event_type", "event_id"), "event_type", [c("event_id").cast("string")], 10).withColumn("rank", c("rank").cast("long"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_per_key(spark, d):
    return ranking.latest_per(load(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS children FROM orders GROUP BY 1")
def children_in_order(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", c("o_orderkey").cast("string").alias("v"))
    return ranking.children_in_order(o, "o_custkey", "o_orderdate", "o_orderkey", "v").select("o_custkey", F.array_join("children", ",").alias("children"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer ORDER BY c_custkey::VARCHAR LIMIT 1")
def representative_row(spark, d):
    return ranking.representative(load(spark, d, "customer").select(c("c_custkey").cast("string").alias("c_custkey"), "c_name"), "c_custkey")


@query("SELECT doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) <= 20000 AS within FROM documents")
def byte_budget(spark, d):
    return ranking.within_budget(load(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", 20000).select("doc_id", "used", "within")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    return ingest.windowed_counts(load(spark, d, "events")).select("start", "event_type", "n")


QUERIES |= catalog_more.QUERIES
SQL |= catalog_more.SQL
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
