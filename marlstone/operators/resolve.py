"""Entity resolution of a batch of postings against stored occurrences, as joins and aggregations.

Postings are taken as if one after another, in order of ``seq``; evidence columns never change once an occurrence exists, which gives a
closed form for every tier:

1. *Natural key.*  A key that is stored, or was met before in the batch, is a re-observation: QUARANTINED if both canonical URLs are
   known and differ, else UPDATED.
2. *Canonical URL* (if the posting has a usable one).  No job with it: the first posting is INSERTED, later ones ATTACHED to it.  One
   job: all ATTACHED.  Several: all AMBIGUOUS, each a new job that is a candidate for those after it.
3. *Tenant and requisition* (only without a usable URL).  Jobs join the candidates as occurrences appear, those of tier 2 among them;
   none: INSERTED, one: ATTACHED, more: AMBIGUOUS.
4. Everything else is INSERTED.

A key, URL or requisition may hold a large part of all rows: tiers are decided by aggregates (first and second least) joined back, never by a
window over a whole group.  Only ambiguous groups, whose rows list all earlier candidates by definition, use one.

Every row is shuffled once, for its key; keys go as bytes, and ids that follow from a ``seq`` are worked out where they are needed, not carried.
Postings of keys whose first one is of tier 4 are settled by that alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import derived_id, key_bytes, natural_key
from ..functions.primitives import identifier, nullable_text
from ..functions.urls import normalize_url
from ..staging import cut

OUTCOMES = ("INSERTED", "UPDATED", "ATTACHED", "QUARANTINED", "AMBIGUOUS")
MADE = ("INSERTED", "ATTACHED", "AMBIGUOUS")  # outcomes of postings that make an occurrence
OCCURRENCE = "key_id string, occurrence_id string, job_id string, canonical_url string, provider string, source string, tenant_id string, requisition_id string, first_seen_at timestamp, last_seen_at timestamp, is_active boolean"


def keyed(postings: DataFrame) -> DataFrame:
    """Postings with key, key_id, canonical url, tenant and requisition; key is null where nothing identifies them (parse errors)."""
    c = F.col
    return postings.select(
        "seq",
        "observed_at",
        natural_key(c("provider"), c("source"), c("source_tenant_id"), c("source_job_id"), normalize_url(c("source_url"))).alias("key"),
        normalize_url(c("canonical_url")).alias("url"),
        identifier(c("provider")).alias("provider"),
        identifier(c("source")).alias("source"),
        nullable_text(c("source_tenant_id")).alias("tenant"),
        nullable_text(c("requisition_id")).alias("requisition"),
    ).withColumn("key_id", F.sha2(key_bytes(c("key")), 256))


def new_id(run_id: str, seq: Column, of: str) -> Column:
    """The id of the job or occurrence that a posting makes."""
    return derived_id(F.lit(run_id), seq, F.lit(of))


def resolve(postings: DataFrame, occurrences: DataFrame, run_id: str, provider: str | None = None) -> DataFrame:
    """seq, outcome, job_id, occurrence_id, key_id, candidates (of AMBIGUOUS: sorted job ids), conflicting_url (of QUARANTINED: the stored
    one), and the evidence columns.  Outcome is PARSE_ERROR for postings without a key.

    postings: seq (unique), provider, source, source_tenant_id, source_job_id, requisition_id, source_url, canonical_url, observed_at.
    provider: the canonical name of the one that all postings are of, if they are: keys hold it, so no other's stored keys are looked at.
    """
    c = F.col
    rows = cut(keyed(postings).withColumn("key_id", F.unhex("key_id")))
    new_job, none = new_id(run_id, c("seq"), "job"), F.array().cast("array<string>")
    has_req = c("tenant").isNotNull() & c("requisition").isNotNull()
    good = rows.filter("key_id is not null")
    first = good.groupBy("key_id").agg(F.min("seq").alias("first_seq"), F.min(F.when(c("url").isNotNull() | has_req, c("seq"))).alias("first_linked"))
    first = first.select("key_id", "first_seq", (c("first_linked").isNull() | (c("first_linked") > c("first_seq"))).alias("alone"))  # the first is of tier 4
    stored = occurrences if provider is None else occurrences.filter(c("provider") == provider)
    stored = stored.select(F.unhex("key_id").alias("key_id"), c("occurrence_id").alias("stored_occurrence"), c("job_id").alias("stored_job"), c("canonical_url").alias("stored_url"))
    told = cut(good.join(first, "key_id").join(stored, "key_id", "left"))
    seen = told.filter((c("stored_job").isNotNull()) | (c("seq") > c("first_seq")))
    fresh = told.filter(c("stored_job").isNull() & (c("seq") == c("first_seq"))).drop("stored_occurrence", "stored_job", "stored_url", "first_seq", "alone")

    # tier 2
    with_url = fresh.filter("url is not null")
    by_url = occurrences.filter("canonical_url is not null").groupBy(c("canonical_url").alias("url")).agg(F.array_sort(F.collect_set("job_id")).alias("jobs"))
    lead = with_url.groupBy("url").agg(F.min("seq").alias("lead"))
    two = with_url.join(lead, "url").join(by_url, "url", "left").withColumn("n", F.coalesce(F.size("jobs"), F.lit(0)))
    leader = new_id(run_id, c("lead"), "job")
    plain2 = two.filter("n < 2").select(*fresh.columns, F.when((c("n") == 0) & (c("seq") == c("lead")), "INSERTED").otherwise("ATTACHED").alias("outcome"), F.when(c("n") == 1, F.get("jobs", F.lit(0))).otherwise(leader).alias("job_id"), none.alias("candidates"))
    earlier = F.collect_list(new_job).over(Window.partitionBy("url").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    doubt2 = two.filter("n >= 2").select(*fresh.columns, F.lit("AMBIGUOUS").alias("outcome"), new_job.alias("job_id"), F.array_sort(F.concat("jobs", earlier)).alias("candidates"))
    tier2 = cut(plain2.unionByName(doubt2))

    # tier 3: what appears first and second among the jobs of a requisition, stored ones before all others
    req = ["provider", "source", "tenant", "requisition"]
    three = fresh.filter(c("url").isNull() & has_req)
    known = occurrences.filter("tenant_id is not null and requisition_id is not null").select("provider", "source", c("tenant_id").alias("tenant"), c("requisition_id").alias("requisition"), "job_id", F.lit(-1).cast("long").alias("at"))
    made = tier2.filter(has_req).select(*req, "job_id", c("seq").cast("long").alias("at"))
    appear = known.union(made).join(three.select(*req).distinct(), req, "left_semi").groupBy(*req, "job_id").agg(F.min("at").alias("at"))
    one = appear.groupBy(*req).agg(F.min(F.struct("at", "job_id")).alias("a"))
    next_one = appear.join(one, req).filter(F.struct("at", "job_id") > c("a")).groupBy(*req).agg(F.min("at").alias("second"))
    opener = three.groupBy(*req).agg(F.min("seq").alias("opener"))
    three = three.join(opener, req).join(one, req, "left").join(next_one, req, "left")
    opens = c("a").isNull() | (c("opener") < c("a.at"))  # nothing is known when the first posting comes: it is inserted
    second = F.when(opens, c("a.at")).otherwise(c("second"))
    three = three.withColumn("opens", opens).withColumn("doubt", F.coalesce(c("seq") > second, F.lit(False)))
    three = cut(three)
    base = new_id(run_id, c("opener"), "job")
    plain3 = three.filter("not doubt").select(*fresh.columns, F.when(c("opens") & (c("seq") == c("opener")), "INSERTED").otherwise("ATTACHED").alias("outcome"), F.when(c("opens"), base).otherwise(c("a.job_id")).alias("job_id"), none.alias("candidates"))
    doubtful = three.filter("doubt").select(*fresh.columns, new_job.alias("job_id"))
    groups = doubtful.select(*req).distinct()
    events = appear.join(groups, req, "left_semi").select(*req, c("at").cast("long").alias("at"), "job_id", F.lit(False).alias("asks"))
    events = events.unionByName(three.filter("opens").select(*req, c("opener").cast("long").alias("at"), base.alias("job_id")).distinct().join(groups, req, "left_semi").withColumn("asks", F.lit(False)))
    events = events.unionByName(doubtful.select(*req, c("seq").cast("long").alias("at"), "job_id", F.lit(True).alias("asks")))
    before = F.collect_list("job_id").over(Window.partitionBy(*req).orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    lists = events.withColumn("candidates", F.array_sort(F.array_distinct(before))).filter("asks").select(c("at").alias("seq"), "candidates")
    doubt3 = cut(doubtful.withColumn("seq", c("seq").cast("long")).join(lists, "seq").select(*fresh.columns, F.lit("AMBIGUOUS").alias("outcome"), "job_id", "candidates"))
    rest = fresh.filter(c("url").isNull() & ~has_req).select(*fresh.columns, F.lit("INSERTED").alias("outcome"), new_job.alias("job_id"), none.alias("candidates"))

    null = F.lit(None).cast("string")
    linked = tier2.unionByName(plain3).unionByName(doubt3)
    created = linked.unionByName(rest).withColumns({"occurrence_id": new_id(run_id, c("seq"), "occurrence"), "conflicting_url": null})
    # re-observations take the job and occurrence that are stored, or those of the key's first posting in this batch
    held, made = c("stored_job").isNotNull(), new_id(run_id, c("first_seq"), "occurrence")
    known = seen.filter(held | c("alone")).withColumns({"job_id": F.when(held, c("stored_job")).otherwise(new_id(run_id, c("first_seq"), "job")), "occurrence_id": F.when(held, c("stored_occurrence")).otherwise(made), "against": F.when(held, c("stored_url"))})
    origin = linked.select(c("seq").alias("first_seq"), "job_id", c("url").alias("against"))
    known = known.select(*fresh.columns, "job_id", "occurrence_id", "against")
    other = seen.filter(~held & ~c("alone")).join(origin, "first_seq", "left").select(*fresh.columns, "job_id", made.alias("occurrence_id"), "against")
    clash = F.coalesce(c("url") != c("against"), F.lit(False))
    again = known.unionByName(other).select(*fresh.columns, F.when(clash, "QUARANTINED").otherwise("UPDATED").alias("outcome"), "job_id", none.alias("candidates"), "occurrence_id", F.when(clash, c("against")).alias("conflicting_url"))
    errors = rows.filter("key_id is null").select(*fresh.columns, F.lit("PARSE_ERROR").alias("outcome"), null.alias("job_id"), none.alias("candidates"), null.alias("occurrence_id"), null.alias("conflicting_url"))
    return created.unionByName(again).unionByName(errors).withColumn("key_id", F.lower(F.hex("key_id")))


def next_occurrences(resolved: DataFrame, occurrences: DataFrame, provider: str | None = None, at_once: bool = False) -> DataFrame:
    """The occurrence table after a batch: evidence and first_seen stay, last_seen only grows, what was seen is active.

    provider: see resolve(); occurrences of others stay as they are.  at_once: all postings have the same observed_at, so that nothing is
    newer than what made an occurrence.
    """
    c = F.col
    seen = resolved.filter(~c("outcome").isin(*MADE) & c("occurrence_id").isNotNull()).groupBy("occurrence_id").agg(F.max("observed_at").alias("latest"))
    own = F.lit(True) if provider is None else c("provider").eqNullSafe(F.lit(provider))
    kept, others = occurrences.filter(own), occurrences.filter(~own)
    if not kept.isEmpty():
        kept = kept.join(seen, "occurrence_id", "left").withColumns({"last_seen_at": F.greatest("last_seen_at", "latest"), "is_active": c("latest").isNotNull() | c("is_active")}).drop("latest")
        others = others.unionByName(kept)
    made = resolved.filter(c("outcome").isin(*MADE))
    made = made.withColumn("latest", c("observed_at")) if at_once else made.join(seen, "occurrence_id", "left").withColumn("latest", F.greatest("observed_at", "latest"))
    new = made.select("key_id", "occurrence_id", "job_id", c("url").alias("canonical_url"), "provider", "source", c("tenant").alias("tenant_id"), c("requisition").alias("requisition_id"), c("observed_at").alias("first_seen_at"), c("latest").alias("last_seen_at"), F.lit(True).alias("is_active"))
    return others.select(*new.columns).unionByName(new)


def conflicts(resolved: DataFrame) -> DataFrame:
    """One row a conflict: evidence_mismatch with both URLs, ambiguous_match with all candidates."""
    c = F.col
    return resolved.filter(c("outcome").isin("QUARANTINED", "AMBIGUOUS")).select(
        "seq",
        F.when(c("outcome") == "QUARANTINED", "evidence_mismatch").otherwise("ambiguous_match").alias("conflict_type"),
        "occurrence_id",
        F.when(c("outcome") == "QUARANTINED", F.to_json(F.struct(c("conflicting_url").alias("stored"), c("url").alias("incoming")))).otherwise(F.to_json("candidates")).alias("evidence"),
    )


def raw_status(outcome) -> F.Column:
    return F.when(outcome == "PARSE_ERROR", "parse_error").when(outcome.isin("QUARANTINED", "AMBIGUOUS"), "identity_conflict").otherwise("normalized")


def invariants(resolved: DataFrame) -> DataFrame:
    """Rows that break what must hold: AMBIGUOUS if and only if there are two or more sorted, distinct candidates."""
    sound = (F.col("candidates") == F.array_sort(F.array_distinct("candidates"))) & (F.size("candidates") >= 2)
    return resolved.filter(F.when(F.col("outcome") == "AMBIGUOUS", ~sound).otherwise(F.size("candidates") > 0))
