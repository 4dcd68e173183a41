"""The row constraints of the stored tables, as a dictionary that `integrity.rejects` and `integrity.accept` read.

A table is described by its kinds of columns; `checks` makes one named condition of each rule.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import integrity

COVERED = " \t\n\r"
SLUG = r"\A[a-z0-9][a-z0-9._-]*\z"


@dataclass(frozen=True)
class Rules:
    text: list[str] = field(default_factory=list)  # trimmed and not empty, where not null
    lower: list[str] = field(default_factory=list)  # in lower case besides
    slugs: list[str] = field(default_factory=list)  # slugs besides
    counts: list[str] = field(default_factory=list)  # not negative
    ordered: list[tuple[str, str]] = field(default_factory=list)  # the first not above the second
    domains: dict[str, list[str]] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    together: list[tuple[str, str]] = field(default_factory=list)  # both null or neither
    objects: list[str] = field(default_factory=list)  # JSON objects, as text
    arrays: list[str] = field(default_factory=list)
    #: column: (statuses that need a null, statuses that need a value), by the column ``status``
    by_status: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)
    #: column: (column that decides, its values with the JSON shape that goes with them)
    shapes: dict[str, tuple[str, dict[str, str]]] = field(default_factory=dict)
    #: name: (columns, condition in SQL)
    others: dict[str, tuple[list[str], str]] = field(default_factory=dict)


# Columns of the stored tables and their domains.
RUN_DONE = ["completed", "completed_with_errors", "failed"]
ATTEMPT_DONE = ["completed", "partial", "failed"]
PLACE = {"latitude": (-90, 90), "longitude": (-180, 180)}
BEFORE_APPLYING = ["interested", "not_interested"]
AFTER_APPLYING = ["applied", "recruiter_contacted", "screening", "interviewing", "offer", "rejected_by_employer", "withdrawn_by_user"]
TABLES = {
    "user": Rules(text=["email"], lower=["email"]),
    "company": Rules(text=["name", "homepage_url", "career_page_url", "industry"], others={"no_duplicate_of_itself": (["id", "duplicate_of_company_id"], "duplicate_of_company_id is null or duplicate_of_company_id <> id")}),
    "candidate_profile": Rules(
        counts=["years_experience", "salary_expectation_min", "salary_expectation_max"],
        ordered=[("salary_expectation_min", "salary_expectation_max")],
        domains={"remote_preference": ["remote", "hybrid", "onsite", "no_preference"]},
    ),
    "candidate_skill": Rules(text=["skill"], domains={"priority": ["must_have", "preferred"]}),
    "saved_search": Rules(
        text=["name"],
        counts=["radius_miles", "salary_floor", "preferred_salary", "recency_limit_hours"],
        ordered=[("salary_floor", "preferred_salary")],
        domains={"remote_rules": ["remote_only", "hybrid_ok", "onsite_ok", "any"], "polling_schedule": ["manual", "hourly", "daily", "weekly"]},
        objects=["enabled_sources", "scoring_weights"],
    ),
    "saved_search_title": Rules(text=["title"]),
    "saved_search_location": Rules(text=["location_text"], counts=["radius_miles_override"], ranges=PLACE, together=[("latitude", "longitude")]),
    "job": Rules(
        text=["requisition_id", "canonical_url", "preferred_apply_url", "title", "normalized_title", "job_family", "department", "team", "description_raw", "description_clean", "location_raw", "city", "state", "country", "postal_code", "employment_type", "seniority", "contract_type", "shift", "salary_currency", "education_requirement", "clearance_requirement", "visa_sponsorship_status", "travel_requirement", "compensation_text"],
        counts=["salary_min", "salary_max", "annualized_salary_min", "annualized_salary_max", "years_experience_min", "years_experience_max"],
        ordered=[("salary_min", "salary_max"), ("annualized_salary_min", "annualized_salary_max"), ("years_experience_min", "years_experience_max"), ("first_seen_at", "last_seen_at")],
        domains={"remote_type": ["remote", "hybrid", "onsite"], "salary_period": ["hourly", "daily", "monthly", "annual"]},
        ranges=PLACE,
        together=[("latitude", "longitude")],
        objects=["field_provenance"],
    ),
    "job_occurrence": Rules(
        text=["provider", "source", "source_url", "source_tenant_id", "source_job_id", "requisition_id_raw", "source_url_normalized", "apply_url", "canonical_url", "canonical_url_normalized", "applicant_count_text"],
        lower=["provider", "source"],
        slugs=["provider", "source"],
        counts=["applicant_count"],
        ordered=[("first_seen_at", "last_seen_at")],
        others={"normalized_url_needs_url": (["canonical_url", "canonical_url_normalized"], "canonical_url is not null or canonical_url_normalized is null")},
    ),
    "raw_ingestion": Rules(
        text=["provider", "source", "raw_content_hash", "source_identifier", "parser_version", "error_message"],
        lower=["provider", "source"],
        slugs=["provider", "source"],
        domains={"processing_status": ["fetched", "parse_error", "normalized", "identity_conflict"]},
        objects=["raw_payload"],
        others={"unprocessed_has_no_occurrence": (["processing_status", "job_occurrence_id"], "processing_status not in ('fetched', 'parse_error') or job_occurrence_id is null")},
    ),
    "collection_run": Rules(
        counts=["jobs_discovered", "jobs_inserted", "jobs_updated", "duration_ms"],
        ordered=[("started_at", "completed_at")],
        domains={"status": ["running", *RUN_DONE]},
        objects=["providers_enforced_locally"],
        arrays=["failures"],
        by_status={"completed_at": (["running"], RUN_DONE)},
    ),
    "provider_attempt": Rules(
        text=["provider", "source", "error_message"],
        lower=["provider", "source"],
        slugs=["provider", "source"],
        counts=["jobs_discovered", "jobs_inserted", "jobs_updated", "retry_count"],
        ordered=[("started_at", "completed_at")],
        domains={"status": ["running", *ATTEMPT_DONE], "error_category": ["timeout", "rate_limited", "auth_error", "blocked", "parse_error", "not_found", "upstream_error", "unknown"]},
        by_status={"completed_at": (["running"], ATTEMPT_DONE)},
    ),
    "identity_conflict": Rules(
        ordered=[("created_at", "resolved_at")],
        domains={"conflict_type": ["evidence_mismatch", "ambiguous_match"], "status": ["open", "resolved", "ignored"]},
        by_status={"resolved_at": (["open"], ["resolved", "ignored"])},
        shapes={n: ("conflict_type", {"evidence_mismatch": "object", "ambiguous_match": "array"}) for n in ("existing_value", "incoming_value")},
        others={"ambiguous_has_no_occurrence": (["conflict_type", "existing_job_occurrence_id"], "conflict_type <> 'ambiguous_match' or existing_job_occurrence_id is null")},
    ),
    "user_job": Rules(domains={"status": [*BEFORE_APPLYING, *AFTER_APPLYING]}, by_status={"applied_at": (BEFORE_APPLYING, AFTER_APPLYING)}),
    "job_note": Rules(text=["body"]),
}


def rules(table: str) -> dict[str, tuple[set[str], Column]]:
    """Name: (columns that it reads, condition) of each constraint of a table."""
    r, c, out = TABLES[table], F.col, {}

    def add(name: str, condition: Column, *columns: str) -> None:
        out[name] = (set(columns), condition)

    for n in r.text:
        add(f"{n}_trimmed", c(n) == F.btrim(c(n), F.lit(COVERED)), n)
        add(f"{n}_not_empty", F.btrim(c(n), F.lit(COVERED)) != "", n)
    for n in r.lower:
        add(f"{n}_lower", c(n) == F.lower(c(n)), n)
    for n in r.slugs:
        add(f"{n}_slug", c(n).rlike(SLUG), n)
    for n in r.counts:
        add(f"{n}_not_negative", c(n) >= 0, n)
    for a, b in r.ordered:
        add(f"{a}_up_to_{b}", c(a) <= c(b), a, b)
    for n, values in r.domains.items():
        add(f"{n}_known", c(n).isin(*values), n)
    for n, ends in r.ranges.items():
        add(f"{n}_in_range", c(n).between(*ends), n)
    for a, b in r.together:
        add(f"{a}_with_{b}", integrity.both_or_neither(c(a), c(b)), a, b)
    for kind, names in (("object", r.objects), ("array", r.arrays)):
        for n in names:
            add(f"{n}_is_{kind}", integrity.json_shape(c(n), kind), n)
    for n, (without, needed) in r.by_status.items():
        add(f"{n}_fits_status", (c("status").isin(*without) & c(n).isNull()) | (c("status").isin(*needed) & c(n).isNotNull()), n, "status")
    for name, (columns, sql) in r.others.items():
        add(name, F.expr(sql), *columns)
    for n, (by, shapes) in r.shapes.items():
        kind = F.schema_of_variant(F.try_parse_json(c(n)))
        fits = F.lit(False)
        for value, shape in shapes.items():
            fits = fits | ((c(by) == value) & F.startswith(kind, F.lit(shape.upper())))
        add(f"{n}_fits_{by}", fits, n, by)
    return out


def checks(table: str) -> dict[str, Column]:
    """Named conditions of a table; null is unknown, and what is unknown holds."""
    return {name: condition for name, (_, condition) in rules(table).items()}


def rejects(rows: DataFrame, table: str) -> DataFrame:
    """Rows that break a constraint of their table, with the names of all that they break; constraints of columns that rows lack are left out."""
    have = {n.lower() for n in rows.columns}
    return integrity.rejects(rows, {name: condition for name, (columns, condition) in rules(table).items() if columns <= have})
