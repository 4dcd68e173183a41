"""Capability-based planning: which fields of a saved search each source enforces, and which are left to filter locally."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrangements, salary

# The fields of a query, and those that a source declares by a switch of its own instead of by name.
FIELDS = ("titles", "excluded_titles", "locations", "remote_ok", "radius_miles", "salary_floor", "employment_types", "seniority", "posted_within_hours", "company_filter", "excluded_companies")
SWITCHES = {"salary_floor": "supports_salary_filter", "locations": "supports_location_filter", "radius_miles": "supports_location_filter", "remote_ok": "supports_remote_filter", "posted_within_hours": "supports_posted_within_filter"}


SLUG = re.compile(r"[a-z0-9][a-z0-9._-]*")


class PlanError(ValueError):
    """A search that cannot be planned."""


@dataclass(frozen=True)
class Source:
    name: str
    switches: frozenset[str] = frozenset()  # names of SWITCHES values that are on
    fields: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Capabilities:
    provider: str
    sources: tuple[Source, ...]

    def __post_init__(self):
        names = [s.name for s in self.sources]
        if len(set(names)) != len(names):
            raise PlanError(f"{self.provider}: a source is declared twice")


@dataclass
class Plan:
    provider: str
    sources: list[str]
    filters: dict[str, object]
    residual: dict[str, list[str]] = field(default_factory=dict)  # source -> sorted fields left to filter locally


def populated(value) -> bool:
    return value is not None and (not isinstance(value, (list, tuple, set)) or len(value) > 0)


def enforces(source: Source, name: str) -> bool:
    return SWITCHES[name] in source.switches if name in SWITCHES else name in source.fields


def plan(search: dict, capabilities: Capabilities, selected: list[str] | None = None) -> Plan | None:
    """The query for a provider; None if no source is selected.  selected: None for all sources, in order of name."""
    declared = {s.name: s for s in capabilities.sources}
    names = sorted(declared) if selected is None else list(selected)
    if not names:
        return None
    if len(set(names)) != len(names):
        raise PlanError("a source is selected twice")
    if unknown := sorted(set(names) - set(declared)):
        raise PlanError(f"{capabilities.provider} has no source {', '.join(unknown)}")
    filters = {k: v for k in FIELDS if populated(v := search.get(k))}
    for k, v in filters.items():
        if isinstance(v, float) and not math.isfinite(v):
            raise PlanError(f"{k} is not finite")
    residual = {n: sorted(k for k in filters if not enforces(declared[n], k)) for n in names}
    return Plan(capabilities.provider, names, filters, {n: r for n, r in residual.items() if r})


def enforcement_json(enforced: dict[str, dict[str, list[str]]]) -> str:
    """provider -> source -> sorted fields that are left to filter locally, always in the same order."""
    return json.dumps({p: {s: sorted(f) for s, f in sorted(sources.items())} for p, sources in sorted(enforced.items())}, separators=(",", ":"))


def capability_rows(spark: SparkSession, capabilities: list[Capabilities]) -> DataFrame:
    """(provider, source, field, supported): a few rows, sorted."""
    rows = [(c.provider, s.name, k, enforces(s, k)) for c in sorted(capabilities, key=lambda c: c.provider) for s in sorted(c.sources, key=lambda s: s.name) for k in FIELDS]
    return spark.createDataFrame(rows, "provider string, source string, field string, supported boolean")


def pushdown(search_fields: DataFrame, capability: DataFrame) -> DataFrame:
    """(search_id, provider, source, pushed, residual) from (search_id, field) rows and capability rows: the planner as a join."""
    hit = search_fields.join(capability, "field")
    pick = lambda flag: F.array_sort(F.collect_list(F.when(F.col("supported") == flag, F.col("field"))))
    return hit.groupBy("search_id", "provider", "source").agg(pick(True).alias("pushed"), pick(False).alias("residual"))


def _kind(classify):
    return lambda v: classify(F.col("title"), F.col("description"))["value"].isin(list(v))


#: How each field filters postings that a source did not filter, as a condition over (posting columns, value).
RESIDUAL = {
    "titles": lambda v: F.exists(F.lit([x.lower() for x in v]), lambda t: F.contains(F.lower("title"), t)),
    "excluded_titles": lambda v: ~F.exists(F.lit([x.lower() for x in v]), lambda t: F.contains(F.lower("title"), t)),
    "locations": lambda v: F.lower("location").isin([x.lower() for x in v]),
    "remote_ok": lambda v: F.lit(True) if v else ~arrangements.classify_remote_type(F.col("title"), F.col("description"))["value"].eqNullSafe(F.lit("remote")),
    "salary_floor": lambda v: F.greatest(*(salary.classify_salary(F.col("compensation_text"))[b]["value"] for b in ("minimum", "maximum"))) >= v,
    "employment_types": _kind(arrangements.classify_employment_type),
    "seniority": _kind(arrangements.classify_seniority),
    "posted_within_hours": lambda v: F.to_timestamp("posted_at") >= F.to_timestamp("discovered_at") - F.make_dt_interval(F.lit(0), F.lit(v)),
    "company_filter": lambda v: F.lower("company").isin([x.lower() for x in v]),
    "excluded_companies": lambda v: ~F.lower("company").isin([x.lower() for x in v]),
}


def apply_residual(postings: DataFrame, p: Plan) -> DataFrame:
    """Postings of each source under the filters that it did not enforce; a posting of which a filter knows nothing goes.

    A field that no local rule can filter by (a radius in miles: postings have no coordinates) is an error, never passed over.
    """
    if odd := sorted({k for fields in p.residual.values() for k in fields} - set(RESIDUAL)):
        raise PlanError(f"no local filter for {', '.join(odd)}")
    keep = F.lit(False)
    for name in p.sources:
        cond = F.col("source") == name
        for k in p.residual.get(name, []):
            cond = cond & F.coalesce(RESIDUAL[k](p.filters[k]), F.lit(False))
        keep = keep | cond
    return postings.filter(keep)
