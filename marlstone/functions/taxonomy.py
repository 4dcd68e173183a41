"""Skill taxonomies: validation, lookup, and the built-in one."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .primitives import COVERED, lookup_key, lookup_key_of

# Canonical id, display name, aliases.
SKILLS = [
    ("python", "Python", []),
    ("javascript", "JavaScript", ["js"]),
    ("typescript", "TypeScript", ["ts"]),
    ("java", "Java", []),
    ("cpp", "C++", ["c++", "cplusplus"]),
    ("csharp", "C#", ["c#", "c-sharp"]),
    ("c", "C", []),
    ("golang", "Go", ["go"]),
    ("rlang", "R", ["r"]),
    ("postgresql", "PostgreSQL", ["postgres"]),
    ("mysql", "MySQL", []),
    ("mongodb", "MongoDB", ["mongo"]),
    ("kubernetes", "Kubernetes", ["k8s"]),
    ("docker", "Docker", []),
    ("node.js", "Node.js", ["node", "nodejs"]),
]
_SLUG = re.compile(r"[a-z0-9][a-z0-9._-]*")


class TaxonomyError(ValueError):
    """A taxonomy breaks one of its rules."""


def index(entries: list[tuple[str, str, list[str]]]) -> dict[str, tuple[str, str]]:
    """Lookup key to (canonical id, display name).  Ids are slugs and unique, aliases belong to one entry and do not repeat, display
    names can be looked up."""
    ids = [e[0] for e in entries]
    if len(set(ids)) != len(ids):
        raise TaxonomyError("an id is given twice")
    out: dict[str, tuple[str, str]] = {}
    for canonical, display, aliases in entries:
        if not isinstance(canonical, str) or not _SLUG.fullmatch(canonical):
            raise TaxonomyError(f"not a slug: {canonical!r}")
        if not isinstance(display, str) or not display.strip(COVERED):
            raise TaxonomyError(f"no display name: {canonical}")
        own = [lookup_key_of(canonical), *map(lookup_key_of, aliases)]
        if len(set(own)) != len(own) or "" in own:
            raise TaxonomyError(f"an alias repeats: {canonical}")
        for key in own:
            if key in out:
                raise TaxonomyError(f"an alias of two entries: {key}")
            out[key] = (canonical, display)
    for canonical, display, _ in entries:
        if out.get(lookup_key_of(display), ("",))[0] != canonical:
            raise TaxonomyError(f"a display name that leads elsewhere: {display}")
    return out


def load(path: str) -> list[tuple[str, str, list[str]]]:
    """Entries of a YAML or JSON file of schema version 1: closed fields, no key twice."""
    with open(path, encoding="utf-8") as f:
        text = f.read()

    def unique(pairs):
        keys = [k for k, _ in pairs]
        if len(set(keys)) != len(keys):
            raise TaxonomyError("a key is given twice")
        return dict(pairs)

    if path.endswith(".json"):
        data = json.loads(text, object_pairs_hook=unique)
    else:
        try:
            import yaml
        except ImportError as e:
            raise TaxonomyError("YAML files need PyYAML") from e

        class Strict(yaml.SafeLoader):
            pass

        def mapping(loader, node):
            if any(not isinstance(k, yaml.ScalarNode) for k, _ in node.value):
                raise TaxonomyError("a key that is no scalar")
            return unique([(loader.construct_object(k), loader.construct_object(v, deep=True)) for k, v in node.value])

        Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
        data = yaml.load(text, Strict)  # noqa: S506  a SafeLoader
    if not isinstance(data, dict) or set(data) != {"schema_version", "entries"}:
        raise TaxonomyError("fields must be schema_version and entries")
    if type(data["schema_version"]) is not int or data["schema_version"] != 1 or not isinstance(data["entries"], list) or not data["entries"]:
        raise TaxonomyError("not of schema version 1, or without entries")
    for e in data["entries"]:
        if not isinstance(e, dict) or set(e) != {"canonical_id", "display_name", "aliases"} or not isinstance(e["aliases"], list) or not all(isinstance(a, str) for a in e["aliases"]):
            raise TaxonomyError("fields of an entry must be canonical_id, display_name and aliases")
    entries = [(e["canonical_id"], e["display_name"], e["aliases"]) for e in data["entries"]]
    index(entries)
    return entries


def frame(spark: SparkSession, entries=None) -> DataFrame:
    """(key, canonical_id, display_name): a few rows."""
    rows = [(k, *v) for k, v in sorted(index(SKILLS if entries is None else entries).items())]
    return spark.createDataFrame(rows, "key string, canonical_id string, display_name string")


def look_up(df: DataFrame, token: Column, entries=None) -> DataFrame:
    """df with canonical_id and display_name of a token column; null where the taxonomy has none.  The table is a literal map in the plan."""
    rows = sorted(index(SKILLS if entries is None else entries).items())
    table = F.create_map(*[x for k, (c, d) in rows for x in (F.lit(k), F.struct(F.lit(c).alias("c"), F.lit(d).alias("d")))])
    hit = F.try_element_at(table, lookup_key(token))
    return df.withColumns({"canonical_id": hit["c"], "display_name": hit["d"]})
