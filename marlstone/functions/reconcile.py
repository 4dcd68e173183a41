"""The rules by which several readings become one answer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .primitives import found, row_type

CONFLICT = "conflict"


def one_or_conflict(values: Column) -> Column:
    """An array to struct(value, conflict): null if empty, the value if there is one, a conflict if there are more."""
    d = F.array_distinct(F.filter(values, lambda v: v.isNotNull()))
    return F.struct(F.when(F.size(d) == 1, F.get(d, F.lit(0))).alias("value"), (F.size(d) > 1).alias("conflict"))


def reconcile(title: Column, description: Column, title_conflict: Column | None = None, description_conflict: Column | None = None) -> Column:
    """struct(value, provenance) of two readings: a conflict in either, or a disagreement, makes the answer unavailable; a title alone is
    inferred, a description (alone or in agreement) is parsed."""
    no = F.lit(False)
    clash = F.coalesce(title_conflict if title_conflict is not None else title == CONFLICT, no) | F.coalesce(description_conflict if description_conflict is not None else description == CONFLICT, no)
    value = F.when(~clash & (title.isNull() | description.isNull() | (title == description)), F.coalesce(description, title))
    return found(value, F.when(description.isNull(), "inferred").otherwise("parsed_description"))


def settle(found_values) -> object:
    """The Python form of one_or_conflict: None, the value, or CONFLICT."""
    values = set(found_values)
    return None if not values else values.pop() if len(values) == 1 else CONFLICT


def agree(title, description) -> tuple:
    """The Python form of reconcile: (value, provenance)."""
    if CONFLICT in (title, description) or (title is not None and description is not None and title != description) or (title is None and description is None):
        return None, "unavailable"
    return (title, "inferred") if description is None else (description, "parsed_description")


def classifier(fn, kind: str):
    """A Column function of (title, description) from a Python one; equal inputs are worked out once a batch."""

    @F.pandas_udf(row_type(kind))
    def run(title: pd.Series, description: pd.Series) -> pd.DataFrame:
        seen: dict[tuple, tuple] = {}
        out = []
        for pair in zip(title.where(title.notna(), None), description.where(description.notna(), None), strict=True):
            if pair not in seen:
                seen[pair] = fn(*pair)
            out.append(seen[pair])
        names = [c.split()[0] for c in kind.split(", ")]
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({n: "Int32" for n, c in zip(names, kind.split(", "), strict=True) if c.endswith(" int")})

    return run
