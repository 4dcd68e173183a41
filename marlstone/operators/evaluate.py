"""Label quality: agreement of annotation passes, and scores of classifiers by split and employer in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("present_supported", "absent", "present_unsupported_form", "ambiguous")


def ratio(hits: Column, total: Column) -> Column:
    """``hits/total``; N/A without any."""
    return F.when(total == 0, F.lit("N/A")).otherwise(F.concat_ws("/", hits.cast("string"), total.cast("string")))


def facts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row a label: expected (record_id, parser, component, outcome, expected_value, expected_provenance, employer, split) with the
    value and provenance that the classifier gave."""
    return expected.join(actual, ["record_id", "parser", "component"], "left")


#: Counters over facts, each (hits, total) as conditions.
def counters() -> dict[str, tuple[Column, Column]]:
    o, v, e = F.col("outcome"), F.col("value"), F.col("expected_value")
    supported, none = o == "present_supported", v.isNull()
    right = F.coalesce(v == e, F.lit(False))
    return {
        "correct": (supported & right, supported),
        "abstained": (supported & none, supported),
        "wrong": (supported & ~none & ~right, supported),
        "provenance": (supported & right & (F.col("provenance") == F.col("expected_provenance")), supported & right),
        "absent_false_positive": ((o == "absent") & ~none, o == "absent"),
        "unsupported_abstained": ((o == "present_unsupported_form") & none, o == "present_unsupported_form"),
        "unsupported_false_positive": ((o == "present_unsupported_form") & ~none, o == "present_unsupported_form"),
        "ambiguous_false_positive": ((o == "ambiguous") & ~none, o == "ambiguous"),
        "ambiguous_abstained": ((o == "ambiguous") & none, o == "ambiguous"),
    }


def score(rows: DataFrame) -> DataFrame:
    """parser, component, slice (combined, a split, or employer:name) and hits and total of each counter: labels are read once."""
    cells = []
    for name, (hit, total) in counters().items():
        cells += [F.count_if(hit).alias(f"{name}_hits"), F.count_if(total).alias(f"{name}_total")]
    slices = F.explode(F.array(F.lit("combined"), F.col("split"), F.concat(F.lit("employer:"), F.col("employer"))))
    return rows.withColumn("slice", slices).groupBy("parser", "component", "slice").agg(*cells)


def skill_scores(labels: DataFrame, returned: DataFrame, *by: str) -> DataFrame:
    """Recall over labelled skills, precision over returned ones: labels and returned are (record_id, skill, *by)."""
    both = labels.select("record_id", "skill", *by, F.lit(1).alias("l")).join(returned.select("record_id", "skill", *by, F.lit(1).alias("r")), ["record_id", "skill", *by], "full")
    hit = F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull())
    return both.groupBy(*by).agg(hit.alias("hits"), F.count("l").alias("labelled"), F.count("r").alias("returned"))


def opportunity_matrix(rows: DataFrame) -> DataFrame:
    """Labels by outcome, zero where there are none."""
    return rows.groupBy("parser", "component").pivot("outcome", list(OUTCOMES)).count().fillna(0, list(OUTCOMES))


def agreement(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """record_id, label_path, agreed of two passes; a label of one pass alone is not agreed on."""
    key = ["record_id", "label_path"]
    return a.select(*key, F.col(value).alias("a"), F.lit(True).alias("in_a")).join(b.select(*key, F.col(value).alias("b"), F.lit(True).alias("in_b")), key, "full").select(*key, "a", "b", (F.coalesce("in_a", F.lit(False)) & F.coalesce("in_b", F.lit(False)) & F.col("a").eqNullSafe(F.col("b"))).alias("agreed"))


def final_labels(agreed: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """The agreed value, else the adjudicated one."""
    return agreed.join(adjudicated.withColumnRenamed("value", "ruled"), ["record_id", "label_path"], "left").select("record_id", "label_path", F.when(F.col("agreed"), F.col("a")).otherwise(F.col("ruled")).alias("value"), (~F.col("agreed") & F.col("ruled").isNull()).alias("missing"))


def packet_hash(rows: DataFrame, *columns: str) -> str:
    """SHA-256 over the rows of a label packet, in order: what its annotation passes are bound to."""
    line = F.to_json(F.struct(*columns))
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256)).first()[0]  # a packet is a few records


def label_checks() -> dict[str, Column]:
    """What holds for each row of an annotation pass: closed domains, a value if and only if it is supported."""
    o = F.col("outcome")
    return {
        "outcome": o.isNotNull() & o.isin(*OUTCOMES),
        "value": (o == "present_supported") == F.col("value").isNotNull(),
        "record_id": F.col("record_id").isNotNull() & (F.btrim("record_id") != ""),
        "label_path": F.col("label_path").isNotNull() & F.col("label_path").rlike(r"\A[a-z_]+(\.[a-z_]+)*\z"),
    }


def build_corpus(packet: DataFrame, first: DataFrame, second: DataFrame, adjudicated: DataFrame, *, bound_to: str) -> DataFrame:
    """record_id, label_path, outcome, value, employer, split: the labels on which two passes agree, else those of the adjudication.

    packet: record_id, employer, text.  Passes: record_id, label_path, outcome, value.  Errors: a packet that is not the one that the passes
    are bound to, labels that break a check, passes over different labels, labels without agreement or ruling, rulings that settle
    nothing, one employer alone.
    """
    from . import integrity

    if packet_hash(packet, "record_id", "employer", "text") != bound_to:
        raise ValueError("the passes are bound to another packet")
    for name, rows in (("first", first), ("second", second), ("adjudicated", adjudicated)):
        broken = integrity.rejects(rows, label_checks()).limit(1).collect()
        if broken:
            raise ValueError(f"{name}: {broken[0].record_id} breaks {', '.join(broken[0].broken)}")
        if not integrity.duplicates(rows, [F.col("record_id"), F.col("label_path")]).isEmpty():
            raise ValueError(f"{name}: a label is given twice")
    said = F.to_json(F.struct("outcome", "value"))
    both = agreement(first.withColumn("said", said), second.withColumn("said", said), "said")
    final = final_labels(both, adjudicated.select("record_id", "label_path", said.alias("value")))
    if not final.filter("missing").isEmpty():
        raise ValueError("a label is neither agreed on nor ruled")
    if not missing(adjudicated, both.filter("not agreed"), "record_id", "label_path").isEmpty():
        raise ValueError("a ruling where there is no disagreement")
    if not missing(final, packet, "record_id").isEmpty():
        raise ValueError("a label of no record of the packet")
    value = F.from_json("value", "outcome string, value string")
    return holdout(final.select("record_id", "label_path", value["outcome"].alias("outcome"), value["value"].alias("value")).join(packet.select("record_id", "employer"), "record_id"))


def missing(expected: DataFrame, recorded: DataFrame, *key: str) -> DataFrame:
    return expected.select(*key).distinct().join(recorded, list(key), "left_anti")


def audit_sample(rows: DataFrame) -> DataFrame:
    """The least record of each (label_path, outcome, employer), and all that are present and supported."""
    least = rows.groupBy("label_path", "outcome", "employer").agg(F.min("record_id").alias("record_id"))
    every = rows.filter("outcome = 'present_supported'").select("label_path", "outcome", "employer", "record_id")
    return least.union(every).distinct()


def holdout(rows: DataFrame, employer: str = "employer") -> DataFrame:
    """rows with split: the last employer by name is held out, the others are for development; one employer alone is an error."""
    ends = rows.agg(F.max(employer).alias("last"), F.min(employer).alias("first"))
    checked = ends.select(F.when(F.col("last") == F.col("first"), F.raise_error(F.lit("a split needs two employers")).cast("string")).otherwise(F.col("last")).alias("last"))
    return rows.join(F.broadcast(checked)).withColumn("split", F.when(F.col(employer) == F.col("last"), "holdout").otherwise("dev")).drop("last")  # one row, by construction


def split_overlap(rows: DataFrame, employer: str = "employer") -> DataFrame:
    """Employers on both sides, and a row of null if a side has none: must be empty."""
    sides = rows.agg(F.count_distinct("split").alias("n")).filter("n < 2").select(F.lit(None).cast(rows.schema[employer].dataType).alias(employer))
    return sides.union(_on_both_sides(rows, employer))


def _on_both_sides(rows: DataFrame, employer: str) -> DataFrame:
    return rows.filter("split = 'dev'").select(employer).intersect(rows.filter("split = 'holdout'").select(employer))


def mismatches(rows: DataFrame) -> DataFrame:
    """Supported labels with another value, in order of record, parser and component."""
    return rows.filter((F.col("outcome") == "present_supported") & ~F.col("value").eqNullSafe(F.col("expected_value"))).select("record_id", "parser", "component", "expected_value", "value").orderBy("record_id", "parser", "component")


def report_lines(scores: DataFrame) -> DataFrame:
    """Text lines of a report, in order."""
    cells = [F.concat(F.lit(f" {n}="), ratio(F.col(f"{n}_hits"), F.col(f"{n}_total"))) for n in counters()]
    return scores.select("slice", "parser", "component", F.concat(F.col("slice"), F.lit(" "), F.col("parser"), F.lit("."), F.col("component"), *cells).alias("line")).orderBy("slice", "parser", "component").select("line")
