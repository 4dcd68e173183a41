"""Corpus cleaning and packing: five stages, each on all that the one before kept.

1. language: documents without letters, or without a language of at least 0.3 mean probability, go.  Where no document has a label to learn
   from (or there is no column ``lang``), all stay.
2. near_duplicates: of each group of near copies (five-word shingles, similarity of 0.8 or more) the one of least id stays.  Rows that repeat
   an id are one document.
3. repeats: bytes of strings of 100 bytes that start earlier in the corpus go; a document of which nothing is left goes.
4. benchmark: documents that hold a benchmark item (five-word shingles, weighted similarity of 0.8 or more) go.
5. packing: sequences of at most 4096 tokens; one row a piece.

Null ids are kept as they are.  All stages but the last return the columns they got; names may be equal but for case.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common, decontaminate, langid, minhash, packing, queries, suffix


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    flat, (id_at, text_at) = common.flattened(docs, "doc_id", "text")
    slim = flat.select(F.col(f"c{id_at}").alias("doc_id"), F.col(f"c{text_at}").alias("text"))
    gone = minhash.near_duplicates(slim, shingle=5, num=80, den=100).filter("not kept").select(F.col("doc_id").alias(f"c{id_at}")).distinct()
    gone, _ = common.store(gone, "gone")
    return common.without(flat, gone, f"c{id_at}").toDF(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(docs, length=100, texts=True)
    if "n_chars" not in docs.columns:
        return out
    flat, (text_at, n_at) = common.flattened(out, "text", "n_chars")
    return flat.withColumn(f"c{n_at}", F.char_length(f"c{text_at}").cast(flat.schema[n_at].dataType)).toDF(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.vocabulary("word_bpe_49k.json"))



def _sparing(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with Arrow batches of 2 MB and after a collection of garbage: buffers, and a heap once filled, stay from stage to stage otherwise."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.shrink(spark)
        return stage(common.gentle(spark, "2m"), docs, sf_dir)

    return run


STAGES = [(name, _sparing(f)) for name, f in (("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("benchmark", benchmark), ("packing", pack))]
#: Language ID, suffix sorting, SimHash and packing are not for SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, used = queries.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = common.store(stage(spark, docs, sf_dir), name)
        common.discard(spark, *used)  # the table before is read no more
        used = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
