"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles, quotes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import common, tokens

    files = tokens.write_tokens(table(spark, sf_dir, "documents"), common.scratch(spark, "tokens"), vocabulary("byte_bpe_50k.json"))
    return tokens.read_tokens(spark, files)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_ngram_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_bloom
    from .langid import held_out

    docs = table(spark, sf_dir, "documents")
    model = ngram_bloom.fit(docs.filter(~held_out(F.col("doc_id"), 10)))
    out = ngram_bloom.score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 10).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotes import link

    return link(table(spark, sf_dir, "conversations"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import common, warc

    files = warc.write_archives(table(spark, sf_dir, "pages"), common.scratch(spark, "warc"), min_bytes=0)
    return warc.read_archives(spark, files)


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_token_files, op3_packing, op4_ngram_bloom, op5_minhash, op6_decontamination, op7_suffix_array, op8_quotes, op9_language_id, op10_warc)}
SQL: dict[str, str] = {"op5_minhash": oracles.MINHASH, "op8_quotes": quotes.SQL, "op10_warc": oracles.WARC}
