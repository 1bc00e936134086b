"""One query for each operator, over whole tables and whole texts, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; large rows are spread over the cores if they come in one small file."""
    df = tables.table(spark, sf_dir, name)
    return tables.spread(df) if name in ("documents", "pages") else df


def tokenizer() -> tuple[str, str]:
    """Vocabulary file and splitting pattern of the production parameters."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def bucket(modulus: int) -> Column:
    """crc32 of the id as text, modulo: what the held-out splits go by."""
    return F.crc32(F.col("doc_id").cast("string")) % F.lit(modulus)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, bucket(3) != 1)
    return langid.predict(docs, model).withColumn("held_out", F.coalesce(bucket(3) == 1, F.lit(False)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    scored = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bucket(5) != 0)
    return scored.withColumn("held_out", F.coalesce(bucket(5) == 0, F.lit(False)))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix

    return suffix.without_repeats(table(spark, sf_dir, "documents"), text=False)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.report(pii.find(table(spark, sf_dir, "documents")), "doc_id")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "n_near", "near_items")


def op7_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_decontam with the lists of items and the proximity matches, for which there is no SQL."""
    from . import decontam

    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rules

    return rules.clean(table(spark, sf_dir, "documents"), text=False)


def op9_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lengths

    return lengths.suffix_sums(lengths.histogram(table(spark, sf_dir, "documents"), *tokenizer()))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.encode(table(spark, sf_dir, "documents"), *tokenizer(), ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_langid, op2_quality, op3_minhash, op4_suffix, op5_warc, op6_pii, op7_decontam, op7_proximity, op8_rules, op9_lengths, op10_bpe)}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
