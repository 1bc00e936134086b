"""documents to token ids: language ID, near-duplicate removal, benchmark decontamination, redaction, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows it gets. All but the last return the columns of documents.
SQL can't express language ID and the encoder, so there is no ORACLE_SQL; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex.llm import bpe, decontam, langid, minhash, pii
from terralex.llm.queries import bucket, table, tokenizer
from terralex.llm.store import Shelf

#: A text whose best model needs more bits a byte than plain bytes take is in no learned language.
RAW_BITS = 8.0


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns c0, c1 and so on, and the new name of each: no column of the input can clash with an operator's."""
    new = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*new), dict(zip(docs.columns, new))


def restored(docs: DataFrame, of: dict[str, str]) -> DataFrame:
    return docs.select(*(F.col(new).alias(old) for old, new in of.items()))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is `und` (null or no letter) and what no language's model codes in fewer bits than raw bytes."""
    rows, of = numbered(docs)
    model = langid.train(docs, bucket(3) != 1)
    seen = langid.predict(rows, model, id_col=of["doc_id"], text_col=of["text"], keep=tuple(rows.columns))
    return restored(seen.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= RAW_BITS)), of)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the least id. Rows without an id stay."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs. Proximity matches drop nothing."""
    rows, of = numbered(docs)
    seen = decontam.contamination(rows, table(spark, sf_dir, "benchmark"), id_col=of["doc_id"], text_col=of["text"], keep=tuple(rows.columns), near=False)
    return restored(seen.where("not contaminated"), of)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [KIND] in the place of each span of personal data; n_chars is counted anew. A null text is an empty one from here on."""
    rows, of = numbered(docs)
    text = of["text"]
    found = pii.find(rows, text_col=text, keep=tuple(rows.columns)).withColumn(text, F.coalesce(F.col(text), F.lit("")))
    out = found.withColumn(text, pii.redacted(found, text))
    return restored(out.withColumn(of["n_chars"], F.length(text).cast("bigint")) if "n_chars" in of else out, of)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to. Of columns that are named like these, these stay."""
    made = {"n_tokens", "ids", "ids_sha256", "decoded_sha256"}
    return bpe.encode(docs, *tokenizer(), keep=tuple(c for c in docs.columns if c.lower() not in made | {"doc_id", "text"}))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("redaction", redaction), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each one's result written before the next reads it."""
    docs, shelf = table(spark, sf_dir, "documents"), Shelf(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shelf.put(docs, name)
            if k:
                shelf.drop(STAGES[k - 1][0])
    return docs
