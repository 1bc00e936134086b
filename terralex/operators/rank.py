"""Ranking functions over the index. Queries come as a table (query_id, pos, term); all queries are one job.

Logarithms are to the base 10. Inverse document frequencies may be negative, so no score is filtered by its sign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .index import Index

#: Fixed values of the models.
DELTA, K1, B = 1.0, 1.2, 0.98
K1_FIELDS, NAME_WEIGHT, ADDRESS_WEIGHT, FIELD_B = 10.0, 20.0, 1.0, 0.95


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, pos, term) of (query_id, query)."""
    return queries.select("query_id", F.posexplode(tokens(F.col("query"))).alias("pos", "term"))


def top(scored: DataFrame, k: int = 10, offset: int = 0, by: str = "query_id", digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rank): a page of each query's documents by score, ties by doc_id. A limit of 0 means 10.

    Spark keeps offset + k rows of each query in every task before it shuffles.
    """
    k = k or 10
    rows = scored.withColumn("score", F.round("score", digits))
    order = Window.partitionBy(by).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).where((F.col("rank") > offset) & (F.col("rank") <= offset + k))


def _weighted(index: Index, posted: DataFrame, terms: DataFrame, weights: dict[str, float]) -> tuple[DataFrame, Column]:
    """Postings of the terms with field lengths and averages, and BM25F's part of a row."""
    w = F.coalesce(*(F.when(F.col("field") == f, F.lit(v)) for f, v in weights.items()))
    rows = posted.where(F.col("field").isin(*weights)).join(terms, "term").join(F.broadcast(index.stats.select("field", "avg_len")), "field")  # a row for each field
    part = w * F.col("tf") / (1.0 + FIELD_B * (F.col("len") / F.col("avg_len") - 1.0))
    return rows, part / (K1_FIELDS + part)


def idf_fields(n: Column, df: Column) -> Column:
    return F.log10(n - df + 0.5) - F.log10(df + 0.5)


def bm25f(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): each occurrence of a query term counts; fields saturate one by one."""
    times = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    posted = index.postings_of(times.select("term").distinct())
    known = times.join(index.frequencies(posted), "term").crossJoin(F.broadcast(index.corpus))  # corpus has one row
    rows, part = _weighted(index, posted, known, {"name": NAME_WEIGHT, "address": ADDRESS_WEIGHT})
    return rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("times") * part * idf_fields(F.col("n"), F.col("df"))).alias("score"))


def _by_document(index: Index, terms: DataFrame) -> DataFrame:
    """Term frequencies over both fields, with document frequency and corpus numbers."""
    times = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    posted = index.postings_of(times.select("term").distinct())
    tf = posted.join(times.join(index.frequencies(posted), "term"), "term").groupBy("query_id", "term", "doc_id", "dl", "times", "df").agg(F.sum("tf").alias("tf"))
    return tf.crossJoin(F.broadcast(index.corpus))


def bm25_plus(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) over distinct query terms; the numerator adds K1 + 1 and the term frequency."""
    rows = _by_document(index, terms)
    idf = F.log10(F.col("n") + 1) - F.log10("df")
    score = idf * (DELTA + ((K1 + 1.0) + F.col("tf")) / (K1 * (1.0 - B + B * F.col("dl") / F.col("avgdl")) + F.col("tf")))
    return rows.groupBy("query_id", "doc_id").agg(F.sum(score).alias("score"))


def tf_idf(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): products of the two weights, without norms."""
    idf = F.log10("n") - F.log10("df")
    score = (1.0 + F.log10("tf")) * idf * (1.0 + F.log10("times")) * idf
    return _by_document(index, terms).groupBy("query_id", "doc_id").agg(F.sum(score).alias("score"))


MODELS = {"BM25_FIELD": bm25f, "BM25_PLUS": bm25_plus, "TF_IDF_COSINE": tf_idf}


def search(index: Index, queries: DataFrame, k: int = 10, offset: int = 0, model: str = "BM25_FIELD") -> DataFrame:
    """A page of ranked documents of each query, without correction of spelling."""
    return top(MODELS[model](index, query_terms(queries)), k, offset)


def with_documents(index: Index, hits: DataFrame) -> DataFrame:
    """Hits with the columns of their documents: fetched after the cut to a page."""
    return hits.join(index.docs, "doc_id")
