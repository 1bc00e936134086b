"""Autocompletion: the last word is a prefix, the others must all occur in the name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .index import Index, doc_freq
from .lm import Model
from .rank import FIELD_B, K1_FIELDS, NAME_WEIGHT, idf_fields


def prefix_terms(vocabulary: DataFrame, prefix: str) -> DataFrame:
    """Terms that begin with a prefix, as a filter that reaches the scan."""
    return vocabulary.where(F.col("term").startswith(prefix))


def expansions(prefixes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(prefix, term): joined on the prefix's own length of the term, so it is an equi-join for each length in use."""
    lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().orderBy(F.length("prefix")).collect()]  # at most as many as a word has characters
    cut = vocabulary.select("term", F.explode(F.array(*(F.lit(n) for n in lengths)) if lengths else F.array().cast("array<int>")).alias("n")).where(F.length("term") >= F.col("n")).select("term", F.expr("substring(term, 1, n)").alias("prefix"))
    return prefixes.select("prefix").distinct().join(cut, "prefix")


def candidates(queries: DataFrame, vocabulary: DataFrame, model: Model, k: int = 3) -> DataFrame:
    """(query_id, tokens, logp, rank): the k likeliest queries whose last word is a term with the typed prefix."""
    terms = queries.select("query_id", tokens(F.col("query")).alias("t")).where("size(t) > 0").withColumn("prefix", F.element_at("t", -1))
    # a row for each candidate: only the last word has several options
    rows = terms.join(expansions(terms, vocabulary), "prefix").select("query_id", "term", F.concat(F.slice("t", F.lit(1), F.size("t") - 1), F.array("term")).alias("tokens")).withColumn("seq_id", F.struct("query_id", "term"))
    scored = rows.join(model.score(rows.select("seq_id", "tokens")), "seq_id")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round("logp", 9)), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "tokens", "logp", "rank")


def conjunctive(index: Index, candidates: DataFrame) -> DataFrame:
    """(query_id, rank, doc_id, score): documents with all words in the name. A document counts as often as its least frequent word."""
    words = candidates.select("query_id", "rank", F.explode(F.array_distinct("tokens")).alias("term"), F.size(F.array_distinct("tokens")).alias("need"))
    named = index.postings_of(words.select("term").distinct()).where("field = 'name'")
    df = doc_freq(named, "name")
    average = index.stats.where("field = 'name'").select("avg_len")
    rows = named.join(words, "term").join(df, "term").crossJoin(F.broadcast(average)).crossJoin(F.broadcast(index.corpus))  # one row each
    part = NAME_WEIGHT * F.col("tf") / (1.0 + FIELD_B * (F.col("len") / F.col("avg_len") - 1.0))
    score = part / (K1_FIELDS + part) * idf_fields(F.col("n"), F.col("df"))
    out = rows.groupBy("query_id", "rank", "doc_id", "need").agg(F.count(F.lit(1)).alias("has"), F.min("tf").alias("times"), F.sum(score).alias("score")).where("has = need")
    return out.select("query_id", "rank", "doc_id", F.round(F.col("score") * F.col("times"), 6).alias("score"))


def autocomplete(index: Index, queries: DataFrame, model: Model, k: int = 10, offset: int = 0) -> DataFrame:
    """(query_id, place, doc_id, cand, score): results of the three likeliest candidates one after another; a document may come again under another one."""
    hits = conjunctive(index, candidates(queries, index.vocabulary, model))
    order = Window.partitionBy("query_id").orderBy("rank", F.desc("score"), "doc_id")
    page = hits.withColumn("place", F.row_number().over(order).cast("bigint")).where((F.col("place") > offset) & (F.col("place") <= offset + (k or 10)))
    return page.select("query_id", "place", "doc_id", F.col("rank").cast("bigint").alias("cand"), "score")
