"""Spelling correction: candidates within two edits, and the candidate query that the language model likes best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import deletions, tokens
from .lm import Model


def candidates(words: DataFrame, vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """(word, term, edits) with at most two edits, for distinct words (column term of both tables).

    Both sides are spread to their deletion variants and joined on these, so no word meets the whole vocabulary;
    the distance itself is then computed, with a bound, on pairs that share a variant.
    """
    left = words.select(F.col("term").alias("word")).distinct().select("word", F.explode(deletions(F.col("word"))).alias("v"))
    right = vocabulary.select("term").distinct().select("term", F.explode(deletions(F.col("term"))).alias("v"))
    pairs = left.join(right, "v").where(F.abs(F.length("word") - F.length("term")) <= most).select("word", "term").distinct()
    return pairs.withColumn("edits", F.levenshtein("word", "term", most)).where("edits >= 0")


def choices(terms: DataFrame, vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, pos, options): a known word stands for itself; an unknown one has its candidates, one edit before two, then by spelling. Words without candidates are dropped."""
    known = vocabulary.select("term", F.lit(True).alias("known")).distinct()
    words = terms.select("term").distinct().join(known, "term", "left")
    near = candidates(words.where("known is null"), vocabulary, most).groupBy("word").agg(F.array_sort(F.collect_list(F.struct((F.col("edits") > 1).alias("far"), "term"))).alias("x")).select(F.col("word").alias("term"), F.col("x.term").alias("options"))
    own = words.where("known").select("term", F.array("term").alias("options"))
    return terms.join(own.unionByName(near), "term").select("query_id", "pos", "options")


def products(options: DataFrame) -> DataFrame:
    """(query_id, cand, tokens): all ways to take one option for each position, numbered in order."""
    each = options.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "options"))).alias("x"))
    # a row is made from its number, whose digits choose the options; the last position is the fastest
    product = lambda sizes: F.aggregate(sizes, F.lit(1).cast("bigint"), lambda a, b: a * b)
    sized = each.withColumn("sizes", F.transform("x.options", lambda o: F.size(o).cast("bigint")))
    rows = sized.withColumn("cand", F.explode(F.sequence(F.lit(0).cast("bigint"), product(F.col("sizes")) - 1)))
    after = lambda i: product(F.slice("sizes", i + 2, F.size("sizes")))
    chosen = F.transform(F.col("x.options"), lambda own, i: F.get(own, (F.floor(F.col("cand") / after(i)) % F.size(own)).cast("int")))
    return rows.select("query_id", F.col("cand").cast("int").alias("cand"), chosen.alias("tokens"))


def ranked(options: DataFrame, model: Model, k: int) -> DataFrame:
    """(query_id, cand, tokens, logp, rank): the k likeliest candidate queries, ties by number."""
    rows = products(options).withColumn("seq_id", F.struct("query_id", "cand"))
    scored = rows.join(model.score(rows.select("seq_id", "tokens")), "seq_id").drop("seq_id")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round("logp", 9)), "cand")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def corrected(queries: DataFrame, vocabulary: DataFrame, model: Model, most: int = 2) -> DataFrame:
    """(query_id, query, logp) of (query_id, query): each query in its likeliest spelling; none if no word of it is known or near a known one."""
    terms = queries.select("query_id", F.posexplode(tokens(F.col("query"))).alias("pos", "term"))
    best = ranked(choices(terms, vocabulary, most), model, 1)
    return best.select("query_id", F.array_join("tokens", " ").alias("query"), "logp")
