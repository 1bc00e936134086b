"""N-gram language model with stupid backoff, as count tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ngrams

START, END, UNK, ORDER, DISCOUNT = "<s>", "</s>", "<unk>", 4, 0.4


def padded(tokens: Column, n: int) -> Column:
    return F.concat(F.array(*[F.lit(START)] * n), tokens, F.array(F.lit(END)))


def counts(docs: DataFrame, n: int, tokens: str = "tokens") -> DataFrame:
    """(w1 .. wn, c): n-grams of the token lists with n start marks and one end mark."""
    grams = docs.select(padded(F.col(tokens), n).alias("p")).select(F.explode(ngrams(F.col("p"), n)).alias("g"))
    return grams.select(*(F.col("g")[i].alias(f"w{i + 1}") for i in range(n))).groupBy(*(f"w{i + 1}" for i in range(n))).agg(F.count(F.lit(1)).alias("c"))


def occurrences(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(g): all n-grams of orders 1 to 4 of the token lists, one row for each time; an order has as many start marks as it has words."""
    orders = range(1, ORDER + 1)
    marked = docs.select(*(padded(F.col(tokens), n).alias(f"p{n}") for n in orders))
    return marked.select(F.explode(F.concat(*(ngrams(F.col(f"p{n}"), n) for n in orders))).alias("g"))


def thresholded(docs: DataFrame, least: int, tokens: str = "tokens") -> DataFrame:
    """docs with UNK in the place of tokens that occur less than `least` times in all documents. The words go by a join, so the vocabulary may be of any size."""
    each = docs.select("doc_id", F.posexplode_outer(tokens).alias("pos", "term"))
    known = each.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("term", F.lit(True).alias("known"))
    marked = each.join(known, "term", "left").select("doc_id", F.when(F.col("pos").isNotNull(), F.struct("pos", F.when(F.col("known"), F.col("term")).otherwise(F.lit(UNK)).alias("term"))).alias("x"))
    lists = marked.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lists.select("doc_id", F.col("x.term").alias(tokens))


@dataclass
class Model:
    """N-gram counts: a stored table (g, c), or the documents that they are taken from when they are needed."""

    docs: DataFrame | None
    stored: DataFrame | None = None
    tokens: str = "tokens"

    @classmethod
    def build(cls, docs: DataFrame, tokens: str = "tokens") -> Model:
        return cls(docs, None, tokens)

    def table(self) -> DataFrame:
        """(g, c) of all n-grams."""
        return self.stored if self.stored is not None else occurrences(self.docs, self.tokens).groupBy("g").agg(F.count(F.lit(1)).alias("c"))

    def save(self, path: str) -> None:
        """One table, sorted by n-gram within its files."""
        self.table().repartition("g").sortWithinPartitions("g").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return cls(None, spark.read.parquet(path))

    def lookup(self, needed: DataFrame) -> DataFrame:
        """(g, c) of the n-grams in needed (distinct g) that occur. Others are left out before anything is counted, so only what is asked for is shuffled."""
        if self.stored is not None:
            return self.stored.join(needed, "g")
        return occurrences(self.docs, self.tokens).join(needed, "g", "left_semi").groupBy("g").agg(F.count(F.lit(1)).alias("c"))

    @property
    def total(self) -> DataFrame:
        """One row: the number of words with marks."""
        if self.stored is not None:
            return self.stored.where(F.size("g") == 1).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"))
        return self.docs.agg(F.coalesce(F.sum(F.size(F.col(self.tokens)) + 2), F.lit(0)).alias("total"))

    def estimates(self, rows: DataFrame) -> DataFrame:
        """rows (h3, h2, h1, w, ...) with p1 .. p4: likelihood estimates of w after 0 to 3 words; 0 where the context is unseen.

        Each distinct row asks for seven counts; all of them come from one join.
        """
        names = ("h3", "h2", "h1", "w")
        asked = {f"c{n}": names[-n:] for n in range(1, ORDER + 1)} | {f"d{n}": names[-n:-1] for n in range(2, ORDER + 1)}
        slots = F.array(*(F.struct(F.lit(k).alias("slot"), F.array(*v).alias("g")) for k, v in asked.items()))
        own = rows.select(*names).distinct()
        wanted = own.select(*names, F.explode(slots).alias("x")).select(*names, "x.slot", "x.g")
        found = wanted.join(self.lookup(wanted.select("g").distinct()), "g", "left")
        out = found.groupBy(*names).agg(*(F.max(F.when(F.col("slot") == k, F.col("c"))).alias(k) for k in asked)).crossJoin(F.broadcast(self.total))  # one row
        p = {n: F.coalesce(F.col(f"c{n}") / F.col(f"d{n}"), F.lit(0.0)) for n in range(2, ORDER + 1)} | {1: F.coalesce(F.col("c1") / F.col("total"), F.lit(0.0))}
        return out.select(*names, *(p[n].alias(f"p{n}") for n in range(1, ORDER + 1)))

    def backoff(self, rows: DataFrame) -> DataFrame:
        """(h3, h2, h1, w, p): the estimate of the highest order that isn't 0, discounted for each order left out; 0 for an unknown word."""
        tried = [F.when(F.col(f"p{n}") > 0, F.col(f"p{n}") * DISCOUNT ** (ORDER - n)) for n in range(ORDER, 0, -1)]
        return self.estimates(rows).select("h3", "h2", "h1", "w", F.coalesce(*tried, F.lit(0.0)).alias("p"))

    def score(self, sequences: DataFrame) -> DataFrame:
        """(seq_id, logp) of (seq_id, tokens): natural logarithms summed up to and with the end mark; null stands for minus infinity."""
        seq = sequences.select("seq_id", padded(F.col("tokens"), ORDER).alias("t"))
        at = F.transform(F.sequence(F.lit(ORDER), F.size("t") - 1), lambda i: F.struct(*(F.get(F.col("t"), i - k).alias(f"h{k}") for k in (3, 2, 1)), F.get(F.col("t"), i).alias("w")))
        rows = seq.select("seq_id", F.explode(at).alias("x")).select("seq_id", "x.*")
        scored = rows.join(self.backoff(rows), ["h3", "h2", "h1", "w"])
        return scored.groupBy("seq_id").agg(F.when(F.min("p") > 0, F.sum(F.when(F.col("p") > 0, F.log("p")))).alias("logp"))
