"""Two-field inverted index as tables: postings, field lengths and corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens

FIELDS = ("name", "address")


def occurrences(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, term, doc_id, len, dl): one row for each token, with the tokens of its field and of the document."""
    held = docs.select("doc_id", *(tokens(F.col(f)).alias(f) for f in fields))
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.size(f).cast("bigint").alias("len"), F.col(f).alias("terms")) for f in fields))
    dl = sum((F.size(f) for f in fields[1:]), F.size(fields[0])).cast("bigint")
    return held.select("doc_id", dl.alias("dl"), F.explode(each).alias("x")).select("doc_id", "dl", "x.field", "x.len", F.explode("x.terms").alias("term"))


def postings(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, term, doc_id, tf). A document's tokens stand together, so counts are made before the shuffle."""
    return occurrences(docs, fields).groupBy("field", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def field_lengths(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, doc_id, len) of fields with a token; no shuffle."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.size(tokens(F.col(f))).cast("bigint").alias("len")) for f in fields))
    return docs.select("doc_id", F.explode(each).alias("x")).select("x.field", "doc_id", "x.len").where("len > 0")


def field_stats(lengths: DataFrame) -> DataFrame:
    """(field, n_docs, total, avg_len) over documents that have the field."""
    return lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("len").alias("total"), F.avg("len").alias("avg_len"))


def document_lengths(lengths: DataFrame) -> DataFrame:
    """(doc_id, dl): tokens over all fields."""
    return lengths.groupBy("doc_id").agg(F.sum("len").alias("dl"))


def corpus_of(n: DataFrame, stats: DataFrame) -> DataFrame:
    """One row (n, avgdl) of one row n and the statistics of the fields."""
    return n.crossJoin(stats.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("words"))).select("n", (F.col("words") / F.greatest("n", F.lit(1))).alias("avgdl"))


def doc_freq(posted: DataFrame, field: str | None = None) -> DataFrame:
    """(term, df): documents with the term in any field, or in one. Posting rows are unique by document and field."""
    if field is not None:
        return posted.where(F.col("field") == field).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return posted.groupBy("term", "doc_id").agg(F.lit(1).alias("one")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


#: Parts that stored postings are dealt into by a hash of the term, so a lookup reads the parts of its terms only.
PIECES = 32


def piece(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PIECES)).cast("int")


def piece_of(term: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(term)), F.lit(PIECES)).cast("int")


@dataclass
class Index:
    """The tables that queries read. `docs` has doc_id, name, address and any other columns.

    An index that is built counts what a query asks for when it asks. A stored one has postings with the lengths of their field
    and document, dealt into parts and sorted by term, document frequencies, and the statistics.
    """

    docs: DataFrame
    postings: DataFrame
    lengths: DataFrame
    tokens: DataFrame | None = None
    terms: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame) -> Index:
        return cls(docs, postings(docs), field_lengths(docs), occurrences(docs))

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """(field, term, doc_id, len, dl, tf) of some terms (distinct term). Where postings aren't stored, other tokens are left out before any are counted."""
        keys = ["field", "term", "doc_id", "len", "dl"]
        if self.terms is not None:
            return self.postings.join(terms.select("term", piece().alias("piece")), ["piece", "term"], "left_semi").select(*keys, "tf")
        if self.tokens is not None:
            return self.tokens.join(terms, "term", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("tf"))
        return self.postings.join(terms, "term", "left_semi").join(self.lengths, ["field", "doc_id"]).join(document_lengths(self.lengths), "doc_id").select(*keys, "tf")

    def frequencies(self, posted: DataFrame) -> DataFrame:
        """(term, df) of postings that were looked up."""
        return doc_freq(posted) if self.terms is None else self.terms.select("term", "df")

    @cached_property
    def stats(self) -> DataFrame:
        return field_stats(self.lengths)

    @cached_property
    def corpus(self) -> DataFrame:
        """One row: n (all documents) and avgdl (tokens over all documents)."""
        return corpus_of(self.docs.agg(F.count(F.lit(1)).alias("n")), self.stats)

    @cached_property
    def df(self) -> DataFrame:
        return doc_freq(self.postings) if self.terms is None else self.terms.select("term", "df")

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self.postings.select("term").distinct() if self.terms is None else self.terms.select("term")

    def save(self, path: str) -> None:
        """Parquet tables that replace those under path: documents, lengths, postings, terms with their frequencies, statistics of fields and corpus."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        spark = self.docs.sparkSession
        lengths = spark.read.parquet(f"{path}/lengths")
        field_stats(lengths).write.mode("overwrite").parquet(f"{path}/stats")
        n = spark.read.parquet(f"{path}/docs").agg(F.count(F.lit(1)).alias("n"))
        corpus_of(n, spark.read.parquet(f"{path}/stats")).write.mode("overwrite").parquet(f"{path}/corpus")
        if self.tokens is not None:
            rows = self.tokens.groupBy("field", "term", "doc_id", "len", "dl").agg(F.count(F.lit(1)).alias("tf"))
        else:
            rows = self.postings.select("field", "term", "doc_id", "tf").join(lengths, ["field", "doc_id"]).join(document_lengths(lengths), "doc_id")
        # a part may be large, so its rows are dealt over several files by term, too
        dealt = rows.withColumn("piece", piece()).repartition("piece", "term").sortWithinPartitions("piece", "term", "field", "doc_id")
        dealt.write.mode("overwrite").partitionBy("piece").parquet(f"{path}/postings")
        stored = spark.read.parquet(f"{path}/postings")
        stored.groupBy("term", "doc_id").agg(F.max(F.col("field") == FIELDS[0]).alias("named")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.count_if("named").alias("df_name")).sort("term").write.mode("overwrite").parquet(f"{path}/terms")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        docs, posted, lengths, terms, stats, corpus = (spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "lengths", "terms", "stats", "corpus"))
        index = cls(docs, posted, lengths, None, terms)
        index.__dict__ |= {"stats": stats, "corpus": corpus}
        return index


def merge(segments: list[DataFrame]) -> DataFrame:
    """Postings of several segments as one, term frequencies summed."""
    out = segments[0]
    for s in segments[1:]:
        out = out.unionByName(s)
    return out.groupBy("field", "term", "doc_id").agg(F.sum("tf").alias("tf"))


def merge_lengths(segments: list[DataFrame]) -> DataFrame:
    """Field lengths (field, doc_id, len) of several segments as one; a document that is in several has their sum."""
    out = segments[0]
    for s in segments[1:]:
        out = out.unionByName(s)
    return out.groupBy("field", "doc_id").agg(F.sum("len").alias("len"))


def in_term_order(posted: DataFrame) -> DataFrame:
    """All postings by term, then field and document: a range for each task, so the whole is in order."""
    return posted.orderBy("term", "field", "doc_id")


def posting_list(posted: DataFrame, term: str, field: str | None = None) -> DataFrame:
    """Rows of one term; an unknown term has none."""
    rows = posted.where(F.col("term") == term)
    return rows if field is None else rows.where(F.col("field") == field)


def run_lengths(values: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, start, value, n): runs of equal values in order, by the difference of two row numbers."""
    from pyspark.sql import Window

    both = values.select(group, order, value, (F.row_number().over(Window.partitionBy(group).orderBy(order)) - F.row_number().over(Window.partitionBy(group, value).orderBy(order))).alias("run"))
    return both.groupBy(group, value, "run").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("n")).select(group, "start", value, "n")
