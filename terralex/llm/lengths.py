"""Exact histogram of encoded lengths.

Documents are aggregated by their number of tokens; each task sends a count for each length it has met. Suffix sums over
the lengths (documents and tokens at this length or above) then answer totals, quantiles and truncated totals for every
context limit without reading a document again. The sums run in blocks of lengths, so no single task sees them all.

Edge cases: null and empty texts have length 0; an empty table has no rows; repeated rows count each time; other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import bounded
from .bpe import checked, codec
from .store import Shelf

#: Lengths of a block.
BLOCK = 512


def histogram(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs), as a table in the shared folder: what reads it twice doesn't encode twice."""
    checked(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, found = codec(path, pattern), Counter()
        for batch in batches:
            for text in batch.column(0):
                found[c.count(text.as_py() or "")] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["n_tokens", "n_docs"])

    counts = bounded(docs).select(F.col(text_col).cast("string")).mapInArrow(run, "n_tokens bigint, n_docs bigint")
    return Shelf(docs.sparkSession, "lengths").put(counts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "histogram")


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs, docs_at_least, tokens_at_least, truncated_total): truncated_total is the number of tokens if each document is cut to n_tokens."""
    rows = lengths.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # blocks are few: the longest length / BLOCK
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    above = sums.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("da"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("ta"), F.sum("t").over(Window.partitionBy()).alias("all"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(above, "block").select("n_tokens", "n_docs", (F.sum("n_docs").over(own) + F.col("da")).alias("docs_at_least"), (F.sum("tokens").over(own) + F.col("ta")).alias("tokens_at_least"), "all")
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (F.col("all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"))


def truncated(lengths: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit, total, n_cut) for each different row of limits: tokens left if documents are cut to the limit, and how many are cut. lengths is a histogram, to which the limits are added as lengths of no document."""
    asked = limits.select("limit").distinct()
    marked = lengths.unionByName(asked.select((F.col("limit") + 1).alias("n_tokens"), F.lit(0).cast("bigint").alias("n_docs"))).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    # at limit + 1 stand the sums over all documents that are longer than the limit
    found = asked.withColumn("n_tokens", F.col("limit") + 1).join(suffix_sums(marked), "n_tokens")
    return found.select("limit", (F.col("truncated_total") - F.col("docs_at_least")).alias("total"), F.col("docs_at_least").alias("n_cut"))


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that a share q of the documents doesn't exceed; null without documents."""
    n = sums.agg(F.max("docs_at_least")).first()[0]
    if n is None:
        return None
    return sums.where((F.lit(n) - F.col("docs_at_least") + F.col("n_docs")) >= q * n).agg(F.min("n_tokens")).first()[0]
