"""Connected components of a table of links.

Each task first joins what it reads of the links by a union-find of its own, which leaves one link for each end at most. Then
large and small stars alternate, all in DataFrames, until a round changes nothing. `FINISH` links or fewer are read by one task,
whose union-find is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Shelf

#: Most links that one task finishes: 16 bytes each.
FINISH = 1 << 20


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of links and for each the least end that it is tied to, by halving paths."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = np.arange(len(ends))
    x, y = at[: len(a)], at[len(a) :]
    while len(x):
        lo, hi = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        open_ = lo != hi
        x, y, lo, hi = x[open_], y[open_], lo[open_], hi[open_]
        np.minimum.at(up, hi, lo)
        while not np.array_equal(up, above := up[up]):
            up = above
    return ends, ends[up]


def contracted(edges: DataFrame) -> DataFrame:
    """(a, b): each end b tied to the least end a of its links as far as one task sees them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            b, a = joined(*(np.concatenate([x, y.to_numpy()]) for x, y in zip((a, b), batch.columns)))
            a, b = a[a != b], b[a != b]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.least("b", "m").alias("a"), F.greatest("b", "m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node (b) and its smaller neighbours (a) are tied to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    near = edges.join(least, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return near.unionByName(least.select(F.col("m").alias("a"), "b"))


def components(edges: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """(id, component): for each end of a link (a, b) the least id that can be reached. Ends without links don't appear.

    A node's least neighbour comes from a partial aggregation and goes back by a join, which Spark splits where one
    node has very many links; no list of neighbours is built.
    """
    sums = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    now, sign = shelf.measured(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-0", **sums)
    if sign["n"] <= FINISH:
        now = shelf.put(contracted(now.coalesce(1)), f"{name}-1")
        shelf.drop(f"{name}-0")
    else:
        before, k = None, 0
        while sign != before:
            k, before = k + 1, sign
            now, sign = shelf.measured(_small(_large(contracted(now))).distinct(), f"{name}-{k}", **sums)
            shelf.drop(f"{name}-{k - 1}")
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
