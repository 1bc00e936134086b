"""The engine as one object over stored tables: search, completion, reverse geocoding and places around a point."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import tokens
from . import autocomplete, rank, spatial, spell
from .index import Index
from .lm import Model

# Characters of queries, of features and of names of fences and points; ranges of numbers in requests.
QUERY, FEATURE, NAME = r"[A-Za-z0-9_ +,.()]+", r"[a-zA-Z0-9_:=]+", r"[A-Za-z0-9_]+"
RANGES = {"lat": (-90, 90), "lon": (-180, 180), "k": (1, 100), "offset": (0, None), "radius": (None, 1000), "fence_radius": (0.2, 20)}
RADIUS_KM = 5.0


def require(**given: object) -> None:
    """Raises ValueError for the first argument that a request may not have: query, feature, fence, point and key by their characters, others by `RANGES`. None is missing."""
    for name, value in given.items():
        if value is None:
            raise ValueError(f"{name} must be given")
        if name in (patterns := {"query": QUERY, "feature": FEATURE, "fence": NAME, "point": NAME, "key": NAME}):
            if not re.fullmatch(patterns[name], str(value)):
                raise ValueError(f"{name} must match {patterns[name]}: {value!r}")
            continue
        low, high = RANGES[name]
        if isinstance(value, bool) or not isinstance(value, int | float) or value != value:
            raise ValueError(f"{name} must be a number: {value!r}")
        if low is not None and value < low or high is not None and value > high:
            raise ValueError(f"{name} must be from {low} to {high}: {value!r}")


def valid(queries: DataFrame) -> Column:
    """Whether a row (query, and lat and lon if there are any) would be taken as a request."""
    out = F.col("query").rlike(rf"\A{QUERY}\z")
    for c in ("lat", "lon"):
        if c in queries.columns:
            out = out & F.col(c).between(*RANGES[c])
    return F.coalesce(out, F.lit(False))


@dataclass
class Searcher:
    """Stored index, language model and places. Queries come as tables; the one-request methods check their arguments."""

    index: Index
    model: Model

    @classmethod
    def build(cls, spark: SparkSession, docs: DataFrame, path: str) -> Searcher:
        """Writes docs (doc_id, name, address and, for places, lat, lon, features) with their index and model under path, and loads them."""
        index = Index.build(docs)
        index.save(path)
        Model.build(docs.select("doc_id", tokens(F.concat_ws(" ", "name", "address")).alias("tokens"))).save(f"{path}/model")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Searcher:
        return cls(Index.load(spark, path), Model.load(spark, f"{path}/model"))

    @property
    def spots(self) -> DataFrame:
        return self.index.docs.select(F.col("doc_id").alias("id"), "lat", "lon", "features")

    def _found(self, hits: DataFrame, queries: DataFrame) -> DataFrame:
        """Hits with the columns of their documents and, if both sides have a position, the distance in km."""
        docs = self.index.docs
        if not {"lat", "lon"} <= set(queries.columns) & set(docs.columns):
            return hits.join(docs, "doc_id")
        users = queries.select("query_id", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
        far = F.round(geo.haversine(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon")), 6)
        return hits.join(docs, "doc_id").join(users, "query_id").withColumn("distance", far).drop("__lat", "__lon")

    def search(self, queries: DataFrame, k: int = 10, offset: int = 0, model: str = "BM25_FIELD") -> DataFrame:
        """(query_id, rank, score, doc_id, the document's columns, distance) of queries (query_id, query, lat, lon): words that aren't in the vocabulary are corrected, others stay."""
        corrected = spell.corrected(queries.select("query_id", "query"), self.index.vocabulary, self.model)
        return self._found(rank.search(self.index, corrected, k, offset, model), queries)

    def complete(self, queries: DataFrame, k: int = 10, offset: int = 0) -> DataFrame:
        """(query_id, place, cand, score, doc_id, the document's columns, distance) of queries whose last word is a prefix."""
        return self._found(autocomplete.autocomplete(self.index, queries.select("query_id", "query"), self.model, k, offset), queries)

    def reverse(self, points: DataFrame) -> DataFrame:
        """(query_id, doc_id, dist, the document's columns) of the place nearest to each point."""
        return spatial.reverse_geocode(points, self.spots).withColumnRenamed("id", "doc_id").join(self.index.docs, "doc_id")

    def around(self, points: DataFrame, feature: str, radius: float = RADIUS_KM, k: int = 10, offset: int = 0) -> DataFrame:
        """(query_id, doc_id, dist, rank, the document's columns) of the places with a feature within a radius."""
        return spatial.nearby(points, self.spots, feature, radius, k, offset).withColumnRenamed("id", "doc_id").join(self.index.docs, "doc_id")

    def _one(self, **columns: object) -> DataFrame:
        spark = self.index.docs.sparkSession
        return spark.range(1).select(F.lit(1).cast("bigint").alias("query_id"), *(F.lit(float(v) if n in ("lat", "lon") else v).alias(n) for n, v in columns.items()))

    def free_form_query(self, query: str, k: int = 10, offset: int = 0, lat: float | None = None, lon: float | None = None) -> DataFrame:
        """search() of one request; a limit of 0 means 10."""
        require(query=query, k=k or 10, offset=offset)
        if lat is None and lon is None:
            return self.search(self._one(query=query), k or 10, offset)
        require(lat=lat, lon=lon)
        return self.search(self._one(query=query, lat=lat, lon=lon), k or 10, offset)

    def autocomplete(self, query: str, k: int = 10, offset: int = 0, lat: float | None = None, lon: float | None = None) -> DataFrame:
        """complete() of one request."""
        require(query=query, k=k or 10, offset=offset)
        if lat is None and lon is None:
            return self.complete(self._one(query=query), k or 10, offset)
        require(lat=lat, lon=lon)
        return self.complete(self._one(query=query, lat=lat, lon=lon), k or 10, offset)

    def reverse_geocode(self, lat: float, lon: float) -> DataFrame:
        require(lat=lat, lon=lon)
        return self.reverse(self._one(lat=lat, lon=lon))

    def nearby_places(self, lat: float, lon: float, feature: str, radius: float = RADIUS_KM, k: int = 10, offset: int = 0) -> DataFrame:
        require(lat=lat, lon=lon, feature=feature, radius=radius, k=k, offset=offset)
        return self.around(self._one(lat=lat, lon=lon), feature, radius, k, offset)


def responses(hits: DataFrame, order: str = "rank") -> DataFrame:
    """(query_id, body): one JSON object for each query, its page of hits in order under "data"; a page is as long as its limit at most."""
    hit = F.struct(F.col(order).alias("__order"), F.to_json(F.struct(*(c for c in hits.columns if c != "query_id"))).alias("row"))
    pages = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("x"))
    return pages.select("query_id", F.concat(F.lit('{"data":['), F.array_join("x.row", ","), F.lit("]}")).alias("body"))
