"""Quality by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics. Each class k has a mean and a covariance that is shrunk twice:
towards the covariance pooled over classes (share `LAMBDA`) and then towards a diagonal (share `GAMMA`). Its Cholesky
factor is inverted once and kept, so the Mahalanobis distance of a text is the length of one matrix product. The score is
the logistic function of the difference of the two log-densities plus that of the log-priors, scaled for calibration on
the sample.

Edge cases: null and empty texts have a vector, too (zeros before the transformation), and so a score; without labelled
rows of both classes all scores are the share of 1 among the labels (1/2 without any); repeated rows get equal scores; other
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import BLACK, bounded, runs, span_hashes, steps, utf8
from .langid import sampled
from .rules import LOWER, SYMBOLS, TERMINAL, UPPER, line_spans, repeats
from .store import Shelf

#: Expected number of labelled rows of a class that the model learns from: the bound of the training sample.
SAMPLE_ROWS = 10_000
LAMBDA, GAMMA = 0.1, 0.02
FEATURES = ("log_words", "word_length", "symbols", "capitals", "digits", "marks", "repeated_words", "repeated_lines", "top_word", "line_words", "endings", "bangs")
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text: shares are on a square-root scale, sizes on a log scale."""
    rows = len(offsets) - 1
    doc_of_byte = np.repeat(np.arange(rows), np.diff(offsets))
    starts, ends, doc = runs(BLACK[data], offsets)
    per = lambda x, w=None: np.bincount(x, w, minlength=rows).astype(float)
    count = lambda what: per(doc_of_byte[what[data]])
    words, chars = per(doc), per(doc, ends - starts)
    share = lambda a, b: np.sqrt(a / np.maximum(b, 1))
    h = span_hashes(data, starts, ends)
    later, _ = repeats(doc, h)
    s = np.lexsort((h, doc))
    edge = np.flatnonzero(np.append(True, (h[s][1:] != h[s][:-1]) | (doc[s][1:] != doc[s][:-1]))) if len(h) else np.zeros(0, np.int64)
    most = np.zeros(rows)
    np.maximum.at(most, doc[s][edge], np.diff(np.append(edge, len(h))))
    ls, le = line_spans(data, offsets)
    line_doc = np.searchsorted(offsets, ls, "right") - 1
    dup, _ = repeats(line_doc, span_hashes(data, ls, le))
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    upper, lower, lines = count(UPPER), count(LOWER), per(line_doc)
    return np.stack([
        np.log1p(words), np.log1p(chars / np.maximum(words, 1)), share(count(SYMBOLS), chars), share(upper, upper + lower), share(count(DIGITS), chars),
        share(per(doc[TERMINAL[last] | (last == 44)]), words), share(per(doc[later]), words), share(per(line_doc[dup]), lines), share(most, words),
        np.log1p(words / np.maximum(lines, 1)), share(per(doc[last == 46]), words), share(per(doc[last == 33]), words),
    ], 1)


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in steps(offsets):
                x = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = pa.array(np.arange(j - i + 1, dtype=np.int32) * np.int32(len(FEATURES)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["doc_id", "x"])

    return bounded(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, x array<double>")


@dataclass
class Discriminant:
    """Means, inverted Cholesky factors and log-determinants of the classes 0 and 1; a prior and a scale."""

    center: np.ndarray
    spread: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    prior: float
    scale: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.spread
        density = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets)]
        return density[1] - density[0] + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) * self.scale, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, prior: float, lam: float = LAMBDA, gamma: float = GAMMA) -> Discriminant:
    """prior: log-odds of class 1 among all labelled rows."""
    center, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - center) / spread
    means = [z[y == k].mean(0) for k in (0, 1)]
    scatter = [(z[y == k] - m).T @ (z[y == k] - m) for k, m in enumerate(means)]
    pooled = sum(scatter) / len(z)
    factors, logdets = [], []
    for k in (0, 1):
        own = scatter[k] / max(1, int((y == k).sum()))
        cov = (1 - lam) * own + lam * pooled
        cov = (1 - gamma) * cov + gamma * (np.trace(cov) / len(cov) * np.eye(len(cov)) + 1e-6 * np.eye(len(cov)))
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * float(np.log(np.diag(low)).sum()))
    model = Discriminant(center, spread, means, factors, logdets, prior)
    m = model.margin(x)  # the scale under which the sample is likeliest: densities that aren't quite normal are overconfident
    weight = np.where(y == 1, 1 / max(1, (y == 1).sum()) / (1 + np.exp(-prior)), 1 / max(1, (y == 0).sum()) / (1 + np.exp(prior)))
    model.scale = min((0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0), key=lambda s: float((weight * np.logaddexp(0, -np.where(y == 1, m, -m) * s)).sum()))
    return model


def scored(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for each row of docs; learns from the labelled rows for which `learn` (of doc_id) holds.

    One pass reads the texts; their vectors, 100 bytes each, go to the shelf and are joined with labels there.
    """
    vectors = Shelf(docs.sparkSession, "quality").put(featured(docs, id_col, text_col), "vectors")
    known = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(learn & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    model, flat = None, counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    rows = vectors.join(sampled(known, "y", "doc_id", SAMPLE_ROWS), "doc_id").select("x", "y").toPandas()
    if len(rows) and set(rows["y"]) == {0, 1}:
        model = fit(np.stack(rows["x"]), rows["y"].to_numpy(), float(np.log(counts[1] / counts[0])))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            p = shared.value.score(x) if shared.value is not None else np.full(len(x), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return vectors.mapInArrow(run, "doc_id bigint, score double, predicted int")
