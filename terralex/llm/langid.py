"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of orders 0 to 3. A node's statistics give a byte seen there n / (N + D), with
N bytes and D different ones, and the escape D / (N + D); an escape goes to the node without the oldest byte, in which
the bytes seen before are excluded and the others' probabilities are scaled to one. Below order 0 all bytes are alike.
The statistics are frozen after fitting, so a text's code length is the exact sum over its bytes of -log2 P(byte | context).
The language with the shortest code wins.

A tree is kept as sorted arrays: the bits of each string of bytes that was seen, and for each node the bits of an escape from
it, from which what it excludes is taken off already. A byte that a node hasn't seen costs these and its bits in the next
shorter context. A context that was never seen costs nothing and gives way to its longest suffix that was (the order is
variable). Trees are fitted apart from one another, one task a language, and no node is left out.

Edge cases: text that is null or has no letter gets `und` and score 0; ties go to the first language in sorted order;
with nothing to learn from, all is `und`; repeated rows get equal results; other columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import apart, bounded, steps, utf8

#: Expected number of documents of a language that the model learns from, and most languages: the bounds of the training sample.
SAMPLE_DOCS, MOST_LANGS = 1500, 1000
#: Orders of the contexts.
ORDERS = range(4)


def sampled(rows: DataFrame, by: str, id_col: str, each: int, most: int = MOST_LANGS) -> DataFrame:
    """About `each` rows of every value of `by`, chosen by a hash of the id, with one narrow count before. Of more values than `most`, the most frequent ones.

    The share kept of a value is each / its count, so the expected size is bounded and no row is moved to choose it.
    """
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(most).collect()}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))]) if counts else None
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.where(draw < share[F.col(by)]) if share is not None else rows.limit(0)


def contexts(data: np.ndarray, offsets: np.ndarray, pad: int) -> list[np.ndarray]:
    """For each byte the one, two and three places before it, `pad` before a row's start."""
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    out, x = [], data
    for _ in range(3):
        y = np.empty_like(x)
        y[1:] = x[:-1]
        y[first] = pad
        out.append(y)
        x = y
    return out


def count_grams(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, gram, n): how often a byte (lowest 8 bits of gram) follows three others. Partial counts leave each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                parts: dict[int, int] = {}
                for i in np.flatnonzero(langs == lang):
                    x = data[offsets[i] : offsets[i + 1]].astype(np.int64)
                    if len(x):
                        a, b, c = contexts(x, np.array([0, len(x)]), 0)
                        grams, n = np.unique(c << 24 | b << 16 | a << 8 | x, return_counts=True)
                        for g, k in zip(grams.tolist(), n.tolist()):
                            parts[g] = parts.get(g, 0) + k
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts), pa.string()), pa.array(list(parts), pa.int64()), pa.array(list(parts.values()), pa.int64())], names=["lang", "gram", "n"])

    rows = bounded(docs).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """One language's contexts. Of order k, `grams[k]` are strings of k + 1 bytes (the context and the byte after it) with `bits`, `nodes[k]` are contexts with `escapes`; both are sorted numbers."""

    grams: list[np.ndarray]
    bits: list[np.ndarray]
    nodes: list[np.ndarray]
    escapes: list[np.ndarray]

    def cost(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each string of four."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for k in reversed(ORDERS):
            own = codes[open_] & ((1 << 8 * (k + 1)) - 1)
            at, hit = found(self.grams[k], own)
            out[open_[hit]] += self.bits[k][at[hit]]
            open_, own = open_[~hit], own[~hit]
            at, hit = found(self.nodes[k], own >> 8)
            out[open_[hit]] += self.escapes[k][at[hit]]
        out[open_] += 8
        return out


def found(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values in a sorted array, and which of them are there."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at, known[at] == values


def fit(code: np.ndarray, n: np.ndarray) -> Tree:
    """The tree of strings of four bytes (as numbers) that were seen n times."""
    grams, bits, nodes, escapes = [], [], [], []
    shorter, chance = np.arange(256), np.full(256, 1 / 256)
    for k in ORDERS:
        own, at = np.unique(code & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        times = np.bincount(at, n)
        contexts_, of = np.unique(own >> 8, return_inverse=True)
        total, kinds = np.bincount(of, times), np.bincount(of).astype(float)
        low = chance[np.searchsorted(shorter, own & ((1 << 8 * k) - 1 if k else 255))]
        left = 1 - np.bincount(of, low)
        kinds = np.where((kinds < 256) & (left > 1e-12), kinds, 0)
        p = times / (total + kinds)[of]
        some = kinds > 0
        escape = np.where(some, kinds / (total + kinds) / np.where(some, left, 1), 1)
        grams.append(own)
        bits.append(-np.log2(p))
        nodes.append(contexts_)
        escapes.append(-np.log2(escape))
        shorter, chance = own, p
    return Tree(grams, bits, nodes, escapes)


@dataclass
class Model:
    """Frozen statistics of each language."""

    langs: list[str]
    trees: list[Tree]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each row under each language. Each string of four bytes of a step is looked up once."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for i, j in steps(offsets):
            own = offsets[i : j + 1] - offsets[i]
            if own[-1]:
                x = data[offsets[i] : offsets[j]].astype(np.uint32)
                c1, c2, c3 = contexts(x, own, 0)
                codes, at = np.unique(c3 << 24 | c2 << 16 | c1 << 8 | x, return_inverse=True)
                table = np.stack([t.cost(codes.astype(np.int64)) for t in self.trees], 1)
                full = np.flatnonzero(own[1:] > own[:-1])
                out[i + full] = np.add.reduceat(table[at], own[:-1][full], axis=0)
        return out


def fitted(grams: DataFrame) -> DataFrame:
    """(lang, kind, codes, bits) of (lang, gram, n): each language's arrays, two rows for each order."""

    def run(table: pa.Table) -> pa.Table:
        tree = fit(table.column("gram").to_numpy(), table.column("n").to_numpy().astype(float))
        rows = [(table.column("lang")[0].as_py(), 2 * k + e, c, b) for k in ORDERS for e, (c, b) in enumerate(((tree.grams[k], tree.bits[k]), (tree.nodes[k], tree.escapes[k])))]
        return pa.table({"lang": [r[0] for r in rows], "kind": pa.array([r[1] for r in rows], pa.int32()), "codes": [r[2].astype("<i8").tobytes() for r in rows], "bits": [r[3].astype("<f8").tobytes() for r in rows]})

    return grams.groupBy("lang").applyInArrow(run, "lang string, kind int, codes binary, bits binary")


def train(docs: DataFrame, where: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each: int = SAMPLE_DOCS) -> Model | None:
    """A model of the documents that `where` holds for and that have text and a language. Trees come to the driver: their size is bounded by the sample."""
    rows = docs.where(where & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    parts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for r in fitted(count_grams(sampled(rows, "lang", id_col, each), "lang", "text")).collect():
        parts.setdefault(r["lang"], {})[r["kind"]] = (np.frombuffer(r["codes"], "<i8"), np.frombuffer(r["bits"], "<f8"))
    langs = sorted(parts)
    column = lambda p, kind, c: [p[2 * k + kind][c] for k in ORDERS]
    return Model(langs, [Tree(column(p, 0, 0), column(p, 0, 1), column(p, 1, 0), column(p, 1, 1)) for p in map(parts.get, langs)]) if langs else None


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score, bits_per_byte) for each row. score is the posterior of the language under equal priors, tempered so that a byte counts as much as in a text of 64 bytes at most."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    text = F.col(text_col).cast("string")
    columns = [id_col, *[c for c in keep if c not in (id_col, text_col)]]
    with_text = int(text_col in keep)
    apart([*columns, *keep], ["lang_pred", "score", "bits_per_byte"])
    picked = bounded(docs).select(*columns, text.alias("__text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-2]) + f", `{text_col}` string" * with_text + ", lang_pred string, score double, bits_per_byte double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            letters = np.array(batch.column(batch.num_columns - 1).to_pylist(), bool)
            names, score, rate = np.full(len(letters), "und", object), np.zeros(len(letters)), np.zeros(len(letters))
            if m is not None and len(letters):
                data, offsets = utf8(batch.column(batch.num_columns - 2))
                bits, size = m.lengths(data, offsets), np.maximum(np.diff(offsets), 1)
                best = bits.argmin(1)
                odds = np.exp2(-(bits - bits.min(1, keepdims=True)) * np.minimum(1, 64 / size)[:, None])
                names[letters] = np.array(m.langs, object)[best[letters]]
                score[letters] = (1 / odds.sum(1))[letters]
                rate[letters] = (bits.min(1) / size)[letters]
            own = [(text_col, batch.column(batch.num_columns - 2))] * with_text
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(c for _, c in own), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(rate)], names=[*batch.schema.names[:-2], *(n for n, _ in own), "lang_pred", "score", "bits_per_byte"])

    return picked.mapInArrow(run, schema)
