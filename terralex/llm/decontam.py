"""Benchmark decontamination with a positional inverted index.

The index is a table in the shared folder, dealt by documents: a row holds a document's test terms and the sorted list of
positions of each. Terms are those of the benchmark only; others can't take part in a match. Counts of the test terms over
all documents and all matches come from that table; texts are read once. Rows of a batch are joined to a shard, which has
one sorted list for each term. A window of consecutive item words starts from the postings of its rarest term, shifted
by that term's offset, and is intersected with the shifted lists of the next rarer terms until nothing is left or all terms
agree. What is left are exact phrase matches. Documents are never shuffled.

Proximity matches are places where a window of `NEAR_WORDS` words or more stands with one word left out, one other word
in the place of an inner one, or one more word between two. One half of such a window is whole, so halves are looked up like
phrases, and the other half's lists are intersected at shifts of -1, 0 and 1. Exact matches count as proximity matches.

The benchmark's windows go to every task. A benchmark of more than `SLICE` bytes is dealt into slices of about that size by a
hash of the item's text. Each slice has an index and matches of its own, so no more than a slice is on the driver or in a
broadcast at once; a document's matched places and items of all slices are then put together.

Edge cases: null and empty texts have no words and are never hit; an item with fewer words than the window, but not
none, is one window; equal windows of several items count for each of them; the words that an item without an id hits are hit, but there is no
id to count or list; an empty benchmark hits nothing;
repeated rows get equal results; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import U64, apart, bounded, runs, span_hashes, steps, utf8
from .store import Shelf

#: Words of a window. Bytes of a benchmark whose windows are matched at once.
WINDOW, SLICE = 10, 2 << 20
#: Least words of a window with proximity matches: of a shorter one too little would be left. Most positions of a shard, but for a longer document.
NEAR_WORDS, MAX_PLACES = 5, 1 << 17


def is_word() -> np.ndarray:
    """Bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text whose A-Z are lower-cased."""
    out = np.zeros(256, bool)
    out[48:58] = out[65:91] = out[97:123] = out[128:] = True
    return out


WORD = is_word()


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, row after row, and where each row's begin."""
    starts, ends, rows = runs(WORD[data], offsets)
    return span_hashes(data, starts, ends, True), np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(offsets) - 1))])


@dataclass
class Phrases:
    """Distinct windows as rows of term numbers, a matrix for each length; `terms` are the sorted hashes of all test terms. The items of window k are who[at[k]:at[k+1]], indexes into ids."""

    terms: np.ndarray
    words: list[np.ndarray]
    at: list[np.ndarray]
    who: list[np.ndarray]
    ids: list[str | None]

    def order(self, counts: np.ndarray) -> list[np.ndarray]:
        """Offsets of each window's terms, from the rarest to the most common of the corpus."""
        return [rarest_first(w, counts) for w in self.words]


def rarest_first(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.argsort(counts[words], axis=1, kind="stable").astype(np.uint16)


def phrases(items: list[tuple[str | None, str]], window: int = WINDOW) -> Phrases:
    """The windows of (item_id, text) rows."""
    raw = [t.encode() for _, t in items]
    hashes, bounds = tokens(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    terms, number = np.unique(hashes, return_inverse=True)
    number, sizes = number.astype(np.int32), np.diff(bounds)
    out = Phrases(terms, [], [], [], [i for i, _ in items])
    for n in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
        own = np.flatnonzero(sizes >= window if n == window else sizes == n)
        count = sizes[own] - n + 1
        start = np.arange(count.sum()) + np.repeat(bounds[own] - np.cumsum(count) + count, count)
        rows, which = np.unique(number[start[:, None] + np.arange(n)], axis=0, return_inverse=True)
        pairs = np.unique(which.reshape(-1).astype(np.int64) * len(items) + np.repeat(own, count))
        out.words.append(rows)
        out.at.append(np.concatenate([[0], np.cumsum(np.bincount(pairs // len(items), minlength=len(rows)))]).astype(np.int32))
        out.who.append((pairs % len(items)).astype(np.int32))
    return out


@dataclass
class Halves:
    """The distinct first (sign 1) or last (sign -1) halves of windows; members[at[k]:at[k+1]] are the windows with half k."""

    sign: int
    words: np.ndarray
    order: np.ndarray
    at: np.ndarray
    members: np.ndarray

    @classmethod
    def of(cls, windows: np.ndarray, counts: np.ndarray, sign: int) -> Halves:
        cut = windows.shape[1] // 2
        words, which = np.unique(windows[:, :cut] if sign > 0 else windows[:, cut:], axis=0, return_inverse=True)
        which = which.reshape(-1)
        return cls(sign, words, rarest_first(words, counts), np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(words)))]).astype(np.int32), np.argsort(which, kind="stable").astype(np.int32))


def found_in(terms: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the hashes that are test terms, and the numbers of these terms."""
    if not len(terms):
        return (np.zeros(0, np.int64),) * 2
    place = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    where = np.flatnonzero(terms[place] == hashes)
    return where, place[where]


class Shard:
    """A positional inverted index over the words of some documents: postings of term t are order[at[t]:at[t+1]]."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, terms: np.ndarray) -> None:
        self._fill(*found_in(terms, hashes), bounds, len(terms))

    @classmethod
    def of(cls, where: np.ndarray, term: np.ndarray, bounds: np.ndarray, n_terms: int) -> Shard:
        """From stored postings; positions of one term ascend."""
        shard = cls.__new__(cls)
        shard._fill(where, term, bounds, n_terms)
        return shard

    def _fill(self, where: np.ndarray, term: np.ndarray, bounds: np.ndarray, n_terms: int) -> None:
        by = np.argsort(term, kind="stable")
        self.order = where[by]
        self.counts = np.bincount(term, minlength=n_terms)
        self.at = np.concatenate([[0], np.cumsum(self.counts)])
        self.bounds, self.span = bounds, int(bounds[-1]) + 1
        self.keys = term[by].astype(np.int64) * self.span + self.order

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1

    def has(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each position, from 0 to the number of words, is in the postings of its term."""
        key = term.astype(np.int64) * self.span + at
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[k] == key

    def phrase(self, words: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first position) of each place where all words of a window stand in order within one document."""
        size = words.shape[1]
        rarest = words[np.arange(len(words)), order[:, 0]]
        n = self.counts[rarest]
        live = np.flatnonzero(n)
        if not len(live):
            return (np.zeros(0, np.int64),) * 2
        n = n[live]
        w = np.repeat(live, n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = self.order[np.repeat(self.at[rarest[live]], n) + inner] - order[w, 0]
        ok = (start >= 0) & (start + size < self.span)
        w, start = w[ok], start[ok]
        for k in range(1, size):
            ok = self.has(words[w, order[w, k]], start + order[w, k])
            w, start = w[ok], start[ok]
        ok = self.doc_of(start) == self.doc_of(start + size - 1)
        return w[ok], start[ok]

    def close(self, windows: np.ndarray, halves: Halves) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first position, end) of each place that one half of a window stands in and the other but for one word."""
        size, known, sign = windows.shape[1], halves.words.shape[1], halves.sign
        k, start = self.phrase(halves.words, halves.order)
        n = halves.at[k + 1] - halves.at[k]
        w = halves.members[np.repeat(halves.at[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        # from here on, words are numbered away from the window's outer end: word 0 stands at base, word i at base + sign * i
        base = np.repeat(start if sign > 0 else start + known - 1, n)
        words, doc = windows[w][:, ::sign], self.doc_of(base)
        low, high = self.bounds[doc], self.bounds[doc + 1]

        def agree(shift: int) -> np.ndarray:
            at = base[:, None] + sign * (np.arange(known, size) + shift)
            inside = (at >= low[:, None]) & (at < high[:, None])
            return inside & self.has(words[:, known:].astype(np.int64), np.where(inside, at, 0))

        if not len(w):
            return (np.zeros(0, np.int64),) * 3
        left_out, same, added = (agree(shift) for shift in (-1, 0, 1))
        number = np.arange(known, size)[None, :]
        run = known + np.cumprod(same, axis=1).sum(axis=1)  # how many words agree before the first that doesn't
        past, whole = number > run[:, None], run == size
        kinds = [
            (size, whole | ((run < size - 1) & (same | ~past).all(axis=1))),
            (size - 1, ~whole & (left_out | ~past).all(axis=1)),
            (size + 1, (added | (number < np.minimum(run, size - 1)[:, None])).all(axis=1)),
        ]
        hits = [(w[ok], base[ok] if sign > 0 else base[ok] - length + 1, length) for length, ok in kinds]
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]), np.concatenate([h[1] + h[2] for h in hits])

    def merged(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, start, end) of the places [start, end) where those that overlap are one; starts and ends count from the document's."""
        if not len(start):
            return (np.zeros(0, np.int64),) * 3
        by = np.argsort(start, kind="stable")
        start, reach = start[by], np.maximum.accumulate(end[by])
        first = np.flatnonzero(np.append(True, start[1:] >= reach[:-1]))
        start, end = start[first], reach[np.append(first[1:], len(reach)) - 1]
        doc = self.doc_of(start)
        return doc, start - self.bounds[doc], end - self.bounds[doc]

    def near(self, a: int, b: int, within: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of positions of terms a and b, each a with the nearest later b, at most `within` words apart in one document."""
        x, y = (np.sort(self.order[self.at[t] : self.at[t + 1]]) for t in (a, b))
        k = np.searchsorted(y, x, "right")
        x, k = x[k < len(y)], k[k < len(y)]
        y = y[k]
        ok = (y - x <= within) & (self.doc_of(x) == self.doc_of(y))
        return x[ok], y[ok]


def indexed(picked: DataFrame, terms: np.ndarray) -> DataFrame:
    """The index: all columns but the last, a text, with n_words and the document's test terms by number, how often each occurs, and their positions, term after term."""
    shared = picked.sparkSession.sparkContext.broadcast(terms)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[:-1]) + "n_words bigint, terms array<int>, counts array<int>, positions array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            for i, j in steps(offsets):
                h, bounds = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                where, term = found_in(known, h)
                doc = np.searchsorted(bounds, where, "right") - 1
                key = doc * max(1, len(known)) + term
                by = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[by], prepend=-1))
                rows = np.arange(j - i + 1)
                ends = np.searchsorted(doc[by][first], rows)
                lists = [(ends, term[by][first]), (ends, np.diff(first, append=len(by))), (np.searchsorted(doc, rows), (where - bounds[doc])[by])]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), pa.array(np.diff(bounds)), *(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32())) for at, v in lists)], names=[*batch.schema.names[:-1], "n_words", "terms", "counts", "positions"])

    return bounded(picked).mapInArrow(run, schema)


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """How often each test term occurs in all documents. A task sends one number for each term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    counts = np.zeros(n_terms, np.int64)
    for r in bounded(index).select("terms", "counts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas().itertuples():
        counts[r.term] = r.n
    return counts


def postings(docs: DataFrame, terms: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, positions array<int>): the index itself, for the given terms."""
    raw = [t.encode() for t in terms]
    flat, ends = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    keys = span_hashes(flat, ends[:-1], ends[1:], True)
    order = np.argsort(keys)
    known, names = keys[order], [terms[i] for i in order]
    picked = bounded(docs).select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in steps(offsets):
                h, bounds = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                shard = Shard(h, bounds, known)
                out: list[tuple[str, int, list[int]]] = []
                for t in range(len(known)):
                    at = shard.order[shard.at[t] : shard.at[t + 1]]
                    doc = shard.doc_of(at)
                    for d in np.unique(doc):
                        out.append((names[t], i + int(d), (at[doc == d] - bounds[d]).tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), batch.column(0).take(pa.array([x[1] for x in out], pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.int32()))], names=["term", id_col, "positions"])

    return picked.mapInArrow(run, f"term string, `{id_col}` {picked.schema[0].dataType.simpleString()}, positions array<int>")


#: What a slice finds in a document: words [start, end) of exact matches and of all, items of exact and of proximity matches.
FOUND = "hits array<struct<start:int,end:int>>, close array<struct<start:int,end:int>>, items array<string>, near_items array<string>"


def matched(index: DataFrame, query: Phrases, counts: np.ndarray, n_keys: int, near: bool) -> DataFrame:
    """index's key columns and n_words with what the query finds in each document (`FOUND`)."""
    halves = [[Halves.of(w, counts, sign) for sign in (1, -1)] if near and w.shape[1] >= NEAR_WORDS else [] for w in query.words]
    shared, n_terms = index.sparkSession.sparkContext.broadcast((query, query.order(counts), halves)), len(query.terms)
    pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in index.schema.fields[: n_keys + 1]) + FOUND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, orders, both = shared.value
        for batch in batches:
            n_words, (terms_, counts_, positions) = batch.column(n_keys).to_numpy(), batch.columns[n_keys + 1 :]
            groups, places = (np.concatenate([[0], np.cumsum(np.diff(c.offsets.to_numpy()))]) for c in (terms_, positions))
            terms_, counts_, positions = (c.flatten().to_numpy() for c in (terms_, counts_, positions))
            found, close = ([set() for _ in range(batch.num_rows)] for _ in range(2))
            spans: tuple[list, list] = ([], [])
            for i, j in steps(places, MAX_PLACES):
                a, z = groups[i], groups[j]
                bounds = np.concatenate([[0], np.cumsum(n_words[i:j])])
                where = positions[places[i] : places[j]] + np.repeat(bounds[:-1], np.diff(places[i : j + 1]))
                shard = Shard.of(where, np.repeat(terms_[a:z], counts_[a:z]), bounds, n_terms)
                exact, loose = [], []
                for words, at, who, order, pieces in zip(p.words, p.at, p.who, orders, both):
                    w, start = shard.phrase(words, order)
                    seen = [(found, w, start, start + words.shape[1])] + [(close, *shard.close(words, h)) for h in pieces]
                    for names, w, start, end in seen:
                        (exact if names is found else loose).append((start, end))
                        for k, d in np.unique(np.stack([w, shard.doc_of(start)], 1), axis=0).tolist() if len(w) else ():
                            names[i + d].update(p.ids[x] for x in who[at[k] : at[k + 1]])
                for parts, out in ((exact, spans[0]), (exact + loose, spans[1])):
                    doc, start, end = shard.merged(*(np.concatenate(x) for x in zip(*parts))) if parts else (np.zeros(0, np.int64),) * 3
                    out.append((doc + i, start, end))
            lists = []
            for out in spans:
                doc, start, end = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
                ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], fields=list(pair))))
            named = [pa.array([sorted(x - {None}) for x in names], pa.list_(pa.string())) for names in (found, [x | y for x, y in zip(found, close)])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n_keys + 1], *lists, *named], names=[*batch.schema.names[: n_keys + 1], "hits", "close", "items", "near_items"])

    return bounded(index).mapInArrow(run, schema)


def covered(spans: Column) -> Column:
    """How many words stand in any of the spans."""
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("bigint").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["reach"], s["end"]).alias("reach"), (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["reach"]), F.lit(0))).alias("n"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: tuple[str, ...] = (), near: bool = True) -> DataFrame:
    """(id, *keep, n_words, n_hit, n_items, items_sha256, contaminated, items) for each row of docs; if `near`, also (n_near, near_items): words in and items of exact and proximity matches."""
    shelf = Shelf(docs.sparkSession, "decontam")
    columns = [id_col, *[c for c in keep if c not in (id_col, text_col)], *([text_col] if text_col in keep else [])]
    apart(columns, ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "n_near", "near_items"])
    keys = [f"c{k}" for k in range(len(columns))]
    rows = docs.select(*((F.col(c).cast("string") if c == text_col and k else F.col(c)).alias(f"c{k}") for k, c in enumerate(columns)), F.col(text_col).cast("string").alias("text"))
    own = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    n = max(1, -(-(own.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // SLICE))
    if n > 1:  # a row's matches in several slices meet by its number
        rows = shelf.put(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    parts = []
    for k in range(n):
        items = (own if n == 1 else own.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)).collect()
        query = phrases([(r["i"], r["t"]) for r in items], window)
        given = keys if n == 1 else ["row"]
        index = shelf.put(indexed(rows.select(*given, "text"), query.terms), f"postings-{k}")
        found = matched(index, query, term_counts(index, len(query.terms)) if len(query.terms) else np.zeros(0, np.int64), len(given), near)
        parts.append(found if n == 1 else shelf.put(found, f"found-{k}"))
    out = parts[0]
    if n > 1:
        for part in parts[1:]:
            out = out.unionByName(part)
        gathered = [F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "close")] + [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")]
        some = out.where(F.size("close") > 0).groupBy("row").agg(*gathered)
        empty = {c: F.coalesce(c, F.expr(f"cast(array() as {t})")).alias(c) for c, t in zip(("hits", "close", "items", "near_items"), ("array<struct<start:int,end:int>>",) * 2 + ("array<string>",) * 2)}
        out = rows.drop("text").join(parts[0].select("row", "n_words"), "row").join(some, "row", "left").select(*keys, "n_words", *empty.values())
    made = [covered(F.col("hits")).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), F.col("items")]
    made += [covered(F.col("close")).alias("n_near"), F.col("near_items")] if near else []
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, columns)), "n_words", *made)
