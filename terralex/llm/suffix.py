"""Removal of byte strings that already stand earlier in the corpus, by deep-shallow suffix sorting.

A suffix is compared on its first `length` bytes only, as a repeated string of that many bytes is what counts. Sorting all
suffixes of a corpus in one place can't be distributed, so they are dealt by content: the key of a window of `length` bytes
is the least hash of the `KMER`-byte strings in it, which equal windows share and which mostly stays the same from one window
to the next. So a document is a sequence of runs of windows with one key.

1. Keys that occur once in the corpus are found by counting, with partial counts from each batch; their windows need no sorting.
2. The other runs travel with their bytes to the bucket of their key. Runs of equal bytes are one, the earliest, and of a
   key that is frequent in a batch only windows that are new to the batch travel: step 3 is done there first.
3. In a bucket, deep-shallow sorting orders the windows. Multikey quicksort with 8-byte characters goes down to the depth
   `SHALLOW`. Groups that are still equal there have long common prefixes and are ordered by blind tries, all of them at once,
   level by level: members are compared with the group's reference leaf; where they part from it (position and byte) is the
   branch of the trie they go on in. Leaves are the classes of equal windows. All but a class's earliest window are removed.
4. Removed windows go back to their documents.

Order: smaller doc_id first (a null id before all others), then the earlier start.
Edge cases: null and empty texts have no bytes and texts shorter than `length` lose none; rows that share an id count as the
same document: they don't remove each other's bytes at equal places, and what is removed from one is removed at the same
places of the other; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import U64, bounded, mix, steps, utf8

#: Bytes of a string that counts as repeated; of the strings whose least hash deals windows out; depth of the first sort.
LENGTH, KMER, SHALLOW = 100, 32, 24
#: Bytes of text for each bucket.
BUCKET = 2 << 20
#: Different runs of a key in one batch from which on they are worked off before they travel.
COMBINE = 8

BYTES = mix((np.arange(256).astype(U64) + U64(1)) * U64(0xD1342543DE82EF95))


def keys_of(data: np.ndarray, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the k-mers, the key of the window at each start (windows across documents aren't told apart here), and k-mers of a window."""
    n = len(data)
    if n < length:
        return np.zeros(0, U64), np.zeros(0, U64), 1
    with np.errstate(over="ignore"):
        h, size = BYTES[data], 1
        while size < kmer:  # hashes of strings twice as long
            h = (h[:-size] * U64(0x9E3779B97F4A7C15)) ^ (h[size:] + (h[:-size] >> U64(29)))
            size *= 2
        own = h = mix(h)
    width, w = length - size + 1, 1
    while 2 * w <= width:
        h = np.minimum(h[:-w], h[w:])
        w *= 2
    return own, np.minimum(h[: n - length + 1], h[width - w : width - w + n - length + 1]), width


def key_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(key, row, first, last, twice) of each maximal run of windows of one row with one key; first and last are places in data.

    twice: the k-mer of the key stands in the run's bytes more than once, so windows may repeat within the run.
    """
    kmers, keys, width = keys_of(data, length)
    if not len(keys):
        return np.zeros(0, U64), *(np.zeros(0, np.int64),) * 3, np.zeros(0, bool)
    size = np.diff(offsets)
    rows = np.flatnonzero(size >= length)
    inside = np.zeros(len(keys) + 1, np.int64)
    np.add.at(inside, offsets[rows], 1)
    np.add.at(inside, offsets[rows] + size[rows] - length + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    turn = np.ones(len(keys), bool)
    turn[1:] = (keys[1:] != keys[:-1]) | ~valid[:-1]
    turn[offsets[rows]] = True
    first = np.flatnonzero(turn & valid)
    row = np.searchsorted(offsets, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(keys)) - 1, offsets[row + 1] - length)
    n = last - first + width
    begin = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(begin - first, n)
    twice = np.add.reduceat(kmers[place] == np.repeat(keys[first], n), begin, dtype=np.int64) > 1 if len(n) else np.zeros(0, bool)
    return keys[first], row, first, last, twice


def deep_shallow(raw: bytes, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings raw[s:s+length] (as indexes into starts), and for each string the place at which its class of equal ones begins in that order."""
    n = len(starts)
    data = np.frombuffer(raw, np.uint8)
    word = np.ndarray((max(0, len(raw) - 7),), ">u8", raw, strides=(1,))
    shallow = max(8, min(shallow, length - length % 8))
    order, group = np.arange(n), np.zeros(n, np.int64)  # group[i]: the place at which the group of order[i] begins
    live = np.arange(n) if n > 1 else np.zeros(0, np.int64)  # places whose group has several members that may differ

    def refine(by: np.ndarray, leaf: int | None = None) -> np.ndarray:
        """Sorts the live places inside their groups and splits groups where the key changes; what is left live."""
        s = np.lexsort((by, group[live]))
        k, g = by[s], group[live]
        order[live] = order[live[s]]
        new = np.ones(len(live), bool)
        new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        done = new & np.append(new[1:], True)
        return live[~(done if leaf is None else done | (k == leaf))]

    for d in range(0, shallow, 8):  # multikey quicksort, a character being 8 bytes
        if len(live):
            live = refine(word[starts[order[live]] + d].astype(U64))
    depths = [*range(shallow, length - 7, 8)]
    if (length - shallow) % 8:
        depths.append(length - 8)
    while len(live) and length > shallow:  # blind tries: a level of all of them at once
        own, ref = starts[order[live]], starts[order[group[live]]]
        lcp, same = np.full(len(live), length, np.int64), np.arange(len(live))
        for d in depths:
            x = word[own[same] + d].astype(U64) ^ word[ref[same] + d].astype(U64)
            hit = np.flatnonzero(x)
            if len(hit):
                top, at = x[hit], np.zeros(len(hit), np.int64)
                for s in (32, 16, 8):  # which of the eight bytes differs first
                    low = top >> U64(64 - s) == 0
                    at += np.where(low, s // 8, 0)
                    top = np.where(low, top << U64(s), top)
                lcp[same[hit]] = d + at
                same = same[x == 0]
        apart = np.flatnonzero(lcp < length)
        mine, its = data[own[apart] + lcp[apart]].astype(np.int64), data[ref[apart] + lcp[apart]].astype(np.int64)
        by = np.full(len(live), 1 << 32, np.int64)  # equal to the reference: between the branches below and above it
        by[apart] = np.where(mine < its, lcp[apart] << 8 | mine, (2 << 32) + ((length - lcp[apart]) << 8) + mine)
        live = refine(by, 1 << 32)
    classes = np.empty(n, np.int64)
    classes[order] = group
    return order, classes


def repeats(texts: list[bytes], rank: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(run, first, last): windows of each run of bytes, as places in it, that equal a window of a run of lower rank or an earlier one of its own.

    Runs are given with distinct bytes; windows of one run are in the order of their places.
    """
    order = np.argsort(rank, kind="stable")
    sizes = np.array([len(t) for t in texts], np.int64)[order]
    ends = np.cumsum(sizes)
    n = sizes - length + 1
    begin = np.cumsum(n) - n
    inner = np.arange(n.sum()) - np.repeat(begin, n)
    starts = np.repeat(ends - sizes, n) + inner
    classes = deep_shallow(b"".join(texts[i] for i in order), starts, length)[1]
    least = np.full(len(starts), len(starts), np.int64)
    np.minimum.at(least, classes, np.arange(len(starts)))
    gone = np.arange(len(starts)) > least[classes]
    run = np.repeat(np.arange(len(order)), n)
    edge = np.ones(len(gone), bool)
    edge[1:] = (gone[1:] != gone[:-1]) | (run[1:] != run[:-1])
    at = np.flatnonzero(edge)
    stop = np.append(at[1:], len(gone))
    return [(int(order[run[a]]), int(inner[a]), int(inner[a]) + int(b - a) - 1) for a, b in zip(at, stop) if gone[a]]


def earliest(held: dict[bytes, tuple[int, int]], text: bytes, me: tuple[int, int], gone: list[tuple[int, int, int]], length: int) -> None:
    """Keeps of runs with equal bytes the earliest place (doc, start); the windows of the other are removed."""
    if (other := held.setdefault(text, me)) != me:
        lo, hi = min(other, me), max(other, me)
        held[text] = lo
        gone.append((hi[0], hi[1], hi[1] + len(text) - length))


def combined(held: dict[bytes, tuple[int, int]], gone: list[tuple[int, int, int]], length: int) -> Iterator[tuple[bytes, tuple[int, int]]]:
    """What is left of runs when windows that equal an earlier one's are removed: shorter runs with their places."""
    texts, places = list(held), np.array(list(held.values()), np.int64)
    rank = np.empty(len(texts), np.int64)
    rank[np.lexsort((places[:, 1], places[:, 0]))] = np.arange(len(texts))
    at = [0] * len(texts)
    for r, a, b in repeats(texts, rank, length):
        doc, start = places[r].tolist()
        gone.append((doc, start + a, start + b))
        if a > at[r]:
            yield texts[r][at[r] : a - 1 + length], (doc, start + at[r])
        at[r] = b + 1
    for r, text in enumerate(texts):
        if at[r] <= len(text) - length:
            doc, start = places[r].tolist()
            yield text[at[r] :], (doc, start + at[r])


NULL_ID = -(1 << 63)


def _rows(buckets: list[int], *columns: list[bytes]) -> list[pa.Array]:
    return [pa.array(buckets, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)]


def counted_keys(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, keys binary): for documents with keys that occur twice or more in the corpus, those keys.

    A batch counts its own keys. What repeats in it is known at once and passes through; only one mark of it goes to the key's
    bucket, so a key that is in very many documents sends a row's worth from each batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = [key_runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in steps(offsets)]
            if not found:
                continue
            key = np.concatenate([f[0] for f in found])
            doc = ids[np.concatenate([f[1] + i for f, (i, _) in zip(found, steps(offsets))])]
            twice = np.concatenate([f[4] for f in found])
            s = np.lexsort((~twice, key))
            key, doc, twice = key[s], doc[s], twice[s]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            several = ~first | ~np.append(first[1:], True) | twice
            count = np.where(several, 2, 1)[first]
            # known: 2 passes through to the document's rows; counts by the key's bucket
            out: tuple[list[int], list[bytes], list[bytes], list[bytes]] = ([], [], [], [])
            for kind, k, d, c in ((0, key[first], doc[first], count), (1, key[several], doc[several], None)):
                b = (k >> U64(7)) % U64(buckets) if kind == 0 else (mix(d.astype(U64)) % U64(buckets))
                o = np.argsort(b, kind="stable")
                k, d, b = k[o], d[o], b[o]
                for lo, hi in zip(at := np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else [], [*at[1:], len(b)] if len(b) else []):
                    out[0].append(int(b[lo]))
                    out[1].append(k[lo:hi].tobytes())
                    out[2].append(d[lo:hi].tobytes())
                    out[3].append(c[o][lo:hi].astype(np.uint8).tobytes() if kind == 0 else b"")
            yield pa.RecordBatch.from_arrays(_rows(*out), names=["bucket", "keys", "docs", "counts"])

    def reduce(table: pa.Table) -> pa.Table:
        keys, ids, counts, known_k, known_d = [], [], [], [], []
        for k, d, c in zip(*(table.column(x).to_pylist() for x in ("keys", "docs", "counts"))):
            (keys if c else known_k).append(np.frombuffer(k, U64))
            (ids if c else known_d).append(np.frombuffer(d, np.int64))
            if c:
                counts.append(np.frombuffer(c, np.uint8))
        if keys:
            key, doc, n = np.concatenate(keys), np.concatenate(ids), np.concatenate(counts)
            s = np.argsort(key, kind="stable")
            key, doc, n = key[s], doc[s], n[s]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            total = np.repeat(np.add.reduceat(n.astype(np.int64), first), np.diff(np.append(first, len(key)))) if len(key) else n
            known_k.append(key[(total > 1) & (n == 1)])
            known_d.append(doc[(total > 1) & (n == 1)])
            # a key that repeats in a batch is known there already, but the batch's other documents are, too
        key = np.concatenate([*known_k, np.zeros(0, U64)])
        doc = np.concatenate([*known_d, np.zeros(0, np.int64)])
        s = np.lexsort((key, doc))
        key, doc = key[s], doc[s]
        edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        return pa.table({"doc_id": pa.array(doc[edge]), "keys": pa.array([np.unique(key[a:b]).tobytes() for a, b in zip(edge, [*edge[1:], len(doc)])], pa.binary())})

    packed = docs.mapInArrow(run, "bucket int, keys binary, docs binary, counts binary")
    return packed.groupBy("bucket").applyInArrow(reduce, "doc_id bigint, keys binary")


def removed(docs: DataFrame, keys: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """(doc_id, spans binary): first and last starts of the removed windows, as pairs of int64, in rows of any number for a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = [np.frombuffer(b"".join(x), U64) for x in batch.column(2).to_pylist()]
            found: dict[int, dict[bytes, tuple[int, int]]] = {}
            gone: list[tuple[int, int, int]] = []
            for i, j in steps(offsets):
                raw = data[offsets[i] : offsets[j]]
                key, row, first, last, _ = key_runs(raw, offsets[i : j + 1] - offsets[i], length)
                edge = np.searchsorted(row, np.arange(j - i + 1))
                for r in range(j - i):
                    a, b = edge[r], edge[r + 1]
                    if b > a and len(lists[i + r]):
                        known, at = np.sort(lists[i + r]), int(offsets[i + r] - offsets[i])
                        for x in a + np.flatnonzero(known[np.minimum(np.searchsorted(known, key[a:b]), len(known) - 1)] == key[a:b]):
                            earliest(found.setdefault(int(key[x]), {}), raw[first[x] : last[x] + length].tobytes(), (int(ids[i + r]), int(first[x]) - at), gone, length)
            out: tuple[list, ...] = ([], [], [], [], [])
            by: dict[int, list[tuple[bytes, tuple[int, int]]]] = {}
            for key, held in found.items():
                # a key that is frequent here is worked off here: only windows that are new to the batch travel
                by.setdefault((key >> 7) % buckets, []).extend(combined(held, gone, length) if len(held) >= COMBINE else held.items())
            for k, runs_ in by.items():
                out[0].append(k)
                out[1].append(np.array([m[0] for _, m in runs_], np.int64).tobytes())
                out[2].append(np.array([m[1] for _, m in runs_], np.int64).tobytes())
                out[3].append(np.array([len(t) for t, _ in runs_], np.int64).tobytes())
                out[4].append(b"".join(t for t, _ in runs_))
            if gone:  # negative buckets only pass on what is removed already
                out[0].append(-1 - gone[0][0] % buckets)
                out[1].append(np.array([g[0] for g in gone], np.int64).tobytes())
                out[2].append(np.array([g[1:] for g in gone], np.int64).tobytes())
                out[3].append(b"")
                out[4].append(b"")
            yield pa.RecordBatch.from_arrays(_rows(*out), names=["bucket", "docs", "firsts", "sizes", "texts"])

    def reduce(table: pa.Table) -> pa.Table:
        held: dict[bytes, tuple[int, int]] = {}
        gone: list[tuple[int, int, int]] = []
        for d, f, n, t in zip(*(table.column(x).to_pylist() for x in ("docs", "firsts", "sizes", "texts"))):
            if not n:
                gone += [(doc, *pair) for doc, pair in zip(np.frombuffer(d, np.int64).tolist(), np.frombuffer(f, np.int64).reshape(-1, 2).tolist())]
                continue
            at = 0
            for doc, start, size in zip(*(np.frombuffer(x, np.int64).tolist() for x in (d, f, n))):
                earliest(held, t[at : at + size], (doc, start), gone, length)
                at += size
        if held:
            for _ in combined(held, gone, length):
                pass
        by: dict[int, list[int]] = {}
        for doc, a, b in gone:
            by.setdefault(doc, []).extend((a, b))
        return pa.table({"doc_id": pa.array(list(by), pa.int64()), "spans": pa.array([np.array(x, np.int64).tobytes() for x in by.values()], pa.binary())})

    lists = keys.groupBy("doc_id").agg(F.collect_list("keys").alias("keys"))
    packed = docs.join(lists, "doc_id").select("doc_id", "text", "keys").mapInArrow(run, "bucket int, docs binary, firsts binary, sizes binary, texts binary")
    return packed.groupBy("bucket").applyInArrow(reduce, "doc_id bigint, spans binary")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary, spans array<struct<start,end>>) for each row. Without `text`, no kept bytes and spans."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))  # a bucket's bytes stay the same as the corpus grows
    rows = bounded(docs).select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = removed(rows, counted_keys(rows, buckets), buckets).groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary, spans array<struct<start:bigint,end:bigint>>" * text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out: list[list] = [[] for _ in range(6)]
            for i, x in enumerate(batch.column(2).to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                merged: list[list[int]] = []
                for a, b in sorted(np.frombuffer(b"".join(x or []), np.int64).reshape(-1, 2).tolist()):
                    a, b = min(a, len(own)), min(b + LENGTH, len(own))
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    elif b > a:
                        merged.append([a, b])
                edges = [0, *(e for m in merged for e in m), len(own)]
                kept = b"".join(own[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2]))
                for column, value in zip(out, (len(own), len(own) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in merged])):
                    column.append(value)
            arrays = [pa.array(out[k], pa.int64()) for k in range(3)] + [pa.array(out[3], pa.string())]
            if text:
                arrays += [pa.array(out[4], pa.binary()), pa.array(out[5], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] * text)])

    out = rows.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
