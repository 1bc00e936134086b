"""Near duplicates by HyperMinHash.

A document's set of word shingles is dealt over K buckets. A bucket keeps of its least hash only the count of leading
zeros and the next few bits after the first one: a register of two bytes. An empty bucket borrows from the first full one in
a fixed random order of its own, so registers of two sets agree about as often as the sets' Jaccard similarity J.
Registers are banded: equal bands make candidates. A pair's J is then estimated from the share of equal registers,
corrected for registers that agree by accident because they are short, and pairs far below the threshold are left out
(six standard errors, which a pair at the threshold misses with probability 5e-9). The rest is verified on the full sets.

Equal sets are one class from the start, by a 128-bit sum over the set; a set of one shingle has a digest of its words in it. A band isn't expanded into all its pairs. Its
members are first tried against one of them, and links make components. Only members of one band that are in different
components are still open. Small bands are joined; larger ones that fit into a block are one group each, and of those that don't,
two blocks of members are. A group is compared as matrices of registers and sends out links only. So no link that the bands show
is lost. A block has at most about `BLOCK` members and `BLOCK_SHINGLES` shingles, so a group's memory is bounded. A member of a band
of one block is sent once, one of a larger band to a group for each block of the others: from there on rows grow with the
square of a band's open members, divided by the size of a block. With 48 bands of 4 registers a
pair at J = 0.75 shares no band with probability (1 - 0.75**4)**48 = 1.2e-8.

Edge cases: null and empty texts and texts without words have an empty set and are linked with nothing; a null id is
linked with nothing and has no component; rows of one id share a component, as what one of its texts is linked with can be
reached from the others; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import BLACK, LOWERED, U64, bounded, mix, runs, span_hashes, steps, utf8
from .graph import components
from .store import Shelf

#: Words of a shingle; least similarity as a percentage; registers, registers of a band, bits kept after the first one.
WORDS, PERCENT, REGISTERS, ROWS, MANTISSA = 5, 75, 192, 4, 10
#: Members of a band that meet at once, and their shingles: registers of 400 bytes and texts are all that a group holds of them.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row, one row after another, and their offsets."""
    starts, ends, rows = runs(BLACK[data], offsets)
    h = span_hashes(data, starts, ends, True)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    at = np.concatenate([[0], np.cumsum(n)])
    with np.errstate(over="ignore"):
        keys = [mix(np.array([k], U64))[0] | U64(1) for k in range(1, words + 1)]
        sums = np.zeros(len(h), U64)
        for k in range(words):
            sums[: len(h) - k] += h[k:] * keys[k] if len(h) >= k else U64(0)
        grams = mix(sums)
    out, sizes = [], np.zeros(len(n), np.int64)
    for i in np.flatnonzero(n):
        a, b = at[i], at[i + 1]
        if b - a >= words:
            s = np.sort(grams[a : b - words + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:  # fewer words: the whole sequence is one shingle
            with np.errstate(over="ignore"):
                s = mix((h[a:b] * np.array(keys[: b - a])).sum(keepdims=True) + U64(b - a))
        out.append(s)
        sizes[i] = len(s)
    return np.concatenate(out) if out else np.zeros(0, U64), np.concatenate([[0], np.cumsum(sizes)])


def borrow_orders(k: int) -> np.ndarray:
    """For each bucket the order in which it looks for a full one."""
    return np.argsort(mix(np.arange(k * k, dtype=U64) + U64(0x5EED)).reshape(k, k), axis=1)


def registers(values: np.ndarray, offsets: np.ndarray, k: int = REGISTERS, bits: int = MANTISSA, orders: np.ndarray | None = None) -> np.ndarray:
    """uint16 registers (rows x k) of sets; rows of empty sets are zero."""
    n = len(offsets) - 1
    least = np.full(n * k, ~U64(0))
    rows = np.repeat(np.arange(n), np.diff(offsets))
    np.minimum.at(least, rows * k + ((values >> U64(20)) % U64(k)).astype(np.int64), mix(values ^ U64(0xA5A5A5A5DEADBEEF)))
    high = (least >> U64(11)).astype(np.float64)
    zeros = np.where(high > 0, 53 - np.frexp(high)[1], 53).astype(np.int64)
    zeros = np.minimum(zeros, 63 - bits)
    tail = (least << (zeros + 1).astype(U64)) >> U64(64 - bits)
    out = (zeros.astype(np.uint16) << bits | tail.astype(np.uint16)).reshape(n, k)
    full = (least != ~U64(0)).reshape(n, k)
    orders = borrow_orders(k) if orders is None else orders
    for i in np.flatnonzero(~full.all(1) & full.any(1)):
        empty = np.flatnonzero(~full[i])
        out[i, empty] = out[i, orders[empty, full[i][orders[empty]].argmax(1)]]
    out[~full.any(1)] = 0
    return out


def spread(n: np.ndarray, k: int = REGISTERS) -> np.ndarray:
    """For sets of n shingles the probability of each number of leading zeros of a register."""
    a, z = np.maximum(n / k, 1)[:, None], np.arange(40)
    return np.exp(-a * 2.0 ** -(z + 1)) - np.exp(-a * 2.0**-z)


def accident(n: np.ndarray, m: np.ndarray, k: int = REGISTERS, bits: int = MANTISSA) -> np.ndarray:
    """Probability that registers of unlike least hashes agree, for sets of n and m shingles."""
    return (spread(n, k) * spread(m, k)).sum(1) / 2**bits


def only(raw: np.ndarray, words: int) -> int:
    """Digest of the first words of a text, in lower case."""
    starts, ends, _ = runs(BLACK[raw], np.array([0, len(raw)]))
    return int.from_bytes(hashlib.blake2b(b" ".join(LOWERED[raw[a:b]].tobytes() for a, b in zip(starts[:words], ends[:words])), digest_size=8).digest(), "little")


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two unlike sets are similar enough. Sets of one shingle aren't: equal ones are one class already."""
    if len(x) == 1 or len(y) == 1:
        return False
    s = np.sort(np.concatenate([x, y]))
    common = int((s[1:] == s[:-1]).sum())
    return common > 0 and 100 * common >= PERCENT * (len(s) - common)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, mark, n_shingles, set_id, registers) of each row. mark is a hash of the text; set_id is equal for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = borrow_orders(REGISTERS)
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in steps(offsets):
                own = offsets[i : j + 1] - offsets[i]
                values, at = shingle_sets(data[offsets[i] : offsets[j]], own, words)
                regs, n = registers(values, at, orders=orders), np.diff(at)
                full = np.flatnonzero(n)
                ids = np.zeros((j - i, 2), U64)
                if len(full):
                    with np.errstate(over="ignore"):
                        ids[full, 0] = np.add.reduceat(mix(values), at[:-1][full])
                        ids[full, 1] = np.add.reduceat(mix(values ^ U64(0x0123456789ABCDEF)), at[:-1][full])
                for r in np.flatnonzero(n == 1):  # one hash would have to tell such a set from all others
                    ids[r, 1] = only(data[offsets[i + r] : offsets[i + r + 1]], words)
                pack = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.itemsize * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:2]), pa.array(n, pa.int64()), pack(ids), pack(regs)], names=["doc_id", "mark", "n_shingles", "set_id", "registers"])

    return bounded(texts(docs, id_col, text_col)).mapInArrow(run, "doc_id bigint, mark bigint, n_shingles bigint, set_id binary, registers binary")


def bands(reps: DataFrame) -> DataFrame:
    """(band, key, cid, id, n): one row for each band of each class."""
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("registers"), b * width + 1, F.lit(width))))
    return reps.select(F.posexplode(keys).alias("band", "key"), "cid", "id", "n")


def near(nx: pa.Array, ny: pa.Array, rx: pa.Array, ry: pa.Array) -> np.ndarray:
    """Whether the estimates of pairs are at most six standard errors below the threshold."""
    t = PERCENT / 100
    a, b = (np.frombuffer(utf8(r)[0].tobytes(), np.uint16).reshape(-1, REGISTERS) for r in (rx, ry))
    n, m = (x.to_numpy(zero_copy_only=False).astype(float) for x in (nx, ny))
    e = accident(n, m)
    return ((a == b).mean(1) - e) / (1 - e) >= t - 6 * np.sqrt(t * (1 - t) / np.minimum(REGISTERS, np.minimum(n, m)))


def checked(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of the pairs (x, y, a, b) of classes x and y with 100 * |X and Y| >= PERCENT * |X or Y|: estimated on the registers, then verified on the full sets."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"), F.col("text").alias(f"t{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.filter(pa.array(near(*(batch.column(c) for c in range(2, 6)))))
            (da, oa), (db, ob) = utf8(batch.column(6)), utf8(batch.column(7))
            good = np.zeros(batch.num_rows, bool)
            for i, j in steps(oa + ob):
                (va, pa_), (vb, pb) = (shingle_sets(d[o[i] : o[j]], o[i : j + 1] - o[i]) for d, o in ((da, oa), (db, ob)))
                for k in range(j - i):
                    good[i + k] = linked(va[pa_[k] : pa_[k + 1]], vb[pb[k] : pb[k + 1]])
            yield batch.select([0, 1]).filter(pa.array(good))

    both = pairs.join(side("y"), "y").join(side("x"), "x")
    return both.select("a", "b", "nx", "ny", "rx", "ry", "tx", "ty").mapInArrow(run, "a bigint, b bigint")


def similar_size(x: str, y: str) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * PERCENT


def estimated(met: DataFrame) -> DataFrame:
    """(x, y, a, b) of the pairs (x, y, a, b, nx, ny, rx, ry) whose registers rx and ry don't speak against the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select([0, 1, 2, 3]).filter(pa.array(near(*(batch.column(c) for c in range(4, 8)))))

    return met.select("x", "y", "a", "b", "nx", "ny", "rx", "ry").mapInArrow(run, "x bigint, y bigint, a bigint, b bigint")


def few(rows: DataFrame) -> DataFrame:
    """Pairs (x, y) of classes of different components a and b in bands of `BLOCK` / 64 open members at most: not more pairs than a fixed number of times the rows."""
    small = rows.where(F.col("size") <= BLOCK // 64)
    one, two = (small.select("key", F.col("cid").alias(x), F.col("c").alias(c), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}")) for x, c in (("x", "a"), ("y", "b")))
    return estimated(one.join(two, "key").where((F.col("x") < F.col("y")) & (F.col("a") != F.col("b")) & similar_size("nx", "ny"))).distinct()


def dealt(rows: DataFrame) -> DataFrame:
    """Members of larger bands, once for each group (led, x, y) that they are in.

    A band's members are those of its leading component and the rest. If all fit into one block, the band is a group. Otherwise
    both are cut into blocks by a hash of the class, so a group is two blocks, whatever the band's size: the rest meets itself and
    the leading component, which needn't meet itself.
    """
    large = rows.where(F.col("size") > BLOCK // 64)
    led = F.col("c") == F.col("lead")
    need = lambda which: F.greatest(F.ceil(F.count_if(which) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")
    counts = large.groupBy("key").agg(need(~led).alias("rest"), need(led).alias("led"), (need(F.lit(True)) == 1).alias("alone"))
    part = lambda k: F.pmod(F.xxhash64("cid"), k).cast("int")
    group = lambda kind, x, y: F.struct(F.lit(kind).alias("led"), x.alias("x"), y.alias("y"))
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    own_rest, own_led = part(F.greatest(F.col("rest"), F.lit(1))), part(F.greatest(F.col("led"), F.lit(1)))
    together = F.array(group(False, F.lit(0), F.lit(0)))
    of_rest = F.concat(F.transform(upto(F.col("rest")), lambda t: group(False, F.least(t, own_rest), F.greatest(t, own_rest))), F.transform(upto(F.col("led")), lambda m: group(True, own_rest, m)))
    of_led = F.transform(upto(F.col("rest")), lambda t: group(True, t, own_led))
    out = large.join(counts, "key").select("key", "band", "cid", "c", "n", "registers", F.when(led, -1).otherwise(own_rest).alias("own"), F.explode(F.when(F.col("alone"), together).when(led, of_led).otherwise(of_rest)).alias("g"))
    return out.select("key", "g.led", "g.x", "g.y", "band", "cid", "c", "own", "n", "registers")


def blocks(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between different components a and b in larger bands.

    Within a group, registers are compared as matrices; a pair is looked at in its first common band only, and not at all
    once the two components are linked there. What passes is verified on the full sets, and only links come out.
    """
    met = dealt(rows).join(classes.select("cid", "text"), "cid").drop("cid")

    def meet(table: pa.Table) -> pa.Table:
        led, x, y, band = (table.column(c)[0].as_py() for c in ("led", "x", "y", "band"))
        comp, own, n = (table.column(c).to_numpy() for c in ("c", "own", "n"))
        regs = np.frombuffer(utf8(table.column("registers"))[0].tobytes(), np.uint16).reshape(-1, REGISTERS)
        keys = regs.view(np.uint64).reshape(len(regs), -1)
        data, offsets = utf8(table.column("text"))
        left = np.flatnonzero(own == x)
        right = np.flatnonzero((own == -1) | (own == y) & (not led))  # groups of two blocks of the rest have no -1
        sets: dict[int, np.ndarray] = {}

        def full(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_sets(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))[0]
            return sets[i]

        t, joined, chance = PERCENT / 100, set(), spread(n.astype(float))
        for i in left:
            others = right[(right > i) | (own[right] == -1)] if x == y else right
            others = others[(comp[others] != comp[i]) & (100 * np.minimum(n[others], n[i]) >= PERCENT * np.maximum(n[others], n[i]))]
            if not len(others):
                continue
            others = others[(keys[others] == keys[i]).argmax(1) == band]
            e = chance[others] @ chance[i] / 2**MANTISSA
            j = ((regs[others] == regs[i]).mean(1) - e) / (1 - e)
            for o in others[j >= t - 6 * np.sqrt(t * (1 - t) / np.minimum(REGISTERS, np.minimum(n[others], n[i])))]:
                if (pair := (min(comp[i], comp[o]), max(comp[i], comp[o]))) not in joined and linked(full(i), full(o)):
                    joined.add(pair)
        return pa.table({"a": pa.array([f[0] for f in joined], pa.int64()), "b": pa.array([f[1] for f in joined], pa.int64())})

    return met.groupBy("key", "led", "x", "y").applyInArrow(meet, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row: the least id of its group, and whether it is the row's own."""
    shelf = Shelf(docs.sparkSession, "minhash")
    # a shelf holds 400 bytes a document, and whole texts only of documents that share a band with another
    rows = shelf.put(sketch(docs, id_col, text_col), "sketch")
    members = rows.where("n_shingles > 0 and doc_id is not null")
    least = members.groupBy("n_shingles", "set_id").agg(F.min(F.struct("doc_id", "mark", "registers")).alias("x"))
    # a class has a number of its own (cid), as one id may have several texts, and goes by its least id in links
    reps = shelf.put(least.select(F.monotonically_increasing_id().alias("cid"), F.col("x.doc_id").alias("id"), "x.mark", F.col("n_shingles").alias("n"), "set_id", "x.registers"), "reps")
    keyed = bands(reps)
    shared = keyed.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi").select("key")
    multi = shelf.put(keyed.join(shared, "key"), "multi")
    held = texts(docs, id_col, text_col).withColumnRenamed("doc_id", "id")
    classes = shelf.put(reps.drop("set_id").join(multi.select("cid").distinct(), "cid").join(held, ["id", "mark"]).dropDuplicates(["id", "mark"]).select("cid", "n", "registers", "text"), "classes")
    # first, each member of a band against the least one: nearly all links of near copies show here
    pivots = multi.groupBy("key").agg(F.min(F.struct("id", "cid", "n")).alias("p"))
    pairs = multi.join(pivots, "key").where((F.col("cid") != F.col("p.cid")) & similar_size("n", "p.n")).select(F.col("p.cid").alias("x"), F.col("cid").alias("y"), F.col("p.id").alias("a"), F.col("id").alias("b")).distinct()
    links = checked(pairs, classes)
    several, seen = shelf.measured(members.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "set_id")).alias("lo"), F.max(F.struct("n_shingles", "set_id")).alias("hi")).where("lo != hi").select("doc_id"), "several", n=F.count(F.lit(1)))
    grouped = components(links.unionByName(same_ids(members, several, reps)) if seen["n"] else links, shelf, "near")
    # then what is open: members of one band in different components
    now = multi.join(grouped, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component", "id")
    mixed = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("cid"), "c")).alias("p")).where("lo < hi").select("key", "size", F.col("p.c").alias("lead"))
    rest = shelf.put(now.join(mixed, "key").join(reps.select("cid", "registers"), "cid"), "open")
    more = components(checked(few(rest), classes).unionByName(blocks(rest, classes)), shelf, "all").select(F.col("id").alias("c"), F.col("component").alias("final"))
    shelf.drop("multi", "classes", "open", "several")
    labels = reps.join(grouped, "id", "left").withColumn("c", F.coalesce("component", "id")).join(more, "c", "left").select(F.col("n").alias("n_shingles"), "set_id", F.coalesce("final", "c").alias("label"))
    out = rows.select("doc_id", "n_shingles", "set_id").join(labels, ["n_shingles", "set_id"], "left")
    # a row with a null id is no member, though its set may be some class's
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def same_ids(members: DataFrame, several: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): links of the ids that have several sets with the least ids of these."""
    found = members.select("doc_id", "n_shingles", "set_id").join(several, "doc_id").distinct()
    return found.join(reps.select(F.col("n").alias("n_shingles"), "set_id", "id"), ["n_shingles", "set_id"]).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
