"""UTF-8 columns as flat byte arrays: what the byte-level operators share.

An Arrow string column is one buffer of bytes and one of offsets, so a batch of documents can be read by numpy
without making a Python object for each row. All helpers treat null as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
CHUNK = 1 << 19

U64 = np.uint64


def bounded(df: DataFrame) -> DataFrame:
    """The same rows; batches sent to Python hold 8 MB from now on, unless the session says otherwise. A longer row is a batch of its own."""
    conf = df.sparkSession.conf
    if conf.get(key := "spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        conf.set(key, str(8 << 20))
    return df


def apart(kept: list[str], made: list[str]) -> None:
    """Raises ValueError if a column that is kept has the name of one that is made; upper and lower case are alike to Spark."""
    if clash := {c.lower() for c in kept} & {c.lower() for c in made}:
        raise ValueError(f"columns {sorted(clash)} can't be kept beside the result's")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (uint8) and offsets (int64, one more than rows) of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most `size` bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def folded() -> np.ndarray:
    """Each byte as it is hashed where A-Z count as a-z."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


LOWERED = folded()


def is_black() -> np.ndarray:
    """Bytes of words [^\\x20\\x09-\\x0D]+."""
    out = np.ones(256, bool)
    out[[9, 10, 11, 12, 13, 32]] = False
    return out


BLACK = is_black()


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of true bytes; a run never crosses rows."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[(first - 1)[first > 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: Spans of more bytes than this are hashed one by one.
SHORT = 64
#: Keeps the first n of a word's eight bytes.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], U64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of data[starts:ends], equal for equal byte strings wherever they stand; A-Z count as a-z if `lower`.

    Short spans are mixed in eight bytes at a time, all of them at once; long ones have a keyed digest. So strings differ in their
    hashes as chance has it, whatever they have in common.
    """
    size = ends - starts
    data = LOWERED[data] if lower else data
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,))
    with np.errstate(over="ignore"):
        out = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x5851F42D4C957F2D))
        live = np.flatnonzero((size > 0) & (size <= SHORT))
        at = starts[live]
        while len(live):
            left = ends[live] - at
            out[live] = mix((out[live] ^ (word[at] & KEEP[np.minimum(left, 8)])) * U64(0xD1342543DE82EF95) + U64(0x2545F4914F6CDD1D))
            more = left > 8
            live, at = live[more], at[more] + 8
    for i in np.flatnonzero(size > SHORT):
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def hex_digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
