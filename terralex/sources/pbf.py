"""Map extracts in protocol-buffer form (.osm.pbf) as tables of nodes, ways and relations.

The driver reads only the headers of a file's blocks, a few bytes each, and gets a table of their places. Tasks then
read and decode blocks by random access, so a file of any size is spread over the cluster.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

NODES = "id bigint, lat double, lon double, tags map<string,string>"
WAYS = "id bigint, node_ids array<bigint>, tags map<string,string>"
RELATIONS = "id bigint, tags map<string,string>, members array<struct<type:string,ref:bigint,role:string>>"
MEMBER_TYPES = ("node", "way", "relation")


def varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: an integer, or the bytes of a longer one."""
    at = 0
    while at < len(raw):
        key, at = varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(raw, at)
        elif kind == 2:
            n, at = varint(raw, at)
            value, at = raw[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = raw[at : at + n], at + n
        else:
            raise ValueError(f"field of unknown wire type {kind}")
        yield key >> 3, value


def packed(raw: bytes) -> np.ndarray:
    """All integers of a packed field."""
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(b < 128)
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    parts = (b & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, starts)


def signed(values: np.ndarray) -> np.ndarray:
    """Zigzag integers."""
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def deltas(raw: bytes) -> np.ndarray:
    return np.cumsum(signed(packed(raw)))


def blocks(source, size: int) -> Iterator[tuple[int, int, str]]:
    """(offset, size, kind) of each block's body. source has read_at(n, offset)."""
    at = 0
    while at + 4 <= size:
        (n,) = struct.unpack(">I", source.read_at(4, at))
        header = dict(fields(source.read_at(n, at + 4)))
        at += 4 + n
        yield at, header[3], header[1].decode()
        at += header[3]


def body(raw: bytes) -> bytes:
    """A block's content, inflated if it must be."""
    found = dict(fields(raw))
    if 1 in found:
        return found[1]
    if 3 in found:
        return zlib.decompress(found[3])
    raise ValueError("block is compressed in a way that isn't supported")


def entities(raw: bytes, kind: str) -> Iterator[tuple]:
    """Rows of one kind in a data block."""
    top: dict[int, list] = {}
    for n, v in fields(raw):
        top.setdefault(n, []).append(v)
    strings = [v.decode("utf-8", "replace") for _, v in fields(top[1][0])] if 1 in top else []
    grain, lat0, lon0 = (top.get(n, [default])[0] for n, default in ((17, 100), (19, 0), (20, 0)))
    whole = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    degrees = lambda v, offset: (whole(offset) + grain * v) * 1e-9
    tags = lambda m: {strings[int(k)]: strings[int(v)] for k, v in zip(packed(m.get(2, b"")), packed(m.get(3, b"")))}
    for group in top.get(2, []):
        for n, v in fields(group):
            if n == 1 and kind == "nodes":
                m = dict(fields(v))
                at = lambda k: int(signed(np.array([m[k]], np.uint64))[0])
                yield at(1), degrees(at(8), lat0), degrees(at(9), lon0), tags(m)
            elif n == 2 and kind == "nodes":
                m = dict(fields(v))
                pairs, all_tags, now = packed(m.get(10, b"")).tolist(), [], {}
                k = 0
                while k < len(pairs):
                    if pairs[k] == 0:
                        all_tags.append(now)
                        now, k = {}, k + 1
                    else:
                        now[strings[pairs[k]]] = strings[pairs[k + 1]]
                        k += 2
                ids = deltas(m[1])
                all_tags = all_tags or [{}] * len(ids)
                yield from zip(ids.tolist(), degrees(deltas(m[8]), lat0).tolist(), degrees(deltas(m[9]), lon0).tolist(), all_tags)
            elif n == 3 and kind == "ways":
                m = dict(fields(v))
                yield m[1], deltas(m.get(8, b"")).tolist(), tags(m)
            elif n == 4 and kind == "relations":
                m = dict(fields(v))
                members = zip(packed(m.get(10, b"")).tolist(), deltas(m.get(9, b"")).tolist(), packed(m.get(8, b"")).tolist())
                yield m[1], tags(m), [{"type": MEMBER_TYPES[t], "ref": r, "role": strings[s]} for t, r, s in members]


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations) of an extract at a URI that Arrow's file systems open (file://, hdfs://, s3://, gs://)."""
    uri = path if "://" in path else f"file://{path}"
    fs, place = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(place) as f:
        found = [(at, n) for at, n, kind in blocks(f, f.size()) if kind == "OSMData"]
    table = spark.createDataFrame(found, "at bigint, n bigint").repartition(max(1, min(len(found), 8 * spark.sparkContext.defaultParallelism)))

    def of(kind: str, schema: str) -> DataFrame:
        types = {
            "nodes": [pa.int64(), pa.float64(), pa.float64(), pa.map_(pa.string(), pa.string())],
            "ways": [pa.int64(), pa.list_(pa.int64()), pa.map_(pa.string(), pa.string())],
            "relations": [pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))],
        }[kind]
        names = [c.split()[0] for c in ("id, lat, lon, tags", "id, node_ids, tags", "id, tags, members")[("nodes", "ways", "relations").index(kind)].split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, place = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(place) as f:
                for batch in batches:
                    for at, n in zip(*(c.to_pylist() for c in batch.columns)):
                        rows = list(entities(body(f.read_at(n, at)), kind))
                        columns = [[list(r[k].items()) if isinstance(r[k], dict) else r[k] for r in rows] for k in range(len(names))]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        return table.mapInArrow(run, schema)

    return of("nodes", NODES), of("ways", WAYS), of("relations", RELATIONS)
