"""WARC 1.1 archives: a writer with revisit records, and a reader that salvages what it can.

Archives are .warc.gz files, one gzip member for each record, in the shared folder. A writer task rolls to a new file at
`ROLL` payload bytes; file names are unique to the attempt and only the names that successful tasks report are read, so
lost executors and repeated tasks do no harm.

The reader goes through an archive by random access and holds one record at a time, of any length: a payload is a cell of a
table, so it isn't longer than one. A record is checked: the gzip member and
its CRC, the version line, the headers, the length, and the digest. After a failed check it searches for the next place
at which a valid member (or, in plain archives, a version line with sound headers) starts, goes on there and logs the bytes
between as a quarantined gap with the reason. Nothing after a damaged record is lost. Where the number of an archive's records
is known, as in round_trip(), a reader that finds another number fails and says which gaps it has seen.

Edge cases: a null html is an empty payload; equal payloads under `SMALL` bytes are all responses; a null page_id is written
and read as null and refers to no other record; repeated rows are records of their own (those with the response's page_id and payload are responses, too);
URLs may hold any characters (line breaks are percent-encoded); empty tables give no archive; extra columns are left out.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import bounded
from .store import Shelf

#: Payload bytes after which a task starts a new archive; least payload of a revisit; archives that a task reads where there are very many.
ROLL, SMALL, ARCHIVES = 32 << 20, 100, 16
DATE = "2024-01-01T00:00:00Z"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
BLOCK = 1 << 16


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or file, and its path there. Hadoop's names of object stores are those of Arrow but for s3a and s3n."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def record(kind: str, uri: str, block: bytes, headers: dict[str, str], rid: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{rid}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", *(f"{k}: {v}" for k, v in headers.items()), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page: int | None, url: str, html: bytes, digest: str, refers: int | None) -> bytes:
    """A response, or a revisit if `refers` names the page whose payload this one equals."""
    uri = re.sub(r"[\s<>]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    name = lambda p: str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{p}"))
    headers = {"WARC-Payload-Digest": f"sha256:{digest}"} | ({"WARC-Page-ID": str(page)} if page is not None else {})
    if refers is None:
        return record("response", uri, http + html, headers, name(page))
    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{name(refers)}>", "WARC-Refers-To-Page-ID": str(refers)}
    return record("revisit", uri, http, headers, name(page))


def deduplicated(pages: DataFrame) -> DataFrame:
    """(page_id, url, html binary, digest, refers_to): which records revisit which.

    Ids and digests alone are grouped and joined, with partial aggregation by digest; the pages themselves only meet the
    short rows of revisits, so html moves once at most.
    """
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html")).withColumn("digest", F.sha2("html", 256))
    short = rows.where((F.length("html") >= SMALL) & F.col("page_id").isNotNull()).select("page_id", "digest")
    least = short.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    revisits = short.join(least, "digest").where("page_id <> refers_to").distinct()
    return rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


def write(rows: DataFrame, folder: str) -> DataFrame:
    """(path, n_records, n_bytes) of each archive written for deduplicated() rows. Read it from a table: each evaluation writes anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        out, name, n, size, payload, done = None, "", 0, 0, 0, []
        for batch in batches:
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, n, size, payload = f"{uuid.uuid4().hex}.warc.gz", 0, 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                raw = gzip.compress(page_record(page, url, html, digest, refers), 4, mtime=0)
                out.write(raw)
                n, size, payload = n + 1, size + len(raw), payload + len(html)
                if payload >= ROLL:
                    out.close()
                    done.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "n_records", "n_bytes"])

    return bounded(rows).select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, n_records bigint, n_bytes bigint")


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class Bad(ValueError):
    """A failed check."""


@dataclass
class Salvage:
    """Iterates over an archive's records; `gaps` has what was passed over. source: an object with read_at(n, offset) and size()."""

    source: object
    gaps: list[Gap] = field(default_factory=list)

    def bytes_at(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        return self.source.read_at(n, at) if n > 0 else b""

    def inflated(self, at: int) -> tuple[bytes, int]:
        """Content of the gzip member at a place, and where it ends."""
        z, out, pos = zlib.decompressobj(31), [], at
        while not z.eof:
            if not (block := self.bytes_at(pos, BLOCK)):
                raise Bad("member is cut short")
            try:
                out.append(z.decompress(block))
            except zlib.error as e:
                raise Bad(f"member: {e}") from None
            pos += len(block)
            if len(out) == 1 and not VERSION.match(out[0][:10].ljust(10)) and len(out[0]) >= 10:
                raise Bad("no version line")
        return b"".join(out), pos - len(z.unused_data)

    def head_at(self, place: int) -> bytes:
        """Bytes from a version line to the end of its headers at least, if they end; lines without a colon end the search."""
        n, head = BLOCK, self.bytes_at(place, BLOCK)
        while VERSION.match(head) and b"\r\n\r\n" not in head and place + n < self.size and all(b":" in x for x in head.split(b"\r\n")[1:-1]):
            n *= 4
            head = self.bytes_at(place, n)
        return head

    def parsed(self, head: bytes) -> tuple[dict[str, str], int, int]:
        """Headers, where the block begins, and its length, of bytes that begin with a version line."""
        if not VERSION.match(head):
            raise Bad("no version line")
        stop = head.find(b"\r\n\r\n")
        if stop < 0:
            raise Bad("headers don't end")
        headers = {}
        for line in head[:stop].split(b"\r\n")[1:]:
            name, colon, value = line.partition(b":")
            if not colon:
                raise Bad("header without a colon")
            headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        if not {"warc-type", "warc-record-id", "warc-date"} <= headers.keys() or not headers.get("content-length", "").isdigit():
            raise Bad("headers are missing")
        return headers, stop + 4, int(headers["content-length"])

    def at(self, place: int) -> Record:
        """The valid record at a place."""
        if self.bytes_at(place, 2) == b"\x1f\x8b":
            raw, end = self.inflated(place)
            headers, begin, n = self.parsed(raw)
            block = raw[begin : begin + n]
            if len(raw) != begin + n + 4 or not raw.endswith(b"\r\n\r\n"):
                raise Bad("length doesn't fit")
        else:
            head = self.head_at(place)
            headers, begin, n = self.parsed(head)
            block, end = self.bytes_at(place + begin, n), place + begin + n + 4
            if len(block) != n or self.bytes_at(end - 4, 4) != b"\r\n\r\n":
                raise Bad("length doesn't fit")
        want = headers.get("warc-payload-digest", "")
        if headers["warc-type"] == "response" and want.startswith("sha256:"):
            if hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest() != want[7:].lower():
                raise Bad("digest doesn't fit")
        return Record(place, end, headers, block)

    def search(self, at: int) -> int:
        """The next place from `at` at which a record could start; the end if there is none."""
        while at < self.size:
            block = self.bytes_at(at, BLOCK + 9)
            hits = [m.start() for m in re.finditer(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n", block)]
            if hits:
                return at + hits[0]
            at += max(1, min(BLOCK, len(block)))
        return self.size

    def __iter__(self) -> Iterator[Record]:
        self.size = self.source.size()
        at = 0
        while at < self.size:
            try:
                found = self.at(at)
            except Bad as e:
                start, reason, found = at, str(e), None
                while (at := self.search(at + 1)) < self.size:
                    try:
                        found = self.at(at)
                        break
                    except Bad:
                        continue
                self.gaps.append(Gap(start, at, reason))
                if found is None:
                    return
            yield found
            at = found.end


def read(archives: DataFrame, *, gaps: bool = False, whole: bool = False) -> DataFrame:
    """Records of the archives in column `path`: (path, offset, record_type, page_id, url, payload_bytes, payload_digest, refers_to, payload). With `gaps`, the quarantined gaps instead: (path, start, end, reason). With `whole`, a ValueError in the task if an archive hasn't as many records as its `n_records`."""
    schema = "path string, start bigint, end bigint, reason string" if gaps else "path string, offset bigint, record_type string, page_id bigint, url string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()] if gaps else [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
        for batch in batches:
            for path, expected in zip(*(c.to_pylist() for c in batch.columns)):
                fs, place = opened(path)
                with fs.open_input_file(place) as f:
                    salvage, rows, held, n = Salvage(f), [], 0, 0
                    for r in salvage:
                        n += 1
                        if gaps:
                            continue
                        h, (head, _, payload) = r.headers, r.block.partition(b"\r\n\r\n")
                        number = lambda x: int(x) if re.fullmatch(r"-?\d+", x or "") else None
                        length = re.search(rb"(?i)content-length: (\d+)", head)
                        size = int(length[1]) if h["warc-type"] == "revisit" and length else len(payload)
                        rows.append((path, r.start, h["warc-type"], number(h.get("warc-page-id")), h.get("warc-target-uri"), size, h.get("warc-payload-digest", "").removeprefix("sha256:"), number(h.get("warc-refers-to-page-id")), payload))
                        held += len(payload)
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if whole and n != expected:
                        raise ValueError(f"{path}: {n} records of {expected}; gaps: {salvage.gaps}")
                    if gaps:
                        rows = [(path, g.start, g.end, g.reason) for g in salvage.gaps]
                    yield batch_of(rows)

    return archives.select("path", "n_records" if whole else F.lit(None).cast("bigint")).mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from archives written for the pages."""
    shelf = Shelf(pages.sparkSession, "warc")
    archives, seen = shelf.measured(write(deduplicated(pages), f"{shelf.root}/archives"), "paths", n=F.count(F.lit(1)))
    tasks = max(1, min(seen["n"], max(2 * pages.sparkSession.sparkContext.defaultParallelism, -(-seen["n"] // ARCHIVES))))
    return read(archives.repartition(tasks, "path"), whole=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
