import gzip
import hashlib
import random

import pytest

from terralex.llm import warc


class Source:
    def __init__(self, raw):
        self.raw = raw

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        return self.raw[at : at + n]


def records(n=20):
    out = []
    for k in range(n):
        html = f"<p>page {k}</p>".encode() * (k % 5 + 1)
        out.append(warc.page_record(k, f"http://a.b/{k}", html, hashlib.sha256(html).hexdigest(), None))
    return out


def pages_in(raw):
    s = warc.Salvage(Source(raw))
    return [int(r.headers["warc-page-id"]) for r in s], s.gaps


@pytest.mark.parametrize("packed", [True, False])
def test_whole_archives(packed):
    raw = b"".join(gzip.compress(r) if packed else r for r in records())
    assert pages_in(raw) == (list(range(20)), [])
    assert pages_in(b"") == ([], [])


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("seed", range(12))
def test_damage_costs_only_its_own_records(packed, seed):
    rng = random.Random(seed)
    parts = [gzip.compress(r) if packed else r for r in records()]
    at = [sum(map(len, parts[:k])) for k in range(21)]
    raw, hurt = bytearray(b"".join(parts)), set()
    for k in rng.sample(range(20), 3):
        hurt.add(k)
        kind = rng.randrange(3)
        place = at[k] + (0 if kind == 0 else len(parts[k]) - 6 if packed else parts[k].index(b"<p>"))
        raw[place : place + 4] = bytes(b ^ 0x55 for b in raw[place : place + 4])
    got, gaps = pages_in(bytes(raw))
    assert got == [k for k in range(20) if k not in hurt]
    covered = {k for g in gaps for k in range(20) if g.start <= at[k] and at[k + 1] <= g.end}
    assert covered == hurt and all(g.reason for g in gaps)


def test_cut_tail_inserted_bytes_and_false_starts():
    parts = [gzip.compress(r) for r in records()]
    assert pages_in(b"".join(parts)[:-9])[0] == list(range(19))
    got, gaps = pages_in(parts[0] + b"\x1f\x8b\x08junk WARC/1.1\r\njunk" + parts[1] + b"tail")
    assert got == [0, 1] and [g.start for g in gaps] == [len(parts[0]), len(parts[0]) + len(parts[1]) + 22] and gaps[1].end - gaps[1].start == 4
    big = [gzip.compress(warc.page_record(1, "u", b"x" * 300_000, hashlib.sha256(b"x" * 300_000).hexdigest(), None), 0)]
    assert pages_in(big[0] + bytes(200_000) + parts[3])[0] == [1, 3]


def test_round_trip(spark, tmp_path):
    long = "<html>" + "é" * 80 + "</html>"
    rows = [(5, "http://x/5", long, 1), (3, "http://x/3", long, 1), (9, "http://x/ 9\n", long, 1), (1, "http://x/1", "short", 1), (2, None, "short", 1), (4, "u", None, 1), (6, "u", "", 1), (None, "u", long, 1), (7, "u", "z" * 99, 1), (8, "u", "z" * 99, 1), (3, "http://x/3", long, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    want = []
    for p, _, html, _ in rows:
        raw = (html or "").encode()
        revisit = html == long and p not in (3, None)
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_gaps_are_logged(spark, tmp_path):
    parts = [gzip.compress(r) for r in records(4)]
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"\0" * 50 + parts[2])
    archives = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")
    gap = warc.read(archives, gaps=True).collect()
    assert [(g.start, g.end) for g in gap] == [(len(parts[0]), len(parts[0]) + 50)] and [r.page_id for r in warc.read(archives).collect()] == [0, 2]


def test_headers_and_records_of_any_length(monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 64)  # headers are longer than what is read at once
    html = b"y" * 100_000
    raw = warc.page_record(1, "http://a.b/" + "u" * 5000, html, hashlib.sha256(html).hexdigest(), None)
    for packed in (gzip.compress(raw), raw):
        assert pages_in(packed + packed) == ([1, 1], [])
    got, gaps = pages_in(b"WARC/1.1\r\nno end " + b"z" * 1000 + raw)
    assert got == [1] and len(gaps) == 1


def test_a_record_that_is_lost_fails_the_round_trip(spark, tmp_path):
    parts = [gzip.compress(r) for r in records(3)]
    (tmp_path / "b.warc.gz").write_bytes(parts[0] + parts[1][:-3] + parts[2])
    archives = spark.createDataFrame([(f"file://{tmp_path}/b.warc.gz", 3)], "path string, n_records long")
    assert warc.read(archives).count() == 2
    with pytest.raises(Exception, match="2 records of 3"):
        warc.read(archives, whole=True).collect()
