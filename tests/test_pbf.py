import struct
import zlib

import numpy as np
import pytest

from terralex.sources import mapdata, pbf


def vint(n):
    out = b""
    n &= (1 << 64) - 1
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def zig(n):
    return (n << 1) ^ (n >> 63)


def whole(k, n):
    return vint(k << 3) + vint(n)


def sized(k, raw):
    return vint(k << 3 | 2) + vint(len(raw)) + raw


def steps(values):
    return b"".join(vint(zig(b - a)) for a, b in zip([0, *values], values))


def ints(values):
    return b"".join(map(vint, values))


def block(kind, content, squeeze):
    blob = sized(3, zlib.compress(content)) if squeeze else sized(1, content)
    header = sized(1, kind) + whole(3, len(blob))
    return struct.pack(">I", len(header)) + header + blob


def extract():
    strings = [b"", b"name", b"Spot", b"historic", b"yes", b"shop", b"food", b"outer"]
    table = sized(1, b"".join(sized(1, s) for s in strings))
    dense = sized(1, steps([5, 3, 1000])) + sized(8, steps([-61000000, -61000010, 10])) + sized(9, steps([1068000000, 0, -5])) + sized(10, ints([0, 1, 2, 3, 4, 0, 0]))
    node = whole(1, zig(7)) + sized(2, ints([1])) + sized(3, ints([2])) + whole(8, zig(-10)) + whole(9, zig(20))
    way = whole(1, 11) + sized(2, ints([1, 5])) + sized(3, ints([2, 6])) + sized(8, steps([5, 3, 5]))
    relation = whole(1, 12) + sized(8, ints([7, 0])) + sized(9, steps([11, -4])) + sized(10, ints([1, 0]))
    first = table + sized(2, sized(2, dense)) + sized(2, sized(1, node))
    second = table + sized(2, sized(3, way)) + sized(2, sized(4, relation))
    return block(b"OSMHeader", b"", False) + block(b"OSMData", first, True) + block(b"OSMData", second, False)


def test_tables(spark, tmp_path):
    (tmp_path / "x.osm.pbf").write_bytes(extract())
    nodes, ways, relations = pbf.read(spark, str(tmp_path / "x.osm.pbf"))
    got = {r.id: r for r in nodes.collect()}
    assert set(got) == {5, 3, 1000, 7} and got[3].tags == {"name": "Spot", "historic": "yes"} and got[5].tags == {} and got[7].tags == {"name": "Spot"}
    assert got[5].lat == pytest.approx(-6.1) and got[5].lon == pytest.approx(106.8) and got[1000].lon == pytest.approx(-5e-7)
    assert [(r.id, r.node_ids, r.tags) for r in ways.collect()] == [(11, [5, 3, 5], {"name": "Spot", "shop": "food"})]
    assert [(m.type, m.ref, m.role) for m in relations.first().members] == [("way", 11, "outer"), ("node", -4, "")]
    assert [r.name for r in mapdata.way_places(ways, nodes).collect()] == ["Spot"]
    (tmp_path / "empty.pbf").write_bytes(b"")
    assert pbf.read(spark, str(tmp_path / "empty.pbf"))[0].count() == 0


def test_integers():
    values = [0, 1, 127, 128, 300, 2**40, 2**63]
    assert pbf.packed(ints(values)).tolist() == values and pbf.packed(b"").tolist() == []
    assert pbf.signed(np.array([zig(v) for v in (0, -1, 5, -(2**40))], np.uint64)).tolist() == [0, -1, 5, -(2**40)]
