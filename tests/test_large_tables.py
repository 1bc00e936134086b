"""What shows only on larger tables than the driver's small ones."""

import random

import random

import duckdb
import pyarrow.parquet as pq
import pytest
from compare import same_rows
from pyspark.sql import functions as F

from terralex.functions import geo
from terralex.operators import spatial
from terralex.operators import spatial
from terralex.plans import registry
from terralex.sources import tables

PAIRS = ["haversine_pairs", "equirect_pairs", "box_distances", "midpoint"]


@pytest.fixture
def held(spark, tmp_path):
    """Holds a query against its SQL on tables written for it."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        same_rows(registry.queries()[name](spark, str(tmp_path)), con, registry.oracle_sql()[name])

    return run


def customers(keys):
    return keys.selectExpr("id as c_custkey", "concat('c', id) as c_name", "cast(id % 25 as int) as c_nationkey", "'X' as c_mktsegment")


def test_nodes_on_the_border_of_a_box_are_in_it(spark, sf, held):
    on_border = spark.range(1, 100_000).where("(id % 997) % 100 = 0 or (id % 1009) % 100 = 0")
    held("node_dedup", customer=customers(on_border), nation=spark.read.parquet(f"{sf}/nation.parquet"))


def test_rounding_equals_duckdb(spark):
    xs = [k / 64e6 for k in range(-200, 200)] + [2.0000005, -1.0000015, 0.4999995, 4.9999999e-7, 1e300, float("inf"), float("nan"), None, 12345.6789015]
    got = [r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").select(geo.rounded(F.col("x")).alias("y")).collect()]
    want = [duckdb.execute("select round(?::double, 6)", [x]).fetchone()[0] for x in xs]
    assert list(map(str, got)) == [str(w + 0.0) if w == 0 else str(w) for w in want]


@pytest.mark.parametrize("name", PAIRS)
def test_pairs_are_made_by_all_cores(spark, sf, held, monkeypatch, name):
    assert registry.queries()[name](spark, sf).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 10)  # the larger side is cut instead
    held(name, **{t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "supplier")})


def suppliers(keys):
    return keys.selectExpr("id as s_suppkey", "concat('s', id) as s_name", "cast(id % 25 as int) as s_nationkey")


def suppliers(keys):
    return keys.selectExpr("id as s_suppkey", "concat('s', id) as s_name", "cast(id % 25 as int) as s_nationkey")


def test_pairs_are_written_in_runs(spark, held, tmp_path, monkeypatch):
    """Nations one after another, few points at a time, each time for all places: else the columns of points take several times the room."""
    monkeypatch.setattr(tables, "RUN", 2, raising=False)
    held("box_distances", customer=customers(spark.range(1, 20_000)), supplier=suppliers(spark.range(1, 126)))
    rows = registry.queries()["box_distances"](spark, str(tmp_path)).select(F.spark_partition_id().alias("part"), "id", "query_id").collect()
    runs = []
    for r in rows:
        if not runs or runs[-1][:2] != (r.part, r.id):
            runs.append((r.part, r.id, []))
        runs[-1][2].append(r.query_id)
    assert {len(queries) for *_, queries in runs} == {1, 2}  # five points of a nation
    turns = [(part, id % 25, tuple(queries)) for part, id, queries in runs]
    assert sum(t != before for t, before in zip(turns, [None, *turns])) == len(set(turns))


@pytest.mark.parametrize("task_pairs", [50, 1 << 23])
def test_pairs_by_middle_equal_sql(spark, held, monkeypatch, task_pairs):
    monkeypatch.setattr(spatial, "MIDDLES", 0)
    monkeypatch.setattr(spatial, "TASK_PAIRS", task_pairs)
    without = spark.sql("select cast(null as bigint) as id")
    keys = spark.range(1, 400_000, 401).union(without)
    unknown = customers(spark.range(3)).selectExpr("c_custkey", "c_name", "cast(null as int) as c_nationkey", "c_mktsegment")
    nowhere = spark.sql("select cast(null as bigint) as c_custkey, 'c' as c_name, 3 as c_nationkey, 'X' as c_mktsegment")
    nobody = spark.sql("select cast(null as bigint) as s_suppkey, 's' as s_name, 3 as s_nationkey")
    held("midpoint", customer=customers(keys).union(unknown).union(nowhere).union(nowhere), supplier=suppliers(spark.range(1, 4_000, 17)).union(nobody))


def test_middles_take_little_room(spark, tmp_path, monkeypatch):
    for name, pairs in (("MIDDLES", 1 << 20), ("TASK_PAIRS", 1 << 18)):
        monkeypatch.setattr(spatial, name, pairs, raising=False)
    customers(spark.range(3, 1_000_000, 25).where("id % 997 < 125 and id % 1009 < 126")).write.parquet(f"{tmp_path}/customer.parquet")
    suppliers(spark.range(3, 80_000, 25)).write.parquet(f"{tmp_path}/supplier.parquet")
    registry.queries()["midpoint"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    rows, size = 0, {}
    for f in tmp_path.glob("out/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        rows += meta.num_rows
        for g in range(meta.num_row_groups):
            for c in map(meta.row_group(g).column, range(4)):
                size[c.path_in_schema] = size.get(c.path_in_schema, 0) + c.total_compressed_size
    assert rows > 1 << 20 and size["lat"] + size["lon"] < 10 * rows  # 16 bytes a row otherwise


@pytest.fixture
def scattered(spark):
    """Places and circles of all sizes near a point, on both sides of the date line and near a pole, some without a position."""
    rng = random.Random(5)
    near = [lambda: (rng.gauss(-6.2, 0.3), rng.gauss(106.2, 0.3)), lambda: (rng.uniform(-60, 60), rng.choice([-180, 180]) * rng.uniform(0.99, 1)), lambda: (rng.uniform(88, 90), rng.uniform(-180, 180))]
    places = [(k, *near[k % 3]()) for k in range(600)] + [(1000, None, 106.0), (1001, -6.2, 106.2), (1002, -6.5, 106.0)]
    circles = [(k, *near[k % 5 // 2](), rng.choice([0.2, 2.0, 20.0, 150.0])) for k in range(60)] + [(100, -6.2, 106.2, 0.0), (101, -6.2, 106.2, -1.0), (102, None, 1.0, 5.0), (103, -6.5, 106.0, 10.0), (104, -6.5, 106.0, 0.0)]
    return spark.createDataFrame(places, "id long, lat double, lon double").cache(), spark.createDataFrame(circles, "query_id long, qlat double, qlon double, radius double").cache()


def pairs_of(df):
    return sorted((r.id, r.query_id) for r in df.collect())


def test_places_in_circles_equal_brute_force(scattered):
    places, circles = scattered
    want = pairs_of(places.crossJoin(circles).where(geo.in_circle(*(F.col(c) for c in ("lat", "lon", "qlat", "qlon", "radius")))))
    assert pairs_of(spatial.in_circles(places, circles, 1.0)) == want and len(want) > 500


@pytest.mark.parametrize("n", [8, 64])
def test_rays_and_circles_equal_brute_force(scattered, n):
    places, circles = scattered
    want = pairs_of(places.crossJoin(circles).where(geo.crosses_circle(F.lit(-6.5), F.lit(106.0), *(F.col(c) for c in ("lat", "lon", "qlat", "qlon", "radius")))))
    assert pairs_of(spatial.rays_and_circles(-6.5, 106.0, places, circles, n)) == want and len(want) > 500
