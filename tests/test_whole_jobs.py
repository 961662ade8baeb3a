"""Nothing is capped or sampled, and what is shuffled goes once and is deleted."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from cartoforge import route_queries
from cartoforge.operators import contraction, graph, multipolygon, tiles
from cartoforge.sources import adapters, lineage

RING = "rel_id long, role string, ring long, nodes array<long>, v array<struct<x:double,y:double>>"


def test_a_ring_of_more_than_a_million_vertices_is_made(spark):
    n = 1_000_001
    points = spark.range(n + 1).select(F.lit(5).cast("long").alias("way_id"), F.col("id").cast("int").alias("pos"), (F.col("id") % n).alias("node_id"), F.cos(F.col("id") % n).alias("x"), F.sin(F.col("id") % n).alias("y"))
    members = spark.createDataFrame([(1, 0, "outer", "w", 5)], "rel_id long, seq long, role string, type string, way_id long")
    status, rings = multipolygon.rings(members, points)
    assert [tuple(r) for r in status.collect()] == [(1, None, 1)]
    assert [tuple(r) for r in rings.select("rel_id", F.size("v")).collect()] == [(1, n + 1)]


def test_every_node_is_a_source(spark, sf_dir):
    """Each node reaches itself, so pairs are as many as nodes at least; a fault far from the nodes divisible by 40 is found."""
    after = contraction.contract(route_queries._edges(spark, sf_dir), 2)[1].where("round = 2")
    nodes = after.select("u").union(after.select("v")).distinct().count()
    (row,) = route_queries.r11(spark, sf_dir).collect()
    assert row.pairs >= nodes > 0 and row.broken == 0
    edges = spark.createDataFrame([(1, 2, 3), (2, 1, 3)], "u long, v long, w long")
    longer = edges.withColumn("w", F.when(F.col("u") == 1, 30).otherwise(F.col("w")).cast("long"))
    assert [tuple(r) for r in contraction.preserved(edges, longer, None, 100.0).collect()] == [(4, 1)]


def test_shuffle_files_go_with_the_write(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    data = lambda: {n for n in (disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size())) if n.startswith("shuffle_")}
    was = data()
    assert len(lineage.cut_lineage(spark.range(1000).repartition(3, "id")).collect()) == 1000
    for _ in range(50):
        if data() <= was:
            break
        time.sleep(0.1)
    assert data() <= was and spark.conf.get(lineage.CLEANUP, None) in (None, "false") and spark.conf.get(lineage.PARTS, None) is None


def test_points_of_a_way_are_brought_together_once(spark, sf_dir):
    plan = tiles.segments(adapters.view(spark, sf_dir, "geo_points"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(way_id") == 1 and "Union" not in plan


def test_points_of_odd_rows_are_those_of_the_sql(spark, tmp_path):
    """Lines alike in all but a column that is not shown, a part that is there twice, and one that is not there."""
    c = duckdb.connect()
    for t in adapters.BASE:
        c.sql(f"CREATE TABLE {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    c.sql("INSERT INTO lineitem SELECT * REPLACE (l_quantity + 1 AS l_quantity) FROM lineitem WHERE l_orderkey % 7 = 0")
    c.sql("INSERT INTO lineitem SELECT * REPLACE (99999999 AS l_partkey) FROM lineitem WHERE l_orderkey % 11 = 0")
    c.sql("INSERT INTO part SELECT * FROM part WHERE p_partkey % 50 = 0")
    for t in adapters.BASE:
        c.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    for name, columns in (("way_refs", "way_id, pos, node_id"), ("geo_points", "way_id, pos, node_id, lat, lon")):
        want = sorted(map(tuple, c.sql(adapters.with_views(f"SELECT {columns} FROM {name} WHERE pos % 2 = 0")).fetchall()))
        assert sorted(map(tuple, adapters.view(spark, str(tmp_path), name).where("pos % 2 = 0").select(*columns.split(", ")).collect())) == want and want


def test_hubs_need_no_join(spark):
    """Ends, nodes of two ways and those met twice by one way are hubs; a way of one point makes no segment."""
    ways = {1: [1, 2, 3, 4], 2: [9, 3, 8], 3: [5, 6, 7, 6, 5], 4: [2]}
    rows = [(w, i, n, -32.0 + n * 1e-3, 115.5 + n * n * 1e-4) for w, nodes in ways.items() for i, n in enumerate(nodes)]
    segs = graph.split_at_nodes(spark.createDataFrame(rows, "way_id long, pos int, node_id long, lat double, lon double"))
    plan = segs._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.way_id, r.seg, r.u, r.v, r.n_points) for r in segs.collect())
    assert got == [(1, 1, 1, 2, 2), (1, 2, 2, 3, 2), (1, 3, 3, 4, 2), (2, 1, 9, 3, 2), (2, 2, 3, 8, 2), (3, 1, 5, 6, 2), (3, 2, 6, 6, 3), (3, 3, 6, 5, 2)]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(node_id") == 1


def test_pairs_without_a_path_come_from_few_groups(spark):
    rng = random.Random(5)
    stay = [(u, v, rng.randint(1, 9)) for u in range(30) for v in range(30) if u != v and rng.random() < 0.2]
    cut = [(u, v, rng.randint(4, 14), 100 + rng.randint(0, 90)) for u in range(30) for v in range(30) if u != v and rng.random() < 0.6]
    seen = {(u, v) for u, v, w, _ in cut if any(a == u and c == b and d == v and x + y <= w for a, b, x in stay for c, d, y in stay)}
    frames = spark.createDataFrame(cut, "u long, v long, w long, mid long"), spark.createDataFrame(stay, "u long, v long, w long")
    rest = contraction.two_hops(*frames, False)
    edge = {(u, v): w for u, v, w in stay}
    want = {(u, v, w, (u, v) in edge) for u, v, w, _ in cut if (u, v) not in seen and edge.get((u, v), 99) > w}
    assert {tuple(r) for r in rest.collect()} == want and 0 < len(seen) < len(cut) and {r[3] for r in want} == {True, False}
    assert {tuple(r) for r in contraction.two_hops(*frames).collect()} == seen


@pytest.mark.parametrize("bucket", [0.05, 4.0])
def test_edges_of_a_small_relation_share_a_bucket(spark, monkeypatch, bucket):
    rng, dealt, plain = random.Random(6), [], multipolygon.buckets
    made = []
    for rel, k in ((1, 5), (2, 150)):
        for ring in range(2):
            v = [(rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(k)]
            made.append((rel, "outer" if ring else "inner", ring, [*range(k), 0], [*v, v[0]]))
    made.append((3, "outer", 0, [1, 2, 3, 1], [(7.0, 7.0)] * 4))
    df = spark.createDataFrame(made, RING)

    def side(a, b, p):
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    edges = {rel: [(ring, i, len(v) - 1, v[i], v[i + 1]) for r, _, ring, _, v in made if r == rel for i in range(len(v) - 1)] for rel in (1, 2)}
    want = {}
    for rel, es in edges.items():
        for x, (r, i, n, a, b) in enumerate(es):
            for s, j, _, c, d in es[x + 1 :]:
                near = r == s and (j == i + 1 or (i == 0 and j == n - 1))
                want[rel] = want.get(rel, 0) + (not near and side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0)
    monkeypatch.setattr(multipolygon, "buckets", lambda *a: dealt.append(plain(*a)) or dealt[-1])
    got = {r.rel_id: r.crossings for r in multipolygon.crossings(df, bucket).collect()}
    assert {rel: got[rel] for rel in want} == want
    if bucket == 0.05:
        assert dealt[-1].where("rel_id = 1").count() == 10
