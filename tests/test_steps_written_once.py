"""Steps that were worked out again by each of their readers, or went through the driver."""

from cartoforge import area_queries
from cartoforge.operators import graph
from cartoforge.sources import adapters


def test_areas_read_written_points(spark, sf_dir):
    members, points, written = area_queries._areas(spark, sf_dir)
    assert len(written) == 3 and all("lineitem" not in f and "orders" not in f for df in (members, points) for f in df.inputFiles())
    used = adapters.view(spark, sf_dir, "area_members").where("type = 'w'").select("way_id").distinct()
    plain = adapters.view(spark, sf_dir, "area_points").join(used, "way_id", "left_semi")
    ours = points.join(used, "way_id", "left_semi")
    assert plain.count() and not plain.exceptAll(ours).count() and not ours.exceptAll(plain).count()


def test_labels_are_not_broadcast(spark, monkeypatch):
    plans, cut = [], graph.cut_lineage

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graph, "cut_lineage", kept)
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "u long, v long")
    assert set(map(tuple, graph.components(edges).collect())) == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert not any("Broadcast" in p for p in plans)
