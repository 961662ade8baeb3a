"""Every registered map query against its SQL, on the smallest tables, in another engine."""

import duckdb
import pytest

from cartoforge import area_queries, audit_queries, check_queries, cluster_queries, feature_queries, frame_queries, outline_queries, overlay_queries, ring_queries, route_queries  # noqa: F401
from cartoforge.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, duck, sf_dir, name):
    ours, theirs = QUERIES[name](spark, sf_dir), duck.sql(ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    got = rows(ours.columns, map(tuple, ours.collect()))
    assert got == rows(theirs.columns, theirs.fetchall())
    assert got


def test_unmet_cells_meet_the_rings_of_ways(spark, sf_dir):
    """The plan reads the rings' edge and interior cells; no cell of a node that a ring of the kind meets is named."""
    got = QUERIES["j35_cells_unmet"](spark, sf_dir)
    assert got.columns == ["source", "cell_x", "cell_y", "kind"] and {r.source for r in got.select("source").distinct().collect()} == {"ways", "shapes"}
