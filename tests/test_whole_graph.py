"""The graph queries see every edge between suppliers of neighbouring lines."""

import pytest

from tallyspark.plans import catalog

# Orders as their lines' suppliers: edges 1-2, 2-3, 10-3, 17-1; supplier 5 has a line but no neighbour, 7 has no line.
ORDERS = {1: [1, 2, 3], 2: [10, 3], 3: [17, 1], 4: [5], 5: [2, 1], 6: [1, 2]}
NATIONS = {1: 0, 2: 0, 3: 1, 5: 1, 7: 0, 10: 1, 17: 0}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("graph"))
    lines = [(o, k, s) for o, ss in ORDERS.items() for k, s in enumerate(ss, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{to}/lineitem.parquet")
    spark.createDataFrame(list(NATIONS.items()), "s_suppkey long, s_nationkey int").write.parquet(f"{to}/supplier.parquet")
    return to


def test_graph_queries_use_every_edge(spark, folder):
    got = lambda name, *cols: sorted(tuple(r[c] for c in cols) for r in catalog.QUERIES[name](spark, folder).collect())
    assert got("graph_degree", "id", "degree") == [(1, 2), (2, 2), (3, 2), (5, 0), (7, 0), (10, 1), (17, 1)]
    assert got("graph_orphans", "id") == [(5,), (7,)]
    assert got("graph_bfs2", "id", "hop") == [(1, 0), (2, 1), (3, 2), (17, 1)]
    # Edges as they stand, in both directions where both occur: 1-2, 2-1, 17-1 inside nation 0 (four suppliers), 10-3 inside nation 1 (three).
    assert got("community_density", "community", "size", "density") == [(0, 4, 0.5), (1, 3, 0.333333333)]
    assert got("poison_fraction", "poison") == [(0.0,)]


def test_hubs_count_every_edge(spark, tmp_path):
    """Supplier 3 meets eight others, none of them a multiple of ten."""
    others = [11, 12, 13, 14, 15, 16, 18, 19]
    spark.createDataFrame([(o, k, s) for o, x in enumerate(others) for k, s in ((1, 3), (2, x))], "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(s, s % 2) for s in [3, *others]], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert [tuple(r) for r in catalog.QUERIES["hub_pollution"](spark, str(tmp_path)).select("target", "score", "degree", "communities").collect()] == [(3, 1.0, 8, 2)]
