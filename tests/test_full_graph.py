import duckdb

from graphloom.plans import catalog, more  # noqa: F401
from graphloom.sources.tables import full_graph_view


def test_full_view_has_every_pair(spark, sf_dir):
    nodes, edges = full_graph_view(spark, sf_dir)
    got = {r["type"]: r["count"] for r in edges.groupBy("type").count().collect()}
    pairs = f"from '{sf_dir}/lineitem.parquet' join '{sf_dir}/orders.parquet' on l_orderkey = o_orderkey"
    for kind, key in (("ORDERED", "o_custkey"), ("SUPPLIES", "l_suppkey")):
        assert got[kind] == duckdb.sql(f"select count(*) from (select distinct {key}, l_partkey {pairs})").fetchall()[0][0]
    assert nodes.filter("label = 'part'").count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()


def test_components_and_communities_cover_the_full_view(spark, sf_dir):
    nodes = full_graph_view(spark, sf_dir)[0].count()
    assert catalog.QUERIES["connected_components_full"](spark, sf_dir).count() == nodes
    assert catalog.QUERIES["communities_full"](spark, sf_dir).count() == nodes
