import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHEAP = ["edges_clean", "degrees", "in_neighbors", "undirected_edges", "edge_placement", "mirror_sets", "load_stats", "edges_from_text", "edges_binary_roundtrip", "gather_all_min", "pagerank_dag", "cc", "kcore_members", "kcore_dot", "custom_max_program"]


@pytest.mark.parametrize("name", CHEAP)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "part", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def test_every_core_query_has_sql():
    from orbweave.plans import catalogue

    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).count() == 15
