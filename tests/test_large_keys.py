"""Graph queries on keys of parts that reach into those of suppliers (s_suppkey + 1,000,000)."""

import duckdb
import pytest

from recollect.plans.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    at, first = str(tmp_path_factory.mktemp("large")), 999_900
    parts = [(k, k % 51) for k in range(first, first + 400)]
    lines = [(k, (k * 7 + j * j) % 300, float(1 + (k * j) % 50)) for k, _ in parts for j in range(6)]
    spark.createDataFrame(parts, "p_partkey long, p_size long").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame([(k,) for k in range(250)], "s_suppkey long").write.parquet(f"{at}/supplier.parquet")
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{at}/lineitem.parquet")
    return at


@pytest.mark.parametrize("name", ["induced_subgraph", "integrity_orphans", "static_activation", "traverse", "purge_agent", "spreading_activation"])
def test_parts_are_not_taken_for_suppliers(spark, large, name):
    con = duckdb.connect()
    for t in ("part", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{large}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, large)
    found = con.execute(ORACLE[name])
    columns = [x[0] for x in found.description]
    want = sorted(found.fetchall())
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == want and want


def test_ranks_start_from_parts_alone(spark, large):
    from recollect.plans import graph_queries

    e, both = graph_queries._both(spark, large)
    assert both.count() == 2 * e.count()
    assert {r.node for r in graph_queries._seeds(e, 50).collect()} == set(range(999_900, 1_000_300, 50))
