"""Nearest rows in blocks of matrices, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import admission, closest, search


def frames(spark, rows):
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    return v, v.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


@pytest.fixture(scope="module")
def vectors():
    """Copies, opposite and zero vectors, ids that repeat, whole numbers so that many pairs tie."""
    g = np.random.default_rng(3)
    base = [[float(x) for x in g.integers(-2, 3, 4)] for _ in range(30)]
    return [(int(i), base[int(g.integers(30))]) for i in g.integers(0, 120, 150)] + [(500, [0.0] * 4), (501, [0.0] * 4)]


def plain(a, b, metric):
    if metric == "l2":
        return 1 / (1 + sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))
    dot = sum(x * y for x, y in zip(a, b, strict=True))
    size = math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    return min(1.0, max(0.0, dot if metric == "dot" else dot / size if size else 0.0))


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_many_queries_against_a_plain_loop(spark, vectors, metric, monkeypatch):
    monkeypatch.setattr(closest, "ROWS", 16)
    v, queries = frames(spark, vectors)
    got = {}
    for r in search.vector_search_many(v, queries, 6, metric, block=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, pytest.approx(r.score)))
    want = {}
    for q in {i for i, _ in vectors if i % 5 == 0}:
        met = sorted((-plain(a, b, metric), i) for j, a in vectors if j == q for i, b in vectors if i != q)
        want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(met[:6])]
    assert {q: sorted(x, key=lambda y: y[0]) for q, x in got.items()} == want


def test_tiles_keep_the_best(vectors, monkeypatch):
    monkeypatch.setattr(closest, "ROWS", 32)
    monkeypatch.setattr(closest, "QUERIES", 8)
    g = np.random.default_rng(1)
    ids, x = np.arange(300), g.normal(size=(300, 8))
    x[200:220] = x[5]
    block = closest.Block(ids[:40], x[:40], 3, "cosine", False)
    for a in range(0, 300, 90):
        block.add(ids[a : a + 90], x[a : a + 90])
    got = {}
    for q, i, s in block.found():
        for row in zip(q, i, s, strict=True):
            got.setdefault(int(row[0]), []).append(int(row[1]))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(40):
        s = np.round(unit @ unit[q], 12)
        assert got[q] == [int(i) for i in np.lexsort((ids, -s)) if i != q][:3]


def test_pairs_are_not_written_out_or_sorted(spark, vectors):
    v, queries = frames(spark, vectors)
    for df in (search.vector_search_many(v, queries, 3), admission.nearest(v.where("id % 5 = 0"), v)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_nearest_of_nulls_and_other_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (5, None), (6, [1.0, None]), (10, [1.0, 2.0, 3.0]), (15, [-1.0, 0.0])]
    v, _ = frames(spark, rows)
    got = {r.id: (r.nearest_id, r.distance and round(r.distance, 6)) for r in admission.nearest(v.where("id % 5 = 0"), v).collect()}
    assert got == {0: (1, 0.292893), 5: (None, None), 10: (None, None), 15: (1, 1.707107)}
    assert [r.distance for r in admission.nearest(v.where("id = 0"), v.limit(0)).collect()] == [None]


def test_prediction_error_of_copies_alone(spark, tmp_path):
    import duckdb

    from recollect.plans.search_queries import ORACLE, QUERIES

    spark.createDataFrame([(i, [1.0, float(i % 20)], 0) for i in range(80)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted((r.id, r.max_similarity, r.rpe) for r in QUERIES["prediction_error"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLE["prediction_error"]).fetchall()) and len(got) == 4
