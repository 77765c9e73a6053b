"""Exact search over cells against a whole scan."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import vectors
from weftline.operators.cells import NO_ANGLE, CellIndex

POINTS = "point_id long, scope string, vector array<double>, cell string"


def clustered(n=1200, seed=3, dims=8):
    draw = random.Random(seed)
    middles = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    # Every fifth point is the one before again: ties.
    rows = []
    for i in range(n):
        v = rows[-1][2] if i % 5 == 4 else [x + draw.gauss(0, 0.1) for x in middles[i % 12]]
        rows.append((i, f"s{i % 2}", v, "clash"))
    return rows


ODD = [(5000, "s0", [0.0] * 8, None), (5001, "s0", None, None), (5002, "s1", [float("inf")] + [1.0] * 7, None), (5003, None, [1.0] * 8, None), (5004, "s1", [1.0, None] + [1.0] * 6, None)]


def whole(points, queries, k, minimum):
    asked = queries.select("query_id", "query_vector", "scope")
    return {tuple(r) for r in vectors.top_k_batch(points.drop("cell"), asked, k, minimum, "scope").select("query_id", "point_id", "score", "rank").collect()}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    points = spark.createDataFrame(clustered() + ODD, POINTS)
    return points, CellIndex.build(points, str(tmp_path_factory.mktemp("cells")), 16)


def test_equals_the_whole_scan(spark, made):
    points, index = made
    rows = clustered()
    asked = [(i, "s0" if i % 4 < 2 else "s1", rows[i * 7 + 1][2]) for i in range(25)] + [(90, "s0", [0.0] * 8), (91, "none", [1.0] * 8), (92, "s1", [-x for x in rows[1][2]])]
    queries = spark.createDataFrame(asked, "query_id long, scope string, query_vector array<double>")
    for k, minimum in ((10, 0.15), (3, -1.0), (1, 0.99), (700, 0.5)):
        assert {tuple(r) for r in index.search(queries, k, minimum).collect()} == whole(points, queries, k, minimum), (k, minimum)
    assert index.search(queries, 0, 0.1).count() == 0 and index.search(queries.limit(0), 5, 0.1).count() == 0


def test_reads_less_and_grows_by_new_files(spark, made, tmp_path):
    points, index = made
    total = index.points().count()
    assert total == points.filter("vector is not null").count()
    query = spark.createDataFrame([(0, "s0", clustered()[0][2])], "query_id long, scope string, query_vector array<double>")
    read, seen = [], index.wanted
    index.wanted = lambda pairs: (read.append(seen(pairs)), read[-1])[1]
    try:
        assert index.search(query, 5, 0.2).count() == 5
    finally:
        index.wanted = seen
    assert len(read) == 2 and sum(r.count() for r in read) < total / 3
    plan = read[1]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    grown = CellIndex.build(points, str(tmp_path / "grown"), 16)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "grown").rglob("*.parquet")}
    more = spark.createDataFrame([(9000 + i, "s0", clustered(20, 8)[i][2], None) for i in range(20)], POINTS)
    grown.add(more)
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    both = points.unionByName(more)
    assert {tuple(r) for r in grown.search(query, 9, 0.1).collect()} == whole(both, query, 9, 0.1)


def test_empty_and_without_angles(spark, tmp_path):
    none = spark.createDataFrame([], POINTS)
    query = spark.createDataFrame([(0, "s0", [1.0, 0.0])], "query_id long, scope string, query_vector array<double>")
    empty = CellIndex.build(none, str(tmp_path / "none"))
    assert empty.search(query, 5, 0.1).count() == 0
    odd = spark.createDataFrame([(1, "s0", [0.0, 0.0], None), (2, "s0", None, None)], POINTS)
    index = CellIndex.build(odd, str(tmp_path / "odd"))
    assert [r.cell for r in index.points().select(F.col("cell")).collect()] == [NO_ANGLE]
    assert [tuple(r) for r in index.search(query, 5, -1.0).collect()] == [(0, 1, 0.0, 1)]
    empty.add(odd)
    assert empty.search(query, 5, -1.0).count() == 1
