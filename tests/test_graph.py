"""Response parsing, merging and manifestation: golden cases."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import extraction, manifestation, reconcile, vectors

DONE = "\n---COMPLETE---"


@pytest.mark.parametrize("response, error, nodes, edges", [
    ('{"nodes":[],"edges":[]}', extraction.INCOMPLETE, None, None),
    ('{"nodes":[],"edges":[]}' + DONE, None, 0, 0),
    ('```json\n{"nodes":[{"display_name":"A","description":"b"}],"edges":[]}\n```' + DONE, None, 1, 0),
    ('```\n{"nodes":[],"edges":[]}\n``` tail' + DONE, extraction.INVALID_JSON, None, None),
    ('well {"nodes":[],"edges":[]} ok' + DONE, None, 0, 0),
    ('{"nodes":{},"edges":[]}' + DONE, extraction.INVALID_SCHEMA, None, None),
    ('{"nodes":[]}' + DONE, extraction.INVALID_SCHEMA, None, None),
    ('{"nodes":[{"display_name":1,"description":"b"}],"edges":[]}' + DONE, extraction.INVALID_SCHEMA, None, None),
    ("[1]" + DONE, extraction.INVALID_SCHEMA, None, None), ("nothing" + DONE, extraction.INVALID_JSON, None, None), ("" + DONE, extraction.INVALID_JSON, None, None),
    ('{"nodes":[],"edges":[]}] {' + DONE, None, 0, 0), ('```\n{"nodes":[],"edges":[]}] 1\n```' + DONE, extraction.INVALID_JSON, None, None), (None, extraction.INCOMPLETE, None, None),
])
def test_parse(spark, response, error, nodes, edges):
    got = extraction.parse(spark.createDataFrame([(response,)], "response string")).select("error", F.size("nodes").alias("n"), F.size("edges").alias("e")).first()
    assert got.error == error
    if error is None:
        assert (got.n, got.e) == (nodes, edges)


def test_strengths_are_whole_numbers(spark):
    values = ["7", "0", "11", "7.0", "true", '"7"', "null", "10"]
    edges = ",".join('{"source_display_name":"a","target_display_name":"b","description":"d","strength":%s}' % v for v in values)
    got = extraction.parse(spark.createDataFrame([('{"nodes":[],"edges":[' + edges + "]}" + DONE,)], "response string")).first()
    assert [e.strength for e in got.edges] == [7, None, None, None, None, None, None, 10]


def merged(spark, nodes, edges):
    keys = dict(world=F.lit("6ba7b811-9dad-11d1-80b4-00c04fd430c8"), run=F.lit("r"), book=F.lit(1), chunk=F.col("c"))
    n = extraction.merge_nodes(spark.createDataFrame(nodes, "c int, seq int, display_name string, description string"), ["c"], **keys)
    e = extraction.merge_edges(spark.createDataFrame(edges, "c int, seq int, source_display_name string, target_display_name string, description string, strength int"), n, ["c"], **keys)
    return n.orderBy("c", "first_seq").collect(), e.orderBy("c", "edge_number").collect()


def test_merge(spark):
    nodes = [(1, 1, "Mara", "A mage."), (1, 2, " Mara ", "A student."), (1, 3, "Mara", "A mage."), (1, 4, "Tor", " "), (1, 5, "Tor", "late"), (2, 1, "Mara", "other"), (1, 6, None, "x")]
    edges = [(1, 1, "Mara", "Tor", "knows", 5), (1, 2, "Mara", "Tor", "knows", 5), (1, 3, "Mara", "Nobody", "x", 5), (1, 4, "Mara", "Tor", " ", 5), (1, 5, "Tor", "Mara", "y", 11), (2, 1, "Mara", "Tor", "no", 3)]
    n, e = merged(spark, nodes, edges)
    assert [(r.c, r.display_name, r.description) for r in n] == [(1, "Mara", "A mage.\n\nA student."), (1, "Tor", "late"), (2, "Mara", "other")]
    assert [(r.c, r.edge_number, r.description) for r in e] == [(1, 1, "knows"), (1, 2, "knows")]
    assert e[0].edge_id != e[1].edge_id and {e[0].source_node_id, e[0].target_node_id} == {n[0].node_id, n[1].node_id}


def test_one_failed_node_holds_its_edge(spark):
    nodes = spark.createDataFrame([("a", "embedded", "written"), ("b", "pending", "pending"), ("c", "failed", "pending"), ("d", "embedded", "written")], "node_id string, embedding_status string, write_status string")
    edges = spark.createDataFrame([(1, "a", "b", "pending", 0), (2, "a", "c", "pending", 0), (3, "a", "d", "waiting_dependency", 1), (4, "a", "c", "written", 0), (5, "d", "a", "failed", 3), (6, "a", "zz", "pending", 0)], "edge_id int, source_node_id string, target_node_id string, status string, retry_count int")
    got = {r.edge_id: (r.status, r.retry_count) for r in manifestation.edge_dependencies(edges, nodes).collect()}
    assert got == {1: ("waiting_dependency", 0), 2: ("failed_dependency", 0), 3: ("pending", 1), 4: ("written", 0), 5: ("pending", 0), 6: ("waiting_dependency", 0)}


def test_node_writes_and_unavailable_sink(spark, tmp_path):
    states = spark.createDataFrame([("a", "embedded", "pending"), ("b", "pending", "pending"), ("c", "embedded", "failed")], "node_id string, embedding_status string, write_status string")
    kept, ok = manifestation.write_nodes(states, manifestation.UnavailableWriter("down"))
    assert not ok and {r.write_status for r in kept.collect()} == {"pending"}
    done, ok = manifestation.write_nodes(states, manifestation.TableWriter(str(tmp_path / "nodes"), "node_id"))
    assert ok and {r.node_id: r.write_status for r in done.collect()} == {"a": "written", "b": "pending", "c": "written"}
    writer = manifestation.TableWriter(str(tmp_path / "nodes"), "node_id")
    like = spark.createDataFrame([("a", "new"), ("d", "x")], "node_id string, world_uuid string")
    assert writer.rows(like).count() == 2
    for _ in range(2):
        writer.write(like)
    assert {r.node_id: r.world_uuid for r in writer.rows(like).collect()} == {"a": "new", "c": "", "d": "x"}
    with pytest.raises(ValueError):
        writer.write(like.union(like))


class Refusing:
    def write_nodes(self, rows):
        raise OSError("refused")

    write_edges = write_nodes


def test_failed_writes_spend_attempts(spark):
    states = spark.createDataFrame([("a", "embedded", "pending", 0), ("b", "embedded", "pending", 2), ("c", "pending", "pending", 0)], "node_id string, embedding_status string, write_status string, retry_count int")
    found, there = manifestation.write_nodes(states, Refusing())
    assert there and {r.node_id: (r.write_status, r.retry_count) for r in found.collect()} == {"a": ("pending", 1), "b": ("failed", 3), "c": ("pending", 0)}


def test_edges_need_both_ends_in_the_graph(spark, tmp_path):
    graph = manifestation.TableGraph(str(tmp_path / "g"))
    graph.write_nodes(spark.createDataFrame([("a", "w"), ("b", "w")], "node_id string, world_uuid string"))
    edges = spark.createDataFrame([("e", "a", "b", "pending", 0), ("f", "a", "x", "pending", 0), ("g", "a", "b", "waiting_dependency", 0)], "edge_id string, source_node_id string, target_node_id string, status string, retry_count int")
    done, there = manifestation.write_edges(edges, graph, "w")
    assert there and {r.edge_id: r.status for r in done.collect()} == {"e": "written", "f": "written", "g": "waiting_dependency"}
    assert [r.edge_id for r in graph.edges.rows(spark.createDataFrame([], "edge_id string")).collect()] == ["e"]


def test_many_queries_go_in_blocks(spark):
    points = spark.createDataFrame([(i, 0, [float(i % 7), 1.0]) for i in range(40)], "point_id int, label int, vector array<float>")
    asked = points.selectExpr("point_id as query_id", "vector as query_vector", "label")
    rows = lambda n: sorted(map(tuple, vectors.top_k_batch(points, asked, 3, 0.1, "label", n).collect()))
    assert rows(7) == rows(10_000) and len(rows(7)) == 120


def test_blocks_of_points_meet_blocks_of_queries(spark, monkeypatch):
    """Products of small blocks against a plain scan, with copies, ties, other lengths, zeros and vectors that are no numbers."""
    monkeypatch.setattr(vectors, "POINTS_BLOCK", 16)
    monkeypatch.setattr(vectors, "QUERIES_BLOCK", 4)
    draw = random.Random(9)
    made = [[draw.gauss(0, 1) for _ in range(4)] for _ in range(30)]
    rows = [(i, i % 2, made[i % 60 // 2]) for i in range(300)] + [(400, 0, [0.0] * 4), (401, 0, [1.0, float("nan"), 1.0, 1.0]), (402, 0, [float("inf")] * 4), (403, 1, [1.0] * 3), (404, 1, None), (405, 0, [1.0, None, 0.0, 2.0]), (406, None, [1.0] * 4)]
    points = spark.createDataFrame(rows, "point_id long, label int, vector array<float>")
    asked = points.filter("point_id % 4 < 2 or point_id >= 400").selectExpr("point_id as query_id", "vector as query_vector", "label")
    scored = points.join(asked, "label").select("query_id", "point_id", vectors.cosine(F.col("vector"), F.col("query_vector")).alias("score")).collect()
    for k, minimum in ((3, 0.1), (7, -1.0), (1, 0.9)):
        want = set()
        for q in {r.query_id for r in scored}:
            best = sorted((-r.score, r.point_id) for r in scored if r.query_id == q and r.score is not None and r.score >= minimum)[:k]
            want |= {(q, p, -s, n + 1) for n, (s, p) in enumerate(best)}
        for limit in (10_000, 20):
            found = vectors.top_k_batch(points, asked, k, minimum, "label", limit)
            assert {tuple(r) for r in found.collect()} == want, (k, minimum, limit)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_responses_are_judged_alike(spark):
    good = '{"nodes":[{"display_name":"a","description":"b"}],"edges":[]}'
    texts = [good + extraction.MARKER, good, "not json " + extraction.MARKER, "[1]" + extraction.MARKER, f"```json\n{good}\n```\n{extraction.MARKER} more", f"Sure: {good} done {extraction.MARKER}", '{"nodes":[{"display_name":1,"description":"b"}],"edges":[]}' + extraction.MARKER, '{"nodes":[]}' + extraction.MARKER, "", '{"nodes":[],"edges":[],"x":NaN}' + extraction.MARKER]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, response string")
    assert {r.i: r.error for r in extraction.parse(rows).collect()} == {i: extraction.response_value(t)[1] for i, t in enumerate(texts)}


def test_reconcile_twice_changes_nothing(spark):
    states = spark.createDataFrame([("p1", "embedded", 2, "x"), ("p2", "pending", 2, None), ("p3", "failed", 3, None)], "point_id string, status string, retry_count int, text_hash string")
    points = spark.createDataFrame([("p1", "x", "run"), ("p2", "old", "run"), ("p3", "z", "run")], "point_id string, text_hash string, run_id string")
    chunks = spark.createDataFrame([("p1", "x"), ("p2", "y"), ("p3", "z")], "point_id string, text_hash string")
    once = reconcile.embedding_states(states, points, chunks, F.lit("run"))
    got = {r.point_id: (r.status, r.retry_count, r.stale_point) for r in once.collect()}
    assert got == {"p1": ("embedded", 2, False), "p2": ("pending", 0, True), "p3": ("embedded", 0, False)}
    twice = reconcile.embedding_states(once.drop("stale_point"), points, chunks, F.lit("run"))
    assert sorted(map(str, twice.select(*once.columns).collect())) == sorted(map(str, once.collect()))


def test_upsert_and_delete(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, seq int")
    found = reconcile.upsert(table, changes, ["id"], "seq")
    assert sorted(map(tuple, found.collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert reconcile.delete(found, spark.createDataFrame([], "id int"), "id").count() == 3


def test_cosine_search_and_context(spark):
    points = spark.createDataFrame([(1, "w", [1.0, 0.0]), (2, "w", [0.8, 0.6]), (3, "w", [0.0, 1.0]), (4, "v", [1.0, 0.0]), (5, "w", [0.0, 0.0])], "point_id int, world string, vector array<float>")
    hits = vectors.top_k(points, [1.0, 0.0], 10, 0.15, world=F.col("world") == "w").collect()
    assert [(r.point_id, r.score) for r in hits] == [(1, 1.0), (2, 0.8)]
    assert vectors.top_k(points, [1.0, 0.0], 0, 0.15).count() == 0
    rows = spark.createDataFrame([("q", 2, "two"), ("q", 1, "one"), ("q", 3, ""), ("q", 4, None)], "q string, r int, t string")
    assert vectors.model_context(rows, ["q"], "r", "t").first().context == "one\n\ntwo"
    state = vectors.verified(spark.createDataFrame([(1, "h", 1.0), (2, "h", 1.0), (3, "h", 1.0)], "id int, text_hash string, score double"), spark.createDataFrame([(1, "h", "t"), (2, "g", "t")], "id int, stored_hash string, chunk_text string"), ["id"])
    assert {r.id: r.outcome for r in state.collect()} == {1: "valid", 2: "stale", 3: "missing"}


def test_signatures_combine_and_tell_sorted_rows_apart(spark):
    draw = random.Random(3)
    old = [(c, draw.choice("xyz"), draw.randrange(3)) for c in range(60) for _ in range(draw.randrange(1, 5))]
    new = [r for r in old if draw.random() < 0.97] + [r for r in old if draw.random() < 0.02] + [(70, None, 1)]
    draw.shuffle(new)
    frame = lambda rows: spark.createDataFrame(rows, "c int, a string, n int")
    found = reconcile.signatures(frame(new), ["c"], ["a", "n"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan and "partial_sum" in plan
    rows = lambda part, c: sorted(((a or "", n) for k, a, n in part if k == c))
    want = {c for c in {r[0] for r in old + new} if rows(old, c) != rows(new, c)}
    assert {r.c for r in reconcile.stale_chunks(frame(old), frame(new), ["c"], ["a", "n"]).collect()} == want and 0 < len(want) < 40
