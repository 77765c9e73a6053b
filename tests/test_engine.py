"""A world end to end with stand-in models."""

import os
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from weftline.operators.chunking import SplitterConfig
from weftline.operators import manifestation
from weftline.operators.manifestation import GraphStoreUnavailable
from weftline.plans.engine import CHUNKS, NODE_VECTORS, Cancellation, Models, World, WorldLocked
from weftline.plans.providers import standin_embedder, standin_extractor
from weftline.sources.keyed import LeaseLost


def make(spark, folder, models=None, size=60):
    return World(spark, str(folder), "w", SplitterConfig(size, 20, 10), models or Models(standin_embedder(), standin_extractor(), in_flight=2), buckets=1)


def test_ingest_resume_append_retrieve(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("Mara met Tor by the river. Tor gave Mara a lantern. They walked to Vell.\n\nVell was dark.")
    world = make(spark, tmp_path / "w")
    first = world.ingest(str(source))
    assert first["complete"] and first["chunks"] >= 2 and first["nodes"] and first["edges"]
    points = world._vectors().rows(spark.createDataFrame([], NODE_VECTORS))
    assert points.count() == first["nodes"] and points.filter("chunk_text_hash is null or source_filename <> 'a.txt' or embedding_profile_key is null or dimensions <> 16 or ingestion_run_id is null").count() == 0
    graph = world._graph().edges.rows(spark.createDataFrame([], "edge_id string, source_display_name string, target_display_name string, chunk_file string"))
    assert graph.count() == first["edges"] and graph.filter("source_display_name is null or target_display_name is null or chunk_file is null").count() == 0
    assert [tuple(r) for r in world.book_totals().collect()] == [(1, first["nodes"], first["edges"])]
    again = make(spark, tmp_path / "w").ingest(str(source))
    assert {k: again[k] for k in ("chunks", "nodes", "edges", "complete")} == {k: first[k] for k in ("chunks", "nodes", "edges", "complete")}
    (source / "b.txt").write_text("The archive of Ostra burned.")
    more = make(spark, tmp_path / "w").ingest(str(source))
    assert more["chunks"] == first["chunks"] + 1
    found = world.retrieve("archive of Ostra burned", top_k=1)
    assert found["context"] == "The archive of Ostra burned." and found["chunks"][0]["book_number"] == 2
    assert world.retrieve("x", top_k=0)["success"] and world.retrieve(" ")["errors"] == ["EMPTY_RETRIEVAL_QUERY"] and world.retrieve("x", top_k=True)["errors"]
    with pytest.raises(WorldLocked):
        make(spark, tmp_path / "w", size=61)
    (source / "b.txt").write_text("changed")
    with pytest.raises(ValueError, match="WORLD_REINGEST_REQUIRED"):
        make(spark, tmp_path / "w").ingest(str(source))
    # A chunk whose stored text changed is dropped from the hits and becomes pending.
    world = make(spark, tmp_path / "w")
    world.lease.take()
    table = world._table("chunks")
    table.upsert(table.read(CHUNKS).filter("book_number = 2").withColumn("chunk_text", F.lit("other")))
    stale = world.retrieve("archive of Ostra burned", top_k=1)
    assert stale["warnings"] == ["RETRIEVAL_CHUNK_VECTOR_STALE"] and stale["chunks"] == []
    assert world.report()["embedding"] == "partial"


def flaky(flag):
    """Fails on one word until a file that workers see is there."""

    def embed(text):
        import os

        if "dark" in text and not os.path.exists(flag):
            return {"code": "DOWN", "retryable": True}
        return standin_embedder()(text)

    return embed


def test_failed_chunk_pauses_and_resumes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("Mara met Tor by the river. Tor gave Mara a lantern. They walked to Vell.\n\nVell was dark.")
    flag = str(tmp_path / "flag")
    models = Models(flaky(flag), standin_extractor(), in_flight=2)
    report = make(spark, tmp_path / "w", models).ingest(str(source))
    assert report["embedding"] == "partial" and not report["complete"] and report["nodes"] == 0
    open(flag, "w").close()
    after = make(spark, tmp_path / "w", models).ingest(str(source))
    assert after["complete"] and after["run"] == report["run"]


def counting(log, answers):
    """An extractor that notes each prompt's kind in a file; answers(kind, earlier calls of that kind) is what it says, or None for a good answer."""

    def extract(prompt):
        kind = "glean" if "### Known nodes" in prompt else "initial"
        with open(log, "a+") as f:
            f.seek(0)
            before = f.read().split().count(kind)
            f.write(kind + " ")
        return answers(kind, before) or {"text": '{"nodes":[{"display_name":"Mara","description":"met"},{"display_name":"Tor","description":"too"}],"edges":[{"source_display_name":"Mara","target_display_name":"Tor","description":"met","strength":5}]} ---COMPLETE---'}

    return extract


def ran(spark, tmp_path, answers, **more):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in/a.txt").write_text("Mara met Tor.")
    log = str(tmp_path / "log")
    open(log, "w").close()
    report = make(spark, tmp_path / "w", Models(standin_embedder(), counting(log, answers), in_flight=1, **more)).ingest(str(tmp_path / "in"))
    return report, open(log).read().split()


def test_malformed_answers_spend_attempts(spark, tmp_path):
    bad = lambda kind, before: {"text": "not json ---COMPLETE---"} if kind == "initial" else None
    report, calls = ran(spark, tmp_path, bad)
    assert calls == ["initial"] * 3 and report["extraction"] == "failed" and not report["complete"] and report["nodes"] == 0


def test_rate_limits_spend_none_and_gleans_resume_alone(spark, tmp_path):
    limited = lambda kind, before: {"code": "LIMIT", "rate_limited": True, "retryable": True} if kind == "glean" else None
    report, calls = ran(spark, tmp_path, limited)
    assert calls == ["initial", "glean"] and report["extraction"] == "partial"
    report, calls = ran(spark, tmp_path, lambda kind, before: None)
    assert calls == ["glean"] and report["complete"] and report["nodes"] == 2 and report["edges"] == 2


class Away:
    def write_nodes(self, rows):
        raise GraphStoreUnavailable("away")

    write_edges = write_nodes


def test_graph_sink_that_is_away_and_too_long_texts(spark, tmp_path):
    none = lambda kind, before: None
    report, _ = ran(spark, tmp_path, none, graph=Away())
    assert report["manifestation"] == "partial" and not report["complete"]
    report, calls = ran(spark, tmp_path, none)
    assert calls == [] and report["complete"]
    (tmp_path / "more").mkdir()
    report, calls = ran(spark, tmp_path / "more", none, count_tokens=len, embed_limit=1000, extract_limit=5)
    assert calls == [] and report["embedding"] == "completed" and report["extraction"] == "failed"


def test_cancelled_run_pauses_and_goes_on(spark, tmp_path):
    seen, done = str(tmp_path / "seen"), str(tmp_path / "done")

    def slow(text):
        if not os.path.exists(done):
            open(seen, "w").close()
            time.sleep(4)
        return standin_extractor()(text)

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Mara met Tor by the river.")
    stop = Cancellation(spark)

    def cancel():
        while not os.path.exists(seen):
            time.sleep(0.05)
        stop.cancel()

    other = threading.Thread(target=cancel)
    other.start()
    world = make(spark, tmp_path / "w", Models(standin_embedder(), slow, in_flight=1))
    report = world.ingest(str(tmp_path / "in"), stop)
    other.join()
    assert report["cancelled"] and not report["complete"] and report["embedding"] == "completed" and report["nodes"] == 0
    open(done, "w").close()
    again = world.ingest(str(tmp_path / "in"))
    assert again["complete"] and not again["cancelled"] and again["run"] == report["run"]
    # One that is cancelled before it begins does nothing.
    assert world.ingest(str(tmp_path / "in"), stop)["cancelled"]


def test_extraction_defaults_are_kept_and_locked_during_a_run(spark, tmp_path):
    world = make(spark, tmp_path / "w")
    world.set_extraction("List what is named.", gleans=0)
    again = make(spark, tmp_path / "w")
    assert (again.models.instructions, again.models.gleans) == ("List what is named.", 0)
    again._save("active")
    with pytest.raises(WorldLocked, match="GRAPH_CONFIG_RUN_ACTIVE"):
        world.set_extraction(gleans=2)
    again._save("paused")
    world.set_extraction(gleans=2)
    assert make(spark, tmp_path / "w").models.gleans == 2


def test_a_run_that_fails_is_paused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_text("x")
    world = make(spark, tmp_path / "w")
    with pytest.raises(ValueError, match="UNSUPPORTED_FILE_TYPE"):
        world.ingest(str(tmp_path / "in"))
    assert make(spark, tmp_path / "w").info["status"] == "paused"


def naming(names, edge=True):
    """An extractor that always finds these names, the first two of them connected."""
    nodes = ",".join('{"display_name":"%s","description":"is there"}' % n for n in names)
    link = '{"source_display_name":"%s","target_display_name":"%s","description":"met","strength":5}' % tuple(names[:2]) if edge else ""
    return lambda prompt: {"text": '{"nodes":[%s],"edges":[%s]}---COMPLETE---' % (nodes, link)}


def held(world, spark):
    graph = world._graph()
    rows = lambda writer, key: {getattr(r, key) for r in writer.rows(spark.createDataFrame([], f"{key} string")).collect()}
    return rows(graph.nodes, "node_id"), rows(graph.edges, "edge_id"), rows(world._vectors(), "point_id")


class Flaky:
    """The world's own graph, which is away, or fails behind a write, while a file says so."""

    def __init__(self, graph, state):
        self.graph, self.state = graph, state

    def __getattr__(self, name):
        def call(rows):
            mode = open(self.state).read()
            if mode == "away":
                raise GraphStoreUnavailable("away")
            getattr(self.graph, name)(rows)
            if mode == "crash":
                raise KeyboardInterrupt

        return call


def test_reingest_leaves_only_the_new_graph(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Anna met Boris.")
    state = str(tmp_path / "state")
    open(state, "w").write("there")
    graph = Flaky(manifestation.TableGraph(str(tmp_path / "w/graph"), buckets=1), state)
    models = lambda names: Models(standin_embedder(), naming(names), in_flight=1, gleans=0, graph=graph)
    world = make(spark, tmp_path / "w", models(["Anna", "Boris"]))
    first = world.ingest(str(tmp_path / "in"))
    own = make(spark, tmp_path / "w")
    before = held(own, spark)
    assert first["complete"] and [len(x) for x in before] == [2, 1, 2]
    # Ids are those of the formula, with the run's id.
    namespace = uuid.UUID(world.info["world_uuid"])
    node = lambda run, name: str(uuid.uuid5(namespace, f"graph-candidate:{run}:book:1:chunk:1:node:{name}"))
    assert before[0] == {node(first["run"], "Anna"), node(first["run"], "Boris")}
    assert before[2] == {str(uuid.uuid5(namespace, f"graph-node:{first['run']}:book:1:node:{n}")) for n in before[0]}
    # A graph that is away keeps its deletes waiting, and takes nothing new before them.
    open(state, "w").write("away")
    second = make(spark, tmp_path / "w", models(["Clara", "Dmitri"])).reingest()
    assert not second["complete"] and held(own, spark)[:2] == before[:2] and held(own, spark)[2] & before[2] == set()
    # A crash between a delete and its acknowledgement: the next run deletes again, which changes nothing.
    open(state, "w").write("crash")
    with pytest.raises(KeyboardInterrupt):
        make(spark, tmp_path / "w", models(["Clara", "Dmitri"])).ingest(str(tmp_path / "in"))
    open(state, "w").write("there")
    third = make(spark, tmp_path / "w", models(["Clara", "Dmitri"])).ingest(str(tmp_path / "in"))
    after = held(own, spark)
    assert third["complete"] and third["run"] == second["run"] and after[0] == {node(second["run"], "Clara"), node(second["run"], "Dmitri")} and [len(x) for x in after] == [2, 1, 2]
    # Writing the same again makes no new version.
    versions = [graph.graph.nodes.table(spark.range(0)).version(), graph.graph.edges.table(spark.range(0)).version()]
    make(spark, tmp_path / "w", models(["Clara", "Dmitri"])).ingest(str(tmp_path / "in"))
    assert versions == [graph.graph.nodes.table(spark.range(0)).version(), graph.graph.edges.table(spark.range(0)).version()]


def test_a_run_that_is_taken_over_fails_and_leaves_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Anna met Boris.")
    other, extract = [], naming(["Anna", "Boris"])
    world = make(spark, tmp_path / "w", Models(standin_embedder(), extract, in_flight=1, gleans=0))
    kept = world._keep

    def keep(rows):
        if not other:  # in the middle of the first run another driver begins one
            other.append(make(spark, tmp_path / "w", Models(standin_embedder(), extract, in_flight=1, gleans=0)).ingest(str(tmp_path / "in")))
        return kept(rows)

    world._keep = keep
    with pytest.raises(LeaseLost, match="WORLD_RUN_TAKEN_OVER"):
        world.ingest(str(tmp_path / "in"))
    assert other[0]["complete"] and make(spark, tmp_path / "w").info["status"] == "completed" and [len(x) for x in held(make(spark, tmp_path / "w"), spark)] == [2, 1, 2]


def test_an_append_costs_what_it_adds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(40):
        (tmp_path / f"in/{i:03}.txt").write_text(f"Book {i} tells of person{i}. " * 60)
    models = lambda: Models(standin_embedder(), naming(["Anna", "Boris"]), in_flight=2, gleans=0)
    tables = ("sources", "source_backups", "chunks", "points", "states", "passes", "nodes", "edges")
    sizes = lambda: {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for t in tables for d, _, names in os.walk(tmp_path / "w" / t) for f in names if f.endswith(".parquet")}
    make(spark, tmp_path / "w", models(), size=2000).ingest(str(tmp_path / "in"))
    before = sizes()
    (tmp_path / "more").mkdir()
    (tmp_path / "more/z.txt").write_text("One more book.")
    report = make(spark, tmp_path / "w", models(), size=2000).ingest(str(tmp_path / "more"))
    new = {p: n for p, n in sizes().items() if p not in before}
    assert report["complete"] and report["chunks"] == 41 and set(before) <= set(sizes())
    # Each commit of the append has one row or few: a file, a few kilobytes.
    assert len(new) <= 2 * len(tables) and sum(new.values()) < 64_000
