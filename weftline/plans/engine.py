"""EP1-EP7, ST7-ST16, FLT17-FLT19: a world from source files to chunks, vectors and graph, and retrieval from it.

State lives in keyed tables under one folder a world. Each stage works on what is not done and commits what it changed,
so a run can stop anywhere and be started again, costs what is new, and changes nothing if nothing is. What a graph or
vector store must forget waits in an outbox until the store has done so.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.status import embedding_rollup, extraction_rollup, manifestation_rollup, node_status
from ..operators import chunking, extraction, manifestation, reconcile, vectors, work
from ..operators.chunking import SplitterConfig
from ..sources import stored, text_sources
from ..sources.keyed import CommitConflict, KeyedTable, Lease, LeaseLost, Numbered

CHUNKS = "world_id string, world_uuid string, source_filename string, book_number int, chunk_number int, chunk_position string, overlap_text string, chunk_text string, chunk_file string, point_id string, text_hash string"
POINTS = "point_id string, vector array<float>, text_hash string, run_id string, book_number int, chunk_number int"
STATES = "point_id string, book_number int, chunk_number int, chunk_text string, text_hash string, status string, retry_count int, last_error_code string"
PASSES = "book_number int, chunk_number int, text_hash string, pass_type string, pass_number int, response string, code string, instructions string, run_id string, provider_id string, model_id string"
NODES = "book_number int, chunk_number int, node_id string, display_name string, description string, point_id string, text_hash string, embedding_status string, write_status string, retry_count int"
EDGES = "book_number int, chunk_number int, edge_id string, source_node_id string, target_node_id string, description string, strength int, status string, retry_count int"
NODE_VECTORS = (
    "node_id string, vector array<float>, point_id string, world_uuid string, ingestion_run_id string, source_filename string, book_number int, chunk_number int, chunk_position string, chunk_file string, chunk_text_hash string, "
    "display_name string, text_hash string, provider_id string, model_id string, task_type string, dimensions int, embedding_model_id string, embedding_profile_version int, embedding_profile_key string"
)
#: What stores must forget: kind is edge, node or vector.
OUTBOX = "kind string, id string, version long, book_number int, chunk_number int"
#: The passes that a chunk's candidates in nodes and edges were made from.
MANIFESTED = "book_number int, chunk_number int, signature string"
_KEYS = {
    "sources": ["book_number"], "source_backups": ["book_number"], "chunks": ["point_id"], "points": ["point_id"], "states": ["point_id"], "passes": ["book_number", "chunk_number", "pass_number"],
    "nodes": ["node_id"], "edges": ["edge_id"], "outbox": ["kind", "id"], "manifested": ["book_number", "chunk_number"],
}
_CHUNK = ["book_number", "chunk_number"]


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


#: What a hit that fails verification is called.
_WARNINGS = {"missing": "RETRIEVAL_CHUNK_FILE_MISSING", "stale": "RETRIEVAL_CHUNK_VECTOR_STALE"}


class WorldLocked(ValueError):
    """FLT18: the splitter or profile of a world cannot change without a full re-ingest; FLT19: nor its extraction defaults during a run."""


class Cancellation:
    """ST18: ends a world's run from another thread.

    Spark cancels the job in flight, so no answer that comes late is stored; what was not written stays pending, and
    the run pauses. A world's snapshots are whole or not there, so a cancelled write leaves nothing behind.
    """

    def __init__(self, spark: SparkSession):
        self._context, self._group, self._asked = spark.sparkContext, f"world-{uuid.uuid4().hex}", threading.Event()

    @property
    def asked(self) -> bool:
        return self._asked.is_set()

    def cancel(self) -> None:
        self._asked.set()
        self._context.cancelJobGroup(self._group)

    def run(self, stages: list[Callable[[], None]]) -> bool:
        """The stages in order as one group of jobs; False if they were cancelled before their end."""
        self._context.setJobGroup(self._group, "world", True)
        try:
            for stage in stages:
                if self.asked:
                    return False
                stage()
        except Exception:  # noqa: BLE001  a cancelled job fails in whatever way its action fails
            if not self.asked:
                raise
            return False
        finally:
            for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                self._context.setLocalProperty(name, None)
        return True


@dataclass
class Models:
    """The injected models and their names."""

    embed: work.Embedder
    extract: work.Extractor
    profile: dict = field(default_factory=lambda: {"provider_id": "local", "model_id": "stand-in", "dimensions": 16, "task_type": "RETRIEVAL_DOCUMENT", "profile_version": 1})
    instructions: str = "List the entities and relationships of the chunk as JSON, then the end mark."
    gleans: int = 1
    in_flight: int = 8
    #: FLT13: counts what is sent, against the limits of embedding and extraction; None does not count.
    count_tokens: work.TokenCounter | None = None
    embed_limit: int | None = None
    extract_limit: int | None = None
    #: UDF6: has write_nodes(rows), write_edges(rows), delete_nodes(ids) and delete_edges(ids); None keeps tables in the world's folder.
    graph: object | None = None
    #: UDF5: has write(rows) and delete(ids) of points; None keeps a table in the world's folder.
    vectors: object | None = None
    #: UDF1: embeds what is asked for, where that is not what embeds documents.
    embed_query: work.Embedder | None = None
    #: ST6: who answers the passes.
    extraction_profile: dict = field(default_factory=lambda: {"provider_id": "local", "model_id": "stand-in"})

    def embedder(self) -> work.Embedder:
        return work.guarded(self.embed, self.count_tokens, self.embed_limit)

    def query_embedder(self) -> work.Embedder:
        return work.guarded(self.embed_query or self.embed, self.count_tokens, self.embed_limit)

    def extractor(self) -> work.Extractor:
        return work.guarded(self.extract, self.count_tokens, self.extract_limit, needs_limit=True)


class World:
    """One world. A driver that begins a run takes the world over; another's commits fail from then on and leave nothing."""

    def __init__(self, spark: SparkSession, folder: str, name: str, splitter: SplitterConfig, models: Models, buckets: int = 8):
        self.buckets = buckets  # of each table by a hash of its key; the same for all who open the world
        self.spark, self.folder, self.name, self.splitter, self.models = spark, folder.rstrip("/"), name, splitter, models
        self.meta, self.lease = Numbered(spark, f"{self.folder}/meta"), Lease(spark, f"{self.folder}/lease")
        self._tables: dict[str, KeyedTable] = {}
        saved = self.meta.last()[1]
        if saved:
            self.info = json.loads(saved)
            if self.info["splitter"] != asdict(splitter):
                raise WorldLocked("WORLD_SPLITTER_CONFIG_LOCKED")
            if self.info["profile"] != models.profile:
                raise WorldLocked("WORLD_EMBEDDING_PROFILE_LOCKED")
        else:
            self.info = {"world_uuid": str(uuid.uuid4()), "name": name, "splitter": asdict(splitter), "profile": models.profile, "run": None, "status": None}
        if self.info.get("extraction"):  # saved defaults come before those of the call
            models.instructions, models.gleans = self.info["extraction"]["instructions"], self.info["extraction"]["gleans"]

    def _table(self, name: str) -> KeyedTable:
        if name not in self._tables:
            self._tables[name] = KeyedTable(self.spark, f"{self.folder}/{name}", _KEYS[name], self.buckets, self.lease.check)
        return self._tables[name]

    def _vectors(self):
        return self.models.vectors or manifestation.TableVectors(f"{self.folder}/node_vectors", self.lease.check, self.buckets)

    def _graph(self):
        return self.models.graph or manifestation.TableGraph(f"{self.folder}/graph", self.lease.check, self.buckets)

    def _work(self) -> str:
        return f"{self.folder}/_work/{self.lease.token or 0}"

    def _keep(self, rows: DataFrame) -> DataFrame:
        """rows as a table under the world's folder: a call to a model is never repeated by a recomputation."""
        path = f"{self._work()}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _save(self, status: str) -> None:
        """ST15: a paused run goes on under its id; a completed one is followed by a new id. A run begins with the lease."""
        if status == "active":
            self.lease.take()
            saved = self.meta.last()[1]
            if saved and not self.info["status"] == "completed":
                self.info = json.loads(saved) | {k: v for k, v in self.info.items() if k in ("extraction",)}
            self._tables.clear()
            if self.info["status"] not in ("active", "paused"):
                self.info["run"] = f"run-{uuid.uuid4()}"
        self.lease.check()
        self.info["status"] = status
        number = self.meta.last()[0] + 1
        if not self.meta.put(number, json.dumps(self.info)):
            raise CommitConflict(f"{self.folder} has a state {number}")
        for old in self.meta.numbers()[:-5]:
            self.meta.drop(old)

    def set_extraction(self, instructions: str | None = None, gleans: int | None = None) -> None:
        """FLT19: new defaults of extraction for this world; not while a run is active, also one that another driver began."""
        saved = self.meta.last()[1]
        if saved and json.loads(saved)["status"] == "active":
            raise WorldLocked("GRAPH_CONFIG_RUN_ACTIVE")
        kept = {"instructions": self.models.instructions if instructions is None else instructions, "gleans": self.models.gleans if gleans is None else gleans}
        self.models.instructions, self.models.gleans = kept["instructions"], kept["gleans"]
        self.info["extraction"] = kept
        self._save(self.info["status"])

    def ingest(self, path: str, cancellation: Cancellation | None = None) -> dict:
        """EP1, EP2: new or unfinished sources at path through all stages; a report of counts and statuses."""
        self._save("active")
        return self._run([lambda: self._store_sources(path), self._split, self._embed, self._extract, self._manifest], cancellation)

    def reingest(self, cancellation: Cancellation | None = None) -> dict:
        """EP3, ST16: all derived tables anew from the stored sources; the stores forget what the last run wrote."""
        self.info["status"] = "completed"
        self._save("active")
        return self._run([self._clear, self._restore_sources, self._split, self._embed, self._extract, self._manifest], cancellation)

    def _clear(self) -> None:
        """What stores hold goes to the outbox before the tables forget it."""
        self._forget(self._table("nodes").read(NODES), self._table("edges").read(EDGES))
        for name, schema in (("manifested", MANIFESTED), ("edges", EDGES), ("nodes", NODES), ("passes", PASSES), ("states", STATES), ("points", POINTS), ("chunks", CHUNKS)):
            self._table(name).replace(self.spark.createDataFrame([], schema))

    def _forget(self, nodes: DataFrame, edges: DataFrame) -> None:
        """JN12: these nodes, their vectors and these edges are to be deleted in the stores."""
        table = self._table("outbox")
        version = F.lit(table.version() + 1).cast("long").alias("version")
        of = lambda rows, kind, key: rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), version, *_CHUNK)
        gone = self._keep(of(edges, "edge", "edge_id").unionByName(of(nodes, "node", "node_id")).unionByName(of(nodes, "vector", "point_id")))
        if gone.limit(1).count():
            table.upsert(gone)

    def _deliver(self) -> bool:
        """ST10, JN13: deletes that wait, edges first; a store that is away keeps its own waiting. False if the graph's wait.

        A delete that was done but not struck off is done again, which changes nothing.
        """
        table, graph, vectors = self._table("outbox"), self._graph(), self._vectors()
        waiting = self._keep(table.read(OUTBOX))
        graph_done = True
        for kind, store, name, key in (("edge", graph, "delete_edges", "edge_id"), ("node", graph, "delete_nodes", "node_id"), ("vector", vectors, "delete", "point_id")):
            rows = waiting.filter(F.col("kind") == kind)
            if not rows.limit(1).count():
                continue
            try:
                getattr(store, name)(rows.select(F.col("id").alias(key)))
            except (LeaseLost, CommitConflict):
                raise
            except Exception:  # noqa: BLE001  a store may raise anything, or have no deletes
                graph_done = graph_done and kind == "vector"
                continue
            table.delete(rows)
        return graph_done

    def _run(self, stages: list[Callable[[], None]], cancellation: Cancellation | None) -> dict:
        """ST15, ST18: the stages of a run that has begun; it completes, or pauses with what is left."""
        try:
            ended = (cancellation or Cancellation(self.spark)).run(stages)
        except LeaseLost:
            raise  # the run is another driver's
        except BaseException:
            self._save("paused")  # a run that fails is not active any more
            raise
        report = self.report()
        self._save("completed" if ended and report["complete"] else "paused")
        stored.Snapshots(self.spark, self._work()).drop()
        return report | {"run": self.info["run"], "cancelled": not ended}

    def _restore_sources(self) -> None:
        """SRC9: slots whose stored source is gone get their backup copy again."""
        table, backups = self._table("sources"), self._table("source_backups").read(self._SOURCES)
        held = table.read(self._SOURCES)
        event = stored.with_backup(held, backups, "book_number", "content").filter("event = 'SOURCE_MISSING_SWITCHED_TO_BACKUP'")
        lost = self._keep(backups.join(event.select("book_number"), "book_number", "left_semi"))
        if lost.limit(1).count():
            table.upsert(lost)

    _SOURCES = "book_number int, source_filename string, content binary, content_sha256 string, text string"

    def _store_sources(self, path: str) -> None:
        """SRC8, JN8: adds new sources in the next slots; a known name with other bytes needs a re-ingest.

        Names and digests decide first; only new files are converted, once.
        """
        table = self._table("sources")
        files = text_sources.read_sources(self.spark, path)
        stored_names = table.read(self._SOURCES).select("book_number", "source_filename", "content_sha256")
        plan = self._keep(stored.plan_requests(files.select("source_filename", "content_sha256"), stored_names, "source_filename", "content_sha256", "book_number").select("source_filename", "decision"))
        refused = plan.filter("decision not in ('new', 'resume')").select("source_filename", "decision").limit(20).collect()
        if refused:
            raise ValueError(", ".join(f"{r.source_filename}: {r.decision}" for r in refused))
        if not plan.filter("decision = 'new'").limit(1).count():
            return
        new = self._keep(text_sources.convert(files.join(plan.filter("decision = 'new'").select("source_filename"), "source_filename", "left_semi")).select("source_filename", "content", "content_sha256", "text", "error"))
        bad = new.filter("error is not null").select("source_filename", "error").limit(20).collect()
        if bad:
            raise ValueError(", ".join(f"{r.source_filename}: {r.error}" for r in bad))
        # Slots are given in order of names; names are few beside their texts and alone pass the one sort.
        start = stored_names.agg(F.coalesce(F.max("book_number"), F.lit(0)).alias("m")).first().m
        slots = new.select("source_filename").withColumn("book_number", F.row_number().over(Window.orderBy("source_filename")) + F.lit(start))
        rows = self._keep(new.join(slots, "source_filename").select("book_number", "source_filename", "content", "content_sha256", "text"))
        self._table("source_backups").upsert(rows)
        table.upsert(rows)

    def _split(self) -> None:
        """EP1: chunks of books that have none yet."""
        table = self._table("chunks")
        held = table.read(CHUNKS)
        fresh = self._table("sources").read(self._SOURCES).join(held.select("book_number").distinct(), "book_number", "left_anti")
        if not fresh.limit(1).count():
            return
        chunks = chunking.split(fresh.select("book_number", "source_filename", "text"), self.splitter)
        made = chunking.chunk_records(chunks, F.lit(self.info["world_uuid"]), F.lit(self.name), F.col("book_number"), F.col("source_filename"))
        table.upsert(made.select(*held.columns))

    def _embed(self) -> None:
        """EP4, ST1-ST3, ST8: reconciles states with points, then embeds what is pending."""
        chunks, points = self._table("chunks").read(CHUNKS), self._table("points").read(POINTS)
        saved = self._table("states").read(STATES)
        base = chunks.select("point_id", "book_number", "chunk_number", "chunk_text").join(saved.select("point_id", "status", "retry_count", "last_error_code"), "point_id", "left")
        base = base.withColumns({"was": F.col("status"), "status": F.coalesce("status", F.lit("pending")), "retry_count": F.coalesce("retry_count", F.lit(0))})
        # Points of earlier completed runs of this world are still good while their text is.
        first = points.select("run_id").limit(1).collect()
        run = F.lit(first[0].run_id if first else self.info["run"])
        judged = reconcile.embedding_states(base, points, chunks.select("point_id", "text_hash"), run)
        changed = self._keep(judged.filter("not (status = 'embedded' and coalesce(was, '') = 'embedded')").drop("was"))
        if not changed.limit(1).count():
            return
        states, found = work.embed_all(changed.drop("stale_point"), "point_id", "chunk_text", self.models.embedder(), self._keep, self.models.in_flight)
        fresh = self._keep(found.join(chunks.select("point_id", "text_hash", "book_number", "chunk_number"), "point_id").withColumn("run_id", run).select(*points.columns))
        stale = changed.filter("stale_point").join(fresh.select("point_id"), "point_id", "left_anti")
        self._table("points").change(fresh, stale)
        self._table("states").upsert(states.select(*saved.columns))

    def _extract(self) -> None:
        """EP5, ST4-ST7: passes of embedded books' chunks that are not extracted, or whose text changed."""
        states = self._table("states").read(STATES)
        books = states.groupBy("book_number").agg(embedding_rollup(F.col("status")).alias("r")).filter("r = 'completed'").select("book_number")
        chunks = self._table("chunks").read(CHUNKS).join(books, "book_number", "left_semi")
        table = self._table("passes")
        held = table.read(PASSES)
        good = held.groupBy("book_number", "chunk_number", "text_hash").agg(F.count_if(F.col("code").isNull()).alias("n")).filter(F.col("n") == self.models.gleans + 1)
        todo = chunks.join(good, ["book_number", "chunk_number", "text_hash"], "left_anti")
        if not todo.limit(1).count():
            return
        # Good passes of an unchanged text stay; a chunk goes on behind them, under the instructions of its first pass.
        keys = ["book_number", "chunk_number", "text_hash"]
        good = self._keep(held.filter("code is null").join(todo.select(*keys), keys, "left_semi").select(*held.columns))
        before = F.transform(F.array_sort(F.collect_list(F.struct("pass_number", "response"))), lambda x: x["response"])
        known = good.groupBy(*keys).agg(before.alias("earlier"), F.min_by("instructions", "pass_number").alias("instructions"), F.min_by("run_id", "pass_number").alias("run_id"))
        asked = self._keep(todo.join(known, keys, "left").withColumns({"earlier": F.coalesce("earlier", F.array().cast("array<string>")), "instructions": F.coalesce("instructions", F.lit(self.models.instructions)), "run_id": F.coalesce("run_id", F.lit(self.info["run"]))}))
        made = self._keep(work.extract_chunks(asked, keys, self.models.extractor(), extraction.pass_prompt, self.models.gleans, self.models.in_flight))
        # What the graph's parser refuses is a failed pass as well.
        judged = extraction.parse(made).withColumn("code", F.coalesce("code", F.when(F.col("response").isNotNull(), F.col("error"))))
        profile = self.models.extraction_profile
        new = self._keep(judged.join(asked.select(*keys, "run_id"), keys).withColumns({c: F.lit(profile.get(c)) for c in ("provider_id", "model_id")}).select(*held.columns))
        # Passes of these chunks that are neither good nor made anew go.
        key = table.keys
        old = held.join(asked.select(*_CHUNK), _CHUNK, "left_semi").join(good.select(*key).unionByName(new.select(*key)), key, "left_anti")
        table.change(new, old.select(*key))

    def _candidates(self, passes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Merged nodes and edges of extracted chunks; ids name the run in which a chunk's first pass was made."""
        parsed = extraction.parse(passes).filter("error is null")
        keys = [*_CHUNK, "run_id"]
        args = (F.lit(self.info["world_uuid"]), F.col("run_id"), F.col("book_number"), F.col("chunk_number"))
        seq = lambda: F.col("pass_number") * 1_000_000 + F.col("n")
        raw = parsed.select(*keys, "pass_number", F.posexplode("nodes").alias("n", "x")).select(*keys, seq().alias("seq"), "x.*")
        raw_edges = parsed.select(*keys, "pass_number", F.posexplode("edges").alias("n", "x")).select(*keys, seq().alias("seq"), "x.*")
        nodes = extraction.merge_nodes(raw, keys, *args)
        return nodes, extraction.merge_edges(raw_edges, nodes, keys, *args)

    def _manifest(self) -> None:
        """EP6, ST9-ST13: candidates to states, reconciled with the saved ones; stale rows leave the stores; vectors, then nodes, then edges.

        Only chunks whose passes changed since, or that are not done, are looked at.
        """
        passes = self._table("passes").read(PASSES).filter("code is null")
        now = reconcile.signatures(passes, _CHUNK, ["pass_number", "text_hash", "response", "run_id"])
        done = self._table("manifested").read(MANIFESTED)
        changed = now.join(done.withColumnRenamed("signature", "made"), _CHUNK, "full").filter("not (signature <=> made)").select(*_CHUNK, "signature")
        old, old_edges = self._table("nodes").read(NODES), self._table("edges").read(EDGES)
        open_chunks = old.filter(node_status(F.col("embedding_status"), F.col("write_status")) != "manifested").select(*_CHUNK).union(old_edges.filter("status <> 'written'").select(*_CHUNK))
        changed = self._keep(changed)
        touched = self._keep(changed.select(*_CHUNK).union(open_chunks).distinct())
        if not touched.limit(1).count():
            self._deliver()
            return
        old, old_edges = self._keep(old.join(touched, _CHUNK, "left_semi").select(*_names(NODES))), self._keep(old_edges.join(touched, _CHUNK, "left_semi").select(*_names(EDGES)))
        nodes, edges = self._candidates(passes.join(touched, _CHUNK, "left_semi"))
        fresh = self._keep(manifestation.node_states(nodes, F.lit(self.info["world_uuid"]), F.col("run_id"), F.col("book_number")).select(*_names(NODES)))
        links = self._keep(edges.withColumns({"status": F.lit("pending"), "retry_count": F.lit(0)}).select(*_names(EDGES)))
        stale = self._keep(reconcile.stale_chunks(old, fresh, _CHUNK, ["node_id", "text_hash"]).union(reconcile.stale_chunks(old_edges, links, _CHUNK, ["edge_id", "description", "strength"])).distinct())
        states = self._keep(reconcile.reconciled(fresh, old, stale, "node_id", _CHUNK, ["text_hash", "point_id"], ["embedding_status", "write_status", "retry_count"]).select(*_names(NODES)))
        links = self._keep(reconcile.reconciled(links, old_edges, stale, "edge_id", _CHUNK, [], ["status", "retry_count"]).select(*_names(EDGES)))
        # First what is to be forgotten, then the states that no longer know it.
        self._forget(old.join(stale, _CHUNK, "left_semi"), old_edges.join(stale, _CHUNK, "left_semi"))
        self._table("nodes").change(states, old.join(states.select("node_id"), "node_id", "left_anti"))
        self._table("edges").change(links, old_edges.join(links.select("edge_id"), "edge_id", "left_anti"))
        self._table("manifested").change(changed.filter("signature is not null"), changed.filter("signature is null"))
        forgotten = self._deliver()
        self._embed_nodes_and_write(states, links, forgotten)

    def _embed_nodes_and_write(self, states: DataFrame, links: DataFrame, forgotten: bool) -> None:
        """ST11-ST13: the touched chunks' nodes and edges; the graph takes nothing while its deletes wait."""
        asked = states.select("node_id", F.concat("display_name", F.lit("\n\n"), "description").alias("text"), F.when(F.col("embedding_status") == "embedded", "embedded").otherwise("pending").alias("status"), "retry_count", F.lit(None).cast("string").alias("last_error_code"))
        done, found = work.embed_all(self._keep(asked), "node_id", "text", self.models.embedder(), self._keep, self.models.in_flight)
        states = self._keep(states.drop("embedding_status", "retry_count").join(done.select("node_id", F.col("status").alias("embedding_status"), "retry_count"), "node_id").select(*_names(NODES)))
        chunks = self._table("chunks").read(CHUNKS).join(states.select(*_CHUNK).distinct(), _CHUNK, "left_semi")
        places = self._keep(chunks.select(*_CHUNK, "source_filename", "chunk_position", "chunk_file", F.col("text_hash").alias("chunk_text_hash"), F.lit(self.info["run"]).alias("ingestion_run_id")))
        self._vectors().write(self._keep(manifestation.vector_rows(found, states, places, self.info["world_uuid"], self.info["profile"]).select(*_names(NODE_VECTORS))))
        if forgotten:
            graph = self._graph()
            states, there = manifestation.write_nodes(states, graph, self.info["world_uuid"], places)
            states = self._keep(states.select(*_names(NODES)))
            if there:  # without a sink edges are left as they are
                links = self._keep(manifestation.edge_dependencies(links, states))
                links, _ = manifestation.write_edges(links, graph, self.info["world_uuid"], places, states)
        self._table("nodes").upsert(states)
        self._table("edges").upsert(links.select(*_names(EDGES)))

    def book_totals(self) -> DataFrame:
        """AGG5: nodes and edges of each book."""
        return manifestation.book_totals(self._table("nodes").read(NODES), self._table("edges").read(EDGES), "book_number")

    def report(self) -> dict:
        """AGG2-AGG5, FLT17: counts and roll-ups; complete if every stage of every book is."""
        states, passes = self._table("states").read(STATES), self._table("passes").read(PASSES)
        nodes, edges = self._table("nodes").read(NODES), self._table("edges").read(EDGES)
        chunk = passes.groupBy("book_number", "chunk_number").agg(F.when(F.count_if(F.col("code").isNotNull()) == 0, "extracted").when(F.count_if(F.col("code").isNull()) > 0, "partial").otherwise("failed").alias("status"))
        both = nodes.select(node_status(F.col("embedding_status"), F.col("write_status")).alias("status")).union(edges.select("status"))
        one = lambda df, c: df.agg(c.alias("r"), F.count("*").alias("n")).first()
        e, x, m = one(states, embedding_rollup(F.col("status"))), one(chunk, extraction_rollup(F.col("status"))), one(both, manifestation_rollup(F.col("status")))
        return {"chunks": e.n, "nodes": nodes.count(), "edges": edges.count(), "embedding": e.r, "extraction": x.r, "manifestation": m.r, "complete": e.r == x.r == m.r == "completed" and e.n == x.n}

    def retrieve(self, text: str, top_k: int = 10, minimum: float = 0.15) -> dict:
        """EP7: the verified chunks most similar to text, with the context they make; invalid hits are repaired, not replaced."""
        if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 0:
            return {"success": False, "errors": ["INVALID_TOP_K"], "chunks": [], "context": ""}
        if isinstance(minimum, bool) or not isinstance(minimum, (int, float)) or not 0 <= minimum <= 1:
            return {"success": False, "errors": ["INVALID_SIMILARITY_MINIMUM"], "chunks": [], "context": ""}
        states = self._table("states").read(STATES)
        k = min(top_k, states.filter("status = 'embedded'").count())
        if top_k == 0:
            return {"success": True, "errors": [], "chunks": [], "context": ""}
        if not text.strip():
            return {"success": False, "errors": ["EMPTY_RETRIEVAL_QUERY"], "chunks": [], "context": ""}
        if not k:
            return {"success": True, "errors": [], "warnings": ["WORLD_HAS_NO_EMBEDDED_CHUNKS"], "chunks": [], "context": ""}
        asked = work.called(self.models.query_embedder(), text.strip())
        if "vector" not in asked:
            return {"success": False, "errors": [asked["code"]], "chunks": [], "context": ""}
        hits = self._keep(vectors.top_k(self._table("points").read(POINTS), list(asked["vector"]), k, minimum).select("point_id", "text_hash", "score"))
        chunks = self._table("chunks").lookup(CHUNKS, hits).select("point_id", F.sha2("chunk_text", 256).alias("stored_hash"), "chunk_text", "source_filename", "book_number", "chunk_number")
        rows = sorted(vectors.verified(hits, chunks, ["point_id"]).collect(), key=lambda r: (-r.score, r.book_number or 0, r.chunk_number or 0))  # k rows at most
        valid, gone = [r for r in rows if r.outcome == "valid"], [r for r in rows if r.outcome != "valid"]
        if gone:
            bad = self.spark.createDataFrame([(r.point_id, r.stored_hash) for r in gone], "point_id string, now string")
            self._table("points").delete(bad)
            self._table("states").upsert(states.join(bad, "point_id").withColumns({"text_hash": F.col("now"), "status": F.lit("pending")}).select(*states.columns))
        return {"success": True, "errors": [], "warnings": [_WARNINGS[r.outcome] for r in gone], "chunks": [r.asDict() for r in valid], "context": "\n\n".join(r.chunk_text for r in valid if r.chunk_text)}
