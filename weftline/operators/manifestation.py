"""PRJ5-PRJ7, AGG5, SET2, JN6, JN7, JN9, ST10-ST12, SNK4-SNK8, UDF6: extracted candidates to vectors, graph nodes and dependency-checked edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import node_point_id, node_text, profile_key, sha256
from ..functions.status import EMBEDDED, FAILED, FAILED_DEPENDENCY, PENDING, RETRIES, WAITING_DEPENDENCY, WRITTEN, after_failure, node_status
from ..sources.keyed import CommitConflict, KeyedTable, LeaseLost
from .reconcile import detached


def node_states(nodes: DataFrame, world: Column, run: Column, book: Column) -> DataFrame:
    """PRJ5: pending states of merged nodes (of extracted chunks alone), with text hash and point id."""
    text = node_text(F.col("display_name"), F.col("description"))
    return nodes.withColumn("text_hash", sha256(text)).withColumn("point_id", node_point_id(world, run, book, F.col("node_id"))).withColumns({"embedding_status": F.lit(PENDING), "write_status": F.lit(PENDING), "retry_count": F.lit(0)})


def embedding_outcomes(pending: DataFrame, vectors: DataFrame, failures: DataFrame) -> DataFrame:
    """JN9, ST11: pending nodes (node_id, retry_count) after a batch: vectors (node_id, vector), failures (node_id, code).

    A node with neither counts as failed with NODE_EMBEDDING_MISSING. Three failures end it.
    """
    found = pending.join(vectors.select("node_id", "vector"), "node_id", "left").join(failures.select("node_id", "code"), "node_id", "left")
    done = F.col("vector").isNotNull()
    tries = F.when(done, 0).otherwise(F.col("retry_count") + 1)
    status = F.when(done, EMBEDDED).when(tries >= RETRIES, FAILED).otherwise(PENDING)
    return found.withColumns({"embedding_status": status, "retry_count": tries, "last_error_code": F.when(~done, F.coalesce("code", F.lit("NODE_EMBEDDING_MISSING")))}).drop("code")


def edge_dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN6: edges (status, retry_count, ...) after a look at both ends' (node_id, embedding_status, write_status).

    Written edges stay. A failed end comes first, then one that is not manifested (or unknown); other edges are released.
    """
    state = nodes.select("node_id", node_status(F.col("embedding_status"), F.col("write_status")).alias("__state"))
    ends = {side: state.select(F.col("node_id").alias(f"{side}_node_id"), F.col("__state").alias(f"__{side}")) for side in ("source", "target")}
    found = edges.join(ends["source"], "source_node_id", "left").join(ends["target"], "target_node_id", "left")
    is_in = lambda value: [F.coalesce(F.col(f"__{s}") == value, F.lit(False)) for s in ("source", "target")]
    failed, ready = is_in("failed"), is_in("manifested")
    status = F.when(F.col("status") == WRITTEN, WRITTEN).when(failed[0] | failed[1], FAILED_DEPENDENCY).when(~(ready[0] & ready[1]), WAITING_DEPENDENCY).otherwise(PENDING)
    retries = F.when((F.col("status") == FAILED) & (status == PENDING), 0).otherwise(F.col("retry_count"))
    return found.withColumns({"__new": status, "__tries": retries}).select(*[c for c in edges.columns if c not in ("status", "retry_count")], F.col("__new").alias("status"), F.col("__tries").alias("retry_count"))


def writable_edges(edges: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """JN7: edges whose both ends stand in the graph under the same world; others vanish from the write."""
    known = graph_nodes.select("node_id", "world_uuid").distinct()
    out = edges
    for side in ("source_node_id", "target_node_id"):
        out = out.join(known.withColumnRenamed("node_id", side), [side, "world_uuid"], "left_semi")
    return out


class GraphStoreUnavailable(RuntimeError):
    """The graph store cannot be reached; nothing was written."""


class UnavailableWriter:
    """SNK8: a graph sink that is not there; work stays pending."""

    def __init__(self, reason: str):
        self.reason = reason

    def write(self, rows: DataFrame) -> None:
        raise GraphStoreUnavailable(self.reason)

    write_nodes = write_edges = write


class TableWriter:
    """SNK5-SNK7: a graph table upserted by id; ids are asserted to be unique in a write.

    A row that stands there already, by id and version (a digest of its columns), is not written again, so that a write
    that was done but not acknowledged changes nothing when it is repeated.
    """

    def __init__(self, folder: str, key: str, guard: Callable[[], None] | None = None, buckets: int = 8):
        self.folder, self.key, self.guard, self.buckets = folder, key, guard, buckets

    def table(self, rows: DataFrame) -> KeyedTable:
        return KeyedTable(rows.sparkSession, self.folder, [self.key], self.buckets, self.guard)

    def rows(self, like: DataFrame) -> DataFrame:
        """What the table holds, in the columns of like."""
        return self.table(like).read(like.schema)

    def write(self, rows: DataFrame) -> None:
        if rows.groupBy(self.key).count().filter("count > 1").limit(1).count():
            raise ValueError(f"{self.key} repeats in one write")
        held = self.table(rows)
        known = held.read(f"{self.key} string, row_version string")
        made = rows.withColumn("row_version", F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256))
        new = made.join(known, [self.key, "row_version"], "left_anti").select(*made.columns)
        if new.limit(1).count():
            held.upsert(new)

    def delete(self, ids: DataFrame) -> None:
        """JN12: the rows of ids; ids that are not there change nothing."""
        held = self.table(ids)
        there = held.read(f"{self.key} string").join(ids.select(self.key).distinct(), self.key, "left_semi")
        if there.limit(1).count():
            held.delete(there)


class TableGraph:
    """UDF6: the graph sink that a world has unless another is injected: two tables; edges need both ends in the first."""

    def __init__(self, folder: str, guard: Callable[[], None] | None = None, buckets: int = 8):
        self.nodes, self.edges = TableWriter(f"{folder}/nodes", "node_id", guard, buckets), TableWriter(f"{folder}/edges", "edge_id", guard, buckets)

    def write_nodes(self, rows: DataFrame) -> None:
        self.nodes.write(rows)

    def write_edges(self, rows: DataFrame) -> None:
        held = self.nodes.rows(rows.sparkSession.createDataFrame([], "node_id string, world_uuid string"))
        self.edges.write(writable_edges(rows, held))

    def delete_edges(self, ids: DataFrame) -> None:
        self.edges.delete(ids)

    def delete_nodes(self, ids: DataFrame) -> None:
        """JN13: with a node go the edges at it."""
        held = self.edges.rows(ids.sparkSession.createDataFrame([], "edge_id string, source_node_id string, target_node_id string"))
        self.edges.delete(held.join(detached(held, ids).select("edge_id"), "edge_id", "left_anti"))
        self.nodes.delete(ids)


class TableVectors:
    """UDF5: the node vector store that a world has unless another is injected."""

    def __init__(self, folder: str, guard: Callable[[], None] | None = None, buckets: int = 8):
        self._writer = TableWriter(folder, "point_id", guard, buckets)

    def rows(self, like: DataFrame) -> DataFrame:
        return self._writer.rows(like)

    def write(self, rows: DataFrame) -> None:
        self._writer.write(rows)

    def delete(self, ids: DataFrame) -> None:
        self._writer.delete(ids)


def _written(states: DataFrame, status: str, ready: Column, write: Callable[[DataFrame], None], rows: DataFrame) -> tuple[DataFrame, bool]:
    """states after a write of the ready ones; a failed write counts as an attempt of each, and the third one ends it."""
    try:
        write(rows)
    except (LeaseLost, CommitConflict):
        raise
    except GraphStoreUnavailable:
        return states, False
    except Exception:  # noqa: BLE001  a sink may raise anything
        state, tries = after_failure(F.coalesce("retry_count", F.lit(0)))
        return states.withColumns({status: F.when(ready, state).otherwise(F.col(status)), "retry_count": F.when(ready, tries).otherwise(F.col("retry_count"))}), True
    return states.withColumn(status, F.when(ready, WRITTEN).otherwise(F.col(status))), True


def located(rows: DataFrame, chunks: DataFrame | None) -> DataFrame:
    """PRJ7: rows with what chunks say of where they come from, one row a (book_number, chunk_number); none changes nothing."""
    return rows if chunks is None else rows.join(chunks, ["book_number", "chunk_number"], "left")


def named(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """PRJ7: edges with their ends' display names, from nodes (node_id, display_name)."""
    for side in ("source", "target") if nodes is not None else ():
        edges = edges.join(nodes.select(F.col("node_id").alias(f"{side}_node_id"), F.col("display_name").alias(f"{side}_display_name")), f"{side}_node_id", "left")
    return edges


def vector_rows(vectors: DataFrame, states: DataFrame, chunks: DataFrame, world: str, profile: dict) -> DataFrame:
    """SNK4: vectors (node_id, vector) as points: the node's and its chunk's fields, and the profile that made the vector."""
    of = {c: F.lit(profile.get(c)) for c in ("provider_id", "model_id", "task_type", "dimensions", "profile_version")}
    key = profile_key(of["provider_id"], of["model_id"], of["dimensions"], of["task_type"], of["profile_version"])
    rows = located(vectors.select("node_id", "vector").join(states.select("node_id", "point_id", "book_number", "chunk_number", "display_name", "text_hash"), "node_id"), chunks)
    return rows.withColumns({"world_uuid": F.lit(world), **{c: of[c] for c in ("provider_id", "model_id", "task_type", "dimensions")}, "embedding_model_id": of["model_id"], "embedding_profile_version": of["profile_version"], "embedding_profile_key": key})


def book_totals(nodes: DataFrame, edges: DataFrame, book: str) -> DataFrame:
    """AGG5: (book, nodes, edges) of every book that has any; both are counted in one aggregate, combined before its shuffle."""
    both = nodes.select(book, F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(edges.select(book, F.lit(0).alias("n"), F.lit(1).alias("e")))
    return both.groupBy(book).agg(F.sum("n").alias("nodes"), F.sum("e").alias("edges"))


def chunk_numbers(nodes: DataFrame, edges: DataFrame, chunk: list[str]) -> DataFrame:
    """SET2: the chunks that have a node or an edge."""
    return nodes.select(*chunk).union(edges.select(*chunk)).distinct()


def write_nodes(states: DataFrame, writer, world: str = "", chunks: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """ST12: node states after a write of those that are embedded and not written; False if the sink was unavailable."""
    states = states.withColumns({"write_status": F.when(F.col("write_status") == FAILED, PENDING).otherwise(F.col("write_status"))})
    ready = (F.col("embedding_status") == EMBEDDED) & (F.col("write_status") == PENDING)
    progress = [c for c in ("embedding_status", "write_status", "retry_count") if c in states.columns]
    return _written(states, "write_status", ready, getattr(writer, "write_nodes", None) or writer.write, located(states.filter(ready).drop(*progress), chunks).withColumn("world_uuid", F.lit(world)))


def write_edges(edges: DataFrame, writer, world: str = "", chunks: DataFrame | None = None, nodes: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """SNK6: edges after a write of the pending ones, whose ends edge_dependencies has found in place; False as above."""
    ready = F.col("status") == PENDING
    return _written(edges, "status", ready, writer.write_edges, located(named(edges.filter(ready).drop("status", "retry_count"), nodes), chunks).withColumn("world_uuid", F.lit(world)))
