"""Queries over embeddings: exact cosine search, verification, contexts, and the state of embedding runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import status
from ..operators import chunking, reconcile, vectors
from ..operators.cells import CellIndex
from ..sources.stored import shared_folder
from .registry import RUN, query, table

_COSINE = "round(list_dot_product(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"
#: Every hundredth row asks, against all rows of its world.
_BATCH = f"""
        SELECT query_id, point_id, score, rank FROM (
            SELECT q.vec_id AS query_id, p.vec_id AS point_id, {_COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, p.vec_id) AS rank
            FROM embeddings p JOIN embeddings q ON p.label = q.label AND q.vec_id % 100 = 0 WHERE {_COSINE} >= 0.15) WHERE rank <= 10"""


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), "label")


def _first(spark, sf_dir):
    """The query vector of the single searches: one row, by its id."""
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


def _batch(spark, sf_dir):
    asked = _points(spark, sf_dir).filter("point_id % 100 = 0").select(F.col("point_id").alias("query_id"), F.col("vector").alias("query_vector"), "label")
    return vectors.top_k_batch(_points(spark, sf_dir), asked, 10, 0.15, "label")


@query("cosine_topk", f"SELECT p.vec_id AS point_id, {_COSINE} AS score FROM embeddings p, embeddings q WHERE q.vec_id = 0 AND p.label = 3 AND {_COSINE} >= 0.05 ORDER BY score DESC, point_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    """TOP1, TOP3, FLT1, FLT3."""
    return vectors.top_k(_points(spark, sf_dir), _first(spark, sf_dir), 10, 0.05, world=F.col("label") == 3).select("point_id", "score")


@query("cosine_topk_batch", _BATCH)
def cosine_topk_batch(spark, sf_dir):
    """TOP1 for a set of queries."""
    return _batch(spark, sf_dir).withColumn("rank", F.col("rank").cast("long"))


@query("cosine_topk_cells", _BATCH)
def cosine_topk_cells(spark, sf_dir):
    """TOP1, TOP3 over an index of cells, which skips what cannot reach a query's k-th score."""
    points = _points(spark, sf_dir).withColumnRenamed("label", "scope")
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    asked = points.filter("point_id % 100 = 0").select(F.col("point_id").alias("query_id"), F.col("vector").alias("query_vector"), "scope")
    return CellIndex.build(points, path).search(asked, 10, 0.15).withColumn("rank", F.col("rank").cast("long"))


@query("topk_clamped", "SELECT label, least(60, count(*))::BIGINT AS k FROM embeddings GROUP BY label")
def topk_clamped(spark, sf_dir):
    """TOP2, AGG4."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")).select("label", vectors.clamp(60, F.col("n")).alias("k"))


_CHUNKS_SQL = "SELECT doc_id AS point_id, sha256(text) AS stored_hash, text AS chunk_text FROM documents WHERE doc_id % 11 <> 5"


def _chunks(spark, sf_dir):
    """The chunk store: documents, of which some are missing."""
    return table(spark, sf_dir, "documents").filter("doc_id % 11 <> 5").select(F.col("doc_id").alias("point_id"), F.sha2("text", 256).alias("stored_hash"), F.col("text").alias("chunk_text"))


def _verified(spark, sf_dir):
    hits = _batch(spark, sf_dir)
    saved = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), F.sha2(F.when(F.col("doc_id") % 7 == 3, F.concat("text", F.lit("?"))).otherwise(F.col("text")), 256).alias("text_hash"))
    return vectors.verified(hits.join(saved, "point_id", "left"), _chunks(spark, sf_dir), ["point_id"])


_VERIFIED_SQL = f"""
        WITH hits AS ({_BATCH}), saved AS (SELECT doc_id AS point_id, sha256(CASE WHEN doc_id % 7 = 3 THEN text || '?' ELSE text END) AS text_hash FROM documents), store AS ({_CHUNKS_SQL}),
        found AS (SELECT hits.*, text_hash, stored_hash, chunk_text, CASE WHEN store.point_id IS NULL THEN 'missing' WHEN text_hash IS DISTINCT FROM stored_hash THEN 'stale' ELSE 'valid' END AS outcome
                  FROM hits LEFT JOIN saved USING (point_id) LEFT JOIN store USING (point_id))"""


@query("retrieve_validated", _VERIFIED_SQL + " SELECT query_id, rank, point_id, score, outcome FROM found")
def retrieve_validated(spark, sf_dir):
    """JN2, FLT3, TOP3: hits within the limit, then checked against the stored text; nothing is filled up."""
    return _verified(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "point_id", "score", "outcome")


@query("retrieval_repairs", _VERIFIED_SQL + " SELECT DISTINCT point_id, 'pending' AS status, CASE WHEN outcome = 'stale' THEN stored_hash END AS text_hash, outcome = 'stale' AS delete_point FROM found WHERE outcome <> 'valid'")
def retrieval_repairs(spark, sf_dir):
    """ST17."""
    return vectors.repairs(_verified(spark, sf_dir)).distinct()


@query("model_context", _VERIFIED_SQL + " SELECT query_id, count(*) AS chunks, sha256(string_agg(chunk_text, chr(10) || chr(10) ORDER BY rank)) AS context_hash FROM found WHERE outcome = 'valid' AND chunk_text <> '' GROUP BY query_id")
def model_context(spark, sf_dir):
    """PRJ9 over the valid hits of each query."""
    found = vectors.model_context(_verified(spark, sf_dir).filter("outcome = 'valid'"), ["query_id"], "rank", "chunk_text")
    return found.select("query_id", F.size("chunks").cast("long").alias("chunks"), F.sha2("context", 256).alias("context_hash"))


_STATES_SQL = f"""
        WITH states AS (SELECT doc_id, source, 'p' || doc_id AS point_id, CASE doc_id % 4 WHEN 0 THEN 'embedded' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'embedded' END AS status, (doc_id % 3)::INT AS retry_count, sha256(text) AS now FROM documents),
        points AS (SELECT 'p' || doc_id AS point_id, CASE WHEN doc_id % 6 = 1 THEN sha256(text || '?') ELSE sha256(text) END AS hash, CASE WHEN doc_id % 10 = 7 THEN 'run-0000' ELSE '{RUN}' END AS run FROM documents WHERE doc_id % 5 <> 2),
        joined AS (SELECT s.*, p.point_id IS NOT NULL AS there, coalesce(p.hash = s.now AND p.run = '{RUN}', false) AS trusted FROM states s LEFT JOIN points p USING (point_id)),
        done AS (SELECT source, point_id, CASE WHEN status = 'embedded' THEN retry_count ELSE 0 END AS retry_count, CASE WHEN trusted THEN 'embedded' ELSE 'pending' END AS status, now AS text_hash, there AND NOT trusted AS stale_point FROM joined)"""


def _states(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key, digest = F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("point_id"), F.sha2("text", 256)
    kind = F.col("doc_id") % 4
    states = docs.select("source", key, F.when(kind == 1, "pending").when(kind == 2, "failed").otherwise("embedded").alias("status"), (F.col("doc_id") % 3).cast("int").alias("retry_count"))
    points = docs.filter("doc_id % 5 <> 2").select(key, F.when(F.col("doc_id") % 6 == 1, F.sha2(F.concat("text", F.lit("?")), 256)).otherwise(digest).alias("text_hash"), F.when(F.col("doc_id") % 10 == 7, "run-0000").otherwise(RUN).alias("run_id"))
    return reconcile.embedding_states(states, points, docs.select(key, digest.alias("text_hash")), F.lit(RUN))


@query("embedding_reconcile", _STATES_SQL + " SELECT point_id, retry_count, status, text_hash, stale_point FROM done")
def embedding_reconcile(spark, sf_dir):
    """JN3, ST8, FLT11."""
    return _states(spark, sf_dir).drop("source")


@query("embedding_status_rollup", _STATES_SQL + " SELECT source, count(*) FILTER (WHERE status = 'embedded') AS embedded, count(*) FILTER (WHERE status = 'pending') AS pending, CASE WHEN count(*) = count(*) FILTER (WHERE status = 'embedded') THEN 'completed' ELSE 'partial' END AS rollup FROM done GROUP BY source")
def embedding_status_rollup(spark, sf_dir):
    """AGG2, AGG3."""
    s = F.col("status")
    return _states(spark, sf_dir).groupBy("source").agg(F.count_if(s == "embedded").alias("embedded"), F.count_if(s == "pending").alias("pending"), status.embedding_rollup(s).alias("rollup"))


@query("resume_prefix", """
        WITH numbered AS (SELECT user_id, event_id AS n, value % 10 < 9 AS ok FROM events), gap AS (SELECT user_id, min(n) FILTER (WHERE NOT coalesce(ok, false)) AS gap FROM numbered GROUP BY user_id)
        SELECT user_id, count(*) FILTER (WHERE gap IS NULL OR n < gap) AS completed FROM numbered JOIN gap USING (user_id) GROUP BY user_id""")
def resume_prefix(spark, sf_dir):
    """WIN1: events of a user as states in order of their id."""
    return chunking.completed_prefix(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value") % 10 < 9)


@query("retry_marking", """
        SELECT code, retry_count, rate_limited, retryable, CASE WHEN rate_limited OR (retryable AND spent < 3) THEN 'pending' ELSE 'failed' END AS status, spent AS retries FROM (
            SELECT *, CASE WHEN rate_limited THEN retry_count ELSE retry_count + 1 END AS spent FROM (
                SELECT DISTINCT event_type AS code, (event_id % 4)::INT AS retry_count, event_id % 5 = 0 AS rate_limited, event_id % 7 < 5 AS retryable FROM events))""")
def retry_marking(spark, sf_dir):
    """ST3, ST11."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), (e % 4).cast("int").alias("retry_count"), (e % 5 == 0).alias("rate_limited"), (e % 7 < 5).alias("retryable")).distinct()
    state, spent = status.after_attempt(F.lit("pending"), F.col("retry_count"), F.col("rate_limited"), F.col("retryable"))
    return rows.withColumns({"status": state, "retries": spent})
