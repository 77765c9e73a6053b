"""TOP1-TOP3, FLT1, FLT3, JN2, PRJ9: exact cosine search in one world, verified against the stored text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Digits to which scores are rounded before they are ranked and returned, so that engines agree on ties.
DIGITS = 6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if a vector is zero, null if one is not finite."""
    return cosine_of(a, b, F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_of(a: Column, b: Column, norms: Column) -> Column:
    """cosine() where the product of the norms is known."""
    return F.when(norms == 0, F.lit(0.0)).otherwise(F.round(F.nanvl(dot(a, b) / norms, F.lit(None).cast("double")), DIGITS))


def top_k(points: DataFrame, query: list[float], k: int, minimum: float, id_column: str = "point_id", vector: str = "vector", world: Column | None = None) -> DataFrame:
    """TOP1: the k best points at or above minimum within one world, by score, then id; k below 1 gives none.

    The filter on the world reaches the scan; each task keeps k rows, so only k rows a task are moved.
    """
    found = points.filter(world) if world is not None else points
    if k < 1:
        found = found.limit(0)
    target = F.array(*[F.lit(float(x)) for x in query])
    return found.withColumn("score", cosine(F.col(vector), target)).filter(F.col("score") >= minimum).orderBy(F.desc("score"), F.col(id_column)).limit(max(k, 0))


#: Vectors and queries that one matrix product scores.
POINTS_BLOCK, QUERIES_BLOCK = 4096, 1024
#: Scores that may round to the same number differ by less.
_NEAR = 2 * 10.0**-DIGITS


def top_k_batch(points: DataFrame, queries: DataFrame, k: int, minimum: float, scope: str, query_limit: int = 10_000) -> DataFrame:
    """TOP1 for many queries (query_id, query_vector, scope): (query_id, point_id, score, rank) within the query's scope.

    Vectors are gathered in blocks of a scope; each block of points meets each block of queries of its scope in one row,
    where a matrix product finds what can be among a query's k best of the block. Only these are moved and ranked, by
    scores whose sums have cosine()'s order. Blocks of queries are broadcast, about query_limit queries at once.
    """
    parts = max(1, -(-queries.count() // query_limit))
    held = _in_blocks(points, "point_id", "vector", scope, POINTS_BLOCK)
    asked = _in_blocks(queries, "query_id", "query_vector", scope, QUERIES_BLOCK)
    if parts == 1:
        return _ranked(_scored(held, asked, k, minimum, scope), k)
    part = F.pmod(F.xxhash64(scope, "block"), F.lit(parts))
    return _ranked(reduce(DataFrame.unionByName, [_scored(held, asked.filter(part == i), k, minimum, scope) for i in range(parts)]), k)


def _in_blocks(rows: DataFrame, key: str, vector: str, scope: str, size: int) -> DataFrame:
    """(scope, dims, block, ids, values): vectors without null entries, about size to a row; values are all entries as one array."""
    whole = rows.filter(F.col(scope).isNotNull() & F.col(vector).isNotNull()).filter(~F.exists(vector, lambda x: x.isNull()))
    each = whole.select(scope, F.size(vector).alias("dims"), F.col(key).alias("__id"), F.col(vector).alias("__vector"))
    counted = each.groupBy(scope, "dims").agg(F.ceil(F.count("*") / size).cast("int").alias("__blocks"))
    placed = each.join(F.broadcast(counted), [scope, "dims"]).withColumn("block", F.pmod(F.xxhash64("__id"), F.col("__blocks")).cast("int"))
    gathered = placed.groupBy(scope, "dims", "block").agg(F.collect_list(F.struct("__id", "__vector")).alias("__rows"))
    return gathered.select(scope, "dims", "block", F.col("__rows.__id").alias("ids"), F.flatten(F.col("__rows.__vector").cast("array<array<double>>")).alias("values"))


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """dot() of each two rows, entry by entry in order."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        total = total + x * y
    return total


def _best(p: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int, minimum: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score) by place: all that can be among each query's k best at or above minimum once scores are rounded."""
    with np.errstate(all="ignore"):
        lengths = np.sqrt(_summed(p, p)), np.sqrt(_summed(q, q))
        norms = lengths[1][:, None] * lengths[0][None, :]
        about = np.where(norms == 0, 0.0, q @ p.T / norms)
        about[~np.isfinite(about)] = np.inf  # judged below
        low = np.full(len(q), minimum - _NEAR)
        if about.shape[1] > k:
            sure = np.where(np.isinf(about), -np.inf, about)
            low = np.maximum(low, np.partition(sure, about.shape[1] - k, axis=1)[:, about.shape[1] - k] - 2 * _NEAR)
        i, j = np.nonzero(about >= low[:, None])
        n = norms[i, j]
        score = np.where(n == 0, 0.0, _summed(p[j], q[i]) / n)
    good = ~np.isnan(score)
    i, j, score = i[good], j[good], score[good]
    # Of equal scores, as copies have, the k least ids do.
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (score[1:] != score[:-1])])) if len(i) else np.zeros(0, int)
    place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
    return i[place < k], j[place < k], score[place < k]


def _scored(held: DataFrame, asked: DataFrame, k: int, minimum: float, scope: str) -> DataFrame:
    """(query_id, point_id, score) of what each block of points has for each query."""
    pairs = held.join(F.broadcast(asked.withColumnRenamed("ids", "__asked").withColumnRenamed("values", "__queries").drop("block")), [scope, "dims"])
    kinds = {f.name: f.dataType.elementType for f in pairs.schema if f.name in ("ids", "__asked")}
    schema = f"query_id {kinds['__asked'].simpleString()}, point_id {kinds['ids'].simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dims, (ids, values, asking, wanted) = batch.column(0)[r].as_py(), (batch.column(c)[r].values for c in range(1, 5))
                p, q = values.to_numpy().reshape(len(ids), dims), wanted.to_numpy().reshape(len(asking), dims)
                order = ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.argsort(np.argsort(np.array(ids.to_pylist(), object).astype(str), kind="stable"))
                for a in range(0, len(q), 128):
                    i, j, score = _best(p, q[a : a + 128], order, max(k, 0), minimum)
                    yield pa.RecordBatch.from_arrays([asking.take(pa.array(i + a)), ids.take(pa.array(j)), pa.array(score)], names=["query_id", "point_id", "score"])

    found = pairs.select("dims", "ids", "values", "__asked", "__queries").mapInArrow(run, schema)
    return found.withColumn("score", F.round(F.nanvl("score", F.lit(None).cast("double")), DIGITS)).filter(F.col("score") >= minimum)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def clamp(k: int, embedded: Column) -> Column:
    """TOP2: no more than there are embedded chunks."""
    return F.greatest(F.lit(0), F.least(F.lit(k).cast("long"), F.coalesce(embedded, F.lit(0).cast("long"))))


def verified(hits: DataFrame, chunks: DataFrame, key: list[str]) -> DataFrame:
    """JN2: hits (key, text_hash, score) with outcome valid, missing or stale against chunks (key, stored_hash, chunk_text)."""
    found = hits.join(chunks.withColumn("__there", F.lit(True)), key, "left")
    state = F.when(F.col("__there").isNull(), "missing").when(~F.col("text_hash").eqNullSafe(F.col("stored_hash")), "stale").otherwise("valid")
    return found.withColumn("outcome", state).drop("__there")


def repairs(outcomes: DataFrame) -> DataFrame:
    """ST17: what invalid hits do to states: pending, with the current hash if the text is there; stale points go."""
    stale = F.col("outcome") == "stale"
    return outcomes.filter("outcome <> 'valid'").select("point_id", F.lit("pending").alias("status"), F.when(stale, F.col("stored_hash")).alias("text_hash"), stale.alias("delete_point"))


def model_context(texts: DataFrame, keys: list[str], rank: str, text: str) -> DataFrame:
    """PRJ9: (keys, chunks, context): non-empty texts in rank order, joined by blank lines."""
    held = texts.filter(F.coalesce(F.col(text), F.lit("")) != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(text)))), lambda s: s[text])
    return held.groupBy(*keys).agg(ordered.alias("chunks")).withColumn("context", F.array_join("chunks", "\n\n"))
