"""JN3-JN5, JN11-JN13, AGG6, SET1, FLT2, FLT4, FLT11: stored state against what is true now, and table updates.

Tables are Parquet snapshots: an update makes the next snapshot's rows. All joins are on ids, so they shuffle by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def embedding_states(states: DataFrame, points: DataFrame, chunks: DataFrame, run: Column) -> DataFrame:
    """JN3: states (point_id, status, retry_count, ...) after a look at points (point_id, text_hash, run_id) and chunks (point_id, text_hash).

    A point of this run with the chunk's present hash is trusted; any other point is stale and to be deleted; all but
    trusted ones are pending. Retries start anew unless a state was embedded.
    """
    there = points.select("point_id", F.col("text_hash").alias("__hash"), F.col("run_id").alias("__run"), F.lit(True).alias("__there"))
    now = chunks.select("point_id", F.col("text_hash").alias("__now"))
    found = states.join(now, "point_id").join(there, "point_id", "left")
    trusted = F.coalesce((F.col("__hash") == F.col("__now")) & (F.col("__run") == run), F.lit(False))
    kept = [c for c in states.columns if c not in ("status", "retry_count", "text_hash")]
    return found.select(
        *kept, F.when(F.col("status") == "embedded", F.col("retry_count")).otherwise(0).alias("retry_count"), F.when(trusted, "embedded").otherwise("pending").alias("status"),
        F.col("__now").alias("text_hash"), (F.coalesce("__there", F.lit(False)) & ~trusted).alias("stale_point"),
    )


def signatures(rows: DataFrame, chunk: list[str], fields: list[str]) -> DataFrame:
    """AGG6: (chunk, signature) of a chunk's rows with their repetitions, whatever their order.

    A row's digest is eight numbers, and a chunk has the sums of each and a count, which combine before the shuffle.
    """
    line = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields])), 256)
    digests = rows.select(*chunk, line.alias("__line"))
    sums = [F.sum(F.conv(F.substring("__line", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"__s{i}") for i in range(8)]
    found = digests.groupBy(*chunk).agg(F.count("*").alias("__n"), *sums)
    return found.select(*chunk, F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in found.columns if c.startswith("__")]), 256).alias("signature"))


def stale_chunks(existing: DataFrame, fresh: DataFrame, chunk: list[str], fields: list[str]) -> DataFrame:
    """JN4, SET1: chunks whose rows differ, or that one side lacks."""
    a, b = signatures(existing, chunk, fields), signatures(fresh, chunk, fields).withColumnRenamed("signature", "__fresh")
    return a.join(b, chunk, "full").filter(~F.col("signature").eqNullSafe(F.col("__fresh"))).select(*chunk)


def reconciled(fresh: DataFrame, saved: DataFrame, stale: DataFrame, key: str, chunk: list[str], equal: list[str], progress: list[str]) -> DataFrame:
    """JN5: fresh rows with the saved progress columns where the chunk is not stale and the columns equal agree."""
    old = saved.select(key, *[F.col(c).alias(f"__{c}") for c in [*equal, *progress]], F.lit(True).alias("__saved"))
    found = fresh.join(old, key, "left").join(stale.select(*chunk).distinct().withColumn("__stale", F.lit(True)), chunk, "left")
    trusted = F.coalesce("__saved", F.lit(False)) & F.col("__stale").isNull()
    for c in equal:
        trusted = trusted & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return found.select(*[F.when(trusted, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in progress else F.col(c) for c in fresh.columns])


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """JN11: the table's next snapshot; of a key's changes the last by order wins, and any change wins over the table."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    latest = changes.withColumn("__n", last).filter("__n = 1").drop("__n", order)
    return table.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def last_wins(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """JN11 into an empty table: one row a key. max_by combines before the shuffle, which a window would not."""
    rest = [c for c in changes.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return changes.groupBy(*keys).agg(best.alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """JN12: the table without ids; null keys stay."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def delete_chunk(nodes: DataFrame, edges: DataFrame, scope: Column) -> tuple[DataFrame, DataFrame]:
    """FLT2, JN13: nodes and edges without a chunk's, and without edges that touched its nodes."""
    kept = detached(edges.filter(~F.coalesce(scope, F.lit(False))), nodes.filter(scope))
    return nodes.filter(~F.coalesce(scope, F.lit(False))), kept.select(*edges.columns)


def detached(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """JN13: the edges that no node of gone (node_id) is an end of."""
    ids, kept = gone.select("node_id"), edges
    for side in ("source_node_id", "target_node_id"):
        kept = kept.join(ids.withColumnRenamed("node_id", side), side, "left_anti")
    return kept.select(*edges.columns)


def distinct_warnings(events: DataFrame, columns: list[str]) -> DataFrame:
    """AGG10: warnings that agree in every column are one."""
    return events.select(*columns).distinct()
