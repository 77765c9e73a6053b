"""SRC8-SRC17, SNK1-SNK4, SNK9-SNK11, JN8, AGG7, AGG11: stored sources, JSON records and table snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share (spark.checkpoint.dir); where it is missing, on one machine alone, one of that machine."""
    if not spark.sparkContext.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="weftline-"))
    return spark.sparkContext.getCheckpointDir()


def kept(rows: DataFrame) -> DataFrame:
    """rows, written to the shared folder and read from it from now on."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def with_backup(primary: DataFrame, backup: DataFrame, key: str, content: str) -> DataFrame:
    """SRC9: each slot's content from its primary copy, else its backup, with what happened."""
    a = primary.select(key, F.col(content).alias("__a"))
    b = backup.select(key, F.col(content).alias("__b"))
    event = F.when(F.col("__a").isNull() & F.col("__b").isNull(), "BACKUP_MISSING").when(F.col("__a").isNull(), "SOURCE_MISSING_SWITCHED_TO_BACKUP")
    return a.join(b, key, "full").select(key, F.coalesce("__a", "__b").alias(content), event.alias("event"))


def stored_slots(files: DataFrame, slot: str, name: str) -> DataFrame:
    """SRC10: one row a slot with its file name, ambiguous if it holds several files or names disagree."""
    found = files.groupBy(slot).agg(F.count("*").alias("files"), F.min(name).alias(name), F.max(name).alias("__last"))
    return found.select(slot, name, ((F.col("files") > 1) | (F.col(name) != F.col("__last"))).alias("ambiguous"))


def plan_requests(requests: DataFrame, stored: DataFrame, name: str, digest: str, slot: str) -> DataFrame:
    """JN8, AGG11: what a requested source (name, digest) does to a world whose stored sources are (slot, name, digest).

    new: no stored source of that name; resume: the only one has the same bytes; WORLD_REINGEST_REQUIRED: other bytes;
    STORED_SOURCE_AMBIGUOUS: several of that name.
    """
    held = stored.groupBy(name).agg(F.count("*").alias("__n"), F.min(digest).alias("__digest"), F.min(slot).alias(slot))
    found = requests.join(held, name, "left")
    decision = F.when(F.col("__n").isNull(), "new").when(F.col("__n") > 1, "STORED_SOURCE_AMBIGUOUS").when(F.col("__digest") == F.col(digest), "resume").otherwise("WORLD_REINGEST_REQUIRED")
    return found.withColumn("decision", decision).withColumn(slot, F.when(F.col("decision") == "resume", F.col(slot))).drop("__n", "__digest")


def next_slots(roots: list[DataFrame], world: str, slot: str) -> DataFrame:
    """AGG7, SET4: per world the slots taken in any root, and the next free one."""
    every = roots[0].select(world, slot)
    for r in roots[1:]:
        every = every.union(r.select(world, slot))
    return every.groupBy(world).agg(F.countDistinct(slot).alias("slots"), (F.coalesce(F.max(slot), F.lit(0)) + 1).alias("next_slot"))


def slot_number(directory: Column) -> Column:
    """FLT16: the number in a directory name like book_07, or null."""
    return F.when(directory.rlike(r"^book_\d{2,}$"), F.substring(directory, F.lit(6), F.length(directory)).cast("int"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC11-SRC16: JSON records of a given schema with their path; a broken file is a row with its text in _corrupt_record."""
    found = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", "true").option("encoding", "UTF-8").option("recursiveFileLookup", "true").json(path)
    return found.withColumn("path", F.input_file_name())


def record_json(*columns: str | Column) -> Column:
    """PRJ8: a record as JSON text without its null fields, whatever the session's setting."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def read_credentials(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: enabled credentials in order of their files; only those must have a secret."""
    found = read_json(spark, path, "name string, api_key string, project_id string, allowed_models array<string>, enabled boolean").filter(F.coalesce("enabled", F.lit(True)))
    return found.withColumn("error", F.when(F.coalesce(F.trim("api_key"), F.lit("")) == "", "PROVIDER_KEY_INVALID")).orderBy("path")


class Snapshots:
    """SNK1-SNK4, SNK10: a table as numbered Parquet folders; readers see the last one that was finished.

    A snapshot is written whole under a draft name and then renamed, so a failed write is never read. The last two stay,
    so that frames of the version before a write can still be read; older ones go.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._files.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.folder))]
        return sorted(int(n) for n in names if n.isdigit())

    def drop(self) -> None:
        """Removes the folder and all that is in it."""
        self._files.delete(self._path(self.folder), True)

    def read(self, schema) -> DataFrame:
        done = self.versions()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{done[-1]:08d}")

    def write(self, rows: DataFrame) -> int:
        version = max(self.versions(), default=0) + 1
        draft, place = f"{self.folder}/_draft-{uuid.uuid4().hex}", f"{self.folder}/{version:08d}"
        rows.write.parquet(draft)
        if not self._files.rename(self._path(draft), self._path(place)):
            raise RuntimeError(f"another writer made snapshot {version}")
        for old in self.versions()[:-2]:
            self._files.delete(self._path(f"{self.folder}/{old:08d}"), True)
        return version


def dimension_error(vectors: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """SNK9: the rows whose vector does not have the collection's dimensions."""
    return vectors.filter(~(F.size(vector).eqNullSafe(F.lit(dimensions)))).withColumn("error", F.lit("VECTOR_COLLECTION_MISMATCH"))
