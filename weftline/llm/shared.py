"""Helpers that the operators of this package share: reading, materialising, bounded batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import give_back

#: Word boundaries of every word operator: space and the ASCII controls \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch at most: a batch stands in the JVM and in a worker at once, and texts are long.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table called name in the folder sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every machine sees: spark.checkpoint.dir; a temporary one only where it is unset and all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again, so that lost executors cost no recomputation.

    The files go when the driver's interpreter ends; a cluster's own clean-up of the folder covers crashes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """The folder path of the shared folder goes when the driver's interpreter ends."""
    atexit.register(_drop, spark, path)


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, forget: Callable[[], None] | None = None) -> DataFrame:
    """df.mapInArrow(run, schema) over batches of BATCH_ROWS rows at most, which is set for the session.

    At a task's end forget() empties what run remembers, and the worker's freed memory goes back.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            give_back()

    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_SETTING, "10000")) <= BATCH_ROWS:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(whole, schema)


def hot(counted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """(keys, salts) of those keys of counted (keys, n) with more than 1 / (4 * shuffle partitions) of total rows.

    There are fewer than 4 * shuffle partitions of them, whatever the input: the bound on which they are broadcast.
    """
    share = max(1, total // (4 * partitions(counted.sparkSession)))
    return counted.filter(F.col("n") > share).select(*keys, F.ceil(F.col("n") / share).cast("int").alias("salts"))


def dealt(rows: DataFrame, heavy: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """rows with salt: those of a hot key are dealt by the columns by, all others have 0."""
    found = rows.join(F.broadcast(heavy), keys, "left")
    return found.withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("salts"))).cast("int")).drop("salts")


def copied(rows: DataFrame, heavy: DataFrame, keys: list[str]) -> DataFrame:
    """rows with salt, one for each salt of their key: the other side of a join with dealt rows."""
    return rows.join(F.broadcast(heavy), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, which a column that is named twice does not promise."""
    return F.get(F.transform(F.array(value), use), 0)


def fresh(name: str, columns: list[str]) -> str:
    """name, with underscores behind it until no column is called so (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """c with A-Z lower-cased and nothing else changed, which lower() would not promise."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(texts: list, limit: int = 1 << 20):
    """(start, stop) of runs of texts with about limit characters each; one longer text is a run of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)
