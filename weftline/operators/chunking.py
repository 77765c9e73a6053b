"""PRJ1-PRJ4, WIN7: texts to chunks that end at readable boundaries, with the overlap before each.

The walk over a text needs to look back from places that depend on the walk itself, and Spark's strings find a place only
by counting from their start; so the walk is an Arrow function over the text column, linear in the text, and all else is
columns. A text's chunks are made in its row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import chunk_filename, chunk_point_id, sha256
from ..functions.workers import bounded_batches, give_back


@dataclass(frozen=True)
class SplitterConfig:
    """FLT10: sizes in code points."""

    chunk_size: int
    max_lookback: int = 0
    overlap_size: int = 0

    def __post_init__(self) -> None:
        if any(isinstance(v, bool) or not isinstance(v, int) for v in (self.chunk_size, self.max_lookback, self.overlap_size)):
            raise TypeError("splitter settings are integers")
        if self.chunk_size < 1 or self.max_lookback < 0 or self.overlap_size < 0:
            raise ValueError("chunk_size is at least 1, the other settings at least 0")


#: Boundaries by rank: kind and the strings that a chunk may end with.
BOUNDARIES = (("paragraph", ("\n\n",)), ("line", ("\n",)), ("sentence", ("!", ".", "?")), ("space", (" ",)))
#: Texts whose lists of Python objects stand at once.
SLICE = 32
_CHUNK = "array<struct<start:int,kind:string,overlap_text:string,chunk_text:string>>"


def walk(text: str, config: SplitterConfig) -> Iterator[tuple[int, int, str]]:
    """PRJ1, PRJ2: (start, end, kind) of each chunk; kind says what ended it: last (the text's end), a kind of BOUNDARIES, or hard."""
    size, start = len(text), 0
    if size <= config.chunk_size:
        yield 0, size, "last"
        return
    while start < size:
        hard = min(start + config.chunk_size, size)
        end, kind = hard, "last" if hard == size else "hard"
        if hard < size and config.max_lookback:
            low = max(start, hard - config.max_lookback)
            for name, marks in BOUNDARIES:
                found = max(text.rfind(m, low, hard) + len(m) if text.find(m, low, hard) >= 0 else 0 for m in marks)
                if found:
                    end, kind = found, name
                    break
        yield start, end, kind
        start = end


def _listed(make: Callable[[str], list], kind: pa.DataType, returned: str) -> Callable[[Column], Column]:
    """An Arrow function from a text to the list that make gives; null texts give null.

    Python holds the lists of SLICE texts at once, and freed memory goes back when a task ends.
    """

    @F.arrow_udf(returned)
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = lambda part: pa.array([None if t is None else make(t) for t in part.to_pylist()], pa.list_(kind))
        try:
            for texts in batches:
                yield pa.concat_arrays([made(texts.slice(a, SLICE)) for a in range(0, max(1, len(texts)), SLICE)])
        finally:
            give_back()

    return each


def chunk_starts(text: Column, config: SplitterConfig) -> Column:
    """array<int>: the start of each chunk, and the text's length behind the last."""
    return _listed(lambda t: [*(a for a, _, _ in walk(t, config)), len(t)], pa.int32(), "array<int>")(text)


def chunks_of(text: Column, config: SplitterConfig) -> Column:
    """WIN7: the chunks of a text in order, each with its start, what ended it, and the overlap before it."""
    kind = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("overlap_text", pa.string()), ("chunk_text", pa.string())])
    made = lambda t: [{"start": a, "kind": k, "overlap_text": t[max(0, a - config.overlap_size) : a], "chunk_text": t[a:b]} for a, b, k in walk(t, config)]
    return _listed(made, kind, _CHUNK)(text)


def split(docs: DataFrame, config: SplitterConfig, text: str = "text") -> DataFrame:
    """docs with chunk_number, total_chunks, start, boundary, overlap_text and chunk_text, one row a chunk; null texts have none.

    An empty text is one empty chunk, as a text that fits into one chunk is returned as it is.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.filter(F.col(text).isNotNull()).withColumn("__chunks", chunks_of(F.col(text), config))
    rows = rows.select(*docs.columns, F.size("__chunks").alias("total_chunks"), F.posexplode("__chunks").alias("__i", "__c"))
    return rows.select(*docs.columns, (F.col("__i") + 1).alias("chunk_number"), "total_chunks", F.col("__c.start").alias("start"), F.col("__c.kind").alias("boundary"), F.col("__c.overlap_text").alias("overlap_text"), F.col("__c.chunk_text").alias("chunk_text"))


def chunk_records(chunks: DataFrame, world: Column, world_id: Column, book: Column, source: Column) -> DataFrame:
    """PRJ3: the stored form of chunks: identity, position as n/total, file name, point id and hash."""
    n = F.col("chunk_number")
    return chunks.select(
        world_id.alias("world_id"), world.alias("world_uuid"), source.alias("source_filename"), book.cast("int").alias("book_number"), n.alias("chunk_number"),
        F.concat_ws("/", n.cast("string"), F.col("total_chunks").cast("string")).alias("chunk_position"), "overlap_text", "chunk_text",
        chunk_filename(book.cast("int"), n).alias("chunk_file"), chunk_point_id(world, book.cast("int"), n).alias("point_id"), sha256(F.col("chunk_text")).alias("text_hash"),
    )


def pending_states(records: DataFrame, *columns: str) -> DataFrame:
    """PRJ4: one pending state for each chunk record."""
    return records.select("world_uuid", "book_number", "chunk_number", "chunk_file", *columns, F.lit("pending").alias("status"), F.lit(0).alias("retry_count"))


def completed_prefix(states: DataFrame, keys: list[str], order: str, done: Column) -> DataFrame:
    """WIN1: (keys, completed): how many states from the first on are done without a gap."""
    # Two aggregates instead of an ordered window: no key's states are gathered or sorted.
    gap = states.groupBy(*keys).agg(F.min(F.when(~F.coalesce(done, F.lit(False)), F.col(order))).alias("__gap"))
    joined = states.join(gap, keys)
    return joined.groupBy(*keys).agg(F.count_if(F.col("__gap").isNull() | (F.col(order) < F.col("__gap"))).alias("completed"))
