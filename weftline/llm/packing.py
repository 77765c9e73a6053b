"""Operator 13: best-fit packing of token sequences in bulk-synchronous rounds.

Documents become pieces of at most the capacity. Pieces that wait and gaps of sequences that are open are sorted by
range together. Each range is swept upwards by one task: a gap takes the largest waiting pieces below it, those whose
successor it is. What a range leaves, gaps without pieces and pieces without gaps, is matched between ranges by rank:
one row of counts a range says which ranks of which range meet. Gaps shrink by what they took, and the next round begins.
Where no gap is as large as the largest waiting piece, sequences are opened, never more than what waits must need: pieces
of a size of which k fit go k to a sequence in order of size, or the largest pieces open SHARE of what the sizes' sum fills.
A sequence is named by the first piece in it.

A gap of m times the largest waiting piece takes up to m pieces in a round, so that rounds grow with the logarithm of
the number of pieces. Ties are broken by a hash of the piece, so that a size that a third of all pieces have is dealt
over many tasks. The driver holds counts: one row a range, and one a size (at most the capacity).

Defined cases: null and empty texts are the end mark alone; rows without an id and repeated rows are packed like any
other. Only documents beyond the capacity are cut, into pieces of the capacity, the first of which may be shorter. Other
columns stay as they are, also those with the names of the results, which get underscores; an empty table gives no row.
"""

from __future__ import annotations

import itertools
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import PLAIN, PLAIN_PIECES, byte_characters
from .shared import arrow_map, drop_at_exit, fresh, materialise, shared_dir

#: Of the sequences that the waiting pieces' sum fills, the share that opens at once; the rest follow when these are full.
SHARE = 0.8
#: Pieces of text whose ids a worker remembers since it last set its memory aside; what it set aside counts as well.
REMEMBERED = 500_000
#: Waiting pieces to a task and a file of a round.
FILE_ROWS = 50_000
#: Kinds of rows: waiting piece, gap, placed piece, and how many pieces and slots a task's sweep leaves.
WAITS, GAP, PLACED, LEFT = 0, 1, 2, 3
_STATE = "kind int, id long, size long, seq long"


class Encoder(dict):
    """Piece of text to its ids as little-endian unsigned 32-bit numbers, asked of the tokenizers library when first seen.

    The file is one of a byte-level BPE: its model sees each byte as one character. Pieces that were used since the
    memory was last set aside stay, others are forgotten at the next time.
    """

    def __init__(self, path: str, pattern: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.before = self.tokenizer.model, {}
        self.table = dict(enumerate(byte_characters()))
        self.pattern, self.usual = regex.compile(pattern), pattern == public_tokenizers.PATTERN

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            spelled = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)
            ids = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()
        split = PLAIN_PIECES if self.usual and PLAIN.fullmatch(text) else self.pattern
        return b"".join(map(self.__getitem__, split.findall(text)))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process; threads of the library would each keep memory."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, pattern)


def cut(size: int, capacity: int) -> list[int]:
    """Where pieces of size tokens start, and the end: pieces of the capacity, the first of which may be shorter."""
    return [0, *range((size - 1) % capacity + 1, size + 1, capacity)]


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int, end: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32, ids): each document's ids and the end mark, cut to the capacity."""
    kind = docs.schema[key].dataType.simpleString()
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            at, rows, data = [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = own.encode(value.as_py() or "") + mark
                starts = cut(len(ids) // 4, capacity)
                for n, (a, b) in enumerate(zip(starts, starts[1:])):
                    at.append(i)
                    rows.append((n, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                    if with_ids:
                        data.append(np.frombuffer(ids, "<u4", b - a, 4 * a))
            n, start, length, crc = (pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), n, start, length, crc, *([pa.array(data, pa.list_(pa.int64()))] if with_ids else [])], names=[key, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return arrow_map(docs.select(key, text), run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def _opened(state: DataFrame, waiting: dict[int, int], capacity: int, salt: int) -> tuple[DataFrame, Column, int]:
    """(placed pieces and the gaps beside them, what of the waiting pieces they are, an upper bound of the other sizes)."""
    largest = max(waiting)
    k = capacity // largest
    low = capacity // (k + 1)
    alike = sum(n for s, n in waiting.items() if s > low)
    wanted = int(SHARE * sum(s * n for s, n in waiting.items()) / capacity)
    size = F.col("size")
    if -(-alike // k) >= wanted:
        chosen, rest = size > low, low
    else:
        k, held = 1, 0
        for rest in sorted(waiting, reverse=True):
            if held + waiting[rest] >= wanted:
                break
            held += waiting[rest]
        # Of the last size a share goes, chosen by a hash that differs between rounds.
        chosen = (size > rest) | ((size == rest) & (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) < int((wanted - held) / waiting[rest] * (1 << 30))))
    new = state.filter(F.col("kind") == WAITS).filter(chosen)
    if k == 1:
        return new.select(F.inline(F.array(_row(PLACED, F.col("id"), size, F.col("id")), _row(GAP, F.col("id"), capacity - size)))), chosen, rest

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names: list[int] = []
        free = capacity
        for batch in batches:
            for i, n in zip(batch.column("id").to_pylist(), batch.column("size").to_pylist()):
                names.append(i)
                free -= n
                out.append((PLACED, i, n, names[0]))
                if len(names) == k:
                    out.append((GAP, names[0], free, None))
                    names, free = [], capacity
            yield _batch(out, _STATE)
            out = []
        if names:
            yield _batch([(GAP, names[0], free, None)], _STATE)

    h = F.xxhash64("id")
    ranged = new.select("id", "size").repartitionByRange(F.desc("size"), h).sortWithinPartitions(F.desc("size"), h, "id")
    return arrow_map(ranged, groups, _STATE), chosen, rest


def _row(kind: int, key: Column, size: Column, seq: Column | None = None) -> Column:
    """A row of the state as a struct."""
    return F.struct(F.lit(kind), key, size, F.lit(None) if seq is None else seq).cast("struct<kind: int, id: bigint, size: bigint, seq: bigint>")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[t]) for j, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


_SWEPT = f"{_STATE}, part int, rank long, slots long"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of pieces and gaps by size: each gap takes the last pieces of its range that wait before it. What is left gets ranks."""
    part, stack, slots = None, [], 0

    def left() -> Iterator[pa.RecordBatch]:
        if part is not None:
            yield _batch([(LEFT, None, None, None, part, len(stack), slots)], _SWEPT)
            for a in range(0, len(stack), 10_000):
                yield _batch([(WAITS, i, n, None, part, a + j, 0) for j, (i, n) in enumerate(stack[a : a + 10_000])], _SWEPT)

    for batch in batches:
        out = []
        for kind, i, size, times, own in zip(*(batch.column(c).to_pylist() for c in ("kind", "id", "size", "times", "part"))):
            if own != part:
                yield from left()
                part, stack, slots = own, [], 0
            if kind == WAITS:
                stack.append((i, size))
                continue
            took = min(times, len(stack))
            for _ in range(took):
                piece, n = stack.pop()
                size -= n
                out.append((PLACED, piece, n, i, part, None, 0))
            out.append((GAP, i, size, None, part, slots, times - took))
            slots += times - took
        yield _batch(out, _SWEPT)
    yield from left()


def meetings(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(part, low, high, gap part, slot): the pieces of ranks low to high - 1, from the last on, meet slots from slot on.

    parts are (part, pieces left, slots left) in order of their ranges; a range's slots come before its pieces.
    """
    stack: list[list[int]] = []
    found = []
    for part, left, slots in sorted(parts):
        at = 0
        while at < slots and stack:
            take = min(slots - at, stack[-1][1])
            stack[-1][1] -= take
            found.append((stack[-1][0], stack[-1][1], stack[-1][1] + take, part, at))
            at += take
            if not stack[-1][1]:
                stack.pop()
        if left:
            stack.append([part, left])
    return found


def _resolved(swept: DataFrame, met: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The state behind a sweep: placed pieces, and what waits or is free, after tasks' leftovers have met by rank."""
    columns = [f.split()[0] for f in _STATE.split(", ")]
    if not met:
        return swept.filter(F.col("kind") != LEFT).select(*columns)
    spark = swept.sparkSession
    ranks = F.broadcast(spark.createDataFrame(pa.Table.from_batches([_batch(met, "part int, low long, high long, gap_part int, first long")])))  # two rows a task at most
    reach: dict[int, int] = {}
    for _, low, high, part, first in met:
        reach[part] = max(reach.get(part, 0), first + high - low)
    reached = F.broadcast(spark.createDataFrame(pa.Table.from_batches([_batch(list(reach.items()), "part int, reach long")])))
    waits = swept.filter(F.col("kind") == WAITS).join(ranks, (swept["part"] == ranks["part"]) & F.col("rank").between(F.col("low"), F.col("high") - 1), "left")
    placed = waits.filter("gap_part is not null").select("gap_part", (F.col("first") + F.col("high") - 1 - F.col("rank")).alias("slot"), F.struct("id", "size").alias("piece"))
    gaps = swept.filter(F.col("kind") == GAP).join(reached, "part", "left").withColumn("uses", F.least(F.col("slots"), F.col("reach") - F.col("rank")))
    used = gaps.filter("uses > 0").select(F.col("part").alias("gap_part"), "id", "size", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("uses") - 1)).alias("slot"))
    filled = used.join(placed, ["gap_part", "slot"]).groupBy("id", "size").agg(F.collect_list("piece").alias("pieces"))  # of a gap, at most the capacity
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["size"])
    rows = F.concat(F.transform("pieces", lambda p: _row(PLACED, p["id"], p["size"], F.col("id"))), F.array(_row(GAP, F.col("id"), F.col("size") - taken)))
    kept = swept.filter(F.col("kind") == PLACED).select(*columns).unionByName(waits.filter("gap_part is null").select(*columns))
    return kept.unionByName(gaps.filter("coalesce(uses, 0) <= 0").select(*columns)).unionByName(filled.select(F.inline(rows)))


def pack(rows: DataFrame, key: str, length: str, capacity: int) -> DataFrame:
    """(key, sequence_id, offset) for rows with a unique whole number and a length from 1 to the capacity."""
    spark, folder = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/packing-{uuid.uuid4().hex}"
    paths: list[str] = []

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    def state_of(frame: DataFrame, files: int | None = None) -> DataFrame:
        paths.append(f"{folder}/state-{len(paths)}")
        return kept(frame.coalesce(files) if files else frame, f"state-{len(paths) - 1}")

    drop_at_exit(spark, folder)
    full = F.col("size") == capacity
    sized = rows.select(F.col(key).cast("long").alias("id"), F.col(length).cast("long").alias("size"))
    state = state_of(sized.select(F.when(full, PLACED).otherwise(WAITS).alias("kind"), "id", "size", F.when(full, F.col("id")).alias("seq")))
    waits_now = 0
    for turn in itertools.count():
        waits, is_gap = F.col("kind") == WAITS, F.col("kind") == GAP
        seen = state.agg(F.max(F.when(waits, F.col("size"))).alias("largest"), F.min(F.when(waits, F.col("size"))).alias("least"), F.max(F.when(is_gap, F.col("size"))).alias("gap")).first()
        if seen.largest is None:
            break
        largest, open_rows, gaps = seen.largest, state.filter(waits), state.filter(is_gap & (F.col("size") >= seen.least))
        if (seen.gap or 0) < largest:
            waiting = {r["size"]: r["count"] for r in open_rows.groupBy("size").count().collect()}  # capacity rows at most
            new, chosen, bound = _opened(state, waiting, capacity, turn)
            waits_now = sum(waiting.values())
            new = state_of(new, 4 + waits_now // FILE_ROWS)
            open_rows, gaps = open_rows.filter(~chosen), gaps.unionByName(new.filter(is_gap & (F.col("size") >= seen.least)))
            largest = max((s for s in waiting if s <= bound), default=1)
        # A gap's times are the pieces it can hold whatever they are; it stands where the least of their places would.
        times = F.greatest(F.lit(1), F.floor(F.col("size") / largest))
        both = open_rows.withColumns({"times": F.lit(1).cast("long"), "value": F.col("size")}).unionByName(gaps.withColumns({"times": times, "value": F.floor(F.col("size") / times)}))
        order = ["value", "kind", "tie", "id"]
        ranged = both.withColumn("tie", F.xxhash64("id")).select("kind", "id", "size", "times", "value", "tie").repartitionByRange(*order).sortWithinPartitions(*order)
        # A task takes several ranges, each by itself, so that small rounds are few tasks.
        swept = kept(ranged.withColumn("part", F.spark_partition_id()).coalesce(4 + waits_now // FILE_ROWS).mapInArrow(_sweep, _SWEPT), f"swept-{turn}")
        left = swept.filter(F.col("kind") == LEFT).select("part", "rank", "slots").collect()  # a row a task
        waits_now = sum(r["rank"] for r in left)
        state = state_of(_resolved(swept, meetings([tuple(r) for r in left])), 4 + waits_now // FILE_ROWS)
    placed = spark.read.schema(_STATE).parquet(*paths).filter(F.col("kind") == PLACED)
    before = F.sum("size").over(Window.partitionBy("seq").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(F.col("id").alias(key), F.col("seq").alias("sequence_id"), F.coalesce(before, F.lit(0)).cast("long").alias("offset"))


def packed(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32, ids, sequence_id, offset) of all documents' pieces."""
    own = fresh("piece_id", [key])
    cuts = materialise(pieces(docs, path, pattern, capacity, end, key, text, with_ids).withColumn(own, F.monotonically_increasing_id()), "pieces")
    return cuts.join(pack(cuts, own, "length", capacity), own).drop(own)
