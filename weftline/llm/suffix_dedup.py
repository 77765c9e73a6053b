"""Operator 5: removal of every byte that a repeated string of LENGTH bytes covers, by sorted and named suffixes.

The cover: positions are sampled by content, so that equal strings of LENGTH bytes hold a sample at equal offsets, which
is what a difference cover gives suffixes of equal residues. A string's sample is its least GRAM-byte string by a hash,
the first of equals; neighbouring strings mostly share one. Only strings whose sample's gram occurs again can repeat,
so a count of the grams leaves the suffixes that need sorting at all, each with its sample's context.

Sorting: the contexts of a gram meet in one place, equal ones once. There suffixes are ordered by names: 8-byte words
are sorted and named, triples of names are sorted and named (24 bytes), and again (72 bytes), and the triple at
distances 0, 64 and 128 names all LENGTH bytes; equal neighbours in that order are the repeated strings. Names are
ranks by sorting, not hashes, so nothing needs a second look. A gram with more than SORTED bytes of different contexts
is not gathered: its strings are dealt over the cluster by their md5 and counted there.

Equal texts are one text with a count. Texts cross the network once, hashed by md5, for all three uses.

Defined cases: null text is the empty text. Strings never cross texts and are judged on the input; a text that occurs
twice (also under one id) loses all its bytes if it has LENGTH or more. Very long texts are sampled in pieces. Extra
columns are ignored; null ids are returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LENGTH, GRAM = 200, 64
#: Bytes that are sampled at once, and bytes of different contexts that are sorted at once.
PIECE, SORTED = 1 << 20, 2_000_000
_SPAN = LENGTH - GRAM + 1
_U = np.uint64
_PLACE = _U((1 << 21) - 1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    """1, base, base**2 and so on, modulo 2**64."""
    out = np.full(2 * PIECE + 1, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_POWERS, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours, by least values forwards and backwards within blocks."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, _U)
    full[: len(x)] = x
    block = full.reshape(-1, width)
    ahead = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(block, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def samples(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, gram hash, first string's start, strings) of the samples in pieces, of 2 * PIECE bytes together at most."""
    sizes = np.array([len(x) for x in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    starts = np.cumsum(sizes) - sizes
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _POWERS[: len(data)], out=sums[1:], dtype=_U)
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * _INVERSE[: len(data) - GRAM + 1])
    least = _sliding_least((grams & ~_PLACE) | np.arange(len(grams), dtype=_U), _SPAN)
    at = (least & _PLACE).astype(np.int64)
    owner = np.repeat(np.arange(len(pieces)), sizes)[: len(at)]
    valid = np.arange(len(at)) + LENGTH <= (starts + sizes)[owner]
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(valid & change)
    # A run ends at the next change or the first string that leaves its piece.
    ends = np.append(np.flatnonzero(change | ~valid), len(at))
    stop = ends[np.searchsorted(ends, first, side="right")]
    return owner[first], grams[at[first]].view(np.int64), first - starts[owner[first]], stop - first


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(text numbers, offsets, pieces) in lots; longer texts are cut so that each string starts in one piece."""
    owners, offsets, held, size = [], [], [], 0
    for i, x in enumerate(texts):
        for a in range(0, max(1, len(x) - LENGTH + 1), PIECE):
            part = x[a : a + PIECE + LENGTH - 1]
            if held and size + len(part) > PIECE + LENGTH:
                yield owners, offsets, held
                owners, offsets, held, size = [], [], [], 0
            owners.append(i)
            offsets.append(a)
            held.append(part)
            size += len(part)
    if held:
        yield owners, offsets, held


def _own_repeats(texts: list[bytes], own: np.ndarray, gram: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(samples to keep, resolved (text, start, strings)): contexts that a text holds twice are settled where they are met.

    Rulers and repeated lines give a sample at each period; one of them stands for all in the sorting.
    """
    keep = np.ones(len(own), bool)
    order = np.lexsort((gram, own))
    same = (own[order][1:] == own[order][:-1]) & (gram[order][1:] == gram[order][:-1])
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    settled: dict[int, list[tuple[int, int]]] = {}
    for i in np.flatnonzero(twice).tolist():
        t, a, k = int(own[i]), int(lo[i]), int(n[i])
        key = (t, texts[t][a : a + k - 1 + LENGTH])
        if key in seen:
            keep[i] = False
            settled.setdefault(t, []).extend([(a, a + k), *([(first, first + k)] if (first := seen[key]) >= 0 else [])])
            seen[key] = -1
        else:
            seen[key] = a
    out = []
    for t, spans in settled.items():
        for a, b in _merged(spans):
            out.append((t, a, b - a))
    return keep, out


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans in order, those that touch made one."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, d, lo, n, settled) of (d, text): samples, and runs of strings that repeat within their text, under grams of their own."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for owners, offsets, held in _pieces(texts):
            piece, gram, start, n = samples(held)
            own, lo = np.array(owners, np.int64)[piece], start + np.array(offsets, np.int64)[piece]
            keep, settled = _own_repeats(texts, own, gram, lo, n)
            done = np.array(settled, np.int64).reshape(-1, 3)
            alone = _mix(np.array([int.from_bytes(batch.column(0)[int(t)].as_py()[:8], "big") for t in done[:, 0]], _U) + done[:, 1].astype(_U)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([gram[keep], alone]), pa.int64()), batch.column(0).take(pa.array(np.concatenate([own[keep], done[:, 0]]))), pa.array(np.concatenate([lo[keep], done[:, 1]]), pa.int64()),
                 pa.array(np.concatenate([n[keep], done[:, 2]]).astype(np.int32), pa.int32()), pa.array(np.repeat([False, True], [int(keep.sum()), len(done)]), pa.bool_())],
                names=["gram", "d", "lo", "n", "settled"],
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, d, lo, n, c, context) from (d, text, array of samples); settled runs have neither c nor context."""
    for batch in batches:
        rows = [(s["gram"], d, s["lo"], s["n"], None if s["settled"] else text[s["lo"] : s["lo"] + s["n"] - 1 + LENGTH]) for d, text, held in zip(*(c.to_pylist() for c in batch.columns)) for s in held]
        for a in range(0, len(rows), 4096):
            part = rows[a : a + 4096]
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32()]
            marks = pa.array([None if r[4] is None else hashlib.md5(r[4]).digest() for r in part], pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in part], t) for i, t in enumerate(kinds)), marks, pa.array([r[4] for r in part], pa.binary())], names=["gram", "d", "lo", "n", "c", "context"])


def _names(x: np.ndarray) -> np.ndarray:
    """The rank of each value among the different values."""
    order = np.argsort(x)
    found = x[order]
    rank = np.empty(len(x), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(found[1:] != found[:-1])])
    return rank


def repeated_strings(contexts: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each context, which of its first counts[i] strings of LENGTH bytes occur twice or more in all of these."""
    sizes = np.array([len(x) for x in contexts])
    data = np.frombuffer(b"".join(contexts) + bytes(LENGTH + 8), np.uint8).astype(np.int64)
    n = int(sizes.sum())
    word = data[:-1] << 8 | data[1:]
    word = word[:-2] << 16 | word[2:]
    word = word[:-4] << 32 | word[4:]

    def triple(names: np.ndarray, step: int, at: np.ndarray | None = None) -> np.ndarray:
        held = np.concatenate([names, np.zeros(2 * step, np.int64)])
        at = np.arange(len(names)) if at is None else at
        return _names(held[at] << 42 | held[at + step] << 21 | held[at + 2 * step])

    starts = np.cumsum(sizes) - sizes
    counts = np.asarray(counts)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    names = triple(triple(triple(_names(word[:n]), 8), 24), 64, at)
    twice = np.bincount(names)[names] > 1
    return np.split(twice, np.cumsum(counts)[:-1])


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2].tolist(), edges[1::2].tolist()


def _sorted_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, start, stop, string) from (gram, c, n, many, context) sorted by gram: runs of repeated strings, or with string each single string of a gram too large to sort."""
    lot: list[tuple] = []
    lot_size = 0
    group: list[tuple] = []
    size, spilled, gram = 0, False, None

    def batch_of(rows):
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["c", "start", "stop", "string"])

    def resolved():
        flags = repeated_strings([r[3] for r in lot], [r[1] for r in lot]) if lot else []
        return [(c, a, b, None) for (c, n, many, _), own in zip(lot, flags) for a, b in zip(*(([0], [n]) if many else _runs(own)))]

    def dealt(row):
        """Strings of a context that repeats count as well: they may occur in others."""
        c, n, many, x = row
        return [(c, i, i + 1, hashlib.md5(x[i : i + LENGTH]).digest()) for i in range(n)] + ([(c, 0, n, None)] if many else [])

    for batch in batches:
        for row in zip(*(x.to_pylist() for x in batch.columns)):
            if row[0] != gram:
                lot += group
                lot_size += size
                group, size, spilled, gram = [], 0, False, row[0]
                if lot_size > SORTED // 2:
                    if rows := resolved():
                        yield batch_of(rows)
                    lot, lot_size = [], 0
            group.append(row[1:])
            size += len(row[4])
            if spilled or lot_size + size > SORTED:
                if not spilled and lot:
                    if rows := resolved():
                        yield batch_of(rows)
                    lot, lot_size = [], 0
                if spilled or size > SORTED:
                    for x in group:
                        yield batch_of(dealt(x))
                    group, size, spilled = [], 0, True
    lot += group
    if rows := resolved():
        yield batch_of(rows)


def _removed(text: bytes, count: int, spans: list[dict]) -> tuple[int, int, int, str]:
    """(bytes, removed, maximal runs, digest of what stays)."""
    if len(text) < LENGTH or (count < 2 and not spans):
        return len(text), 0, 0, hashlib.sha256(text).hexdigest()
    if count > 1:
        return len(text), len(text), 1, hashlib.sha256(b"").hexdigest()
    merged = _merged([(s["a"], s["b"] - 1 + LENGTH) for s in spans])
    kept, at = hashlib.sha256(), 0
    for a, b in merged:
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    return len(text), sum(b - a for a, b in merged), len(merged), kept.hexdigest()


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_removed(t, n, s or []) for t, n, s in zip(*(c.to_pylist() for c in batch.columns[1:]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string())], names=["d", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    keyed = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).withColumn("d", F.unhex(F.md5("text"))).filter("d is not null")
    # The same aggregate wherever texts are needed, down to the filter that a join would infer: then one exchange serves all.
    unique = keyed.groupBy("d").agg(F.first("text").alias("text"))
    copies = keyed.groupBy("d").agg(F.count("*").alias("count")).filter("count > 1")

    sampled = unique.mapInArrow(_sampled, "gram long, d binary, lo long, n int, settled boolean")
    again = sampled.withColumn("times", F.count("*").over(Window.partitionBy("gram"))).filter("times > 1 or settled").drop("times")
    asked = again.groupBy("d").agg(F.collect_list(F.struct("gram", "lo", "n", "settled")).alias("held"))
    contexts = unique.join(asked, "d").select("d", "text", "held").mapInArrow(_contexts, "gram long, d binary, lo long, n int, c binary, context binary")
    different = contexts.filter("c is not null").groupBy("gram", "c").agg(F.first("n").alias("n"), (F.count("*") > 1).alias("many"), F.first("context").alias("context"))
    sorts = different.repartition(_parts(docs), "gram").sortWithinPartitions("gram").select("gram", "c", "n", "many", "context")
    found = sorts.mapInArrow(_sorted_contexts, "c binary, start int, stop int, string binary")

    # Strings of grams that were too large to sort are counted by digest; sorted runs pass, each under a key of its own.
    own = F.coalesce("string", F.concat("c", F.col("start").cast("string").cast("binary")))
    runs = found.withColumn("times", F.count("*").over(Window.partitionBy(own))).filter("string is null or times > 1").select("c", "start", "stop")
    spans = contexts.select("d", "lo", "n", "c").join(runs, "c", "left").filter("c is null or start is not null")
    spans = spans.select("d", (F.col("lo") + F.coalesce("start", F.lit(0))).alias("a"), (F.col("lo") + F.coalesce("stop", "n")).alias("b"))
    spans = spans.groupBy("d").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    results = unique.join(spans, "d", "left").join(copies, "d", "left").select("d", "text", F.coalesce("count", F.lit(1)).alias("count"), "spans").mapInArrow(_results, "d binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return keyed.select("id", "d").join(results, "d").select(F.col("id").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _parts(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
