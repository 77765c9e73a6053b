"""Operator 8: near-duplicate groups by fast similarity sketches, banding and exact verification.

A text is a set of word shingles, hashed to 64 bits. Its sketch has COORDINATES bins. Round i hashes every element to
one bin with value (i, hash), for as many rounds as there are bins; in later rounds every element goes to one bin given
by the round, so every bin fills at last; rounds end when all bins are full. Equal bins of two sketches estimate the
Jaccard similarity with concentration bounds. Bands of ROWS bins are hashed: BANDS of them miss a pair of similarity
0.8 with a probability of 1e-7.

Texts with equal sets are one node, named by the least id. Of buckets (a band's value) with the same members one is kept.
In each all members are compared with its least member on their full sets, which costs rows in proportion to the members;
the members of a hot leader are dealt over salts, to each of which its set is copied. Buckets whose members these links
leave in several components are mixed. Mixed buckets with more than a block (BLOCK members or ELEMENTS shingles) outside
their largest component get other leaders for up to ROUNDS rounds, each of which is compared with the members outside its
component. Nodes that mixed buckets connect then form a crowd. A crowd is compared as a whole, or each of its mixed
buckets by itself where that moves fewer rows (other pairs share no bucket): those outside the largest component with
each other and with all others. All pairs of a group in different components are compared on their full sets within
tasks, a block against a block at a time: what leaves a task is links between components, not pairs. So no link between
members of a bucket is lost, and no pairs are written. A group of g members moves some 2 * g sets if a block holds those
outside its largest component; with o of them beyond a block it moves some 2 * g * o / BLOCK sets.

Defined cases: words are runs of other characters than space and \\t \\n \\v \\f \\r, with A-Z lower-cased; texts with
fewer words than a shingle are one shingle; null texts and texts without words have an empty set and link with nothing.
Rows that share an id count as one document with several texts, so their groups are joined. Rows with a null id have a
null component and are kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import arrow_map, copied, dealt, hot, materialise, partitions

BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS
#: Members of a group that are compared with as many others at once, their shingles together, and members that share a shingle from which its pairs are counted by a matrix product.
BLOCK, ELEMENTS, DENSE = 512, 500_000, 24
#: Rounds in which large mixed buckets get a further leader, before what is left is compared block by block.
ROUNDS = 6
_REMEMBERED = 100_000
_U = np.uint64


class _Words(dict):
    """64-bit hashes of words, remembered while few."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def _forget() -> None:
    _words.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of width words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, _U)
    w = np.array([_words[x] for x in words], _U)
    n = min(width, len(w))
    h = np.full(len(w) - n + 1, n, _U)
    for i in range(n):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
    return np.unique(h)


_SEEDS = _mix(np.arange(1, 2 * COORDINATES + 1, dtype=_U) * _U(0xD1342543DE82EF95))


def sketch(elements: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The t bins of a non-empty set: each holds the least (round, hash) that came to it."""
    bins = np.full(t, np.iinfo(np.uint64).max, _U)
    done = 0
    while done < 2 * t:
        rounds = np.arange(done, min(2 * t, done + max(1, -(-8 * t // len(elements)))))
        h = _mix(elements[None, :] ^ _SEEDS[rounds][:, None])
        at = np.where((rounds < t)[:, None], ((h >> _U(32)) * _U(t)) >> _U(32), (rounds % t)[:, None].astype(_U)).astype(np.int64)
        value = (rounds.astype(_U) << _U(32))[:, None] | (h & _U(0xFFFFFFFF))
        np.minimum.at(bins, at.ravel(), value.ravel())
        done = int(rounds[-1]) + 1
        if bins.max() < np.iinfo(np.uint64).max:
            break
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band; its number is hashed in."""
    key = np.arange(BANDS, dtype=_U)
    for column in bins.reshape(BANDS, ROWS).T:
        key = _mix(key * _U(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def signatures(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(id, n_shingles, digest binary, bands array<long>): digest names the set, bands is empty for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sizes, names, bands = [], [], []
            for x in batch.column(1):
                found = shingles(x.as_py(), width)
                sizes.append(len(found))
                names.append(xxhash.xxh3_128_digest(found.tobytes()))
                bands.append(band_keys(sketch(found)) if len(found) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            values = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))], names=["id", "n_shingles", "digest", "bands"])

    texts = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return arrow_map(texts, run, "id long, n_shingles long, digest binary, bands array<long>", _forget)


def sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, size, members array<long>) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py(), width).view(np.int64) for x in batch.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))], names=["node", "size", "members"])

    return arrow_map(docs, run, "node long, size int, members array<long>", _forget)


def _verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b), each given once, whose full sets meet 100 * intersection >= percent * union."""
    counted = pairs.groupBy("a").agg(F.count("*").alias("n"))
    heavy = materialise(hot(counted, ["a"], pairs.count()), "hot-leaders")
    b = held.select(F.col("node").alias("b"), F.col("members").alias("y"))
    a = copied(held.join(counted.select(F.col("a").alias("node")), "node", "left_semi").select(F.col("node").alias("a"), F.col("members").alias("x")), heavy, ["a"])
    # Sizes alone settle some pairs before the sets meet.
    met = dealt(pairs, heavy, ["a"], ["b"]).join(b, "b").join(a, ["a", "salt"]).filter(F.least(F.size("x"), F.size("y")) * 100 >= F.greatest(F.size("x"), F.size("y")) * percent)
    return met.withColumn("both", F.size(F.array_intersect("x", "y"))).filter(F.col("both") * 100 >= (F.size("x") + F.size("y") - F.col("both")) * percent).select("a", "b")


def intersections(found: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairs' intersections. Rare elements are counted pair by pair, frequent ones by matrix products."""
    n = len(found)
    out = np.zeros(n * n, np.float32)
    owner = np.repeat(np.arange(n), [len(x) for x in found])
    values = np.concatenate(found)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    times = np.diff(np.append(starts, len(values)))
    for d in np.unique(times):
        at = starts[times == d]
        if d < 2 or d > DENSE:
            continue
        held = owner[at[:, None] + np.arange(d)]
        for i, j in zip(*np.triu_indices(d, 1)):
            np.add.at(out, held[:, i] * n + held[:, j], np.float32(1))
    out = out.reshape(n, n)
    often = np.flatnonzero(times > DENSE)
    for a in range(0, len(often), 4096):
        part = often[a : a + 4096]
        table = np.zeros((n, len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), times[part])
        place = np.repeat(starts[part] - (np.cumsum(times[part]) - times[part]), times[part]) + np.arange(times[part].sum())
        table[owner[place], column] = 1
        out += table @ table.T
    return np.maximum(out, out.T)


def _joining(rows: list[tuple], percent: int, apart: bool) -> list[tuple[int, int]]:
    """Links between components that pairs of rows (component, block, set) give; apart: only between different blocks."""
    parts = np.array([r[0] for r in rows], np.int64)
    if parts.min() == parts.max():
        return []
    blocks, sizes = np.array([r[1] for r in rows]), np.array([len(r[2]) for r in rows], np.float64)
    both = intersections([r[2] for r in rows])
    # Sets of a block have fewer than 2**24 shingles, so single precision holds the counts; the sum is compared in double.
    good = both.astype(np.float64) * (100 + percent) >= percent * (sizes[:, None] + sizes[None, :])
    good &= parts[:, None] < parts[None, :]
    if apart:
        good &= blocks[:, None] != blocks[None, :]
    i, j = np.nonzero(good)
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := top.get(x, x)) != x:
            top[x] = top.get(y, y)
            x = y
        return x

    out = []
    for x, y in np.unique(np.stack([parts[i], parts[j]], axis=1), axis=0).tolist():
        a, b = root(x), root(y)
        if a != b:
            top[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def _compared(percent: int):
    """Rows (a, b) of linked components from rows (kind, crowd, i, j, component, block, members), sorted by the first four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links():
            found = _joining(held, percent, now[2] != now[3]) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(6)))
            members = batch.column(6)
            flat, ends = members.flatten().to_numpy(zero_copy_only=False), np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))
            for (kind, crowd, i, j, component, block), size, end in zip(keys, members.value_lengths().to_pylist(), ends):
                if now != (kind, crowd, i, j):
                    if held:
                        yield links()
                    now, held = (kind, crowd, i, j), []
                held.append((component, block, flat[end - size : end].copy()))
        if held:
            yield links()

    return run


def _weighed(rows: DataFrame, group: str) -> DataFrame:
    """(group, most, outs, ins, moved, n, away) of rows (group, node, component, size), one for each group.

    most is its largest component, ins are blocks that this takes and outs those of all others, of whom away are held; a
    group that fits into a block has ins 0 and outs 1. moved are the rows by which its blocks meet.
    """
    each = rows.groupBy(group, "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    both = each.groupBy(group).agg(F.max(F.struct("n", "component", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / ELEMENTS)).cast("int")
    n, size, top = F.col("n"), F.col("size"), F.col("top")
    apart = blocks(n, size) > 1
    cut = both.withColumn("outs", F.when(apart, blocks(n - top["n"], size - top["size"])).otherwise(1)).withColumn("ins", F.when(apart, blocks(top["n"], top["size"])).otherwise(0))
    moved = F.when(F.col("ins") == 0, n).otherwise(top["n"] * F.col("outs") + (n - top["n"]) * (F.col("outs") + F.col("ins")))
    return cut.select(group, top["component"].alias("most"), "outs", "ins", moved.alias("moved"), "n", (n - top["n"]).alias("away"))


def _parts(rows: DataFrame, weighed: DataFrame, group: str, kind: int) -> DataFrame:
    """(kind, crowd, i, j, block, node, component) of rows (group, node, component, size): for each pair of blocks (i, j) of a weighed group its nodes.

    Blocks hold either members of the largest component, which need not meet each other, or others. Hot groups are dealt over salts.
    """
    heavy = materialise(hot(weighed, [group], rows.count()), "hot-groups")
    sides = dealt(rows.select(group, "node", "component"), heavy, [group], ["node"]).join(copied(weighed.select(group, "most", "outs", "ins"), heavy, [group]), [group, "salt"])
    dealt_by = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    inside = (F.col("component") == F.col("most")) & (F.col("ins") > 0)
    block = F.when(inside, F.col("outs") + dealt_by("ins")).otherwise(dealt_by("outs"))
    last = F.when(inside, F.col("outs") - 1).otherwise(F.col("outs") + F.col("ins") - 1)
    met = sides.select(F.lit(kind).alias("kind"), F.col(group).alias("crowd"), block.alias("block"), "node", "component", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return met.select("kind", "crowd", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component")


def _groups_to_compare(left: DataFrame, crowds: DataFrame) -> DataFrame:
    """(kind, crowd, i, j, block, node, component): for each pair of blocks (i, j) of a group its nodes; groups are crowds (kind 0) or buckets (kind 1).

    A crowd is compared as a whole where this moves no more rows than its mixed buckets one by one; both find the same links of members of a bucket.
    """
    placed = materialise(left.groupBy("node").agg(F.first("component").alias("component"), F.first("size").alias("size")).join(crowds, "node"), "crowded")
    whole = materialise(_weighed(placed, "crowd"), "weighed")
    large = whole.filter("ins > 0")
    if not large.limit(1).count():
        return _parts(placed, whole, "crowd", 0)
    by_bucket = left.groupBy("bucket").agg(F.min("first").alias("node")).join(placed.join(large.select("crowd"), "crowd", "left_semi").select("node", "crowd"), "node").join(_weighed(left, "bucket"), "bucket")
    by_bucket = materialise(by_bucket.select("crowd", "bucket", "most", "outs", "ins", "moved", "n"), "weighed")
    split = materialise(by_bucket.groupBy("crowd").agg(F.sum("moved").alias("apart")).join(large, "crowd").filter("apart < moved").select("crowd"), "split")
    rows = _parts(placed, whole.join(split, "crowd", "left_anti"), "crowd", 0)
    if not split.limit(1).count():
        return rows
    return rows.union(_parts(left, by_bucket.join(split, "crowd", "left_semi"), "bucket", 1))


def _mixed(now: DataFrame) -> DataFrame:
    """(bucket, first, node, component, size): the buckets of now (bucket, node, component, size) whose members are in several components."""
    mixed = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("first")).filter("low <> high").select("bucket", "first")
    return materialise(now.join(mixed, "bucket").select("bucket", "first", "node", "component", "size"), "left")


def _to(links: list[DataFrame]) -> DataFrame:
    """(component, to): what the components that links (a, b) connect become. Their graph is small."""
    return components(reduce(DataFrame.union, links)).select(F.col("node").alias("component"), F.col("component").alias("to"))


def _further_leaders(left: DataFrame, held: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Mixed buckets and links between the components of left, after buckets with more than a block outside their largest component had further leaders.

    Each round moves no more rows than these buckets hold. After two rounds that link less than a tenth of what they ask, no more follow.
    """
    links, idle = [], 0
    for seed in range(ROUNDS):
        large = materialise(_weighed(left, "bucket").filter("outs > 1").select("bucket"), "large-buckets")
        if not large.limit(1).count():
            break
        asked = left.join(large, "bucket")
        leaders = asked.groupBy("bucket").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(seed))).alias("leader"))
        # Buckets with much the same members have the same leader, so that their pairs are few.
        pairs = materialise(asked.join(leaders, "bucket").filter("component <> leader.component").select(F.col("leader.node").alias("a"), F.col("node").alias("b"), F.col("leader.component").alias("from"), "component").distinct(), "further")
        good = _verified(pairs.select("a", "b"), held, percent)
        links.append(materialise(good.join(pairs, ["a", "b"]).select(F.col("from").alias("a"), F.col("component").alias("b")).distinct(), "lifted"))
        if made := links[-1].count():
            left = _mixed(left.join(_to(links[-1:]), "component", "left").select("bucket", "node", F.coalesce("to", "component").alias("component"), "size"))
        idle = idle + 1 if made * 10 < pairs.count() else 0
        if idle == 2:
            break
    return left, links


def joined(nodes: DataFrame, texts: DataFrame, given: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of nodes (node, digest, bands) that verified links or given ones (a, b) join; texts are (node, text)."""
    spark = nodes.sparkSession
    placed = nodes.select("node", F.xxhash64("digest").alias("x"), F.explode("bands").alias("bucket"))
    bucket = Window.partitionBy("bucket")
    shared = placed.select("bucket", "node", F.min("node").over(bucket).alias("leader"), F.max("node").over(bucket).alias("last"), F.count("*").over(bucket).alias("n"), F.bit_xor("x").over(bucket).alias("x"))
    shared = materialise(shared.filter("leader <> last"), "shared")
    # Buckets with the same sets say the same: their least and last node, their number and 64 bits of their digests name them.
    one = shared.groupBy("leader", "last", "n", "x").agg(F.min("bucket").alias("bucket")).select("bucket")
    members = materialise(shared.select("bucket", "leader", "node").join(one, "bucket", "left_semi").distinct(), "buckets")
    # Nodes are as many as the input makes them: this join is a merge at every size, never a broadcast.
    held = materialise(sets(texts.hint("merge").join(members.select("node").distinct(), "node"), width), "shingles")
    tried = materialise(members.filter("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "tried")
    named = materialise(components(_verified(tried, held, percent).union(given)), "components")

    sizes = held.groupBy("node").agg(F.sum("size").alias("size"))
    known = materialise(sizes.join(named, "node", "full").select("node", F.coalesce("component", "node").alias("component"), "size"), "known")
    now = materialise(members.select("bucket", "node").join(known, "node"), "now")
    left, links = _further_leaders(_mixed(now), held, percent)
    crowds = components(left.select(F.col("first").alias("a"), F.col("node").alias("b"))).withColumnRenamed("component", "crowd")
    dealt_out = _groups_to_compare(left, crowds).join(held.select("node", "members"), "node")
    order = ["kind", "crowd", "i", "j"]
    dealt_out = dealt_out.repartition(partitions(spark), *order).sortWithinPartitions(*order).select(*order, "component", "block", "members")
    links.append(materialise(arrow_map(dealt_out, _compared(percent), "a long, b long"), "lifted"))
    return materialise(known.join(_to(links), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row; a component's least id is kept."""
    signed = materialise(signatures(docs, width, key, text), "signatures")
    full = signed.filter("n_shingles > 0 and id is not null")
    named = full.groupBy("digest").agg(F.min("id").alias("node"), F.first("bands").alias("bands"))
    # Ids whose rows have several texts join the nodes of these texts.
    several = full.select("id", "digest").distinct().groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    texts = docs.select(F.col(key).cast("long").alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    nodes = materialise(named, "nodes")
    own = full.join(several, "id").join(nodes, "digest").select(F.col("node").alias("a"), F.col("id").alias("b"))
    found = joined(nodes, texts, own, width, percent)
    node = signed.filter("n_shingles > 0").join(nodes.select("digest", "node"), "digest", "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("node")).alias("node"))
    node = node.union(signed.filter("n_shingles = 0").select("id", "n_shingles", "id"))
    placed = node.join(found, "node", "left").select("id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return placed.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
