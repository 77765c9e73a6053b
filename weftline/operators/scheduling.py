"""FLT7, FLT8, WIN3-WIN5, AGG9: which credential may send the next request, and when."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.status import bucket_keys, quota_scope
from ..sources.stored import kept


@dataclass(frozen=True)
class Quota:
    """Limits of a model; None does not limit."""

    requests_per_minute: int | None = None
    tokens_per_minute: int | None = None
    requests_per_day: int | None = None


def eligible(credentials: DataFrame, model: str) -> DataFrame:
    """FLT7: enabled credentials whose list of models is empty or names the model."""
    return credentials.filter(F.coalesce("enabled", F.lit(True)) & ((F.coalesce(F.size("allowed_models"), F.lit(0)) <= 0) | F.array_contains("allowed_models", model)))


def available(credentials: DataFrame, cooldowns: DataFrame, busy: DataFrame, model: str, now: Column) -> DataFrame:
    """FLT8: credentials of whose three buckets none cools down (scope_key, cooldown_until) and whose scope is not busy (scope_key)."""
    scoped = credentials.withColumn("scope", quota_scope(F.col("provider_id"), F.col("project_id"), F.col("credential_name")))
    live = cooldowns.filter(F.col("cooldown_until") > now).select(F.col("scope_key").alias("__bucket")).distinct()
    blocked = scoped.select("scope", F.explode(bucket_keys(F.col("scope"), F.lit(model))).alias("__bucket")).join(live, "__bucket", "left_semi").select("scope").distinct()
    return scoped.join(blocked, "scope", "left_anti").join(busy.select(F.col("scope_key").alias("scope")).distinct(), "scope", "left_anti")


def offered_load(requests: DataFrame, bucket: str, at: str, tokens: str) -> DataFrame:
    """WIN3: requests with the count and tokens of their bucket in the last 60 seconds, their own included.

    A minute's windows reach into the minute before and no farther. So each minute of a bucket is a group of its own, to
    which the rows of the minute before are copied, and a bucket with most of the requests is many groups.
    """
    length = 60_000_000
    rows = requests.withColumn("__at", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("__copy", F.explode(F.array(F.lit(0), F.lit(1))))
    window = Window.partitionBy(bucket, F.floor(F.col("__at") / length) + F.col("__copy")).orderBy("__at").rangeBetween(-length, 0)
    found = rows.withColumn("requests_60s", F.count("*").over(window)).withColumn("tokens_60s", F.sum(tokens).over(window))
    return found.filter("__copy = 0").drop("__at", "__copy")


_TAIL = "array<struct<at: bigint, tokens: bigint>>"
_SUMMARY = f"bucket string, slice long, count long, cut boolean, tail {_TAIL}, used_tail {_TAIL}, used_left long"
MINUTE, DAY = 60_000_000, 86_400_000_000


def admitted(requests: DataFrame, bucket: str, at: str, tokens: str, order: str, quota: Quota, slice_seconds: int = 3600, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """WIN3, WIN4: (bucket, order, admitted) when requests are taken one by one and only admitted ones count.

    A bucket is cut into slices of time, which many tasks take at once. What a slice must know of those before it is the
    last minute's admitted requests and how many the day has left. Slices begin by a guess, nothing and a whole day; then
    those whose slices before end otherwise than guessed are taken again, until none is. The first slice is right at
    once, and each round makes at least the next one right; most need no second look, as a minute without requests
    forgets. A request without a time is refused and counts nowhere. slice_seconds divides a day and is a minute at least.
    """
    if slice_seconds < 60 or 86_400 % slice_seconds:
        raise ValueError("slices are parts of a day, of a minute at least")
    keep, length = keep or kept, slice_seconds * 1_000_000
    time = F.unix_micros(F.col(at).cast("timestamp"))
    every = requests.select(F.col(bucket).cast("string").alias("bucket"), F.col(order).cast("long").alias("order"), time.alias("at"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("tokens"))
    rows = every.filter("at is not null").withColumn("slice", F.floor(F.col("at") / length))
    whole = quota.requests_per_day if quota.requests_per_day is not None else -1
    start = rows.select("bucket", "slice").distinct().select("bucket", "slice", F.array().cast(_TAIL).alias("tail"), F.lit(whole).cast("long").alias("left"))
    summary = keep(_taken(rows, start, quota, length, False))
    while True:
        wanted = _wanted(summary, whole, length)
        same_tail = F.col("tail_in") == F.col("used_tail")
        same_day = (F.col("left") == F.col("used_left")) | (~F.col("cut") & (F.col("left") >= F.col("count")))
        again = keep(wanted.filter(~(same_tail & same_day)).select("bucket", "slice", F.col("tail_in").alias("tail"), "left"))
        if not again.limit(1).count():
            break
        same = rows["bucket"].eqNullSafe(again["bucket"]) & (rows["slice"] == again["slice"])
        anew = _taken(rows.join(again, same, "left_semi"), again, quota, length, False)
        other = summary["bucket"].eqNullSafe(again["bucket"]) & (summary["slice"] == again["slice"])
        summary = keep(summary.join(again, other, "left_anti").unionByName(anew))
    states = summary.select("bucket", "slice", F.col("used_tail").alias("tail"), F.col("used_left").alias("left"))
    return _taken(rows, states, quota, length, True).unionByName(every.filter("at is null").select("bucket", "order", F.lit(False).alias("admitted")))


def _wanted(summary: DataFrame, whole: int, length: int) -> DataFrame:
    """summary with what each slice should have known: tail_in from the slice just before, left from those of its day."""
    by_time, day = Window.partitionBy("bucket").orderBy("slice"), F.floor(F.col("slice") * length / DAY)
    before = F.coalesce(F.sum("count").over(Window.partitionBy("bucket", day).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(-1) if whole < 0 else F.greatest(F.lit(0), F.lit(whole) - before)
    tail = F.when(F.lag("slice").over(by_time) == F.col("slice") - 1, F.lag("tail").over(by_time))
    return summary.withColumns({"tail_in": F.coalesce(tail, F.array().cast(_TAIL)), "left": left.cast("long")})


def _taken(rows: DataFrame, states: DataFrame, quota: Quota, length: int, decisions: bool) -> DataFrame:
    """The requests of slices from their states on: decisions, or what each slice ends with."""
    nothing = lambda kind: F.lit(None).cast(kind)
    first = states.select("bucket", "slice", F.lit(0).alias("kind"), nothing("long").alias("order"), nothing("long").alias("at"), nothing("long").alias("tokens"), "tail", "left")
    both = first.unionByName(rows.select("bucket", "slice", F.lit(1).alias("kind"), "order", "at", "tokens", nothing(_TAIL).alias("tail"), nothing("long").alias("left")))
    sorted_rows = both.repartition("bucket", "slice").sortWithinPartitions("bucket", "slice", "kind", "at", "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            out, ended = [], []
            for b, s, kind, o, t, n, tail, left in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if state is not None:
                        ended.append(state.end())
                    state = _Slice(b, s, tail, left, quota, length)
                else:
                    out.append((b, o, state.take(t, n)))
            if decisions:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.bool_()))], ["bucket", "order", "admitted"])
            else:
                yield _ends(ended)
        if state is not None and not decisions:
            yield _ends([state.end()])

    return sorted_rows.mapInArrow(run, "bucket string, order long, admitted boolean" if decisions else _SUMMARY)


class _Slice:
    """A slice's requests in order: recent has (time, tokens) of the last minute's admitted ones, held their tokens."""

    def __init__(self, bucket, number: int, tail: list[dict], left: int, quota: Quota, length: int):
        self.bucket, self.number, self.tail, self.left, self.quota, self.until = bucket, number, tail, left, quota, (number + 1) * length
        self.recent = deque((x["at"], x["tokens"]) for x in tail)
        self.held, self.count, self.cut = sum(n for _, n in self.recent), 0, False

    def take(self, at: int, tokens: int) -> bool:
        recent, quota = self.recent, self.quota
        while recent and recent[0][0] < at - MINUTE:
            self.held -= recent.popleft()[1]
        if quota.requests_per_minute is not None and len(recent) >= quota.requests_per_minute:
            return False
        if quota.tokens_per_minute is not None and self.held + tokens > quota.tokens_per_minute:
            return False
        if 0 <= self.left <= self.count:
            self.cut = True
            return False
        recent.append((at, tokens))
        self.held += tokens
        self.count += 1
        return True

    def end(self) -> tuple:
        tail = [{"at": t, "tokens": n} for t, n in self.recent if t >= self.until - MINUTE]
        return self.bucket, self.number, self.count, self.cut, tail, self.tail, self.left


_ENTRIES = pa.list_(pa.struct([("at", pa.int64()), ("tokens", pa.int64())]))
_KINDS = [("bucket", pa.string()), ("slice", pa.int64()), ("count", pa.int64()), ("cut", pa.bool_()), ("tail", _ENTRIES), ("used_tail", _ENTRIES), ("used_left", pa.int64())]


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_KINDS)], [n for n, _ in _KINDS])


def rotation(requests: DataFrame, pool: str, order: list[str], size: int, block: Column) -> DataFrame:
    """WIN5: requests with slot, the place in the pool's sorted credentials at which their search begins.

    block rises with order (an hour, say): rows are numbered within a block, behind the counts of the pool's earlier ones,
    so that a pool is as many groups as it has blocks.
    """
    rows = requests.withColumn("__block", block)
    counts = rows.groupBy(pool, "__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(pool).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = rows[pool].eqNullSafe(F.col("__pool")) & F.col("__block").eqNullSafe(F.col("__of"))
    offsets = counts.withColumn("__before", before).select(F.col(pool).alias("__pool"), F.col("__block").alias("__of"), "__before")
    place = F.row_number().over(Window.partitionBy(pool, "__block").orderBy(*order)) + F.col("__before") - 1
    return rows.join(offsets, same).withColumn("slot", place % size).select(*requests.columns, "slot")


def wait_seconds(waits: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """AGG9: the shortest wait, not under 0.1 nor over 2 seconds."""
    return waits.groupBy(*by).agg(F.greatest(F.lit(0.1), F.least(F.lit(2.0), F.min(seconds))).alias("wait"))
