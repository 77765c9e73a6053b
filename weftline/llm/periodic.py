"""Operator 12: runs of words that repeat with a period.

The words of a text become numbers. For each lag up to the number of words over the least exponent, the array is
compared with itself shifted by the lag, a block of lags at once, and a stretch of equal places is a run of that
period. Documents with many lags are dealt over tasks by ranges of lags, so that one long text is the work of many
tasks; the ranges' runs are put together again by document.

Defined cases: null and empty texts have no words and no runs. A document has one row for each of its rows; rows that
repeat in id and text give equal results. Very long texts are whole, as their lags are many ranges. Words are compared
exactly. A run with a smaller period inside its own is that of the smallest one. Other columns stay as they are, also
one named as the result, which gets underscores; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WORD, arrow_map, fresh, materialise

#: A run has so many words at least, and its period so many times.
LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Lags of a range, and comparisons that stand in memory at once.
LAGS, AT_ONCE = 4096, 1 << 20
#: Rows of a result's batch.
ROWS = 100
_WORDS = re.compile(WORD)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = "array<struct<start: bigint, length: bigint, period: bigint>>"


def numbered(words: list[str]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def stretches(ids: np.ndarray, first: int, last: int, least: int = LEAST_WORDS, times: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the stretches with a period from first to last, maximal, of the least length and exponent."""
    n, found = len(ids), []
    last = min(last, n // times, n - 1)
    padded = np.concatenate([ids, np.full(max(0, last) + 1, -1, np.int32)])
    block = max(1, AT_ONCE // max(1, n))
    for p in range(first, last + 1, block):
        lags = np.arange(p, min(p + block, last + 1))
        shifted = np.lib.stride_tricks.sliding_window_view(padded, n)[lags[0] : lags[-1] + 1]
        # Row p ends with p places beyond the text, which equal nothing: no stretch reaches into the next row.
        equal = np.flatnonzero(shifted == ids)
        if not len(equal):
            continue
        breaks = np.flatnonzero(np.diff(equal) != 1)
        starts, ends = equal[np.concatenate([[0], breaks + 1])], equal[np.concatenate([breaks, [len(equal) - 1]])] + 1
        periods = lags[starts // n]
        length = ends - starts + periods
        good = length >= np.maximum(least, times * periods)
        found += zip((starts[good] % n).tolist(), length[good].tolist(), periods[good].tolist())
    return found


def smallest(runs) -> list[tuple[int, int, int]]:
    """Of stretches with the same place the one of the smallest period, by start and period.

    A stretch four times as long as its period has every smaller period as a divisor, and then the same ends.
    """
    best: dict[tuple[int, int], int] = {}
    for start, length, period in runs:
        if period < best.get((start, length), period + 1):
            best[start, length] = period
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds behind its first period, joined by a space."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [w for w, k in zip(words, np.cumsum(change)) if not k]
    return " ".join(words)


def find(rows: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """rows with a struct periodic(n_words, runs, collapsed) as last column; runs are (start, length, period) by start, then period."""
    out, lags, low = fresh("periodic", rows.columns), fresh("lags", rows.columns), fresh("low", rows.columns)
    # A text with few characters cannot have the words for a second range.
    many = F.length(text) > 2 * LEAST_EXPONENT * LAGS
    placed = rows.withColumn(lags, F.when(many, F.floor(F.regexp_count(text, F.lit(WORD)) / LEAST_EXPONENT)).otherwise(0))
    long = F.col(lags) > LAGS
    short = placed.filter(~F.coalesce(long, F.lit(False))).drop(lags)
    one = _finished(short, text, None, out)
    big = placed.filter(long)
    # The ranges' rows and the documents' are held together by id and digest; runs of repeated rows are the same set.
    digest, same = fresh("digest", [*rows.columns, lags]), [F.col(key).cast("string").alias("id"), F.sha2(text, 256).alias("digest")]
    ranges = big.select(*same, F.col(text).alias("text"), F.explode(F.sequence(F.lit(1), F.col(lags), F.lit(LAGS))).alias("low"))
    dealt = ranges.groupBy("id", "digest", "low").agg(F.first("text").alias("text"))
    found = arrow_map(dealt, _ranges, f"id string, digest string, runs {_SCHEMA}")
    whole = materialise(found.groupBy("id", "digest").agg(F.flatten(F.collect_list("runs")).alias("runs")), "periodic-runs")
    there = big.drop(lags).withColumn(digest, F.sha2(text, 256)).alias("docs")
    joined = there.join(whole.withColumnsRenamed({"id": low, "digest": lags, "runs": out}), F.col(f"docs.{key}").cast("string").eqNullSafe(F.col(low)) & (F.col(f"docs.{digest}") == F.col(lags)), "left").drop(low, lags, digest)
    return one.unionByName(_finished(joined, text, out, out))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = numbered(_WORDS.findall(batch.column("text")[i].as_py()))
            low = batch.column("low")[i].as_py()
            runs = [dict(zip(("start", "length", "period"), r)) for r in stretches(ids, low, low + LAGS - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1), batch.column("digest").slice(i, 1), pa.array([runs], _RUNS)], ["id", "digest", "runs"])


def _finished(rows: DataFrame, text: str, runs: str | None, out: str) -> DataFrame:
    """rows with the result; the stretches are in the column runs, or found here."""

    def one(value: str | None, known: list[dict] | None) -> dict:
        words = _WORDS.findall(value or "")
        if runs is None:
            given = stretches(numbered(words), 1, LAGS) if len(words) >= LEAST_WORDS else []
        else:
            given = [(r["start"], r["length"], r["period"]) for r in known or []]
        best = smallest(given)
        return {"n_words": len(words), "runs": [dict(zip(("start", "length", "period"), r)) for r in best], "collapsed": collapsed(words, best)}

    kind = pa.struct([("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])
    kept = [c for c in rows.columns if c != runs]
    value, known = fresh("text", rows.columns), fresh("known", rows.columns)

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(kept))]
            texts, given = batch.column(len(kept)), batch.column(len(kept) + 1)
            for a in range(0, batch.num_rows, ROWS):
                made = pa.array([one(t.as_py(), k.as_py()) for t, k in zip(texts.slice(a, ROWS), given.slice(a, ROWS))], kind)
                yield pa.RecordBatch.from_arrays([*[c.slice(a, ROWS) for c in columns], made], names=[*kept, out])

    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(out, T.StructType.fromDDL(f"n_words bigint, runs {_SCHEMA}, collapsed string"))])
    asked = rows.select(*kept, F.col(text).alias(value), (F.col(runs) if runs else F.lit(None).cast(_SCHEMA)).alias(known))
    return arrow_map(asked, result, schema)
