"""ST1-ST6, UDF1-UDF4: calls to injected models over pending rows, with retry budgets.

Providers are plain functions that executors call; each returns an outcome dict. Rows are independent, so a batch is one
map over partitions, whose number bounds the calls in flight, and its result is materialised before anything reads it
twice, because a call must not be repeated by a recomputation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.status import RETRIES, after_attempt
from .extraction import response_value

#: text -> {"vector": [...]} or {"code": str, "retryable": bool, "rate_limited": bool}
Embedder = Callable[[str], dict[str, Any]]
#: prompt -> {"text": str} or {"code": str, "retryable": bool, "rate_limited": bool}
Extractor = Callable[[str], dict[str, Any]]
Materialise = Callable[[DataFrame], DataFrame]
#: UDF3: text -> its tokens in the model's own count
TokenCounter = Callable[[str], int]

_OUTCOME = "vector array<float>, code string, retryable boolean, rate_limited boolean"


def called(embed: Embedder, text: str) -> dict[str, Any]:
    """One call; an exception or an empty vector is that row's failure."""
    try:
        found = embed(text)
    except Exception as e:  # noqa: BLE001  a provider may raise anything
        return {"code": type(e).__name__, "retryable": True}
    if "vector" in found and not len(found["vector"] or ()):
        return {"code": "EMBEDDING_EMPTY", "retryable": True}
    return found


def guarded(call: Callable[[str], dict[str, Any]], count: TokenCounter | None, limit: int | None, needs_limit: bool = False) -> Callable[[str], dict[str, Any]]:
    """FLT13 before each call: a text that cannot be counted or is too large is never sent; without a counter nothing is asked."""
    if count is None:
        return call

    def checked(text: str) -> dict[str, Any]:
        if limit is None:
            return {"code": "LIMIT_MISSING", "retryable": False} if needs_limit else call(text)
        try:
            tokens = count(text)
        except Exception:  # noqa: BLE001  a counter may raise anything
            return {"code": "COUNT_FAILED", "retryable": True}
        return {"code": "TOO_LARGE", "retryable": False} if tokens > limit else call(text)

    return checked


def embed_batch(pending: DataFrame, key: str, text: str, embed: Embedder, in_flight: int) -> DataFrame:
    """ST1, UDF1: (key, vector or code, retryable, rate_limited) of one attempt for each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [called(embed, t) for t in frame[text]]
            yield pd.DataFrame({
                key: frame[key], "vector": [x.get("vector") for x in found], "code": [x.get("code") for x in found],
                "retryable": [bool(x.get("retryable", False)) for x in found], "rate_limited": [bool(x.get("rate_limited", False)) for x in found],
            })

    kind = pending.schema[key].dataType.simpleString()
    return pending.select(key, text).repartition(in_flight).mapInPandas(run, f"{key} {kind}, {_OUTCOME}")


def embed_all(states: DataFrame, key: str, text: str, embed: Embedder, keep: Materialise, in_flight: int = 8, rounds: int = 2 * RETRIES) -> tuple[DataFrame, DataFrame]:
    """ST1-ST3: (states, vectors) after rounds of attempts at what is pending, until nothing is or rounds end.

    states: (key, text, status, retry_count, last_error_code). Rate limits spend no retry but do spend a round, so the
    loop ends; what is left stays pending for the next run.
    """
    vectors = None
    for _ in range(rounds):
        pending = states.filter("status = 'pending'")
        if not pending.limit(1).count():
            break
        found = keep(embed_batch(pending, key, text, embed, in_flight))
        done = found.filter("code is null").select(key, "vector")
        vectors = done if vectors is None else vectors.unionByName(done)
        state, spent = after_attempt(F.col("status"), F.col("retry_count"), F.coalesce("rate_limited", F.lit(False)), F.coalesce("retryable", F.lit(False)))
        joined = states.join(found.withColumn("__asked", F.lit(True)), key, "left")
        new = F.when(F.col("__asked").isNull(), F.col("status")).when(F.col("code").isNull(), "embedded").otherwise(state)
        tries = F.when(F.col("__asked").isNull() | F.col("code").isNull(), F.col("retry_count")).otherwise(spent)
        error = F.when(F.col("__asked").isNull(), F.col("last_error_code")).otherwise(F.col("code"))
        changed = {"__s": new, "__t": tries, "__e": error}
        states = keep(joined.withColumns(changed).select(*[F.col({"status": "__s", "retry_count": "__t", "last_error_code": "__e"}.get(c, c)).alias(c) for c in states.columns]))
    if vectors is None:
        vectors = states.filter("false").select(key, F.lit(None).cast("array<float>").alias("vector"))
    return states, vectors


def extract_chunks(chunks: DataFrame, keys: list[str], extract: Extractor, prompt: Callable[[str, str, str, list[str]], str], gleans: int = 1, in_flight: int = 8) -> DataFrame:
    """ST4-ST6, UDF2: (keys, pass_type, pass_number, response, code, instructions), one row a new pass of each chunk.

    chunks have overlap_text, chunk_text, instructions (of the chunk's first pass, which its gleans share) and earlier
    (the responses of its good passes; the next one follows them). Passes of a chunk are sequential, as a glean's prompt
    shows the earlier responses; chunks are independent. A pass has RETRIES attempts: an answer without its end mark, with
    bad JSON or with a bad schema spends one, as a failure does that can be retried; another failure ends the chunk. A rate
    limit spends none and ends the chunk for now.
    """
    names = [f"{c} {chunks.schema[c].dataType.simpleString()}" for c in keys]

    def asked(text: str) -> tuple[str | None, str | None]:
        code = None
        for _ in range(RETRIES):
            try:
                found = extract(text)
            except Exception as e:  # noqa: BLE001
                found = {"code": type(e).__name__, "retryable": True}
            code = found.get("code")
            if code is None:
                code = response_value(found.get("text") or "")[1]
                if code is None:
                    return found["text"], None
            elif found.get("rate_limited") or not found.get("retryable"):
                break
        return None, code

    def one(text: str, overlap: str, instructions: str, earlier: list[str]) -> Iterator[tuple]:
        for number in range(len(earlier), gleans + 1):
            response, code = asked(prompt(instructions, text, overlap, earlier))
            yield "glean" if number else "initial", number, response, code, instructions
            if code:
                return
            earlier = [*earlier, response]

    columns = ["chunk_text", "overlap_text", "instructions", "earlier"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*k, *p) for k, t, o, i, e in zip(frame[keys].itertuples(index=False, name=None), *(frame[c] for c in columns)) for p in one(t, o, i, list(e))]
            yield pd.DataFrame(rows, columns=[*keys, "pass_type", "pass_number", "response", "code", "instructions"])

    return chunks.select(*keys, *columns).repartition(in_flight).mapInPandas(run, ", ".join([*names, "pass_type string, pass_number int, response string, code string, instructions string"]))
