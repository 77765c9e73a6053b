"""Operator 10: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of lexicon words, of words the training rows make suspect and of letters-only
forms of obfuscated words, how near second-person words stand to lexicon words, shares of capitals, punctuation, digits
and stretched letters, rates of obfuscated words (letters with digits or signs inside), and lengths. Trees of logistic
loss are grown on quantile bins; three quarters of the training rows grow them, the rest calibrate by
pool-adjacent-violators.

Training rows: labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most TRAINING_ROWS of them, the first by
md5 of the id: a bounded sample, which alone reaches the driver. Scoring covers every row.

Defined cases: null text is the empty text and gets a score like any other. Labels with null ids or null marks are
ignored; an id with several marks counts as toxic if any is 1. Without labels of both kinds every score is the share
of toxic training rows (0 without any). Repeated rows get equal scores. Extra columns are ignored; a null id is scored
and not held out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, give_back, materialise

TRAINING_ROWS = 12_000
#: Share of the toxic training rows in which a suspect word or beginning stands at least.
LEAST_SHARE = 0.01
#: Toxic rows in which it stands at least, and toxic rows that a calibration fold needs.
LEAST_ROWS, LEAST_FOLD = 10, 20
#: Insults and slurs against persons in four languages; a parameter of features().
LEXICON = frozenset(
    "idiot idiots moron morons scum loser losers clown clowns stupid worthless disgusting pathetic trash garbage dumb fool fools "
    "imbecile jerk creep freak pig pigs rat vermin filth filthy hate ugly useless retard bastard bitch damn crap kill "
    "idioten dumm dummkopf abschaum versager trottel arschloch widerlich müll "
    "imbécile crétin débile ordure minable dégoûtant nul connard salaud "
    "imbécil tonto basura escoria estúpido inútil asqueroso perdedor payaso patético".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes tus".split())
#: Digits and signs that stand for letters in obfuscated words.
LETTERS = str.maketrans("013457@$!", "oleastasi")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "¡¿«»“”„’…"
_INSIDE = re.compile(r"(?i)[a-z][0-9@$!*]+[a-z]")
_STRETCHED = re.compile(r"([A-Za-z!?.])\1\1")
_CAPITALS, _DIGITS, _SIGNS = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[!-/:-@\[-`{-~]")
NAMES = ("lexicon", "lexicon_count", "lexicon_log", "suspect", "suspect_count", "near_you", "nearest_you", "second_person", "capitals", "capital_words", "punctuation", "exclaims", "digits", "obfuscated", "obfuscated_lexicon", "stretched", "words_log", "word_length")


def features(text: str, suspects: frozenset[str] = frozenset(), lexicon: frozenset[str] = LEXICON) -> list[float]:
    """The values of NAMES for a text."""
    raw = _WORD.findall(text)
    n = max(1, len(raw))
    bare = [w.strip(_EDGE) for w in text.lower().split()] if raw else []
    hits = [i for i, w in enumerate(bare) if w in lexicon]
    you = [i for i, w in enumerate(bare) if w in SECOND_PERSON]
    hidden = [w for w in raw if not w.isalpha() and _INSIDE.search(w)]
    unmasked = sum(w.lower().translate(LETTERS).strip(_EDGE) in lexicon for w in hidden)
    suspicious = sum(w in suspects or w[:4] + "*" in suspects or w[:5] + "*" in suspects for w in bare) if suspects else 0
    nearest, near = 50, 0
    if hits and you:
        at = np.searchsorted(you, hits)
        held = np.array(you)
        gap = np.minimum(np.abs(held[np.minimum(at, len(you) - 1)] - hits), np.abs(held[np.maximum(at - 1, 0)] - hits))
        nearest, near = int(min(50, gap.min())), int((gap <= 5).sum())
    size = max(1, len(text))
    return [
        len(hits) / n, float(len(hits)), math.log1p(len(hits)), suspicious / n, float(suspicious), near / n, float(nearest), len(you) / n,
        len(_CAPITALS.findall(text)) / size, sum(w.isupper() and len(w) > 2 for w in raw) / n, len(_SIGNS.findall(text)) / size, text.count("!") / size,
        len(_DIGITS.findall(text)) / size, len(hidden) / n, float(unmasked), len(_STRETCHED.findall(text)) / n, math.log1p(len(raw)), size / n,
    ]


def held_out(key) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 0


@dataclass
class Model:
    """Boosted trees in arrays of equal depth, and a step function that calibrates their sum."""

    suspects: frozenset[str] = frozenset()
    start: float = 0.0
    #: For each tree (feature, threshold) of the inner nodes by level, and the leaves' values.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
    constant: float | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, limit, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while len(feature) > 0:
                inner = node < len(feature)
                if not inner.all():
                    break
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.margin(x), *self.steps), 0.0, 1.0)

    def score_texts(self, texts: list[str]) -> np.ndarray:
        found = [features(x, self.suspects) for x in texts]
        return self.score(np.array(found, float).reshape(len(texts), len(NAMES)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares rising function of x, by pooling adjacent violators."""
    values, where = np.unique(x, return_inverse=True)
    weight = np.bincount(where).astype(float)
    mean = np.bincount(where, y) / weight
    pools: list[list[float]] = []  # mean, weight, first x, last x
    for v, m, w in zip(values.tolist(), mean.tolist(), weight.tolist()):
        pools.append([m, w, v, v])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    return np.array([e for p in pools for e in (p[2], p[3])]), np.array([p[0] for p in pools for _ in range(2)])


def _grow(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, leaf value) of one complete tree; a node that nothing splits sends all rows left."""
    n, width = binned.shape
    inner = 2**depth - 1
    feature, limit, node = np.zeros(inner, np.int64), np.full(inner, bins, np.int64), np.zeros(n, np.int64)
    for level in range(depth):
        first, count = 2**level - 1, 2**level
        local = node - first
        best = np.full(count, 1e-6)
        for j in range(width):
            cell = local * bins + binned[:, j]
            g = np.bincount(cell, grad, count * bins).reshape(count, bins).cumsum(axis=1)
            h = np.bincount(cell, hess, count * bins).reshape(count, bins).cumsum(axis=1)
            tg, th = g[:, -1:], h[:, -1:]
            gain = g**2 / (h + 1) + (tg - g) ** 2 / (th - h + 1) - tg**2 / (th + 1)
            gain[(h < 2) | (th - h < 2)] = 0
            at = gain[:, :-1].argmax(axis=1)
            top = gain[np.arange(count), at]
            better = top > best
            best[better] = top[better]
            feature[first : first + count][better], limit[first : first + count][better] = j, at[better]
        node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > limit[node])
    leaf = node - inner
    return feature, limit, -np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + 1)


def marks_of(text: str) -> set[str]:
    """What may make a text suspect: its words, and beginnings of four and five letters, which have a star."""
    words = {w.strip(_EDGE) for w in text.lower().split()}
    return {w for w in words if w} | {w[:k] + "*" for w in words for k in (4, 5) if len(w) >= k}


def suspects_of(counts: list[tuple[str, int, int]], bad: int, good: int) -> frozenset[str]:
    """Of (mark, toxic rows, other rows) those that speak for toxic rows, by smoothed log odds over rows."""
    odds = lambda t, o: math.log((t + 0.5) / (bad + 1)) - math.log((o + 0.5) / (good + 1))
    return frozenset(w for w, t, o in counts if t >= max(LEAST_ROWS, LEAST_SHARE * bad) and odds(t, o) > 2)


def grows(key: str) -> bool:
    """Whether a training row grows trees (three quarters) or calibrates them."""
    return zlib.crc32(b"fold" + key.encode()) % 4 != 0


def fit(keys: list[str], x: np.ndarray, marks: np.ndarray, suspects: frozenset[str], rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64) -> Model:
    """A model from training rows' ids, features and marks of 0 or 1."""
    marks = np.asarray(marks, float)
    if not len(marks) or marks.min() == marks.max():
        return Model(constant=float(marks.mean()) if len(marks) else 0.0)
    grown = np.array([grows(k) for k in keys])
    if marks[~grown].sum() < LEAST_FOLD or len({*marks[~grown]}) < 2 or len({*marks[grown]}) < 2:
        grown[:] = True
    tx, ty = x[grown], marks[grown]
    cuts = [np.unique(np.quantile(tx[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(tx.shape[1])]
    # Rare counts hide above the last quantile; their own values split them.
    cuts = [np.unique(np.concatenate([c, np.unique(tx[:, j])[: bins // 4]])) for j, c in enumerate(cuts)]
    width = max(map(len, cuts)) + 1
    binned = np.stack([np.searchsorted(c, tx[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    model = Model(suspects, float(np.log(ty.mean() / (1 - ty.mean()))))
    margin = np.full(len(ty), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        feature, limit, value = _grow(binned, p - ty, p * (1 - p), depth, width)
        threshold = np.array([cuts[f][b] if b < len(cuts[f]) else np.inf for f, b in zip(feature, limit)])
        model.trees.append((feature, threshold, value * rate))
        margin = margin + Model(trees=model.trees[-1:]).margin(tx)
    held = grown if grown.all() else ~grown
    model.steps = isotonic(model.margin(x[held]), marks[held])
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "toxic", limit: int = TRAINING_ROWS) -> Model:
    """A model from at most limit labelled rows outside the held-out fifth; their features alone reach the driver."""
    named = labels.select(F.col(key).alias("id"), F.col(mark).alias("mark")).filter("id is not null and mark is not null")
    named = named.filter("crc32(cast(cast(id as string) as binary)) % 5 <> 0").groupBy("id").agg(F.max("mark").alias("mark"))
    chosen = named.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(limit)
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("mark").alias("mark"), F.min("text").alias("text"))
    rows = materialise(rows.select(F.col("id").cast("string").alias("id"), F.expr("cast(mark <> 0 as int)").alias("mark"), "text"), "toxicity-training")

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(w, m) for k, m, t in zip(*(c.to_pylist() for c in batch.columns)) if grows(k) for w in marks_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([m for _, m in found], pa.int32())], names=["word", "mark"])

    marks = rows.select("id", "mark").collect()
    bad = sum(r.mark for r in marks if grows(r.id))
    good = sum(1 - r.mark for r in marks if grows(r.id))
    least = max(LEAST_ROWS, LEAST_SHARE * bad)
    counted = arrow_map(rows, spelled, "word string, mark int").groupBy("word").agg(F.sum("mark").alias("bad"), F.sum(F.lit(1) - F.col("mark")).alias("good")).filter(F.col("bad") >= least)
    suspects = suspects_of([tuple(r) for r in counted.toLocalIterator()], bad, good)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(t, suspects) for t in batch.column(2).to_pylist()], pa.list_(pa.float64()))], names=["id", "mark", "x"])

    got = sorted(arrow_map(rows, measured, "id string, mark int, x array<double>").collect())
    model = fit([r.id for r in got], np.array([r.x for r in got]).reshape(len(got), len(NAMES)), np.array([r.mark for r in got]), suspects)
    del got, marks
    give_back()
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) for each row of docs."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score_texts(batch.column(1).to_pylist())
            out = [held_out(k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], names=[key, "held_out", "score", "predicted"])

    return arrow_map(docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")), run, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs whose score is below one half, with all columns as they are."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score_texts([x or "" for x in batch.column(place).to_pylist()]) < 0.5))

    return arrow_map(docs, run, docs.schema)
