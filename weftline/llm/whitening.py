"""Operator 11: whitening of embeddings by an exact scatter matrix.

Entries become whole numbers. Each task multiplies its vectors as residues of several primes, in blocks so small that
double-precision products of residues are exact; Spark adds the residues, and Chinese remaindering gives every sum of
products as the whole number it is, however far the entries lie from zero. The covariance is one division of whole
numbers, rounded once. Its eigenvectors are found in double precision twice: eigh of the covariance, then eigh of the
covariance as those vectors see it (in extended precision), which mends what the first pass left in small eigenvalues.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry give no row. Vectors of different
lengths are different spaces, each whitened by itself; empty vectors have no component. An entry whose whole number
leaves 62 bits takes the nearest that does not. Repeated vectors count once in the fit and give equal results; an empty
table gives no row. A component without variance has null values and shares; deviations beyond 38 digits are null.
Other columns stay as they are, also those with the names of the results, which get underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, fresh, materialise

#: x = floor(SCALE * c) + OFFSET, in the limits of LARGEST; OFFSET is also what sums are taken about.
SCALE, OFFSET, LARGEST = 64, 1_000_000, 1 << 62
#: Vectors a product takes at once, and the bits of a prime: BLOCK * (2**BITS / 2)**2 stays under 2**53.
BLOCK, BITS = 4096, 21
#: A component with a smaller share of the variance has none: it is what rounding leaves.
LEAST_SHARE = 1e-12


def primes(bound: int) -> list[int]:
    """The largest primes below 2**BITS, so many that their product exceeds twice bound, and two at least."""
    found, n = [], 1 << BITS
    while len(found) < 2 or prod(found) <= 2 * bound:
        n -= 1
        if all(n % d for d in range(2, int(n**0.5) + 1)):
            found.append(n)
    return found


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The whole number nearest to zero that leaves these residues."""
    whole = prod(moduli)
    x = sum(r * (whole // p) * pow(whole // p, -1, p) for r, p in zip(residues, moduli)) % whole
    return x - whole if 2 * x > whole else x


def whole(vector: Column) -> Column:
    """The vector's entries as whole numbers; null if it is null or an entry is null or not finite."""
    good = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    at = lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)) + OFFSET
    return F.when(good, F.transform(vector, at))


@dataclass
class Space:
    """What is known of the vectors of one length; total is the sum of x - OFFSET over the fit list."""

    n: int
    total: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    def deviation(self, y: np.ndarray) -> pa.Array:
        """The sum over entries of (n * x - S)^2 for each row of y = x - OFFSET, exact, as text."""
        most = max([abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))])
        reach = self.n * most + max(map(abs, self.total), default=0)
        if len(self.total) * reach * reach < 1 << 63:
            return pa.array(((y * self.n - np.array(self.total, np.int64)) ** 2).sum(1)).cast(pa.string())
        return pa.array([str(sum((self.n * v - t) ** 2 for v, t in zip(row, self.total))) for row in y.tolist()])

    def project(self, y: np.ndarray) -> np.ndarray:
        """The rows of y, centred, on the axes, over the roots of the eigenvalues; NaN where there is no variance."""
        centred = y - np.array([t / self.n for t in self.total])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, centred @ self.axes / np.sqrt(self.values), np.nan)


def _matrices(batch: pa.RecordBatch, column: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, y) for each length of vectors in a batch, with y = x - OFFSET."""
    lists = batch.column(column)
    sizes = np.asarray(lists.value_lengths())
    starts = np.asarray(lists.offsets)[:-1]
    flat = np.asarray(lists.values)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[starts[rows, None] + np.arange(size)] - OFFSET


def _scatter(batches: Iterator[pa.RecordBatch], moduli: list[int]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(length, for each prime the residues of the sums of products of (1, y) with itself) of a task's vectors."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for _, y in _matrices(batch):
            z = np.concatenate([np.ones((len(y), 1), np.int64), y], 1)
            held = sums.setdefault(y.shape[1], [np.zeros((z.shape[1], z.shape[1]), np.int64) for _ in moduli])
            for a in range(0, len(z), BLOCK):
                for p, total in zip(moduli, held):
                    r = z[a : a + BLOCK] % p
                    r = np.where(r > p // 2, r - p, r).astype(np.float64)
                    total += (r.T @ r).astype(np.int64) % p
                    total %= p
    yield from sums.items()


def _eigen(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The count largest eigenvalues and their unit eigenvectors as columns, the largest entry of each positive."""
    first = np.linalg.eigh(v)[1].astype(np.longdouble)
    seen = first.T @ v.astype(np.longdouble) @ first
    axes = first @ np.linalg.eigh(((seen + seen.T) / 2).astype(np.float64))[1].astype(np.longdouble)
    axes /= np.sqrt((axes * axes).sum(0))
    values = ((v.astype(np.longdouble) @ axes) * axes).sum(0).astype(np.float64)
    order = np.argsort(-values, kind="stable")[:count]
    axes = axes[:, order].astype(np.float64)
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])]) if axes.size else np.zeros(0)
    return np.where(values[order] > LEAST_SHARE * np.trace(v), values[order], 0.0), axes * signs


def fit(vectors: DataFrame, components: int) -> dict[int, Space]:
    """A Space for each length of vectors (one column of whole numbers, every vector once)."""
    name = vectors.columns[0]
    sizes = vectors.groupBy(F.size(name).alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform(name, lambda x: F.abs(x - OFFSET)))).alias("most")).collect()  # one row a length
    if not sizes:
        return {}
    moduli = primes(max(r.n for r in sizes) * max(1, *[r.most or 0 for r in sizes]) ** 2)
    names = [f"r{i}" for i in range(len(moduli))]

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, sums in _scatter(batches, moduli):
            i, j = np.triu_indices(d + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), *[pa.array(s[i, j]) for s in sums]], ["d", "i", "j", *names])

    parts = arrow_map(vectors, scatter, "d long, i long, j long, " + ", ".join(f"{n} long" for n in names))
    found: dict[int, dict[tuple[int, int], int]] = {}
    for r in parts.groupBy("d", "i", "j").agg(*[F.sum(n).alias(n) for n in names]).collect():  # (d + 1) * (d + 2) / 2 sums
        found.setdefault(r.d, {})[r.i, r.j] = remaindered([r[n] for n in names], moduli)
    spaces = {}
    for d, sums in found.items():
        n, total = sums[0, 0], [sums[0, j] for j in range(1, d + 1)]
        v = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                v[i, j] = v[j, i] = (n * sums[i + 1, j + 1] - total[i] * total[j]) / (n * n)
        values, axes = _eigen(v, components) if d else (np.zeros(0), np.zeros((0, 0)))
        spaces[d] = Space(n, total, axes, values, sum(n * sums[i + 1, i + 1] - total[i] ** 2 for i in range(d)) / (n * n))
    for d, error in _identity_errors(vectors, spaces).items():
        spaces[d].identity_error = error
    return spaces


def _identity_errors(vectors: DataFrame, spaces: dict[int, Space]) -> dict[int, float]:
    """For each length the largest entry of the whitened vectors' covariance minus the identity, over components with variance.

    A task's sums are about its own means; the tasks' means join them afterwards.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, y in _matrices(batch):
                space = spaces[y.shape[1]]
                w = space.project(y)[:, space.values > 0]
                mean = w.mean(0)
                c = (w - mean).T @ (w - mean)
                i, j = np.triu_indices(w.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), y.shape[1])), pa.array(i), pa.array(j), pa.array(c[i, j] + len(w) * mean[i] * mean[j]), pa.array(len(w) * mean[i]), pa.array(len(w) * mean[j])], ["d", "i", "j", "c", "a", "b"])

    parts = arrow_map(vectors, sums, "d long, i long, j long, c double, a double, b double")
    errors: dict[int, float] = {}
    for r in parts.groupBy("d", "i", "j").agg(*[F.sum(x).alias(x) for x in "cab"]).collect():
        n = spaces[r.d].n
        errors[r.d] = max(errors.get(r.d, 0.0), abs(r.c / n - r.a / n * (r.b / n) - (r.i == r.j)))
    return errors


def whiten(rows: DataFrame, vector: str = "embedding", components: int = 16) -> DataFrame:
    """The rows with a usable vector, and a struct whitening(n, deviation, identity_error, values, explained) as last column.

    values and explained are arrays with an entry for each of the first components by falling eigenvalue.
    """
    x, out = fresh("x", rows.columns), fresh("whitening", rows.columns)
    kept = rows.withColumn(x, whole(F.col(vector))).filter(F.col(x).isNotNull())
    spaces = fit(materialise(kept.select(x).distinct(), "vectors"), components)
    kind = "n bigint, deviation string, identity_error double, values array<double>, explained array<double>"

    @F.arrow_udf(kind)
    def whitened(vectors: pa.Array) -> pa.Array:
        made, order = [], []
        for at, y in _matrices(pa.RecordBatch.from_arrays([vectors], ["x"])):
            space, w = spaces[y.shape[1]], spaces[y.shape[1]].project(y)
            ends = pa.array(np.arange(len(y) + 1) * w.shape[1], pa.int32())
            share = np.where(space.values > 0, space.values / (space.trace or 1), np.nan)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1), from_pandas=True, type=pa.float64())) for x in (w, np.tile(share, (len(y), 1)))]
            made.append(pa.StructArray.from_arrays([pa.array(np.full(len(y), space.n)), space.deviation(y), pa.array([space.identity_error] * len(y), pa.float64()), *lists], ["n", "deviation", "identity_error", "values", "explained"]))
            order.append(at)
        return pa.concat_arrays(made).take(pa.array(np.argsort(np.concatenate(order))))

    found = kept.withColumn(out, whitened(x))
    exact = F.expr(f"try_cast(`{out}`.deviation as decimal(38, 0))")
    return found.withColumn(out, F.col(out).withField("deviation", exact)).drop(x)
