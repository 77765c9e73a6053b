"""TOP1, TOP3, FLT1: exact cosine search that skips what cannot reach the k-th score.

Points lie in cells around a few of them, the centres, and a cell's files are sorted by scope and by angle to the centre. The
angle between vectors obeys the triangle inequality, so a point at angle a of its centre, which is at angle t of a
query, is at angle |t - a| or more of the query. A search reads each query's most promising cells until they hold k
points, which gives a k-th score; then, of the other cells, only those parts whose bound reaches it. Nothing is
approximate: scores, ties and ranks are those of a whole scan.

Defined cases: null vectors are not held, as no score of theirs passes a minimum. Vectors that are zero, not finite or of
another length than the centres have no angle; they are a cell of their own, which every search reads. A query of that kind
reads all cells. An index of no points has no centres and finds nothing. k below 1 finds nothing. Points added twice are held twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stored import kept
from .vectors import DIGITS, cosine_of, dot

#: The cell of points without an angle.
NO_ANGLE = -1
#: Slack of bounds: scores are rounded to DIGITS digits, angles are doubles.
SCORE_SLACK, ANGLE_SLACK = 2 * 10.0**-DIGITS, 1e-6
#: (query, cell) pairs up to which they are broadcast to the points; more are joined by cell.
BROADCAST_PAIRS = 200_000


def angles(vectors: pd.Series, centres: np.ndarray) -> np.ndarray:
    """The angles of each vector to each centre (unit rows); NaN for vectors that have none."""
    out = np.full((len(vectors), len(centres)), np.nan)
    sized = [i for i, v in enumerate(vectors) if v is not None and len(v) == centres.shape[1] and not any(x is None for x in v)]
    if sized:
        held = np.array([vectors.iloc[i] for i in sized], float)
        with np.errstate(all="ignore"):
            norms = np.sqrt((held * held).sum(axis=1))
            good = np.isfinite(norms) & (norms > 0)
            units = held[good] / norms[good, None]
        out[np.array(sized)[good]] = np.arccos(np.clip(units @ centres.T, -1.0, 1.0))
    return out


class CellIndex:
    """Points (point_id, scope, vector) at path. Each addition is new files of the cells; no file is written again."""

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray, kinds: tuple[str, str, str]):
        """kinds: the types of point_id, scope and vector."""
        self.spark, self.path, self.centres, self.kinds = spark, path, centres, kinds

    @classmethod
    def build(cls, points: DataFrame, path: str, cells: int = 64) -> CellIndex:
        """An index of all points. At most cells of them, the first by a hash of their ids, are centres and come to the driver."""
        rows = points.select("point_id", "scope", "vector")
        usable = rows.filter(F.size("vector") > 0).filter(~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double"))))
        drawn = usable.orderBy(F.xxhash64("point_id"), "point_id").limit(cells).select("vector").collect()
        found = [np.array(r.vector, float) for r in drawn]
        length = max((len(v) for v in found), default=1)
        units = [v / np.linalg.norm(v) for v in found if len(v) == length and np.isfinite(v).all() and np.linalg.norm(v) > 0]
        centres = np.unique(np.array(units), axis=0) if units else np.zeros((0, length))
        index = cls(points.sparkSession, path, centres, tuple(points.schema[c].dataType.simpleString() for c in ("point_id", "scope", "vector")))
        index.add(rows)
        return index

    def add(self, points: DataFrame) -> None:
        """Each point goes to its nearest centre's cell, with its angle and norm."""
        centres = self.centres

        @F.pandas_udf("cell int, angle double")
        def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for vectors in batches:
                found = angles(vectors, centres)
                known = ~np.isnan(found).any(axis=1) if len(centres) else np.zeros(len(vectors), bool)
                cell, angle = np.full(len(vectors), NO_ANGLE), np.full(len(vectors), np.nan)
                if known.any():
                    cell[known] = found[known].argmin(axis=1)
                    angle[known] = found[known].min(axis=1)
                yield pd.DataFrame({"cell": cell, "angle": angle})

        rows = points.filter("vector is not null").select("point_id", "scope", "vector", placed("vector").alias("__at"))
        whole = rows.select("point_id", "scope", "vector", F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("norm"), F.nanvl("__at.angle", F.lit(None).cast("double")).alias("angle"), F.col("__at.cell").alias("cell"))
        # A range of (cell, scope, angle) a task: a cell with most of the points is many tasks and files.
        whole.repartitionByRange("cell", "scope", "angle").sortWithinPartitions("cell", "scope", "angle").write.partitionBy("cell").mode("append").parquet(f"{self.path}/points")

    def points(self) -> DataFrame:
        key, scope, vector = self.kinds
        return self.spark.read.schema(f"point_id {key}, scope {scope}, vector {vector}, norm double, angle double, cell int").parquet(f"{self.path}/points")

    def summary(self) -> DataFrame:
        """(scope, cell, n, least, most): from the columns of angles alone."""
        return self.points().groupBy("scope", "cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"))

    def bounds(self, queries: DataFrame) -> DataFrame:
        """(query_id, scope, cell, n, theta, upper): the best score that each cell can offer to each query of its scope."""
        centres = self.centres

        @F.pandas_udf("array<double>")
        def thetas(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for vectors in batches:
                yield pd.Series([row.tolist() for row in angles(vectors, centres)])

        asked = queries.select("query_id", "scope", thetas("query_vector").alias("__thetas"))
        pairs = asked.join(self.summary(), "scope")
        theta = F.when(F.col("cell") >= 0, F.nanvl(F.element_at("__thetas", F.greatest(F.col("cell"), F.lit(0)) + 1), F.lit(None).cast("double")))
        gap = F.greatest(F.lit(0.0), F.col("theta") - F.col("most"), F.col("least") - F.col("theta"))
        return pairs.select("query_id", "scope", "cell", "n", theta.alias("theta"), "least", "most").withColumn("upper", F.coalesce(F.when(F.col("theta").isNotNull(), F.cos(gap)), F.lit(1.0))).drop("least", "most")

    def search(self, queries: DataFrame, k: int, minimum: float, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(query_id, point_id, score, rank): for queries (query_id, scope, query_vector) the k best points of their scope at or above minimum."""
        keep = keep or kept
        if k < 1:
            return self._scored(self.points().filter("false"), queries, self.bounds(queries).filter("false"), minimum).withColumn("rank", F.lit(1))
        by_hope = Window.partitionBy("query_id").orderBy(F.desc("upper"), F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
        pairs = keep(self.bounds(queries).withColumn("first", F.coalesce(F.sum("n").over(by_hope), F.lit(0)) < k))
        first = keep(_best(self._read(queries, pairs.filter("first"), minimum), k))
        reached = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
        floor = F.greatest(F.lit(float(minimum)), F.coalesce("reached", F.lit(float(minimum))))
        left = pairs.filter("not first").join(reached, "query_id", "left").withColumn("floor", floor).filter(F.col("upper") >= F.col("floor") - SCORE_SLACK)
        around = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("floor") - SCORE_SLACK))) + ANGLE_SLACK
        second = self._read(queries, keep(left.withColumns({"low": F.col("theta") - around, "high": F.col("theta") + around})), minimum)
        return _best(first.drop("rank").unionByName(second), k)

    def wanted(self, pairs: DataFrame) -> DataFrame:
        """The points of pairs' cells, within the least and greatest angle that any query wants of them: what a search reads.

        The cells' numbers, at most one a centre, come to the driver, so that other cells' files and other angles' row groups are skipped.
        """
        rows = self.points()
        if "low" not in pairs.columns:
            return rows.filter(F.col("cell").isin([r.cell for r in pairs.select("cell").distinct().collect()]))
        # A query without an angle wants a cell as a whole.
        spans = pairs.groupBy("cell").agg(F.min(F.coalesce("low", F.lit(-1.0))).alias("low"), F.max(F.coalesce("high", F.lit(4.0))).alias("high")).collect()
        part = F.lit(False)
        for r in spans:
            here = F.col("cell") == r.cell
            part = part | (here if r.cell == NO_ANGLE or (r.low <= 0 and r.high >= 3.2) else here & F.col("angle").between(r.low, r.high))
        return rows.filter(part)

    def _read(self, queries: DataFrame, pairs: DataFrame, minimum: float) -> DataFrame:
        return self._scored(self.wanted(pairs), queries, pairs, minimum)

    def _scored(self, points: DataFrame, queries: DataFrame, pairs: DataFrame, minimum: float) -> DataFrame:
        norm = F.sqrt(dot(F.col("query_vector"), F.col("query_vector"))).alias("query_norm")
        asked = pairs.join(queries.select("query_id", "query_vector", norm), "query_id")
        if pairs.count() <= BROADCAST_PAIRS:
            asked = F.broadcast(asked)
        found = points.join(asked.drop("n", "upper", "first", "floor", "reached"), ["scope", "cell"])
        if "low" in pairs.columns:
            found = found.filter(F.col("low").isNull() | F.col("angle").isNull() | F.col("angle").between(F.col("low"), F.col("high")))
        scored = found.withColumn("score", cosine_of(F.col("vector"), F.col("query_vector"), F.col("norm") * F.col("query_norm")))
        return scored.filter(F.col("score") >= minimum).select("query_id", "point_id", "score")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
