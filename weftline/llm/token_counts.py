"""Operator 6: token counts as delta-maintained rollups.

A store is a folder with two Parquet tables and marks: `changes` (one folder a batch: the sums that the batch added),
`totals` (one folder a version: additive totals by source, language and tokenizer version) and `commits` (one small file
a committed batch, named by the batch, which holds the version of the totals that includes it). A batch has rows (source,
lang, tokenizer, n_docs, n_tokens, n_chars): +1 inserts, -1 deletes, and a revised count is a delete of the old and an
insert of the new count. commit() adds the batch's sums to the last version's totals; a batch whose commit exists is left
alone, so a retry after any failure changes nothing twice: what an unfinished attempt wrote is overwritten or never read,
as no commit names it. Whether a batch is committed is one look at a name, and versions before the last but one are
dropped, so neither grows with the number of batches.

Counting itself runs the tokenizer over Arrow batches; only sums are shuffled, after map-side combination, so a hot
source costs a row a task.

Defined cases: null texts count as empty, null source and language are groups of their own, groups whose documents all
went keep no row, an empty batch commits with unchanged totals, and a total below zero raises ValueError before the
commit, as it shows deletes of rows that were never inserted. Rows that repeat count each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe

GROUPS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
_TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def counted(docs: DataFrame, tokenizer: str, path: str, pattern: str, text: str = "text", sign: Column | int = 1, also: tuple[str, ...] = ()) -> DataFrame:
    """The batch rows of docs (source, lang, text): signed counts of documents, tokens and characters, and the columns also."""
    s = sign if isinstance(sign, Column) else F.lit(sign)
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), *also, s.cast("long").alias("sign"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
    found = byte_bpe.count_tokens(rows, path, pattern, ["source", "lang", *also, "sign", "n_chars"])
    return found.select(*also, "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col("sign").alias("n_docs"), (F.col("sign") * F.col("n_tokens")).alias("n_tokens"), (F.col("sign") * F.col("n_chars")).alias("n_chars"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The batch that takes the counted rows old back and adds new."""
    return deleted(old).unionByName(new.select(*GROUPS, *SUMS))


def deleted(old: DataFrame) -> DataFrame:
    """The batch that takes the counted rows old back."""
    return old.select(*GROUPS, *[(-F.col(c)).alias(c) for c in SUMS])


class Rollup:
    """The totals in one store folder, of which one driver at a time commits."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _committed(self, mark: str) -> int | None:
        """The version that includes the batch of that mark, if it is committed."""
        place = self._path(f"{self.folder}/commits/{mark}")
        if not self._files.exists(place):
            return None
        return int(self.spark.read.text(place.toString()).first().value)

    def _versions(self) -> list[tuple[int, str]]:
        """(version, mark) of the committed versions that are kept, the last first: two, and what failed attempts left."""
        at = self._path(f"{self.folder}/totals")
        if not self._files.exists(at):
            return []
        names = [s.getPath().getName().split("-") for s in self._files.listStatus(at)]
        return [(int(v), mark) for v, mark in sorted(names, reverse=True) if self._committed(mark) == int(v)]

    def totals(self) -> DataFrame:
        """The totals of all committed batches."""
        done = self._versions()
        if not done:
            return self.spark.createDataFrame([], _TOTALS)
        return self.spark.read.schema(_TOTALS).parquet(f"{self.folder}/totals/{done[0][0]:08d}-{done[0][1]}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds changes under the name batch; False, and no work, if that batch is committed already."""
        mark = hashlib.sha256(batch.encode()).hexdigest()
        if self._committed(mark) is not None:
            return False
        done = self._versions()
        version = done[0][0] + 1 if done else 1
        sums = [F.sum(c).cast("long").alias(c) for c in SUMS]
        delta, to = f"{self.folder}/changes/{mark}", f"{self.folder}/totals/{version:08d}-{mark}"
        changes.groupBy(*GROUPS).agg(*sums).write.mode("overwrite").parquet(delta)
        both = self.totals().unionByName(self.spark.read.schema(_TOTALS).parquet(delta))
        after = both.groupBy(*GROUPS).agg(*sums).filter(" or ".join(f"{c} <> 0" for c in SUMS))
        after.coalesce(1).write.mode("overwrite").parquet(to)
        if self.spark.read.schema(_TOTALS).parquet(to).filter(" or ".join(f"{c} < 0" for c in SUMS)).limit(1).count():
            raise ValueError(f"batch {batch} takes back more than was counted")
        self._put(f"{self.folder}/commits/{mark}", str(version))
        for old, name in done[1:]:
            self._files.delete(self._path(f"{self.folder}/totals/{old:08d}-{name}"), True)
        return True

    def _put(self, name: str, line: str) -> None:
        """A file that is there whole or not at all: written beside its place and renamed to it, never over another."""
        draft, place = self._path(f"{self.folder}/drafts/{name.rpartition('/')[2]}"), self._path(name)
        self._files.mkdirs(place.getParent())
        out = self._files.create(draft, True)
        out.write(bytearray(line.encode()))
        out.close()
        if self._files.exists(place) or not self._files.rename(draft, place):
            raise RuntimeError(f"another driver has committed {name}")
