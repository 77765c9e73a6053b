"""SNK1-SNK3, SRC8, JN11, JN12, JN14: tables that change by key and cost what changes, not what they hold.

A table is a base and a few deltas, each a folder of Parquet files dealt by a hash of the key. A delta has the rows that
a commit put and marks for those that it took away; a read lets the last delta of a key win over the base. Deltas are
joined when they are many, and become a new base when they outweigh a part of the old one, so that all writes together
stay in proportion to the changes. What is live is said by numbered commit files, each put only if nobody else put that
number: a writer that lost a race, or whose lease was taken over, gets an error and its files go.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

#: A table has so many deltas at most before they are joined; they become a base beyond this part of its bytes and so many bytes.
DELTAS, PART, LEAST = 8, 0.5, 1 << 20
#: Commits whose files stay, for frames that were read before.
KEPT = 6
_GONE, _BUCKET = "__gone", "__bucket"


class CommitConflict(RuntimeError):
    """Another writer changed the table since it was read; nothing of this commit is left."""


class LeaseLost(RuntimeError):
    """Another driver works on this since; nothing of this commit is left."""


class Numbered:
    """A folder of numbered small texts; put() adds the next number or fails, whole in either case."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, jvm = folder.rstrip("/"), spark.sparkContext._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self._files.exists(self._path(self.folder)):
            return []
        return sorted(int(n) for s in self._files.listStatus(self._path(self.folder)) if (n := s.getPath().getName()).isdigit())

    def text(self, number: int) -> str:
        stream = self._files.open(self._path(f"{self.folder}/{number:012d}"))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def last(self) -> tuple[int, str | None]:
        found = self.numbers()
        return (found[-1], self.text(found[-1])) if found else (0, None)

    def put(self, number: int, text: str) -> bool:
        """False if the number is taken. The text is complete before its name is there: a hard link on a local disk, else a rename, which does not replace."""
        draft, place = self._path(f"{self.folder}/_{uuid.uuid4().hex}"), self._path(f"{self.folder}/{number:012d}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        try:
            if self._files.getScheme() == "file":
                local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    self._jvm.java.nio.file.Files.createLink(local(place), local(draft))
                except Exception as e:  # noqa: BLE001  the one exception that Py4J raises for all
                    if "FileAlreadyExists" in str(e):
                        return False
                    raise
                return True
            return not self._files.exists(place) and self._files.rename(draft, place)
        finally:
            self._files.delete(draft, False)

    def drop(self, number: int) -> None:
        self._files.delete(self._path(f"{self.folder}/{number:012d}"), False)


class Lease:
    """A right to write that the last who asked for it has; each grant has a greater token than those before."""

    def __init__(self, spark: SparkSession, folder: str):
        self._grants, self.token = Numbered(spark, folder), None

    def take(self) -> int:
        while True:
            token = self._grants.last()[0] + 1
            if self._grants.put(token, json.dumps({"token": token})):
                self.token = token
                for old in self._grants.numbers()[:-KEPT]:
                    self._grants.drop(old)
                return token

    def check(self) -> None:
        """Raises LeaseLost if another has taken the lease since."""
        if self.token is not None and self._grants.last()[0] != self.token:
            raise LeaseLost("WORLD_RUN_TAKEN_OVER")


class KeyedTable:
    """A table of one row a key. put, take away and replace commit at once or not at all."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 8, guard: Callable[[], None] | None = None):
        self.spark, self.folder, self.keys, self.buckets, self.guard = spark, folder.rstrip("/"), keys, buckets, guard
        self._log = Numbered(spark, f"{self.folder}/_log")
        self._seen: int | None = None

    def _entry(self) -> tuple[int, dict]:
        number, text = self._log.last()
        return number, json.loads(text) if text else {"base": None, "deltas": [], "bytes": {}, "schema": []}

    def version(self) -> int:
        return self._log.last()[0]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _struct(schema) -> StructType:
        return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def _part(self, path: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(StructType([*schema.fields]).add(_GONE, BooleanType()).add(_BUCKET, IntegerType())).parquet(f"{self.folder}/{path}")

    def _joined(self, deltas: list[DataFrame]) -> DataFrame:
        """The last row of each key, marks of removal included."""
        if len(deltas) == 1:
            return deltas[0]
        rest = [c for c in deltas[0].columns if c not in self.keys]
        every = reduce(DataFrame.unionByName, [d.withColumn("__n", F.lit(i)) for i, d in enumerate(deltas)])
        best = F.max_by(F.struct(*rest), "__n").alias("__row")
        return every.groupBy(*self.keys).agg(best).select(*self.keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*deltas[0].columns)

    def _merged(self, entry: dict, schema: StructType, within: Column | None = None) -> DataFrame:
        parts = [self._part(p, schema) for p in [entry["base"], *entry["deltas"]] if p]
        if within is not None:
            parts = [p.filter(within) for p in parts]
        if not parts:
            return self.spark.createDataFrame([], StructType([*schema.fields]).add(_GONE, BooleanType()).add(_BUCKET, IntegerType()))
        if not entry["base"]:
            return self._joined(parts)
        if not entry["deltas"]:
            return parts[0]
        last = self._joined(parts[1:])
        return parts[0].join(last.select(*self.keys), self.keys, "left_anti").select(*parts[0].columns).unionByName(last)

    def read(self, schema) -> DataFrame:
        """All rows as of now."""
        schema = self._struct(schema)
        self._seen, entry = self._entry()
        return self._merged(entry, schema).filter(f"not {_GONE}").select(*schema.names)

    def lookup(self, schema, keys: DataFrame, most: int = 1000) -> DataFrame:
        """JN14: the rows of keys, at most so many as most; only files of their buckets are read."""
        wanted = keys.select(*self.keys).distinct()
        found = wanted.select(self._bucket().alias("b")).distinct().limit(self.buckets).collect()
        schema = self._struct(schema)
        self._seen, entry = self._entry()
        within = F.col(_BUCKET).isin([r.b for r in found])
        return self._merged(entry, schema, within).filter(f"not {_GONE}").select(*schema.names).join(wanted, self.keys, "left_semi")

    def _write(self, rows: DataFrame) -> str:
        path = uuid.uuid4().hex
        try:
            placed = rows.withColumn(_BUCKET, self._bucket())
            dealt = placed.repartition(_BUCKET) if self.buckets > 1 else placed.coalesce(1)
            dealt.sortWithinPartitions(_BUCKET, *self.keys).write.partitionBy(_BUCKET).parquet(f"{self.folder}/{path}")
        except BaseException:
            self._remove(path)
            raise
        return path

    def _remove(self, path: str) -> None:
        files = self._log._files
        files.delete(self._log._path(f"{self.folder}/{path}"), True)

    def bytes(self, path: str) -> int:
        where = self._log._path(f"{self.folder}/{path}")
        return self._log._files.getContentSummary(where).getLength() if self._log._files.exists(where) else 0

    def _commit(self, entry: dict, new: str | None) -> int:
        """The next version, or an error that leaves nothing."""
        number = (self.version() if self._seen is None else self._seen) + 1
        try:
            if self.guard:
                self.guard()
            if not self._log.put(number, json.dumps(entry)):
                raise CommitConflict(f"{self.folder} has a version {number}")
        except BaseException:
            if new:
                self._remove(new)
            raise
        self._seen = number
        self._clear(number)
        return number

    def _clear(self, number: int) -> None:
        """Folders that only versions before the last few name go, and those versions."""
        old = [n for n in self._log.numbers() if n <= number - KEPT]
        live = {p for n in self._log.numbers() if n > number - KEPT for p in self._named(n)}
        for n in old:
            for p in self._named(n):
                if p not in live:
                    self._remove(p)
            self._log.drop(n)

    def _named(self, number: int) -> list[str]:
        entry = json.loads(self._log.text(number))
        return [p for p in [entry["base"], *entry["deltas"]] if p]

    def change(self, puts: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """Puts rows (one a key) and takes the rows of other keys away, in one commit."""
        parts = []
        if puts is not None:
            parts.append(puts.withColumn(_GONE, F.lit(False)))
        if gone is not None:
            parts.append(gone.select(*self.keys).distinct().withColumn(_GONE, F.lit(True)))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        new = self._write(rows)
        seen, entry = self._entry()
        self._seen = seen if self._seen is None else self._seen
        entry = {"base": entry["base"], "deltas": [*entry["deltas"], new], "bytes": {**entry["bytes"], new: self.bytes(new)}, "schema": self._fields(entry, rows)}
        number = self._commit(entry, new)
        weight = sum(entry["bytes"][p] for p in entry["deltas"])
        heavy = weight > max(LEAST, PART * entry["bytes"].get(entry["base"], 0))
        if heavy or len(entry["deltas"]) > DELTAS:
            self._compact(entry, heavy)
        return number

    @staticmethod
    def _fields(entry: dict, rows: DataFrame) -> list[dict]:
        """All columns that live parts have, as Spark writes fields."""
        known = {f["name"]: f for f in entry["schema"]}
        return list((known | {f.name: f.jsonValue() for f in rows.schema.fields if f.name not in (_GONE, _BUCKET)}).values())

    def _compact(self, entry: dict, whole: bool) -> None:
        """Deltas as one delta, or with the base as a new base."""
        schema = StructType.fromJson({"fields": entry["schema"]})
        if whole:
            new = self._write(self._merged(entry, schema).filter(f"not {_GONE}").drop(_BUCKET))
            made = {"base": new, "deltas": []}
        else:
            new = self._write(self._joined([self._part(p, schema) for p in entry["deltas"]]).drop(_BUCKET))
            made = {"base": entry["base"], "deltas": [new]}
        keep = {p: entry["bytes"][p] for p in [made["base"]] if p in entry["bytes"]}
        self._commit(made | {"bytes": {**keep, new: self.bytes(new)}, "schema": entry["schema"]}, new)

    def upsert(self, rows: DataFrame) -> int:
        return self.change(puts=rows)

    def delete(self, ids: DataFrame) -> int:
        return self.change(gone=ids)

    def replace(self, rows: DataFrame) -> int:
        """All rows anew."""
        if self._seen is None:
            self._seen = self.version()
        new = self._write(rows.withColumn(_GONE, F.lit(False)))
        return self._commit({"base": new, "deltas": [], "bytes": {new: self.bytes(new)}, "schema": self._fields({"schema": []}, rows)}, new)

    def live_bytes(self) -> int:
        return sum(self._entry()[1]["bytes"].values())

    def drop(self) -> None:
        """Removes the table."""
        self._log._files.delete(self._log._path(self.folder), True)
        self._seen = None
