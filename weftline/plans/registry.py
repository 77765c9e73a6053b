"""How queries are registered: a Spark function and, beside it, the same question in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: White space as RE2 spells it (functions.text.SPACE).
_SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The namespace in which the queries name their worlds.
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
RUN = "run-0001"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def sql_uuid5(namespace: str, name: str) -> str:
    d = f"sha1(unhex(replace({namespace}, '-', '')) || encode({name}))"
    return f"(SELECT substr(sha_, 1, 8) || '-' || substr(sha_, 9, 4) || '-5' || substr(sha_, 14, 3) || '-' || substr('89ab', (('0x' || substr(sha_, 17, 1))::INT % 4) + 1, 1) || substr(sha_, 18, 3) || '-' || substr(sha_, 21, 12) FROM (SELECT {d} AS sha_))"


def sql_world(x: str) -> str:
    return sql_uuid5(f"'{NAMESPACE}'", f"'world:' || {x}")
