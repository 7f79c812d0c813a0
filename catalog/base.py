"""Registration, table access, and the one place where result columns get name and type."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.adapters import ADAPTERS, BASE_TABLES, DEALT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPARK_TYPES = {"long": "bigint", "int": "int", "d": "double", "s": "string", "t": "timestamp_ntz", "b": "boolean"}
_DUCK_TYPES = {"long": "bigint", "int": "integer", "d": "double", "s": "varchar", "t": "timestamp", "b": "boolean"}


class Tables:
    """Given tables and the shapes derived from them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._seen = spark, folder.rstrip("/"), {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in BASE_TABLES:
                self._seen[name] = self.spark.read.parquet(self.path(name))
            elif name in DEALT:
                source, most, keys = DEALT[name]
                rows = self(source)
                tasks = -(-rows.count() // most)
                self._seen[name] = rows.repartition(tasks, *keys) if tasks > 1 else rows
            else:
                sql = ADAPTERS[name]["spark"]
                self._seen[name] = self.spark.sql(
                    re.sub(r"\{(\w+)\}", r"{\1}", sql), **{n: self(n) for n in names_in(sql)})
        return self._seen[name]


def names_in(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def _ctes(sql: str, done: dict[str, str]) -> None:
    for name in names_in(sql):
        if name in ADAPTERS and name not in done:
            text = ADAPTERS[name]["duck"]
            _ctes(text, done)
            done[name] = text


def _fill(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def season_sql(month: str) -> str:
    return (f"(case when {month} in (12,1,2) then 'DJF' when {month} in (3,4,5) then 'MAM' "
            f"when {month} in (6,7,8) then 'JJA' when {month} in (9,10,11) then 'SON' end)")


def finish(df: DataFrame, spec: str) -> DataFrame:
    """Columns of the spec, cast; doubles rounded to 6 places, without negative zero."""
    out = []
    for part in spec.split():
        name, kind = part.split(":")
        c = F.col(name).cast(_SPARK_TYPES[kind])
        if kind == "d":
            c = F.round(c, 6) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def finish_sql(sql: str, spec: str) -> str:
    out = []
    for part in spec.split():
        name, kind = part.split(":")
        c = f"cast({name} as {_DUCK_TYPES[kind]})"
        if kind == "d":
            c = f"(round({c}, 6) + 0.0::double)"
        out.append(f"{c} as {name}")
    ctes: dict[str, str] = {}
    _ctes(sql, ctes)
    head = ", ".join(f"{n} as ({_fill(t)})" for n, t in ctes.items())
    return (f"with {head} " if head else "") + f"select {', '.join(out)} from ({_fill(sql)}) as result_rows"


def query(name: str, spec: str, sql: str | None = None):
    """Register a function of ``Tables``; ``sql`` is the same result for another engine."""

    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return finish(build(Tables(spark, folder)), spec)

        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = finish_sql(sql, spec)
        return build

    return register
