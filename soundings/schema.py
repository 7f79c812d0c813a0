"""Canonical tables: explicit types, one step that brings any input to them."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_TYPES = {
    "str": T.StringType(), "int": T.IntegerType(), "long": T.LongType(),
    "dbl": T.DoubleType(), "ts": T.TimestampNTZType(), "bool": T.BooleanType(),
}


def _struct(spec: str) -> T.StructType:
    fields = [part.split(":") for part in spec.split()]
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in fields])


TABLES: dict[str, T.StructType] = {
    "grid_cell": _struct("run:str x:int y:int lon:dbl lat:dbl bathymetry:dbl bottom_level:int"),
    "grid_field": _struct(
        "run:str year:int month:int t:ts x:int y:int z:int depth:dbl temperature:dbl salinity:dbl"
    ),
    "grid_ssh": _struct("run:str year:int month:int t:ts x:int y:int ssh:dbl"),
    "profile_header": _struct("profile_id:long time:ts lon:dbl lat:dbl"),
    "profile_level": _struct("profile_id:long z:int depth:dbl temperature:dbl salinity:dbl qc:int"),
    "tg_station": _struct("port:int lon:dbl lat:dbl"),
    "tg_series": _struct("port:int time:ts ssh:dbl"),
    "tg_extract": _struct("port:int time:ts ssh_obs:dbl ssh_mod:dbl"),
    "region_polygon": _struct("region:str seq:int lon:dbl lat:dbl"),
    "region_limits": _struct("region:str min_depth:dbl max_depth:dbl"),
    "ref_depth": _struct("z:int depth:dbl thickness:dbl"),
}


def canonicalise(df: DataFrame, table: str, renames: dict[str, str] | None = None) -> DataFrame:
    """Rename, keep the table's columns, cast, and turn NaN into NULL.

    Columns the input lacks come out as NULL.
    """
    if renames:
        df = df.withColumnsRenamed(renames)
    out = []
    for field in TABLES[table].fields:
        if field.name not in df.columns:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        value = F.col(field.name).cast(field.dataType)
        if isinstance(field.dataType, T.DoubleType):
            value = F.when(~F.isnan(value), value)
        out.append(value.alias(field.name))
    return df.select(*out)


def run_key(*tables: DataFrame) -> list[str]:
    """``["run"]`` if all the tables name the run of their rows, else nothing: part of the keys they share."""
    return ["run"] if all("run" in t.columns for t in tables) else []


def one_run(table: DataFrame, run: str | None = None) -> DataFrame:
    """The table without ``run``: the rows of the run named, or of the only one.

    Without a name, rows of a second run raise an error rather than mix with the first's; that takes a pass over
    the table's ``run`` column, so large tables are checked after they are cut to what is needed.
    """
    if "run" not in table.columns:
        return table
    if run is not None:
        return table.filter(F.col("run") == run).drop("run")
    first = table.select(F.min("run").alias("run")).select("run").scalar()
    same = F.when(F.col("run").eqNullSafe(first), True).otherwise(F.raise_error(F.lit("several runs in one table: choose one")).cast("boolean"))
    return table.filter(same).drop("run")
