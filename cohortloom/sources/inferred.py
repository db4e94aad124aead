"""CSV files whose types are found in their values: a lattice of types, combined over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_INTEGER = r"\A[+-]?[0-9]{1,18}\z"
_INTEGRAL = r"\A[+-]?[0-9]{1,15}(?:\.0*)?\z"
_FLOAT = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,3})?\z"
_TIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?)?\z"

# From the narrowest up. Whole numbers are the integers, also as floats that gaps have turned them into; a column whose
# values share none of the types is text, and so is one without a value.
_TYPES = ("integer", "integral", "float", "time")


def _value(name: str) -> Column:
    """The trimmed value; an empty one is a gap."""
    return F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))


def _fits(name: str, kind: str) -> Column:
    value = _value(name)
    pattern = {"integer": _INTEGER, "integral": _INTEGRAL, "float": _FLOAT, "time": _TIME}[kind]
    good = value.rlike(pattern)
    if kind == "time":
        good = good & value.try_cast("timestamp_ntz").isNotNull()
    return F.when(value.isNotNull(), good)  # a gap says nothing


def infer_types(strings: DataFrame) -> dict[str, str]:
    """The narrowest type of every column that holds for all its values, from one pass over all rows.

    A task's rows combine into one flag per column and type before the shuffle; the driver sees one row.
    """
    columns = strings.columns
    flags = [
        F.coalesce(F.bool_and(_fits(name, kind)), F.lit(False)).alias(f"{i}_{kind}")
        for i, name in enumerate(columns)
        for kind in _TYPES
    ]
    row = strings.agg(*flags).first()
    return {name: next((kind for kind in _TYPES if row[f"{i}_{kind}"]), "text") for i, name in enumerate(columns)}


def cast_inferred(strings: DataFrame, types: dict[str, str]) -> DataFrame:
    """The columns in their types: integers as 64 bits, times without a zone. Gaps are null in any type but text."""

    def cast(name: str) -> Column:
        value, kind = _value(name), types[name]
        if kind in ("integer", "integral"):
            return F.regexp_replace(value, r"\..*\z", "").cast("bigint")
        if kind == "float":
            return value.cast("double")
        return value.cast("timestamp_ntz") if kind == "time" else F.col(f"`{name}`")

    return strings.select(*[cast(name).alias(name) for name in strings.columns])


def read_inferred_csv(spark: SparkSession, path: str, quote: str = '"', columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV file or folder with a header; quotes around names are dropped, types found in all rows.

    The files are read twice: once for the types, once for the values.
    """
    raw = spark.read.option("header", "true").option("quote", quote).option("escape", quote).option("inferSchema", "false").csv(path)
    named = raw.toDF(*[name.strip().strip("'\"").strip() for name in raw.columns])
    chosen = named if columns is None else named.select(*columns)
    return cast_inferred(chosen, infer_types(chosen))
