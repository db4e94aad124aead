"""Code lists as predicates. The lists are fixed and short, so they are literals in the plan and need no join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_prefix(code: Column, prefixes: Mapping[int, Sequence[str]]) -> Column:
    """True where the first n characters of the code are in the list for n. A shorter code is compared whole."""
    found = F.lit(False)
    for length, codes in sorted(prefixes.items()):
        found = found | F.substring(code, 1, length).isin(list(codes))
    return F.coalesce(found, F.lit(False))


def prefix_flag(df: DataFrame, code_col: str, prefixes: Mapping[int, Sequence[str]], out: str) -> DataFrame:
    """0/1 column from a prefix list; a NULL code gives 0."""
    return df.withColumn(out, as_flag(has_prefix(F.col(code_col), prefixes)))


def exact_flag(df: DataFrame, code_col: str, codes: Sequence, out: str) -> DataFrame:
    """0/1 column: is the whole code in the list?"""
    return df.withColumn(out, as_flag(F.col(code_col).isin(list(codes))))


def as_flag(predicate: Column) -> Column:
    """1 where the predicate is true, else 0 (also where it is NULL)."""
    return F.when(predicate, 1).otherwise(0)


def value_flags(value: Column, values: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Independent 0/1 flags from one text value; a value may stand in several lists."""
    return {name: as_flag(value.isin(list(texts))) for name, texts in values.items()}


def cascade(rules: Sequence[tuple[Column, int]], default: int = 0) -> Column:
    """The value of the first rule whose predicate is true."""
    (predicate, value), *rest = rules
    column = F.when(predicate, value)
    for predicate, value in rest:
        column = column.when(predicate, value)
    return column.otherwise(default)
