"""Keyword cohorts, text evidence and label frequencies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import as_flag
from ..functions.text import contains_keyword
from .joins import group_for_join


def keyword_cohort(df: DataFrame, text_col: str, keywords: Sequence[str], literal: bool = True) -> DataFrame:
    """Rows whose text holds any keyword, ignoring case; a NULL text is no match."""
    return df.filter(contains_keyword(F.col(text_col), keywords, literal))


def text_evidence(
    df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column], prefilter: Column | None = None
) -> DataFrame:
    """Per key: 1 if any text meets the rule, else 0.

    The cheap ``prefilter`` runs before the patterns, and the text is dropped before the shuffle.
    """
    rows = df if prefilter is None else df.filter(prefilter)
    marked = rows.select(*keys, *[as_flag(rule).alias(name) for name, rule in rules.items()])
    found = group_for_join(marked, keys).agg(*[F.max(name).alias(name) for name in rules])
    return found.select(*keys, *rules)


def frequency(df: DataFrame, label: Column, out: str = "label", ordered: bool = True) -> DataFrame:
    """(label, n): how often each label occurs, most frequent first, ties by label."""
    counts = df.select(label.alias(out)).groupBy(out).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.col(out).asc_nulls_last()) if ordered else counts


def frequency_total(counts: DataFrame) -> DataFrame:
    """Grand total of a frequency table, one row."""
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def frequency_lines(counts: DataFrame, label: str = "label") -> DataFrame:
    """The frequency table as fixed-width report lines."""
    return counts.select(F.format_string("%-65s ==> %10d", F.col(label), F.col("n")).alias("line"))
