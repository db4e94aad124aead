"""Id-set overlap and attrition tables, each in one pass over the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_set(df: DataFrame, id_col: str, out: str = "id") -> DataFrame:
    """The distinct non-null ids as a one-column frame."""
    return df.select(F.col(id_col).alias(out)).filter(F.col(out).isNotNull()).distinct()


def union_ids(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, frames).distinct()


def intersect_ids(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.intersect(second)


def overlap(sets: Mapping[str, DataFrame]) -> DataFrame:
    """Sizes of id sets (one-column frames), one row.

    Columns: ``n_<name>`` per set, ``n_<a>_and_<b>`` per pair, and ``n_union``. All sets are tagged and grouped by
    id once; repeated and NULL ids do not count.
    """
    names = list(sets)
    tagged = reduce(
        DataFrame.union,
        [
            df.select(F.col(df.columns[0]).alias("_id"), F.lit(i).alias("_set"))
            for i, df in enumerate(sets.values())
        ],
    ).filter(F.col("_id").isNotNull())
    member = tagged.groupBy("_id").agg(
        *[F.max(F.when(F.col("_set") == i, 1).otherwise(0)).alias(name) for i, name in enumerate(names)]
    )
    return member.agg(
        *[F.count(F.when(F.col(a) == 1, 1)).alias(f"n_{a}") for a in names],
        *[
            F.count(F.when((F.col(a) == 1) & (F.col(b) == 1), 1)).alias(f"n_{a}_and_{b}")
            for a, b in combinations(names, 2)
        ],
        F.count(F.lit(1)).alias("n_union"),
    )


def attrition(
    df: DataFrame, key: str, criteria: Sequence[tuple[str, Column]], cumulative: bool = True
) -> DataFrame:
    """(step, label, n_rows, n_keys): rows and distinct non-null keys left under each criterion.

    With ``cumulative`` each criterion is added to those before it. Rows are counted per key first, so one shuffle of
    small counters gives every distinct count exactly, without repeating the rows per criterion.
    """
    steps = range(len(criteria))
    tests: list[Column] = []
    for _, predicate in criteria:
        tests.append(tests[-1] & predicate if cumulative and tests else predicate)
    marked = df.select(F.col(key).alias("_key"), *[test.alias(f"_t{i}") for i, test in enumerate(tests)])
    per_key = marked.groupBy("_key").agg(*[F.count_if(F.col(f"_t{i}")).alias(f"_n{i}") for i in steps])
    totals = per_key.agg(
        *[F.coalesce(F.sum(f"_n{i}"), F.lit(0)).alias(f"_rows{i}") for i in steps],
        *[F.count_if((F.col(f"_n{i}") > 0) & F.col("_key").isNotNull()).alias(f"_keys{i}") for i in steps],
    )
    rows = [
        F.struct(
            F.lit(i + 1).alias("step"),
            F.lit(label).alias("label"),
            F.col(f"_rows{i}").alias("n_rows"),
            F.col(f"_keys{i}").alias("n_keys"),
        )
        for i, (label, _) in enumerate(criteria)
    ]
    return totals.select(F.inline(F.array(*rows)))


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns) of a frame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
