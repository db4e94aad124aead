"""Bolus tables: dose sums per stay and time from several systems."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_of_sums(sources: Sequence[DataFrame], keys: Sequence[str], amount: str, out: str) -> DataFrame:
    """UNION (distinct) of the sources' ``SELECT keys, sum(amount) GROUP BY keys``.

    Equal sums of two sources for one key give one row, different sums two rows; sums are never added across
    sources. All sources share one aggregation: a sum per source and key, then the distinct sums of the key.
    """
    tagged = reduce(
        DataFrame.unionByName,
        [
            df.select(*keys, F.col(amount).alias("_amount"), F.lit(i).alias("_source"))
            for i, df in enumerate(sources)
        ],
    )
    per_source = []
    for i in range(len(sources)):
        mine = F.col("_source") == i
        per_source += [
            F.sum(F.when(mine, F.col("_amount"))).alias(f"_sum{i}"),
            F.max(mine).alias(f"_has{i}"),
        ]
    sums = F.filter(
        F.array(
            *[
                F.struct(F.col(f"_has{i}").alias("has"), F.col(f"_sum{i}").alias("total"))
                for i in range(len(sources))
            ]
        ),
        lambda s: s.has,
    )
    grouped = tagged.groupBy(*keys).agg(*per_source)
    return grouped.select(*keys, F.explode(F.array_distinct(sums)).alias("_s")).select(
        *keys, F.col("_s.total").alias(out)
    )
