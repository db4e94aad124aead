"""First, last and ever status, and the code-status table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_last_status(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tiebreak: Sequence[str],
    flags: Mapping[str, Column],
    first_times: Mapping[str, str] | None = None,
) -> DataFrame:
    """Per key: ``<flag>_first``, ``<flag>_last``, ``<flag>`` (ever) and the first time of chosen flags.

    First and last follow (ts, tiebreak); a NULL time comes after every other, so it is picked last. Minimum and
    maximum of a struct replace two opposite sorts and are combined before the shuffle. ``first_times`` maps a flag
    to the name of its first-time column.
    """
    rows = df.select(*keys, ts, *tiebreak, *[column.alias(name) for name, column in flags.items()])
    record = F.struct(F.col(ts).isNull().alias("_late"), F.col(ts).alias("_at"), *tiebreak, *flags)
    summary = rows.groupBy(*keys).agg(
        F.min(record).alias("_first"),
        F.max(record).alias("_last"),
        *[F.max(name).alias(name) for name in flags],
        *[
            F.min(F.when(F.col(name) == 1, F.col(ts))).alias(out)
            for name, out in (first_times or {}).items()
        ],
    )
    return summary.select(
        *keys,
        *[F.col(f"_first.{name}").alias(f"{name}_first") for name in flags],
        *[F.col(f"_last.{name}").alias(f"{name}_last") for name in flags],
        *flags,
        *(first_times or {}).values(),
    )
