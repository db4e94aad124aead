"""Encounter index, ages and the cohort join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.temporal import age_flag, whole_years
from .joins import left_join_many, lookup_join
from .ranking import repeat_rows, value_bounds, with_range


def _counted(stays: DataFrame, on: Sequence[str], stay_col: str) -> DataFrame:
    """(on.., stay_col, _copies): copies of a stay row become a count before anything else."""
    return stays.groupBy(*on, stay_col).agg(F.count(F.lit(1)).alias("_copies"))


def encounter_index(
    parents: DataFrame,
    admissions: DataFrame,
    stays: DataFrame,
    parent_key: str,
    admission_key: str,
    stay_col: str,
    stay_keys: Sequence[str] | None = None,
    out: str = "ind",
) -> DataFrame:
    """parents LEFT JOIN admissions LEFT JOIN stays, with the dense rank of the stay within its admission.

    Output: (parent_key, admission_key, stay_col, out). A parent without an admission and an admission without a
    stay are kept with NULLs and index 1; a stay without an id ranks after the others. ``stay_keys`` are the
    columns stays share with admissions (default: both keys). The stay id must be an integer.

    One form for all admissions, however many stays they have. Stay ids are cut into ranges. A visit gets the list of
    the ranges its admission has stays in, with the number of earlier stays (one entry per range at most), and meets
    the stays by admission and range; so the stays of one admission are spread over the ranges.
    """
    on = list(stay_keys or [parent_key, admission_key])
    columns = [parent_key, admission_key, stay_col, out]
    visits = left_join_many(parents.select(parent_key), admissions.select(parent_key, admission_key), [parent_key])
    stay_rows = stays.select(*on, stay_col)
    counted = with_range(_counted(stay_rows, on, stay_col), stay_col, value_bounds(stay_rows, stay_col))
    place = F.row_number().over(W.partitionBy(*on, "_range").orderBy(F.col(stay_col).asc_nulls_last()))
    ranked = counted.withColumn("_place", place)

    sizes = counted.groupBy(*on, "_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy(*on).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    ranges = offsets.groupBy(*on).agg(F.collect_list(F.struct("_range", "_before")).alias("_ranges"))
    spread = visits.join(ranges, on, "left").select(parent_key, admission_key, F.inline_outer("_ranges"))

    joined = spread.join(ranked.select(*on, "_range", stay_col, "_place", "_copies"), [*on, "_range"], "left")
    index = F.coalesce(F.col("_before") + F.col("_place"), F.lit(1)).cast("bigint")
    rows = joined.select(
        parent_key, admission_key, stay_col, index.alias(out), F.coalesce("_copies", F.lit(1)).alias("_copies")
    )
    return repeat_rows(rows, "_copies", [admission_key, stay_col]).select(*columns)


def first_encounters(
    parents: DataFrame,
    admissions: DataFrame,
    stays: DataFrame,
    parent_key: str,
    admission_key: str,
    stay_col: str,
    stay_keys: Sequence[str] | None = None,
    out: str = "ind",
) -> DataFrame:
    """The rows of ``encounter_index`` with index 1 that have a parent and an admission, without ranking the others.

    The lowest stay of an admission, with the number of its copies, is an aggregate.
    """
    on = list(stay_keys or [parent_key, admission_key])
    order = F.coalesce(F.col(stay_col).cast("bigint"), F.lit((1 << 63) - 1)).alias("_order")
    lowest = (
        _counted(stays.select(*on, stay_col), on, stay_col)
        .groupBy(*on)
        .agg(F.min(F.struct(order, F.col(stay_col), F.col("_copies"))).alias("_s"))
    )
    visits = admissions.select(parent_key, admission_key).join(parents.select(parent_key), parent_key, "inner")
    joined = visits.join(lowest, on, "left").select(
        parent_key, admission_key, F.col(f"_s.{stay_col}"), F.coalesce("_s._copies", F.lit(1)).alias("_copies")
    )
    rows = repeat_rows(joined, "_copies", [admission_key, stay_col])
    return rows.select(parent_key, admission_key, stay_col, F.lit(1).cast("bigint").alias(out))


def age_flags(
    admissions: DataFrame,
    patients: DataFrame,
    key: str,
    birth: str,
    at: str,
    min_years: int = 18,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Admissions with ``age`` in whole years and ``age_flag``; an unknown birth date counts as adult."""
    joined = admissions.join(patients.select(key, birth, *keep), key, "left")
    age = whole_years(F.col(birth), F.col(at))
    return joined.select(
        *admissions.columns, birth, *keep, age.alias("age"), age_flag(age, min_years).alias("age_flag")
    )


def build_cohort(
    index: DataFrame,
    flags: DataFrame,
    admissions: DataFrame,
    on: Sequence[str],
    criteria: Column,
    out: str = "ind",
) -> DataFrame:
    """First encounters of the flagged admissions, with the flag and admission columns.

    The flags are cut by the criteria and meet their admissions first (one row each), then the index rows.
    """
    chosen = flags.filter(criteria).join(admissions, list(on), "inner")
    return lookup_join(index.filter(F.col(out) == 1), chosen, on)
