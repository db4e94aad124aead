"""Ranks and top-k picks that never sort one whole hot group in a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import seeded_order
from .joins import lookup_join


_LAST = (1 << 63) - 1


def value_bounds(df: DataFrame, order_col: str, parts: int | None = None) -> list[int]:
    """Rising bounds that cut an integer column into at most ``parts`` ranges of about equal size.

    One small aggregation, run now: ranks need the same bounds wherever they are used. Any bounds give the same ranks;
    only the size of the ranges depends on them. By default there are as many ranges as shuffle partitions, 64 at least.
    """
    parts = parts or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(F.col(order_col).cast("bigint"), shares, max(10_000, 10 * parts))).first()[0]
    return sorted(set(found or []))


def _range_of(value: Column, bounds: Sequence[int]) -> Column:
    """How many bounds are at most the value: first by groups of bounds, then within one."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = F.from_json(F.lit(str([list(bounds[i : i + step]) for i in range(0, len(bounds), step)])), "array<array<bigint>>")
    group = F.size(F.filter(groups, lambda g: F.get(g, F.lit(0)) <= value)) - 1
    inside = F.size(F.filter(F.get(groups, group), lambda bound: bound <= value))
    return F.when(group < 0, F.lit(0)).otherwise(group * step + inside).cast("int")


def with_range(df: DataFrame, order_col: str, bounds: Sequence[int], out: str = "_range") -> DataFrame:
    """Add the number of the range the value falls into; a missing value belongs to the last one."""
    return df.withColumn(out, _range_of(F.coalesce(F.col(order_col).cast("bigint"), F.lit(_LAST)), bounds))


def dense_ranks(
    distinct: DataFrame, keys: Sequence[str], order_col: str, out: str, bounds: Sequence[int] | None = None
) -> DataFrame:
    """DENSE_RANK() OVER (PARTITION BY keys ORDER BY order_col NULLS LAST) of an integer, for one row per key and value.

    Two levels replace the window over a whole key: the place inside a range of values, and the number of values of the
    key in earlier ranges. However many values a key has, the first window sees a range of them and the second one
    small row per range. Rows with a NULL key form a key of their own; other columns are kept.
    """
    keys = list(keys)
    bounds = value_bounds(distinct, order_col) if bounds is None else bounds
    ranged = with_range(distinct, order_col, bounds)
    local = ranged.withColumn(
        "_place", F.row_number().over(W.partitionBy(*keys, "_range").orderBy(F.col(order_col).asc_nulls_last()))
    )
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    # The first range of a key needs no offset, so for most keys nothing is left to join.
    later = sizes.select(*keys, "_range", F.sum("_size").over(earlier).alias("_before")).filter("_before > 0")
    names = {key: f"_key{i}" for i, key in enumerate(keys)}
    later = later.withColumnsRenamed(names).withColumnRenamed("_range", "_of")
    same = F.col("_range") == F.col("_of")
    for key, other in names.items():
        same = same & F.col(key).eqNullSafe(F.col(other))
    rank = F.col("_place") + F.coalesce(F.col("_before"), F.lit(0))
    return local.join(later, same, "left").select(*distinct.columns, rank.cast("bigint").alias(out))


def with_dense_rank(df: DataFrame, keys: Sequence[str], order_col: str, out: str) -> DataFrame:
    """Rows with the dense rank of their integer value within their key; a NULL value ranks last."""
    names = [*keys, order_col]
    ranks = dense_ranks(df.select(*names).distinct(), keys, order_col, out, value_bounds(df, order_col))
    other = {name: f"_rank_{i}" for i, name in enumerate(names)}
    spread = F.xxhash64(*names)
    left = df.withColumn("_spread", spread)
    right = ranks.withColumn("_spread_of", spread).withColumnsRenamed(other)
    same = F.col("_spread") == F.col("_spread_of")
    for name, copy in other.items():
        same = same & F.col(name).eqNullSafe(F.col(copy))
    return left.join(right, same).select(*df.columns, out)


def repeat_rows(df: DataFrame, count_col: str, spread_by: Sequence[str], chunk: int = 100_000) -> DataFrame:
    """Each row ``count_col`` times, without that column.

    Every row is cut into chunks of at most ``chunk`` copies, which are spread over the tasks before they are written
    out: a row with very many copies is no burden for one task.
    """
    n = F.col(count_col)
    rest = [name for name in df.columns if name != count_col]
    chunks = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))))
    size = F.least(F.lit(chunk), n - F.col("_chunk").cast("bigint") * chunk).cast("int")
    spread = chunks.repartition(*spread_by, "_chunk")
    return spread.select(*rest, F.explode(F.sequence(F.lit(1), size)).alias("_copy")).drop("_copy")


def with_ordinal(df: DataFrame, key: str, out: str = "ordinal") -> DataFrame:
    """Add the row's position (from 0) in the order of a unique integer key; rows without a key come last.

    Rows are ranged by bounds of the key, and rows without a key by a hash of the whole row, which also breaks ties.
    A window sees one range; the sizes of earlier ranges are one small row per range, so they may be broadcast.
    """
    bounds = value_bounds(df, key)
    row = F.xxhash64(*df.columns)
    keyless = F.lit(len(bounds) + 1) + F.pmod(row, F.lit(len(bounds) + 1))
    number = F.when(F.col(key).isNull(), keyless).otherwise(_range_of(F.col(key).cast("bigint"), bounds))
    ranged = df.withColumn("_range", number.cast("int")).withColumn("_row", row)
    inside = W.partitionBy("_range").orderBy(F.col(key).asc_nulls_last(), "_row")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(F.col("_range").alias("_of"), "_size").select(
        "_of", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")
    )
    placed = ranged.withColumn("_place", F.row_number().over(inside) - 1)
    joined = placed.join(F.broadcast(before), F.col("_range") == F.col("_of"))
    return joined.select(*df.columns, (F.col("_place") + F.col("_before")).cast("bigint").alias(out))


def ranked(
    df: DataFrame,
    group: Sequence[str],
    by: str,
    tie: str,
    out: str = "rank",
    total: str = "n_rows",
    bounds: Sequence[int] | None = None,
) -> DataFrame:
    """Add the place (from 1) of each row in its group, by falling ``by`` and rising integer ``tie``, and the group's size.

    For whole rankings of groups of any size: a window sees the rows of a group with one value of ``by`` and one range
    of ``tie``, and the counts of what comes earlier are one small row each. The pair of ``by`` and ``tie`` is unique
    in a group, and neither is NULL. ``bounds`` spare a pass over rows that are dear to compute: see ``value_bounds``.
    """
    slot = [*group, by, "_range"]
    ranged = with_range(df, tie, value_bounds(df, tie) if bounds is None else bounds)
    local = ranged.withColumn("_place", F.row_number().over(W.partitionBy(*slot).orderBy(tie)))
    sizes = local.groupBy(*slot).agg(F.max("_place").alias("_size"))
    in_order = W.partitionBy(*group).orderBy(F.col(by).desc(), "_range").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(
        *slot,
        F.coalesce(F.sum("_size").over(in_order), F.lit(0)).alias("_before"),
        F.sum("_size").over(W.partitionBy(*group)).alias(total),
    )
    place = (F.col("_place") + F.col("_before")).cast("bigint")
    return lookup_join(local, before, slot).select(*df.columns, place.alias(out), total)


def top_k(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, spread_by: str, parts: int | None = None
) -> DataFrame:
    """The first k rows of each group with their ``rank`` (from 1).

    ``order`` must be a total order. Rows are cut to k within each of ``parts`` slices of a group (by default one for
    each shuffle partition), what is left within each of about the square root of as many, and then as a whole: the last
    window sees at most k rows of each of those.
    """
    parts = parts or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = df.withColumn("_slice", F.pmod(F.xxhash64(F.col(spread_by)), F.lit(parts)))
    for slices in (parts, max(1, int(parts**0.5))):
        part = W.partitionBy(*group, F.col("_slice") % slices).orderBy(*order)
        kept = kept.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= k).drop("_n")
    whole = W.partitionBy(*group).orderBy(*order)
    return kept.drop("_slice").withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)


def seeded_sample(
    df: DataFrame, key: str, n: int, seed: int, by: Sequence[str] | None = None
) -> DataFrame:
    """n reproducible pseudo-random rows (of each group, if ``by`` is given); ``key`` must be unique.

    Without groups this is a take-ordered: each task keeps n rows and nothing is sorted as a whole.
    """
    order = [seeded_order(F.col(key), seed), F.col(key)]
    if by is None:
        return df.orderBy(*order).limit(n)
    return top_k(df, by, order, n, key).drop("rank")


def seeded_samples(df: DataFrame, key: str, n: int, seeds: Sequence[int], out: str = "seed") -> DataFrame:
    """n reproducible rows for each seed, from one pass over the rows."""
    drawn = df.withColumn(out, F.explode(F.array(*[F.lit(seed) for seed in seeds])))
    return top_k(drawn, [out], [seeded_order(F.col(key), F.col(out)), F.col(key)], n, key).drop("rank")


def first_match(df: DataFrame, order: Sequence[Column], predicate: Column | None = None) -> DataFrame:
    """The first row in the given total order, of those satisfying the predicate."""
    rows = df if predicate is None else df.filter(predicate)
    return rows.orderBy(*order).limit(1)
