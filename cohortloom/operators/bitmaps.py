"""Cohorts as bitmaps: id sets kept as bits, so that unions, intersections and counts need no grouping of ids.

An id has a bucket and a place in it; a cohort has one row of 4 KB for every bucket with a member. Sets are combined
bucket by bucket, and sizes are sums of bit counts. Building a bitmap combines the ids of a task before they are
shuffled, so repeated ids cost nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise

BITS = 32_768  # in a bucket


def _id(df: DataFrame, id_col: str) -> DataFrame:
    """Null ids are in no set."""
    return df.select(F.col(id_col).cast("bigint").alias("_id")).filter("_id IS NOT NULL")


def _bucket() -> Column:
    return F.bitmap_bucket_number("_id").alias("bucket")


def _bits(test: Column | None = None) -> Column:
    place = F.bitmap_bit_position("_id")
    return F.bitmap_construct_agg(place if test is None else F.when(test, place))


def cohort_bitmaps(cohorts: Mapping[str, DataFrame]) -> DataFrame:
    """(cohort, bucket, bits) of id sets given as frames whose first column is the id; each source is read once."""
    tagged = [_id(df, df.columns[0]).withColumn("cohort", F.lit(name)) for name, df in cohorts.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("cohort", _bucket()).agg(_bits().alias("bits"))


def store_cohorts(cohorts: Mapping[str, DataFrame], path: str) -> DataFrame:
    """The bitmaps as a table with a folder for each cohort; a reader of some cohorts skips the others."""
    return materialise(cohort_bitmaps(cohorts), path, ["cohort"])


def _only(bitmaps: DataFrame, names: Sequence[str]) -> DataFrame:
    return bitmaps.filter(F.col("cohort").isin(list(names)))


def union_bits(bitmaps: DataFrame, names: Sequence[str]) -> DataFrame:
    """(bucket, bits) of the ids in any of the cohorts."""
    return _only(bitmaps, names).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersection_bits(bitmaps: DataFrame, names: Sequence[str]) -> DataFrame:
    """(bucket, bits) of the ids in all of the cohorts; a bucket that one of them lacks is not in it."""
    distinct = list(dict.fromkeys(names))
    grouped = _only(bitmaps, distinct).groupBy("bucket")
    both = grouped.agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("_n"))
    return both.filter(F.col("_n") == len(distinct)).select("bucket", "bits")


def count_bits(bits: DataFrame) -> DataFrame:
    """(n): how many ids."""
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def members(bits: DataFrame, out: str = "id") -> DataFrame:
    """The ids of (bucket, bits), one a row. Bytes without a bit set are dropped before their bits are looked at."""
    codes = F.transform(
        F.sequence(F.lit(0), F.lit(BITS // 8 - 1)),
        lambda i: F.struct(i.alias("i"), F.substring(F.col("bits"), i + 1, F.lit(1)).alias("byte")),
    )
    rows = bits.select("bucket", F.inline(F.filter(codes, lambda x: x.byte != F.lit(b"\x00"))))
    byte = F.conv(F.hex("byte"), 16, 10).cast("int")
    places = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: byte.bitwiseAND(F.pow(F.lit(2), k).cast("int")) != 0)
    place = rows.select("bucket", "i", F.explode(places).alias("k")).select("bucket", (F.col("i") * 8 + F.col("k")).alias("place"))
    positive = (F.col("bucket") - 1) * BITS + F.col("place") + 1
    return place.select(F.when(F.col("bucket") > 0, positive).otherwise(F.col("bucket") * BITS - F.col("place")).cast("bigint").alias(out))


def overlap_of_bitmaps(bitmaps: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sizes of the cohorts, of every two together and of all, one row, in one pass over the bitmaps.

    Columns as ``sets.overlap`` names them. A bucket has one row of bits per cohort.
    """
    names = list(names)
    empty = F.lit(bytes(BITS // 8))
    side = _only(bitmaps, names).groupBy("bucket").agg(
        *[F.coalesce(F.max(F.when(F.col("cohort") == name, F.col("bits"))), empty).alias(f"_b{i}") for i, name in enumerate(names)],
        F.bitmap_or_agg("bits").alias("_any"),
    )
    pairs = list(combinations(range(len(names)), 2))
    # The bits of two cohorts are laid one above the other and aggregated for each bucket.
    sizes = side.select(
        *[F.bitmap_count(f"_b{i}").alias(f"n_{name}") for i, name in enumerate(names)], F.bitmap_count("_any").alias("n_union")
    ).agg(*[F.coalesce(F.sum(column), F.lit(0)).alias(column) for column in [*[f"n_{name}" for name in names], "n_union"]])
    if not pairs:
        return sizes
    stacked = side.select(
        "bucket",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("pair"), F.col(f"_b{side_}").alias("bits"))
                    for k, pair in enumerate(pairs)
                    for side_ in pair
                ]
            )
        ),
    )
    common = stacked.groupBy("bucket", "pair").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    both = common.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("pair") == k, F.col("n"))), F.lit(0)).alias(f"n_{names[a]}_and_{names[b]}")
            for k, (a, b) in enumerate(pairs)
        ]
    )
    order = [*[f"n_{name}" for name in names], *[f"n_{names[a]}_and_{names[b]}" for a, b in pairs], "n_union"]
    return sizes.withColumn("_row", F.lit(1)).join(both.withColumn("_row", F.lit(1)), "_row").select(*order)


def bitmap_attrition(df: DataFrame, key: str, criteria: Sequence[tuple[str, Column]], cumulative: bool = True) -> DataFrame:
    """(step, label, n_rows, n_keys) as ``sets.attrition`` gives them, for integer keys, in one pass over the rows.

    What is shuffled is one row of counters and bits per task and bucket of keys, not one per key.
    """
    tests: list[Column] = []
    for _, predicate in criteria:
        tests.append(tests[-1] & predicate if cumulative and tests else predicate)
    steps = range(len(criteria))
    marked = df.select(F.col(key).cast("bigint").alias("_id"), *[test.alias(f"_t{i}") for i, test in enumerate(tests)])
    per_bucket = marked.groupBy(_bucket()).agg(
        *[F.count_if(F.col(f"_t{i}")).alias(f"_n{i}") for i in steps],
        *[_bits(F.col(f"_t{i}")).alias(f"_b{i}") for i in steps],
    )
    # Rows without a key have no bucket; their bits do not count.
    keyed = F.col("bucket").isNotNull()
    totals = per_bucket.agg(
        *[F.coalesce(F.sum(f"_n{i}"), F.lit(0)).alias(f"_rows{i}") for i in steps],
        *[F.coalesce(F.sum(F.when(keyed, F.bitmap_count(f"_b{i}"))), F.lit(0)).alias(f"_keys{i}") for i in steps],
    )
    rows = [
        F.struct(F.lit(i + 1).alias("step"), F.lit(label).alias("label"), F.col(f"_rows{i}").alias("n_rows"), F.col(f"_keys{i}").alias("n_keys"))
        for i, (label, _) in enumerate(criteria)
    ]
    return totals.select(F.inline(F.array(*rows)))

