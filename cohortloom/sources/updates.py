"""Keyed updates of a stored table: only the partitions that hold a changed key are written again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import group_for_join

BUCKET = "_bucket"


def _bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_keyed(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """Store the frame in one folder per bucket of its key."""
    placed = df.withColumn(BUCKET, _bucket_of(keys, buckets))
    placed.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def update_keyed(
    spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], buckets: int = 64, order: Sequence[str] = ()
) -> list[int]:
    """Set the other columns of ``changes`` in the stored rows with their key; returns the buckets written again.

    Of several changes to a key the last one by ``order`` wins, of equally late ones the greatest. A key that the table
    does not hold, and a change without a key, changes nothing; a null value is set like any other. Rows of the same
    key are all set. The driver sees the numbers of the buckets, at most ``buckets`` of them. The new files stand
    beside the old ones until all are written, then the folders are exchanged; if that fails, the update can be
    repeated, since setting the same values twice changes nothing.
    """
    keys = list(keys)
    values = [name for name in changes.columns if name not in keys and name not in order]
    present = changes
    for key in keys:
        present = present.filter(F.col(key).isNotNull())
    latest = F.max(F.struct(*[F.col(name).alias(f"o{i}") for i, name in enumerate(order)], F.struct(*values).alias("v")))
    last = group_for_join(present, keys).agg(latest.alias("_set")).select(*keys, F.col("_set.v").alias("_set"))
    stored = spark.read.parquet(path)
    touched = last.select(_bucket_of(keys, buckets).alias(BUCKET)).distinct()
    # Buckets that hold one of the keys: a change to a key the table lacks rewrites nothing.
    numbers = sorted(row[BUCKET] for row in touched.collect())
    affected = stored.filter(F.col(BUCKET).isin(numbers))
    held = affected.select(*keys, BUCKET).join(last.select(*keys), keys, "left_semi").select(BUCKET).distinct()
    numbers = sorted(row[BUCKET] for row in held.collect())
    if not numbers:
        return []
    rows = stored.filter(F.col(BUCKET).isin(numbers))
    joined = rows.join(last, keys, "left")
    found = F.col("_set").isNotNull()
    out = joined.select(
        *[
            F.when(found, F.col("_set").getField(name).cast(rows.schema[name].dataType)).otherwise(F.col(name)).alias(name)
            if name in values
            else F.col(name)
            for name in rows.columns
        ]
    )
    writer = out.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(BUCKET).parquet(path)
    spark.catalog.refreshByPath(path)
    return numbers
