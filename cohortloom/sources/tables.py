"""Reading and materialising tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession


def load(
    spark: SparkSession,
    directory: str,
    name: str,
    columns: Iterable[str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """``directory/name.parquet``; the column list and the filter reach the scan."""
    df = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    if where is not None:
        df = df.filter(where)
    return df if columns is None else df.select(*columns)


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    bounds: tuple[int, int],
    partitions: int,
    properties: Mapping[str, str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """A database table, read in key ranges by many tasks at once; the filter runs in the database."""
    df = spark.read.jdbc(
        url,
        table,
        column=key,
        lowerBound=bounds[0],
        upperBound=bounds[1],
        numPartitions=partitions,
        properties=dict(properties or {}),
    )
    return df if where is None else df.filter(where)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Make the frames available to ``spark.sql`` under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def materialise(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write the frame, replacing what the path held, and read it back: a short lineage for what is used often."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def save_table(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 0) -> DataFrame:
    """Save as a catalogue table, replacing one of that name; bucketed tables join on their key without a shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    if bucket_by is not None:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)
