"""Tables clustered by a key, for reads of single rows, and tables found along a search path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_clustered(
    df: DataFrame, path: str, keys: Sequence[str], bloom: Sequence[str] = (), row_group_bytes: int = 16 << 20, distinct: int = 1_000_000
) -> None:
    """Parquet files of successive ranges of the keys, sorted, with statistics and Bloom filters for point reads.

    The first key prunes files, row groups and pages by their limits; ``bloom`` names columns, in no order in the files,
    whose row groups are ruled out by a Bloom filter made for ``distinct`` values each. Null keys come first.
    """
    order = [F.col(key).asc_nulls_first() for key in keys]
    writer = df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite")
    writer = writer.option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(64 << 10))
    # The writer looks at the size of a row group only every so many rows.
    writer = writer.option("parquet.page.size.row.check.min", "100").option("parquet.page.row.count.limit", "5000")
    for name in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{name}", str(distinct))
    writer.parquet(path)


def point_read(spark: SparkSession, path: str, key: str, values: Sequence) -> DataFrame:
    """The rows with one of the values: a condition that reaches the scan, so only row groups that may hold them are read."""
    table = spark.read.parquet(path)
    kind = table.schema[key].dataType
    wanted = [F.lit(value).cast(kind) for value in values if value is not None]
    return table.filter(F.col(key).isin(wanted) if wanted else F.lit(False))


class SearchPath:
    """Catalogue databases in the order in which names are looked up."""

    def __init__(self, spark: SparkSession, databases: Sequence[str]):
        self.spark, self.databases = spark, list(databases)

    def resolve(self, name: str) -> str:
        """``database.table`` of the first database that has the table; a name with a database stands for itself."""
        if "." in name:
            return name
        for database in self.databases:
            if self.spark.catalog.tableExists(f"{database}.{name}"):
                return f"{database}.{name}"
        raise KeyError(f"no table {name} in {', '.join(self.databases)}")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.resolve(name))

    def views(self, *names: str) -> None:
        """Make the tables known to ``spark.sql`` under their short names, for this session."""
        for name in names:
            self.table(name).createOrReplaceTempView(name)
