"""CSV, text and JSON files: readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _parsed(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return column
    if isinstance(data_type, _INTEGRAL):
        # Ids of a column with gaps are often written as 125506.0; 125506.7 is no id.
        return F.regexp_extract(column, r"^\s*([+-]?[0-9]+)(?:\.0*)?\s*$", 1).try_cast(data_type)
    return column.try_cast(data_type)


def read_quoted_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV whose header names may stand in single quotes; text that does not fit its type becomes NULL.

    Columns are taken by name, nothing is inferred, so the file is read once.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    raw = spark.read.option("header", True).csv(path)
    named = raw.toDF(*[name.strip().strip("'") for name in raw.columns])
    return named.select(*[_parsed(F.col(f.name), f.dataType).alias(f.name) for f in wanted.fields])


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Chosen columns with a header; one file per task."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def export_documents(df: DataFrame, path: str, id_col: str, text_col: str, one_file_each: bool = False) -> None:
    """Documents as (id, text) parquet, or for a small export one text file per document, foldered by id."""
    rows = df.select(id_col, text_col)
    if one_file_each:
        rows.write.mode("overwrite").partitionBy(id_col).text(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def read_exported_texts(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """Read one-file-per-document text back as (id, text); the id comes from the folder name."""
    files = spark.read.text(path, wholetext=True)
    # The writer ends each file with one line break of its own.
    text = F.regexp_replace("value", r"\n\z", "")
    return files.select(F.col(id_col).cast("bigint").alias(id_col), text.alias("text"))


def id_from_path(path: Column, suffix: str = ".txt") -> Column:
    """The integer file name of a path, without its extension."""
    return F.regexp_extract(path, r"([0-9]+)" + suffix.replace(".", r"\.") + "$", 1).try_cast("bigint")


def write_lines(df: DataFrame, path: str, order: str, line: str) -> None:
    """A report of a few thousand lines at most as one ordered text file."""
    df.orderBy(order).select(line).coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str, column: str) -> None:
    """One JSON document per line, already encoded in the column."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
