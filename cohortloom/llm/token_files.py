"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on the document ids.

The rows of a file are in ascending order of ids and files hold successive ranges, so a reader of some documents skips
files by their statistics, stripes and row groups by theirs, and the rest by the Bloom filters. Stripes are read by
separate tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, ranges_for, texts_of, tidied
from .library_tokens import library_encoder

SCHEMA = "doc_id bigint, part int, place bigint, n_tokens bigint, ids array<int>"


def encode_documents(
    docs: DataFrame, path: str, end_id: int, words: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids): the ids of every whole text with ``end_id`` behind them. A null text gives the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path, words)
        for batch in batches:
            for low, ids, cuts in encoder.encode_with_end(batch.column(1), end_id):
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(lists)), lists], ["doc_id", "ids"])
                del ids, cuts, lists  # else they last beside the next ones

    return texts_of(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id bigint, ids array<int>")


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int,
    files: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    stripe_bytes: int = 16 << 20,
    stride: int = 2000,
    bloom_fpp: float = 0.01,
) -> None:
    """Write the ids of every document as ORC files below ``path``, in ascending order of ids.

    Columns: doc_id, part (number of the file), place (row of the document in it, from 0), n_tokens, ids. Texts are
    shuffled once, into successive ranges of ids, as many as the bytes ask for; encoding and writing happen in that
    order. Null ids come first; rows of one id stand together, in the order of a hash of their texts, by which an id
    with many rows is parted too. An empty table gives files without rows.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = (
        texts_of(docs, id_col, text_col)
        .repartitionByRange(files or ranges_for(docs), *order, F.monotonically_increasing_id())
        .sortWithinPartitions(*order, "text")
    )
    encoded = encode_documents(ordered, vocabulary, end_id)
    rows = encoded.select(
        "doc_id",
        F.spark_partition_id().alias("part"),
        # Counts the rows of a task from 0 in its low 33 bits, here in the order they are written in.
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
    )
    (
        rows.write.mode("overwrite")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.compress", "ZSTD")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The rows of the files; a condition on doc_id reaches the statistics and Bloom filters of the stripes."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if where is None else rows.filter(where)


def read_documents(spark: SparkSession, path: str, ids: Sequence[int]) -> DataFrame:
    """The rows of the documents named: files, stripes and row groups that cannot hold them are not read."""
    return read_token_files(spark, path, F.col("doc_id").isin([int(i) for i in ids]))


def with_starts(
    rows: DataFrame, sizes: DataFrame, part: str = "part", place: str = "place", n: str = "n_tokens"
) -> DataFrame:
    """Add ``start``: the sum of ``n`` over all rows before, by part and place.

    Two levels: running sums inside each part, which are bounded by the size of a file, and the totals of earlier
    parts, one small row per part, taken from ``sizes``: the same rows, from which no more than these columns are read.
    """
    inside = W.partitionBy(part).orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    totals = sizes.groupBy(part).agg(F.sum(n).alias("_total"))
    offsets = totals.select(F.col(part), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    local = rows.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    joined = local.join(offsets, part)
    return joined.withColumn("start", F.col("_inside") + F.col("_offset")).drop("_inside", "_offset")


def token_digests(rows: DataFrame) -> DataFrame:
    """(doc_id, part, place, n_tokens, ids_crc32) of rows read back; the checksum takes ids as unsigned 32-bit."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(3)
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        cuts = ids.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                batch.column(2),
                pa.array(np.diff(cuts), pa.int64()),
                pa.array(sums, pa.int64()),
            ],
            ["doc_id", "part", "place", "n_tokens", "ids_crc32"],
        )

    schema = "doc_id bigint, part int, place bigint, n_tokens bigint, ids_crc32 bigint"
    return map_batches(rows.select("doc_id", "part", "place", "ids"), step, schema)


def token_file_report(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files alone."""
    rows = read_token_files(spark, path)
    found = with_starts(token_digests(rows), rows.select("part", "n_tokens"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")
