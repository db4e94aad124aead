"""Packing along a space-filling curve: alike documents stand side by side in the sequences.

A document's tokens are hashed into a vector, the vector is projected to a few dimensions, and the Hilbert curve gives
it a place on a line along which neighbours are near in all dimensions. Documents are sorted by ranges of that line and
laid one behind the other; every ``size`` tokens a new sequence begins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, ranges_for, stored, texts_of, tidied
from .library_tokens import library_encoder
from .token_files import with_starts

DIMENSIONS, BITS, WIDTH = 4, 10, 256
_SIGNS = np.random.Generator(np.random.PCG64(7)).choice([-1.0, 1.0], (WIDTH, DIMENSIONS))


def project(ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A row per document: its hashed, normalised token counts in few dimensions, as integers of ``BITS`` bits."""
    n = len(cuts) - 1
    hashed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
    cells = np.repeat(np.arange(n) * WIDTH, np.diff(cuts)) + hashed
    counts = np.sqrt(np.bincount(cells, minlength=n * WIDTH).reshape(n, WIDTH))
    lengths = np.sqrt((counts**2).sum(axis=1))
    points = counts / np.maximum(lengths, 1e-300)[:, None] @ _SIGNS
    return np.minimum((1 << BITS) - 1, (1 << BITS) / (1 + np.exp(-2 * points))).astype(np.int64)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points, a row each: the bits of all coordinates, turned level by level.

    From the highest bit down, a set bit of a coordinate flips the lower bits of the first one, a clear bit swaps
    lower bits with it; then the coordinates are Gray-decoded and interleaved.
    """
    x = points.T.astype(np.int64)
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, lower = 1 << level, (1 << level) - 1
        for i in range(n):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & lower)
            x[0] ^= np.where(flip, lower, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x = x ^ turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _tokenised(docs: DataFrame, vocabulary: str, end_id: int, kind: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, n_tokens, ids): packed ids of every text with the end id, and its place on the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary, True)
        for batch in batches:
            for low, ids, cuts in encoder.encode_with_end(batch.column(1), end_id):
                n = len(cuts) - 1
                keys = np.concatenate([_keys(ids, cuts[i : i + 1001]) for i in range(0, n, 1000)])
                packed = ids.astype(kind)
                ends = pa.array(cuts * packed.itemsize, pa.int32())
                binary = pa.Array.from_buffers(pa.binary(), n, [None, ends.buffers()[1], pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n), pa.array(keys), pa.array(np.diff(cuts)), binary], names
                )
                del ids, cuts, keys, packed, ends, binary  # else they last beside the next ones

    names = ["doc_id", "key", "n_tokens", "ids"]
    schema = "doc_id bigint, key bigint, n_tokens bigint, ids binary"
    return texts_of(docs, id_col, text_col).mapInArrow(tidied(run), schema)


def _keys(ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Places on the curve of documents with the end id behind each, which does not count."""
    part, edges = ids[cuts[0] : cuts[-1]], cuts - cuts[0]
    return hilbert_keys(project(np.delete(part, edges[1:] - 1), edges - np.arange(len(edges))))


def packed_pieces(
    docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): a row per piece of a document in a sequence.

    All sequences but the last are full. Documents are ordered by the curve, ties by id and row; only their keys and
    lengths are sorted, in ranges that may part a group of equal keys. ``ids`` holds the piece's tokens as little-endian
    numbers of 2 bytes (4 if the vocabulary is larger). A null or empty text is the end id alone; repeated rows are
    packed each; an empty table gives no piece. The vocabulary must be in lower case and drop white space.
    """
    kind = library_encoder(vocabulary, True).kind.str
    tokens = _tokenised(docs, vocabulary, end_id, kind, id_col, text_col)
    rows = stored(tokens.withColumn("row", F.monotonically_increasing_id()), "packing-tokens")
    order = ["key", "doc_id", "row"]
    sorted_rows = (
        rows.select("row", "key", "doc_id", "n_tokens")
        .repartitionByRange(ranges_for(docs), *order)
        .sortWithinPartitions(*order)
        .select(
            "row",
            "n_tokens",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        )
    )
    placed = stored(sorted_rows, "packing-order")
    starts = with_starts(placed, placed.select("part", "n_tokens")).select("row", F.col("start").alias("at"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        width = np.dtype(kind).itemsize
        for doc_id, ids, n, at in zip(*(column.to_pylist() for column in batch.columns)):
            done = 0
            while done < n:
                length = min(n - done, size - (at + done) % size)
                piece = ids[done * width : (done + length) * width]
                out.append((doc_id, done, length, piece, n, (at + done) // size, (at + done) % size))
                done += length
        columns = [pa.array(column, field.type) for column, field in zip(zip(*out), _PIECES)]
        return pa.RecordBatch.from_arrays(columns, schema=_PIECES)

    schema = (
        "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
    return map_batches(rows.join(starts, "row").select("doc_id", "ids", "n_tokens", "at"), cut, schema, 500)


_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ]
)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32``, the checksum of their ids as unsigned 32-bit numbers, in place of the ids."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = []
        for ids, length in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist()):
            kind = "<u2" if len(ids) == 2 * length else "<u4"
            sums.append(zlib.crc32(np.frombuffer(ids, kind).astype("<u4")))
        arrays = [*batch.columns]
        arrays[3] = pa.array(sums, pa.int64())
        return pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return map_batches(pieces, step, ", ".join(f"{name} bigint" for name in names))
