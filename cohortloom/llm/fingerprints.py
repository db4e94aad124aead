"""Document fingerprints by winnowing: the least hash of every window of k-grams, the rightmost of equal ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    gram_hashes, list_array, map_batches, mixed, partitions, range_bounds, range_number, signed, texts_of, window_minima,
)

K, WINDOW = 25, 40
_U = np.uint64
_SEGMENT = 1 << 22


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """A fixed 64-bit number for each code point."""
    return mixed(np.arange(0x110000, dtype=_U) + _U(0x5851F42D4C957F2D))


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions picked from the k-gram hashes: in every w neighbours the least, rightmost if several are least.

    Fewer than w hashes count as one window. Long texts are taken in segments that overlap by w - 1.
    """
    picked = []
    for at in range(0, max(len(hashes) - w, 0) + 1, _SEGMENT):
        part = hashes[at : at + _SEGMENT + w - 1]
        if not len(part):
            continue
        # Upper bits of the hash, then the place counted from the right: the least key is the rightmost least hash.
        place = np.arange(len(part) - 1, -1, -1, dtype=_U)
        least = window_minima((part & ~_U((1 << 23) - 1)) | place, w)
        chosen = np.unique(least) & _U((1 << 23) - 1)
        picked.append(at + len(part) - 1 - chosen.astype(np.int64))
    return np.unique(np.concatenate(picked)) if picked else np.zeros(0, np.int64)


def fingerprint(text: str, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the fingerprint, in order of positions; positions are code points from 0.

    Two texts that share a passage of at least w + k - 1 code points share at least one hash, at the same place of the
    passage. A text with fewer than k code points has one hash, of the whole text; an empty one has none.
    """
    codes = _letters()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    if not len(codes):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    hashes = gram_hashes(codes, min(k, len(codes)))
    places = winnow(hashes, w)
    return hashes[places], places


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes: size of the intersection over size of the union; two empty sets are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def digits(hashes: np.ndarray) -> str:
    """The fingerprint as text: 8 hexadecimal digits of each hash, in order of positions."""
    return (hashes >> _U(32)).astype(">u4").tobytes().hex()


def document_fingerprints(
    docs: DataFrame, k: int = K, w: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, hashes, positions) of every whole text: a map over rows.

    A null text is empty and has empty lists; repeated rows, null ids and ties stay; other columns are not read.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(text, k, w) for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                list_array([signed(h) for h, _ in found], pa.int64()),
                list_array([p for _, p in found], pa.int64()),
            ],
            ["doc_id", "hashes", "positions"],
        )

    schema = "doc_id bigint, hashes array<bigint>, positions array<bigint>"
    return map_batches(texts_of(docs, id_col, text_col), step, schema)


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, doc_id, text, border) laid out so that each row's next one, by falling id, follows it in its task.

    Ids are cut into as many ranges as there are shuffle partitions, by percentiles. The first row of each range is
    also sent behind the last row of the range above, marked as ``border``; the very first row follows the very last.
    Texts are shuffled once. Null ids come last; rows with equal ids are ordered by text. The driver sees the bounds
    and the first id of each range, so as many numbers as there are partitions.
    """
    spark = docs.sparkSession
    lowest = F.lit(-(1 << 63))
    rows = texts_of(docs, id_col, text_col).withColumn("_key", F.coalesce("doc_id", lowest))
    bounds = range_bounds(rows, "_key", partitions(spark))
    ranged = rows.withColumn("bucket", range_number(F.col("_key"), bounds))
    heads = {r["bucket"]: r["head"] for r in ranged.groupBy("bucket").agg(F.max("_key").alias("head")).collect()}
    used = sorted(heads)
    above = {b: used[(i + 1) % len(used)] for i, b in enumerate(used)}
    n = len(bounds) + 1
    head = F.get(F.from_json(F.lit(str([heads.get(b, 0) for b in range(n)])), "array<bigint>"), F.col("bucket"))
    other = F.get(F.from_json(F.lit(str([above.get(b, 0) for b in range(n)])), "array<int>"), F.col("bucket"))

    def place(bucket, border: bool):
        return F.struct(bucket.alias("bucket"), F.lit(border).alias("border"))

    own = place(F.col("bucket"), False)
    places = F.when(F.col("_key") == head, F.array(own, place(other, True))).otherwise(F.array(own))
    laid = ranged.withColumn("_place", F.explode(places)).select("_place.*", "_key", "doc_id", "text")
    return (
        laid.repartitionById(n, "bucket")
        .sortWithinPartitions("border", F.col("_key").desc(), "text")
        .select("doc_id", "text", "border")
    )


def edit_and_next(
    docs: DataFrame, k: int = K, w: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every text's fingerprint beside those of its edited text and of the next document.

    The edited text ends in the start of the next document's text (see ``beside_next``): its last floor(n/2) code
    points are replaced by the next text's first as many, or all of them if it has fewer. Every row gives one row; of a
    single row the next is the row itself. An empty text has an empty fingerprint; its likeness to an empty one is 1.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, border in zip(*(column.to_pylist() for column in batch.columns)):
                hashes, _ = fingerprint(text, k, w)
                if waiting is not None:
                    rows.append(_compared(*waiting, text, hashes, k, w))
                # Only the first border row is a next one; more of them are repeated ids.
                waiting = None if border else (doc_id, text, hashes)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, field.type) for column, field in zip(zip(*rows), _RESULT)], schema=_RESULT
                )

    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return beside_next(docs, id_col, text_col).mapInArrow(step, schema)


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]
)


def _compared(doc_id, text: str, own: np.ndarray, following: str, beside: np.ndarray, k: int, w: int) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    hashes, _ = fingerprint(edited, k, w)
    return (
        doc_id,
        len(text),
        hashlib.sha256(edited.encode()).hexdigest(),
        digits(own),
        digits(hashes),
        likeness(own, hashes),
        likeness(own, beside),
    )
