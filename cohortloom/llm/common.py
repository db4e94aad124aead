"""Helpers the operators of this folder share: batches, words, hashes, memos, ranges of ids and scratch tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_folder, scratch_folder

# --- scratch tables ---------------------------------------------------------------------------------------------


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write the frame to the shared folder and read it back: later steps survive lost executors and do not repeat it.

    Files that a lazy result reads must outlive it, so they stay until the owner of the shared folder empties it;
    ``discard`` removes what no result needs any more.
    """
    path = scratch_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Remove the files of stored frames that nothing will read again."""
    for frame in frames:
        remove_folder(frame.sparkSession, frame._scratch_path)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of the frame has."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# --- Arrow batches ----------------------------------------------------------------------------------------------


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a null text as the empty one; all other columns, whatever their names, stay behind."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def _trimmer() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # a C library without it
        return None


def release() -> None:
    """Give what this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = _trimmer()
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, and what it has freed given back to the system.

    Python workers live on between tasks, beside a JVM and other workers that need the memory.
    """

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def map_batches(
    df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, largest: int = 2000
) -> DataFrame:
    """``step`` over Arrow batches of at most ``largest`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, largest):
                out = step(batch.slice(at, largest))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(tidied(run), schema)


# --- memo -------------------------------------------------------------------------------------------------------


class Memo(dict):
    """A dictionary that computes missing values and holds at most two generations of ``limit`` entries.

    A full generation becomes the old one; what is met again moves back. Values depend on their key alone, so the
    limit changes the time taken, never a result.
    """

    def __init__(self, compute: Callable, limit: int = 300_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.pop(key, self)
        if value is self:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteMemo:
    """Values of texts, held in two generations of together at most ``room`` bytes; long texts are not kept."""

    def __init__(self, room: int = 64 << 20, longest: int = 64):
        self.room, self.longest = room // 2, longest
        self.new, self.old, self.used = {}, {}, 0

    def values(self, names: Sequence[str], compute: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The value of every name; ``compute`` gives those of the distinct names that are not held."""
        out = list(map(self.new.get, names))
        if None not in out:
            return out
        # In the order of the texts, which lie in memory that way; a set of hundreds of thousands would jump about.
        lacking = dict.fromkeys([name for name, value in zip(names, out) if value is None])
        old = self.old
        found = {name: old[name] for name in lacking if name in old} if old else {}
        rest = [name for name in lacking if name not in found] if found else list(lacking)
        found.update(zip(rest, compute(rest)))
        out = [found[name] if value is None else value for name, value in zip(names, out)]
        kept = found
        if max(map(len, found)) > self.longest:
            kept = {name: value for name, value in found.items() if len(name) <= self.longest}
        # 150 for the two objects' heads and the entry of the dictionary, and as much for a text that is not ASCII.
        self.used += sum(map(len, kept)) + sum(map(len, kept.values())) + 200 * len(kept)
        self.new.update(kept)
        if self.used >= self.room:
            self.new, self.old, self.used = {}, self.new, 0
        return out


# --- words and their hashes -------------------------------------------------------------------------------------

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_P_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^0..p^n and their inverses modulo 2^64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for i, base in enumerate((_P, _P_INVERSE)):
            table = np.full(size, base, _U)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], equal for equal contents wherever they stand."""
    powers, inverses = _power_tables(len(values))
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(_U))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, byte codes) of the words ``[^\\x20\\x09-\\x0D]+`` of an UTF-8 text."""
    codes = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = ~_SPACE[codes]
    turns = np.flatnonzero(np.diff(inside))
    return turns[0::2], turns[1::2], codes


CHUNK = 1 << 20


def text_chunks(sizes: Sequence[int], largest: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``largest`` bytes together, from their sizes; a longer text stands alone."""
    at, size = 0, 0
    for i, more in enumerate(sizes):
        if size and size + more > largest:
            yield at, i
            at, size = i, 0
        size += more + 1
    if at < len(sizes):
        yield at, len(sizes)


def chunk_words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts taken together: word hashes, starts, ends, byte codes, and where each text's words begin (and end)."""
    data = b"\n".join(texts)
    starts, ends, codes = word_spans(data)
    hashes = span_hashes(_BYTE[codes], starts, ends) if len(starts) else np.zeros(0, _U)
    edges = np.cumsum([0] + [len(text) + 1 for text in texts])
    return hashes, starts, ends, codes, np.searchsorted(starts, edges)


def hashed_words(texts: Sequence[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(index of a text, the 64-bit hashes of its words in order) for every text.

    Texts are hashed many at a time, so short ones cost no numpy call of their own.
    """
    for low, high in text_chunks([len(text) for text in texts]):
        hashes, _, _, _, cuts = chunk_words(texts[low:high])
        for i in range(high - low):
            yield low + i, hashes[cuts[i] : cuts[i + 1]]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = words[:n].copy()
    for i in range(1, k):
        out = out * _P + words[i : i + n]
    return mixed(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbouring values, in log2(w) passes; all values count as one window if fewer."""
    w = min(w, len(values))
    have, out = 1, values
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


# --- lists in Arrow ---------------------------------------------------------------------------------------------


def list_array(parts: Sequence[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(part) for part in parts], out=offsets[1:])
    values = np.concatenate(parts) if len(parts) else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


# --- ranges of ids ----------------------------------------------------------------------------------------------


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges_for(df: DataFrame, each: int = 64 << 20) -> int:
    """As many ranges as the session shuffles into, and more where one would get over ``each`` bytes of the files read.

    The size is the planner's, from the files' lengths; where it knows none, the session's number holds.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), -(-size // each) if size < 1 << 58 else 0)


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 rising bounds that cut the integer key into parts of about equal size."""
    shares = [i / parts for i in range(1, parts)]
    if not shares:
        return []
    accuracy = max(10_000, 20 * parts)
    found = df.agg(F.percentile_approx(key, shares, accuracy)).first()[0]
    return sorted(set(found or []))


def range_number(key: Column, bounds: Sequence[int]) -> Column:
    """How many bounds are at most the key: coarse steps first, then the bounds of one step."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [list(bounds[i : i + step]) for i in range(0, len(bounds), step)]
    literal = F.from_json(F.lit(str(groups)), "array<array<bigint>>")

    def at_most(items: Column) -> Column:
        return F.size(F.filter(items, lambda bound: bound <= key))

    coarse = F.size(F.filter(literal, lambda group: F.get(group, F.lit(0)) <= key))
    inner = F.get(literal, coarse - 1)
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + at_most(inner)).cast("int")
