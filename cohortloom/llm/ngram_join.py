"""N-gram Jaccard join: T-occurrence search with DivideSkip inside cells of documents that share a rare shingle.

Two sets that are alike enough share an element among the first few of any common order (prefix filter). With rare
shingles first, few documents meet by chance. Documents that share such a shingle form a cell; inside a cell an
inverted index is searched for documents that occur in at least T lists of the query: short lists are merged by counting,
and only what they leave possible is looked up in the long ones. Cells are searched breadth first, each document against
those not yet reached, so a group of near copies costs few searches and gives one link per document, never all pairs.

A cell of more than one block is first searched block by block, beside some members that stand in all of its blocks. What
that connects needs no search among itself any more: only the others meet all blocks, and each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .common import (
    discard,
    gram_hashes,
    hashed_words,
    list_array,
    map_batches,
    mixed,
    partitions,
    signed,
    stored,
    texts_of,
    tidied,
)
from .components import components

N, PERCENT = 5, 80
BLOCK, HUBS = 512, 32
SKETCH_BITS = 24
BROADCAST_ROWS = 1 << 20
_U = np.uint64


def shingle_set(words: np.ndarray, n: int = N) -> np.ndarray:
    """The distinct n-word shingles, sorted; of fewer words the whole sequence as one."""
    return np.unique(gram_hashes(words, min(n, len(words)))) if len(words) else np.zeros(0, _U)


def least_overlap(size: int, percent: int) -> int:
    """The smallest overlap with which a set of this size can be alike to any other: ceil(percent * size / 100)."""
    return -(-percent * size // 100)


def alike(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


# --- search -----------------------------------------------------------------------------------------------------


class Index:
    """Inverted lists over some sets: for each shingle the rising numbers of the sets that hold it."""

    def __init__(self, sets: Sequence[np.ndarray], numbers: Sequence[int]):
        sizes = [len(sets[i]) for i in numbers]
        values = np.concatenate([sets[i] for i in numbers]) if len(numbers) else np.zeros(0, _U)
        owner = np.repeat(np.array(numbers, np.int64), sizes)
        order = np.argsort(values, kind="stable")
        self.owner, values = owner[order], values[order]
        self.starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        self.keys = values[self.starts]
        self.ends = np.append(self.starts[1:], len(values))

    def lists(self, query: np.ndarray) -> list[np.ndarray]:
        """The non-empty lists of the query's shingles."""
        if not len(self.keys):
            return []
        at = np.searchsorted(self.keys, query)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == query]
        return [self.owner[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]


def _occurrences(lists: Sequence[np.ndarray], least: int, mu: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that occur in at least ``least`` lists, rising, and how often.

    The longest lists are set aside, at most least - 1 of them; the others are merged. What occurs in them often enough
    to reach ``least`` with all long lists is looked up in those.
    """
    none = np.zeros(0, np.int64)
    if len(lists) < least or least < 1:
        return none, none
    lists = sorted(lists, key=len)
    aside = min(least - 1, int(least / (mu * log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    times = np.bincount(np.concatenate(short))
    numbers = np.flatnonzero((times > 0) & (times + aside >= least))
    times = times[numbers]
    if len(numbers) and long:
        times = times + np.bincount(np.concatenate(long), minlength=numbers[-1] + 1)[numbers]
    enough = times >= least
    return numbers[enough], times[enough]


def divide_skip(lists: Sequence[Sequence[int]], least: int, mu: float = 0.01) -> dict[int, int]:
    """Numbers that occur in at least ``least`` lists, with how often."""
    numbers, times = _occurrences([np.asarray(ids, np.int64) for ids in lists], least, mu)
    return dict(zip(numbers.tolist(), times.tolist()))


def _partners(index: Index, sizes: np.ndarray, query: np.ndarray, percent: int) -> np.ndarray:
    """The numbers of the indexed sets that are alike to the query."""
    numbers, common = _occurrences(index.lists(query), least_overlap(len(query), percent))
    return numbers[alike(common, len(query), sizes[numbers], percent)]


def linked_groups(sets: Sequence[np.ndarray], percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """(i, j) links that connect the same sets as all links between alike sets do.

    Breadth first: a set that is reached searches among those not reached yet, in an index that is rebuilt when it
    has halved.
    """
    sizes = np.array([len(one) for one in sets], np.int64)
    waiting, left = np.ones(len(sets), bool), len(sets)
    index, indexed = Index(sets, range(len(sets))), left
    for root in range(len(sets)):
        if not waiting[root]:
            continue
        waiting[root], left = False, left - 1
        reached = [root]
        while reached and left:
            i = reached.pop()
            if 2 * left < indexed:
                index, indexed = Index(sets, np.flatnonzero(waiting).tolist()), left
            found = _partners(index, sizes, sets[i], percent)
            found = found[waiting[found]]
            waiting[found], left = False, left - len(found)
            reached += found.tolist()
            yield from ((i, j) for j in found.tolist())


def links_across(sets: Sequence[np.ndarray], others: Sequence[bool], percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """(i, j): for every one of the ``others`` a set j that is not among them and alike to it, if there is one."""
    sizes = np.array([len(one) for one in sets], np.int64)
    index = Index(sets, [j for j, other in enumerate(others) if not other])
    for i, other in enumerate(others):
        if other:
            yield from ((i, int(j)) for j in _partners(index, sizes, sets[i], percent)[:1])


# --- sketches ---------------------------------------------------------------------------------------------------


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of 2^k cells of a second hash, about four a cell, a byte each.

    Two sets share at most the sum of the smaller counts, so a sketch rules pairs out and never one that links. Empty
    if a count does not fit a byte: nothing is ruled out then.
    """
    bits = _cell_bits(len(shingles))
    counts = np.bincount((mixed(shingles ^ _SECOND) >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 128 else b""


_SECOND = _U(0x243F6A8885A308D3)


def _cell_bits(size: int) -> int:
    return max(6, (max(1, size // 4) - 1).bit_length())


def possible_partners(sizes: Sequence[int], sketches: Sequence[bytes], percent: int = PERCENT) -> np.ndarray:
    """Which sets, given by rising size, may be alike to another of them, as far as sizes and sketches tell."""
    sizes = np.array(sizes, np.int64)
    marked = np.zeros(len(sizes), bool)
    bits = np.array([_cell_bits(n) for n in sizes.tolist()])
    missing = np.array([not part for part in sketches])
    last = np.searchsorted(sizes * percent, sizes * 100, "right")  # sets after this one are too large
    tables: dict[int, tuple[int, np.ndarray]] = {}
    for k in np.unique(bits).tolist():
        # Larger sets have one more bit at most if they may be alike; neighbouring cells are added up.
        low, high = np.searchsorted(bits, [k, k + 2]).tolist()
        rows = np.zeros((high - low, 1 << k), np.uint8)
        for i in range(low, high):
            if sketches[i]:
                counts = np.frombuffer(sketches[i], np.uint8)
                rows[i - low] = counts if bits[i] == k else counts.reshape(-1, 2).sum(axis=1)
        tables[k] = low, rows
    for i in range(len(sizes)):
        low, rows = tables[int(bits[i])]
        others = np.arange(i + 1, last[i])
        if marked[i]:
            others = others[~marked[others]]
        if not len(others):
            continue
        most = np.minimum(rows[others - low], rows[i - low]).sum(axis=1, dtype=np.int64)
        most[missing[others] | missing[i]] = sizes[i]
        may = others[100 * most >= percent * (sizes[i] + sizes[others] - most)]
        if len(may):
            marked[may] = True
            marked[i] = True
    return marked


# --- steps ------------------------------------------------------------------------------------------------------


def _cells_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> _U(64 - SKETCH_BITS)).astype(np.int64)


def frequency_levels(texts: DataFrame, n: int) -> np.ndarray:
    """A rough logarithm of how often shingles occur, by a hash of 24 bits: 16 MB whatever the size of the corpus.

    It only orders shingles, and any order gives the same links; so tasks report outlying cells alone.
    """
    spark = texts.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                found = [shingle_set(words, n) for _, words in hashed_words(_lowered(batch.column(0).slice(at, 2000)))]
                np.add.at(counts, _cells_of(np.concatenate(found)), 1)
        cells = np.flatnonzero(counts >= 4 + 4 * counts.mean())
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(counts[cells])], ["cell", "n"])

    def pack(table: pa.Table) -> pa.Table:
        levels = np.zeros(1 << 12, np.uint8)
        levels[table["cell"].to_numpy() & 0xFFF] = np.minimum(255, 4 * np.log2(1 + table["n"].to_numpy()))
        return pa.table({"part": table["part"][:1], "levels": [levels.tobytes()]})

    sums = texts.select("text").mapInArrow(tidied(count), "cell int, n int").groupBy("cell").agg(F.sum("n").alias("n"))
    packed = sums.withColumn("part", F.shiftright("cell", 12)).groupBy("part").applyInArrow(pack, "part int, levels binary")
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in packed.collect():  # at most 4096 rows of 4096 bytes
        levels[row["part"] << 12 : (row["part"] + 1) << 12] = np.frombuffer(row["levels"], np.uint8)
    return levels


ROW_KEY = "struct<x:bigint,y:bigint>"


def _row_key() -> Column:
    """128 bits that tell rows of (doc_id, text) apart: the text is hashed from two starting values."""
    return F.struct(F.xxhash64("doc_id", "text").alias("x"), F.xxhash64("text", "doc_id").alias("y"))


def _sets(rows: DataFrame, n: int) -> DataFrame:
    """(id, rid, n_shingles, content, mark, sketch): size and digest of each set; ``mark`` is half of the digest."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(words, n) for _, words in hashed_words(_lowered(batch.column(2)))]
        digests = [hashlib.blake2b(part.tobytes(), digest_size=16).digest() for part in found]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([len(part) for part in found], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([_mark(digest) for digest in digests], pa.int64()),
                pa.array([sketch(part) if len(part) else b"" for part in found], pa.binary()),
            ],
            ["id", "rid", "n_shingles", "content", "mark", "sketch"],
        )

    schema = f"id bigint, rid {ROW_KEY}, n_shingles bigint, content binary, mark bigint, sketch binary"
    return map_batches(rows, step, schema)


def _lowered(texts: pa.Array) -> list[bytes]:
    return [text.encode().lower() for text in texts.to_pylist()]


def _mark(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _shared(rows: DataFrame, levels, n: int, percent: int) -> DataFrame:
    """(key, mark, size): the prefix shingles that sets of different content share; equal sets give one row."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        order_by = levels.value
        shingles, marks, sizes = [], [], []
        for _, words in hashed_words(_lowered(batch.column(0))):
            found = shingle_set(words, n)
            length = len(found) - least_overlap(len(found), percent) + 1 if len(found) else 0
            order = np.argsort(order_by[_cells_of(found)], kind="stable")
            shingles.append(signed(found[order[:length]]))
            marks.append(np.full(length, _mark(hashlib.blake2b(found.tobytes(), digest_size=16).digest())))
            sizes.append(np.full(length, len(found), np.int32))
        columns = [pa.array(np.concatenate(column)) for column in (shingles, marks, sizes)]
        return pa.RecordBatch.from_arrays(columns, ["key", "mark", "size"])

    found = map_batches(rows.select("text"), step, "key bigint, mark bigint, size int")
    # Copies become one row in every task before they are shuffled, and one for all before a window holds them. A
    # shingle's rows come from texts that have nothing rarer to offer: a small share of all rows.
    sets = found.groupBy("key", "mark").agg(F.max("size").alias("size"))
    same = W.partitionBy("key")
    known = sets.withColumn("_low", F.min("mark").over(same)).withColumn("_high", F.max("mark").over(same))
    return known.filter(F.col("_low") != F.col("_high")).select("key", "mark", "size")


def _cells(shared: DataFrame) -> DataFrame:
    """The members of one shingle for each group of shingles that have the same ones."""
    marks = shared.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("mark")).alias("x"), F.bit_xor(F.xxhash64("mark", F.lit(1))).alias("y")
    )
    return shared.join(marks.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key")


def _parted(members: DataFrame, percent: int) -> DataFrame:
    """The members with their ``part``: by rising size, a group falls apart where a set is too large for the one before."""
    by_size = W.partitionBy("key").orderBy("size", "mark")
    gap = F.col("size") * percent > F.lag("size", 1, 0).over(by_size) * 100
    return members.withColumn("_gap", gap.cast("int")).withColumn("part", F.sum("_gap").over(by_size)).drop("_gap")


def _counted(cells: DataFrame, percent: int) -> DataFrame:
    """(key, mark, size, part, n): the parts of the cells with more than one member; ``n`` is their number."""
    counted = _parted(cells, percent).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key", "part")))
    return counted.filter(F.col("n") > 1)


def _beside_hubs(large: DataFrame, block: int) -> DataFrame:
    """(work, mark): blocks of the parts, each with the same ``HUBS`` members of its part.

    Near copies share many cells of nearly the same members: a member goes with the largest of its parts alone.
    """
    part = ["key", "part"]
    own = large.groupBy("mark").agg(F.max(F.struct("n", *part, "size")).alias("_of")).select("_of.*", "mark")
    placed = own.withColumn("_place", F.row_number().over(W.partitionBy(*part).orderBy("size", "mark")))
    placed = placed.withColumn("block", F.floor((F.col("_place") - 1) / block))
    by_hash = W.partitionBy(*part).orderBy(F.xxhash64("mark"), "mark")
    hubs = large.withColumn("_place", F.row_number().over(by_hash)).filter(F.col("_place") <= HUBS)
    beside = placed.select(*part, "block").distinct().join(hubs.select(*part, "mark"), part)
    rows = placed.select(*part, "block", "mark").unionByName(beside)
    return rows.select(F.xxhash64(*part, "block").alias("work"), "mark").distinct()


def _across(others: DataFrame, members: DataFrame, percent: int, block: int) -> DataFrame:
    """(work, mark, other): blocks of others with every block of their group's members whose sizes allow links."""

    def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        by_size = W.partitionBy("key").orderBy("size", "mark")
        rows = rows.withColumn("block", F.floor((F.row_number().over(by_size) - 1) / block))
        return rows, rows.groupBy("key", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))

    def named(bounds: DataFrame, name: str) -> DataFrame:
        return bounds.select("key", *[F.col(column).alias(f"{name}_{column}") for column in ("block", "low", "high")])

    (others, a), (members, b) = placed(others), placed(members)
    near = named(a, "a").join(named(b, "b"), "key").filter(
        (F.col("a_low") * percent <= F.col("b_high") * 100) & (F.col("b_low") * percent <= F.col("a_high") * 100)
    )
    work = near.withColumn("work", F.xxhash64("key", "a_block", "b_block", F.lit("across")))
    parts = [
        rows.join(work.select("key", F.col(f"{name}_block").alias("block"), "work"), ["key", "block"]).select("work", "mark", F.lit(other).alias("other"))
        for rows, name, other in ((others, "a", True), (members, "b", False))
    ]
    return parts[0].unionByName(parts[1])


def _work(members: DataFrame, percent: int, block: int) -> DataFrame:
    """(work, mark): groups of (key, mark, size), cut into pieces of work of at most two blocks.

    A group falls apart by sizes (``_parted``); single sets are left out. Large parts are cut into blocks of neighbouring sizes, and every two blocks whose sizes allow links are one piece of work.
    """
    inside = W.partitionBy("key", "part")
    placed = (
        _parted(members, percent).withColumn("_n", F.count(F.lit(1)).over(inside))
        .filter(F.col("_n") > 1)
        .withColumn("block", F.floor((F.row_number().over(inside.orderBy("size", "mark")) - 1) / block).cast("int"))
    )
    key = ["key", "part"]
    blocks = placed.groupBy(*key, "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    left = blocks.select(*key, F.col("block").alias("a"), F.col("high"))
    right = blocks.select(*key, F.col("block").alias("b"), F.col("low"))
    near = left.join(right, key).filter((F.col("a") <= F.col("b")) & (F.col("low") * percent <= F.col("high") * 100))
    work = near.select(*key, F.xxhash64(*key, "a", "b").alias("work"), F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    return placed.join(work, [*key, "block"]).select("work", "mark")


def _apart(large: DataFrame, known: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, mark, size, main, outside): what is left to search when ``labels`` (id, component) connects many members.

    ``main`` is the commonest component of the part, ``key`` stands for the part. Parts that one component holds are done.
    """
    part = ["key", "part"]
    named = lookup_join(large.join(known.select("mark", "id"), "mark"), labels, ["id"], "left")
    named = named.withColumn("component", F.coalesce("component", "id"))
    counts = named.groupBy(*part, "component").agg(F.count(F.lit(1)).alias("m"))
    main = counts.groupBy(*part).agg(F.max(F.struct("m", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("kinds"))
    split = named.join(main.filter("kinds > 1"), part).withColumn("outside", F.col("component") != F.col("main"))
    return split.select(F.xxhash64(*part).alias("key"), "mark", "size", "main", "outside")


def _together(rows: DataFrame) -> DataFrame:
    """The rows of a piece of work one behind the other in one task."""
    return rows.repartition(partitions(rows.sparkSession), "work").sortWithinPartitions("work")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one piece of work after the other."""
    current, rows = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[0] != current and rows:
                yield rows
                rows = []
            current = row[0]
            rows.append(row)
    if rows:
        yield rows


def _promising(work: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(key, mark, size): the members that may link to another of their piece, by their sketches; texts stay behind.

    ``key`` is the smallest id among them. Pieces with the same smallest document become one group, so near copies that
    share many cells are not compared in each of them.
    """

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches):
            rows.sort(key=lambda row: row[3])
            stay = possible_partners([row[3] for row in rows], [row[4] for row in rows], percent)
            found = [row for row, yes in zip(rows, stay.tolist()) if yes]
            if found:
                key = min(row[1] for row in found)
                columns = [[key] * len(found), [row[2] for row in found], [row[3] for row in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "mark", "size"])

    rows = known.join(work, "mark").select("work", "id", "mark", "size", "sketch")
    return _together(rows).mapInArrow(tidied(sift), "key bigint, mark bigint, size bigint").distinct()


def _links(named: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links found by searching every piece of work, given as stored (work, rid, id, other).

    Where some rows of a piece are ``other``, these are searched for among the rest, which is connected; else every row is.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            texts = [row[2].encode().lower() for row in piece]
            sets = [shingle_set(words, n) for _, words in hashed_words(texts)]
            order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
            others, ordered = [piece[i][3] for i in order], [sets[i] for i in order]
            found = list(links_across(ordered, others, percent) if any(others) else linked_groups(ordered, percent))
            ends = [pa.array([piece[order[pair[side]]][1] for pair in found], pa.int64()) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    needed = named.select("rid").distinct()
    if named.count() <= BROADCAST_ROWS:  # 16 bytes each; beyond that the texts are shuffled to them
        needed = F.broadcast(needed)
    # However often a row is repeated, its text comes once, and once for a task before it is shuffled.
    texts = rows.select("rid", "text").join(needed, "rid", "left_semi").dropDuplicates(["rid"])
    texts = texts.join(named, "rid").select("work", "id", "text", "other")
    return _together(texts).mapInArrow(tidied(search), "a bigint, b bigint").distinct()


def similar_documents(
    docs: DataFrame, n: int = N, percent: int = PERCENT, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id): for every row the smallest id reachable by links, itself included.

    Two texts link when the Jaccard similarity of their sets of lower-case n-word shingles is at least ``percent`` per
    cent; equal sets always do. The result is exact. Null and empty texts, and texts without a word, have 0 shingles
    and no links. Repeated rows give the same result; rows that share an id are one document, and rows without an id
    come before all others in order, with a null component. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    lowest = -(1 << 63)
    rows = texts_of(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(lowest)).alias("id"), _row_key().alias("rid"), "text"
    )
    levels = spark.sparkContext.broadcast(frequency_levels(rows, n))  # 16 MB
    sets = stored(_sets(rows, n), "shingle-sets")
    # Of rows with equal sets the one with the smallest id stands for all.
    known = (
        sets.filter(F.col("n_shingles") > 0)
        .groupBy("content", "mark")
        .agg(
            F.min(F.struct("id", "rid")).alias("first"),
            F.any_value("n_shingles").alias("size"),
            F.any_value("sketch").alias("sketch"),
        )
        .select("mark", "first.id", "first.rid", "size", "sketch")
    )
    known = stored(known, "distinct-sets")
    shared = stored(_shared(rows, levels, n, percent), "shared-shingles")
    cells = stored(_counted(_cells(shared), percent), "cells")
    discard(shared)

    def search(work: DataFrame, purpose: str) -> DataFrame:
        named = stored(work.join(known.select("mark", "rid", "id"), "mark").select("work", "rid", "id", "other"), "work")
        links = stored(_links(named, rows, n, percent), purpose)
        discard(named)
        return links

    # A part of one block is one piece of work.
    work = cells.filter(F.col("n") <= block).select(F.xxhash64("key", "part").alias("work"), "mark")
    large = cells.filter(F.col("n") > block)
    first, split = None, None
    if not large.isEmpty():
        first = search(_beside_hubs(large, block).withColumn("other", F.lit(False)), "first-links")
        split = stored(_apart(large, known, components(first, "a", "b")), "apart")
        # Members outside the main component meet each other here, and the main component below.
        work = work.unionByName(_work(split.filter("outside").select("key", "mark", "size"), percent, block))
    groups = stored(_promising(work, known, percent), "promising")
    work = _work(groups, percent, block).withColumn("other", F.lit(False))
    if split is not None:
        by_main = split.select(F.col("main").alias("key"), "mark", "size", "outside").distinct()
        work = work.unionByName(_across(by_main.filter("outside"), by_main.filter("NOT outside"), percent, block))
    links = search(work, "links")
    discard(groups, cells)
    if split is None:
        reached = components(links, "a", "b")
    else:
        reached = components(links.unionByName(first), "a", "b")
        discard(split, first)
    discard(links, known)
    # Of rows with equal sets the smallest id is their node.
    nodes = sets.filter(F.col("n_shingles") > 0).groupBy("content").agg(F.min("id").alias("node"))
    known = lookup_join(sets.select("id", "n_shingles", "content"), nodes, ["content"], "left")
    labelled = lookup_join(known, reached.select(F.col("id").alias("node"), "component"), ["node"], "left")
    smallest = F.coalesce("component", "node", "id")
    return labelled.select(
        F.nullif("id", F.lit(lowest)).alias("doc_id"), "n_shingles", F.nullif(smallest, F.lit(lowest)).alias("component_id")
    )
