"""A trie of conversation prefixes, rolled up in depth bands.

Conversations are rebuilt as ordered turns; the running hash of a conversation's turns names the node of each prefix.
Sums over subtrees are taken in bands of a fixed height: a node's values go to its ancestors inside its band only, so a
row becomes at most ``BAND`` rows. The roots of the bands then hold their band's sums and form a tree ``BAND`` times
lower, whose totals are found the same way, and the completed totals of band roots go to the nodes of the band above.
The number of rounds is the logarithm of the greatest depth to the base ``BAND``.

Edge cases: rows without a conversation id belong to no conversation and are left out; null roles and texts are empty;
turns of the same number stand in the order of their digest; repeated rows are turns each; an empty table has no node;
columns other than conv_id, turn, role and text stay behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .common import discard, map_batches, partitions, stored
from .ordered_scan import prefix_scan

BAND = 8
HEADS = 3  # the longest shared beginning


def turn_hashes(conversations: DataFrame) -> DataFrame:
    """(conv, turn, t1, t2, words): 128 bits of the digest of role and text, and the number of words of the text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, words = [], []
        for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            who, said = role.encode(), text.encode()
            digests.append(hashlib.blake2b(b"%d:%b%b" % (len(who), who, said), digest_size=16).digest())
            words.append(len(said.split()))
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        arrays = [batch.column(0), batch.column(1), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(words, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["conv", "turn", "t1", "t2", "words"])

    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).filter("conv IS NOT NULL")
    return map_batches(turns, step, "conv bigint, turn bigint, t1 bigint, t2 bigint, words bigint")


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its twenty."""
    return F.crc32(conv.cast("string").cast("binary")) % (HEADS + 1)


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """(conv, words, depth, a, b, last): the node of every prefix of every rebuilt conversation, the empty one included."""
    turn = F.col("turn").asc_nulls_first()
    own = prefix_scan(turn_hashes(conversations), "conv", [turn, F.col("t1"), F.col("t2")], "trie-turns")
    own = stored(own.select("conv", "idx", "t1", "t2", "words"), "trie-own")
    convs = own.filter("idx = 0").select("conv")
    # At most three turns a conversation.
    bases = own.filter((F.col("idx") < HEADS) & (F.pmod("conv", F.lit(20)) == 0)).groupBy(F.col("conv").alias("base"))
    heads = bases.agg(F.collect_list(F.struct("idx", "t1", "t2", "words")).alias("turns"))
    taken = convs.withColumn("base", F.col("conv") - F.pmod("conv", F.lit(20))).join(heads, "base")
    first = taken.select("conv", F.explode("turns").alias("x")).filter(F.col("x.idx") < shared_turns(F.col("conv")))
    rows = (
        first.select("conv", (F.col("x.idx") + 1).alias("seq"), "x.t1", "x.t2", "x.words")
        .unionByName(
            own.filter(F.col("idx") >= shared_turns(F.col("conv"))).select(
                "conv", (F.col("idx") + HEADS + 1).alias("seq"), "t1", "t2", "words"
            )
        )
        .unionByName(convs.select("conv", *[F.lit(0).cast("bigint").alias(name) for name in ("seq", "t1", "t2", "words")]))
    )
    found = prefix_scan(rows, "conv", [F.col("seq")], "trie-rebuilt")
    return found.select("conv", "words", F.col("idx").alias("depth"), F.col("s1").alias("a"), F.col("s2").alias("b"), "last")


def _pairs(rows: DataFrame, unit: int) -> DataFrame:
    """(a, b, up_a, up_b, distance, root): each node whose depth is a multiple of ``unit`` with its ancestors of that sort.

    They reach from the node's band root to its parent; a band root gets the whole band above. Groups are one band of
    one conversation, so of at most BAND + 1 rows, and equal pairs of conversations become one before they are shuffled.
    """
    place = (F.col("depth") / unit).cast("bigint")
    band = (place / BAND).cast("bigint")
    bands = F.when((place % BAND == 0) & (place > 0), F.array(band, band - 1)).otherwise(F.array(band))
    parted = rows.filter(F.col("depth") % unit == 0).select("conv", F.explode(bands).alias("band"), F.struct(place.alias("place"), "a", "b").alias("x"))
    paths = parted.groupBy("conv", "band").agg(F.array_sort(F.collect_list("x")).alias("path"))
    nodes = paths.select("path", F.explode("path").alias("x"), "band")
    above = nodes.select("x", F.explode(F.filter("path", lambda up: up.place < F.col("x.place"))).alias("up"))
    return above.groupBy(
        F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("up.a").alias("up_a"), F.col("up.b").alias("up_b")
    ).agg(
        F.max(F.col("x.place") - F.col("up.place")).alias("distance"),
        F.max(F.col("x.place") % BAND == 0).alias("root"),
    )


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("a", "b").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _raised(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """The values of nodes, handed to the ancestors they are paired with."""
    return pairs.join(values, ["a", "b"]).select(F.col("up_a").alias("a"), F.col("up_b").alias("b"), "leaves", "saved")


def subtree_totals(rows: DataFrame, values: DataFrame, deepest: int, pairs: DataFrame, unit: int = 1) -> DataFrame:
    """(a, b, leaves, saved) summed over the subtrees of the nodes whose depth is a multiple of ``unit``.

    ``values`` has (a, b, depth, leaves, saved) of those nodes and ``pairs`` their ancestors.
    """
    own = values.select("a", "b", "leaves", "saved")
    inside = _sums(own.unionByName(_raised(pairs.filter("NOT root"), own)))
    step = unit * BAND
    if deepest < step:
        return inside
    inside = stored(inside, "trie-band-sums")
    roots = values.filter(F.col("depth") % step == 0).select("a", "b", "depth").join(inside, ["a", "b"])
    upper = stored(_pairs(rows, step), "trie-band-pairs")
    totals = stored(subtree_totals(rows, roots, deepest, upper, step), "trie-band-totals")
    out = stored(_sums(inside.unionByName(_raised(pairs.filter("root"), totals))), "trie-totals")
    discard(inside, upper, totals)
    return out


CHUNK = 1 << 20


def ends_digests(rows: DataFrame) -> DataFrame:
    """(a, b, digest): SHA-256 of the ids, ascending and joined by commas, of the conversations that end at a node.

    Ids are sorted by ranges of (node, id). A node inside one partition is hashed there; the ids of a node that meets a
    border become texts of about a megabyte, which are hashed one behind the other, so no task holds or sorts all ids.
    """
    ends = rows.filter("last").select("a", "b", "conv")
    ordered = ends.repartitionByRange(partitions(rows.sparkSession), "a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    schema = "a bigint, b bigint, part int, seq bigint, text binary, digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, node, first = TaskContext.get().partitionId(), 0, None, True
        texts: list[bytes] = []  # of the node so far; written out when large
        size, cut = 0, False  # has a part of this node been written?
        out: list[tuple] = []

        def written() -> pa.RecordBatch:
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "part", "seq", "text", "digest"])

        def close(whole: bool) -> None:
            nonlocal seq, texts, size
            if whole and not cut:
                out.append((*node, None, None, None, hashlib.sha256(b",".join(texts)).hexdigest()))
            elif texts:
                out.append((*node, part, seq, b",".join(texts), None))
                seq += 1
            texts, size = [], 0

        for batch in batches:
            a, b, conv = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)]):
                here = (int(a[low]), int(b[low]))
                if here != node:
                    if node is not None:
                        close(not first)
                        first = False
                    node, cut = here, False
                texts.append(",".join(map(str, conv[low:high].tolist())).encode())
                size += len(texts[-1])
                if size > CHUNK:
                    close(False)
                    cut = True
            if len(out) > 1000 or any(row[4] is not None for row in out):
                yield written()
        if node is not None:
            close(False)
        if out:
            yield written()

    found = stored(ordered.mapInArrow(run, schema), "trie-ends")
    loose = found.filter("digest IS NULL").repartition("a", "b").sortWithinPartitions("a", "b", "part", "seq")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        out: list[tuple] = []
        for batch in batches:
            for a, b, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                if (a, b) != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (a, b), hashlib.sha256(text)
                else:
                    state.update(b"," + text)
        if node is not None:
            out.append((*node, state.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["a", "b", "digest"])

    hashed = loose.select("a", "b", "text").mapInArrow(join, "a bigint, b bigint, digest string")
    return found.filter("digest IS NOT NULL").select("a", "b", "digest").unionByName(hashed)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per node."""
    rows = stored(rebuilt_turns(conversations), "trie-rows")
    nodes = rows.groupBy("a", "b").agg(
        F.max("depth").alias("depth"),
        F.min("conv").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("words").alias("words"),
        F.sum(F.col("last").cast("bigint")).alias("n_ends"),
    )
    # All members end at a node without children.
    nodes = nodes.withColumns(
        {
            "leaves": (F.col("n_ends") == F.col("n_convs")).cast("bigint"),
            "saved": (F.col("n_convs") - 1) * F.col("words"),
        }
    )
    nodes = stored(nodes, "trie-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    pairs = stored(_pairs(rows, 1), "trie-pairs")
    totals = subtree_totals(rows, nodes, deepest, pairs)

    links = pairs.filter("distance = 1").select("a", "b", "up_a", "up_b")
    children = links.groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    names = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    parents = lookup_join(links, names, ["up_a", "up_b"]).select("a", "b", "parent_conv_id")
    return (
        nodes.join(totals.withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"}), ["a", "b"])
        .join(children, ["a", "b"], "left")
        .join(parents, ["a", "b"], "left")
        .join(ends_digests(rows), ["a", "b"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )


# --- the same in SQL --------------------------------------------------------------------------------------------

SQL = """
WITH turns AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (
  SELECT conv_id, own, conv_id - (conv_id % 20) AS base,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, zero: xor(c >> 1, 3988292384::BIGINT * (c & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM turns),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.own, [])[:c.h], c.own[c.h + 1:]) AS path
  FROM crc c LEFT JOIN crc b ON b.conv_id = c.base),
prefixes AS (
  SELECT conv_id, len(path) AS len, d, path[:d] AS path FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = d) AS ends,
    count(*) = count(*) FILTER (len = d) AS leaf,
    coalesce(len(regexp_extract_all(path[d].text, '[^\\x20\\x09-\\x0D]+')), 0) AS words
  FROM prefixes GROUP BY path, d),
above AS (
  SELECT *, path[:k] AS top FROM (SELECT *, unnest(range(depth + 1)) AS k FROM nodes)),
totals AS (
  SELECT top, sum(leaf::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens,
    count(*) FILTER (depth = len(top) + 1) AS n_children
  FROM above GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, t.n_children, t.n_leaves::BIGINT AS n_leaves,
  t.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN totals t ON t.top = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]
"""
