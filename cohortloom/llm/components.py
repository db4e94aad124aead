"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .common import discard, stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): for every node of the edges the smallest id of its component. Ids are integers, not null.

    Alternates two steps until nothing changes: all larger neighbours of a node move to its smallest neighbour, then
    all smaller ones do. The number of rounds grows with the logarithm of the longest path; every round is written to
    the shared folder, and the driver sees a count and a checksum.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    current, before = stored(pairs, "edges"), None
    while (mark := _mark(current)) != before:
        before, last = mark, current
        current = stored(_small(_large(last)), "edges")
        discard(last)
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is tied to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = lookup_join(both.filter("v > u"), least, ["u"])
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every neighbour smaller than a node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = lookup_join(down, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).filter("u != v").distinct()
