"""The trie of conversation prefixes against a plain one."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import prefix_trie, queries
from cohortloom.llm.ordered_scan import prefix_scan
from tests.llm.plain import words
from tests.oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def digest(role, text):
    who, said = role.encode(), text.encode()
    found = hashlib.blake2b(b"%d:%b%b" % (len(who), who, said), digest_size=16).digest()
    return tuple(np.frombuffer(found, "<i8").tolist())


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, digest(role, text), role, text))
    turns = {conv: [(role, text) for *_, role, text in sorted(found)] for conv, found in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(turns):
        h = zlib.crc32(str(conv).encode()) % 4
        path = tuple(turns.get(conv - conv % 20, [])[:h] + turns[conv][h:])
        ends[path].append(conv)
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, found in members.items():
        if path:
            children[path[:-1]] += 1
    for path, found in members.items():
        tokens = (len(found) - 1) * len(words(path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += tokens
            leaves[path[:d]] += not children[path]
    return sorted(
        (
            min(found), len(path), min(members[path[:-1]]) if path else -1, len(found), children[path], leaves[path], saved[path],
            hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest(),
        )
        for path, found in members.items()
    )


def trie(spark, rows, extra=()):
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = prefix_trie.prefix_trie(table.select("*", *[F.lit(7).alias(name) for name in extra]))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if i == 2 and v is None else v for i, v in enumerate(row)) for row in found.collect())


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def noisy_rows():
    draw = random.Random(5)
    rows = []
    for conv in [*range(0, 130), 1000, 1001, 1013]:
        if conv in (40, 41, 42):
            continue
        first = draw.randrange(3)
        for turn in range(draw.randint(1, 7)):
            rows.append((conv, turn + first, draw.choice(["user", "assistant", None]), draw.choice(["a b", "c", "", None, "d  e\nf", "é"])))
    rows += [(7, None, "user", "no turn"), (7, None, "system", "no turn either"), (8, 1, "user", "same turn"), (8, 1, "user", "same"), (8, 1, "user", "same")]
    rows += [(None, 1, "user", "no conversation"), (None, None, None, None), (45, 0, "user", "alone"), (61, 3, None, None)]
    return rows


def test_equals_the_plain_trie(spark, many_partitions):
    rows = noisy_rows()
    assert trie(spark, rows) == plain_trie(rows)


def test_clashing_columns_and_empty_tables(spark):
    rows = noisy_rows()[:60]
    names = ["conv", "words", "t1", "t2", "a", "b", "idx", "depth", "last", "part", "place", "path", "leaves", "saved", "digest", "open", "end"]
    assert trie(spark, rows, names) == plain_trie(rows)
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []


def test_long_and_common_conversations(spark, many_partitions):
    """One conversation holds a third of the rows; a third of the others are equal, so one node ends a third of the ids."""
    long = [(500, i, "user", f"turn {i % 9}") for i in range(700)]
    branch = [(503, i, "user", f"turn {i % 9}" if i < 630 else "else") for i in range(640)]
    same = [(1000 + i, 0, "user", "hello there") for i in range(900)]
    other = [(5000 + i, j, "user", f"hi {i % 50} {j * (i % 7)}") for i in range(300) for j in range(3)]
    rows = long + branch + same + other
    got = trie(spark, rows)
    assert max(row[1] for row in got) >= 640
    assert got == plain_trie(rows)


def test_scan_over_borders(spark, many_partitions):
    draw = random.Random(1)
    sizes = [1, 1, 500, 2, 1, 1300, 3]
    rows = [(g, i, draw.getrandbits(63), draw.getrandbits(62)) for g, size in enumerate(sizes) for i in range(size)]
    table = spark.createDataFrame(rows, "g bigint, i bigint, t1 bigint, t2 bigint").repartition(5)
    got = {(r.g, r.i): r for r in prefix_scan(table, "g", [F.col("i")], "test-scan").collect()}
    p, size = 0x9E3779B97F4A7C15, 1 << 64
    sums = defaultdict(lambda: [0, 0])
    for g, i, t1, t2 in rows:
        sums[g] = [(s + t * pow(p, i, size)) % size for s, t in zip(sums[g], (t1, t2))]
        row = got[g, i]
        assert (row.idx, row.s1 % size, row.s2 % size, row.last) == (i, *sums[g], i == sizes[g] - 1)


def test_matches_sql(spark):
    assert compare(queries.op12_prefix_trie(spark, SMALL), connect(SMALL), queries.ORACLES["op12_prefix_trie"]) is None


def test_rows_grow_by_the_band_only(spark):
    """No stage makes more than BAND rows of a node, however deep the conversation is."""
    rows = [(1, i, "user", f"t{i}") for i in range(2000)]
    table = prefix_trie.rebuilt_turns(spark.createDataFrame(rows, SCHEMA)).cache()
    assert prefix_trie._pairs(table, 1).count() <= prefix_trie.BAND * 2001
    assert prefix_trie._pairs(table, prefix_trie.BAND).count() <= 2001
    table.unpersist()
