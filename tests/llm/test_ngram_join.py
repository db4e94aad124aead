"""The n-gram join against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import ngram_join
from cohortloom.llm.components import components
from tests.llm import plain
from tests.llm.plain import EDGE_TEXTS, edge_docs, edited, empty_docs, sentence


def check(spark, rows, **options):
    docs = edge_docs(spark, rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs, **options).collect()}
    sets = {i: plain.shingles(text) for i, text in rows}
    want = plain.components(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_edge_rows(spark):
    rows = [(i, text) for i, text in EDGE_TEXTS if i is not None]
    check(spark, rows)
    every = ngram_join.similar_documents(edge_docs(spark)).collect()
    assert len(every) == len(EDGE_TEXTS)
    assert [r.component_id for r in every if r.doc_id is None] == [None]
    assert ngram_join.similar_documents(empty_docs(spark)).collect() == []


@pytest.mark.parametrize("block", [4, 512])
def test_large_groups_and_common_passages(spark, block):
    """Chains of near copies, many exact copies, and a passage that a third of the documents share."""
    passage = sentence(77, 30)
    rows, base = [], sentence(5, 120)
    for i in range(60):
        rows.append((i, edited(base, i, i % 6)))
    for i in range(60, 100):
        rows.append((i, base.upper()))
    for i in range(100, 160):
        rows.append((i, sentence(i, 60 + i % 50) + " " + passage))
    chain = sentence(9, 100)
    for i in range(160, 200):
        chain = edited(chain, i, 2)
        rows.append((i, chain))
    random.Random(1).shuffle(rows)
    check(spark, rows, block=block)


def test_divide_skip_equals_counting():
    draw = random.Random(3)
    for _ in range(300):
        lists = [sorted(draw.sample(range(30), draw.randint(1, 30))) for _ in range(draw.randint(0, 25))]
        least = draw.randint(1, 12)
        times = {i: sum(i in ids for ids in lists) for i in range(30)}
        want = {i: n for i, n in times.items() if n >= least}
        for mu in (0.0001, 0.01, 1.0):
            assert ngram_join.divide_skip(lists, least, mu) == want


def test_links_connect_what_all_links_connect():
    draw = np.random.Generator(np.random.PCG64(4))
    for _ in range(30):
        pool = np.unique(draw.integers(0, 1 << 60, 40).astype(np.uint64))
        sets = [np.sort(draw.choice(pool, draw.integers(25, len(pool)), replace=False)) for _ in range(25)]
        want = plain.components({i: set(s.tolist()) for i, s in enumerate(sets)})
        parent = list(range(len(sets)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in ngram_join.linked_groups(sets):
            p, q = find(a), find(b)
            assert p != q  # no link more than needed
            parent[max(p, q)] = min(p, q)
        assert {i: find(i) for i in want} == want


def test_any_order_of_shingles_gives_the_same_links(spark, monkeypatch):
    rows = [(i, edited(sentence(5, 80), i, i % 5)) for i in range(30)]
    levels = np.random.Generator(np.random.PCG64(6)).integers(0, 255, 1 << ngram_join.SKETCH_BITS).astype(np.uint8)
    monkeypatch.setattr(ngram_join, "frequency_levels", lambda texts, n: levels)
    check(spark, rows)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (7, 3)]
    random.Random(2).shuffle(edges)
    frame = spark.createDataFrame(edges, "a BIGINT, b BIGINT")
    got = {r.id: r.component for r in components(frame, "a", "b").collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1400)}
    assert components(frame.limit(0), "a", "b").collect() == []


def test_sketches_never_rule_out_a_link():
    draw = np.random.Generator(np.random.PCG64(9))
    pool = draw.integers(0, 1 << 62, 3000).astype(np.uint64)
    for n in (1, 5, 60, 250, 270, 900):
        base = np.unique(draw.choice(pool, n))
        sets = [base]
        for _ in range(25):
            keep = base[draw.random(len(base)) < draw.uniform(0.7, 1)]
            sets.append(np.unique(np.concatenate([keep, draw.choice(pool, draw.integers(0, 1 + n // 5))])))
        sets = sorted((s for s in sets if len(s)), key=len)
        marked = ngram_join.possible_partners([len(s) for s in sets], [ngram_join.sketch(s) for s in sets])
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if i != j and ngram_join.alike(len(np.intersect1d(a, b)), len(a), len(b), 80):
                    assert marked[i] and marked[j]
    strangers = [np.unique(draw.integers(0, 1 << 62, 500).astype(np.uint64)) for _ in range(40)]
    assert not ngram_join.possible_partners([500] * 40, [ngram_join.sketch(s) for s in strangers]).any()


def test_repeated_rows_beside_a_near_copy(spark):
    """A third of the rows is one repeated row; its text reaches the search once, its set the window once."""
    base = plain.sentence(31, 120)
    rows = [(7, base)] * 3000 + [(3, plain.edited(base, 2, 1))] + [(100 + i, plain.sentence(1000 + i, 60)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = ngram_join.similar_documents(docs).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id in (3, 7)} == {3}
    keyed = ngram_join.texts_of(docs).select(F.col("doc_id").alias("id"), ngram_join._row_key().alias("rid"), "text")
    levels = spark.sparkContext.broadcast(np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8))
    shared = ngram_join._shared(keyed, levels, 5, 80)
    assert shared.groupBy("key").count().agg(F.max("count")).first()[0] == 2


def test_work_grows_with_the_members_of_a_group(spark, monkeypatch):
    """Rows of all pieces of work, for one group of near copies of several blocks; with pairs of blocks they grew 16 times."""
    sizes, kept = [], ngram_join.stored

    def counting(frame, purpose):
        out = kept(frame, purpose)
        if purpose == "work":
            sizes[-1] += out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", counting)
    base = sentence(5, 200)
    for many in (100, 400):
        sizes.append(0)
        docs = edge_docs(spark, [(i, edited(base, i, 1 + i % 3)) for i in range(many)])
        got = ngram_join.similar_documents(docs, block=32).collect()
        assert {r.component_id for r in got} == {0}
    assert sizes[1] < 8 * sizes[0]


def test_members_outside_the_main_component_meet_all_of_it(spark):
    """Far copies that link to few members, to each other, or to none, beside a group of many blocks."""
    base = sentence(8, 150)
    near = [(i, edited(base, i, i % 3)) for i in range(120)]
    far = [(200 + i, edited(base, 300 + i, 5 + i)) for i in range(12)]
    pairs = [(300 + i, edited(edited(base, 500 + i // 2, 14), 600 + i, i % 2)) for i in range(12)]
    rows = near + far + pairs
    random.Random(4).shuffle(rows)
    for block in (4, 16):
        check(spark, rows, block=block)


def test_links_across_find_every_other_with_a_partner():
    draw = np.random.Generator(np.random.PCG64(11))
    pool = np.unique(draw.integers(0, 1 << 60, 45).astype(np.uint64))
    for _ in range(30):
        sets = [np.sort(draw.choice(pool, draw.integers(25, len(pool)), replace=False)) for _ in range(30)]
        others = (draw.random(30) < 0.4).tolist()
        found = dict(ngram_join.links_across(sets, others))
        for i in range(30):
            near = {j for j in range(30) if not others[j] and others[i]
                    and ngram_join.alike(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 80)}
            assert found[i] in near if near else i not in found
