"""Repeated passages against a plain search of all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from cohortloom.llm import substring
from cohortloom.llm.common import gram_hashes
from tests.llm import plain
from tests.llm.plain import EDGE_TEXTS, edge_docs, empty_docs, sentence, words


def check(spark, rows, **options):
    docs = edge_docs(spark, rows)
    runs = substring.repeat_runs(docs, **options)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_report(docs, runs).collect()}
    texts = dict(rows)
    kept = plain.without_repeats(texts, options.get("length", 20))
    want = {}
    for i, text in texts.items():
        n = len(words(text))
        want[i] = (n, n - len(kept[i]), hashlib.sha256(" ".join(kept[i]).encode()).hexdigest())
    assert got == want
    return docs, runs, kept


def test_edge_rows(spark):
    check(spark, [(i, text) for i, text in EDGE_TEXTS if i is not None])
    docs = edge_docs(spark)
    report = substring.removal_report(docs, substring.repeat_runs(docs)).collect()
    assert len(report) == len(EDGE_TEXTS)
    assert len({tuple(r) for r in report if r.doc_id == 4}) == 1  # repeated rows agree
    none = empty_docs(spark)
    assert substring.removal_report(none, substring.repeat_runs(none)).collect() == []


def test_shared_passages_inside_and_across(spark):
    draw = random.Random(8)
    passages = [sentence(100 + k, draw.randint(15, 60)) for k in range(8)]
    rows = []
    for i in range(80):
        parts = [sentence(500 + i, draw.randint(0, 40), 60)]
        for _ in range(draw.randint(0, 4)):
            parts += [draw.choice(passages), sentence(draw.randrange(10**6), draw.randint(0, 12), 60)]
        rows.append((draw.randrange(10**6), " ".join(parts)))
    docs, runs, kept = check(spark, rows)
    stay = {r.doc_id: r.text for r in substring.without_repeats(docs, runs).collect()}
    texts = dict(rows)
    for i, found in kept.items():
        if len(found) == len(words(texts[i])):
            assert stay[i] == texts[i]  # untouched, white space included
        elif found:
            assert stay[i] == " ".join(found)
        else:
            assert i not in stay
    assert substring.without_repeats(docs, runs).dtypes == docs.dtypes


@pytest.mark.parametrize("length, seed", [(8, 3), (20, 20), (12, 1)])
def test_other_lengths(spark, length, seed):
    rows = [(i, sentence(i % 7, 40, 12) + " " + sentence(i, 30, 9)) for i in range(40)]
    check(spark, rows, length=length, seed=seed)


def test_every_window_has_its_anchor_at_the_same_place():
    draw = np.random.Generator(np.random.PCG64(5))
    values = draw.integers(0, 30, 400).astype(np.uint64)
    places = substring._anchor_places(gram_hashes(values, 6), 15)
    by_window = {}
    for start, place in enumerate(places):
        assert start <= place <= start + 14
        window = tuple(values[start : start + 20].tolist())
        assert by_window.setdefault(window, place - start) == place - start
