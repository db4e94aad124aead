"""Statistics against plain counts, trees on labelled rows, and the monotonic features."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from cohortloom.llm import quality
from tests.llm.plain import EDGE_TEXTS, edge_docs, empty_docs, words

TEN = "/root/testdata/sf0.1"


def plain_counts(text):
    found = words(text)
    grams = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    times, covered = Counter(grams), set()
    for i, gram in enumerate(grams):
        if times[gram] > 1:
            covered |= {i, i + 1, i + 2}
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            copies += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), copies, len(covered)


def test_edge_rows(spark):
    got = quality.quality_verdicts(edge_docs(spark), None).collect()
    want = []
    for doc_id, text in EDGE_TEXTS:
        counts = plain_counts(text)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        want.append((doc_id, *counts, failed, 1.0, not failed))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert quality.quality_verdicts(empty_docs(spark), None).collect() == []


def test_without_usable_labels_there_is_no_model(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(6, 1), (None, 0), (7, None)], "doc_id BIGINT, quality INT")
    assert quality.train_on_labels(docs, labels) is None
    assert quality.train_on_labels(docs, labels.limit(0)) is None
    kept = quality.keep_good(docs, None)
    assert kept.dtypes == docs.dtypes
    verdicts = quality.quality_verdicts(docs, None).filter("kept")
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in verdicts.collect())


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = (spark.read.parquet(f"{TEN}/{name}.parquet") for name in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").orderBy("doc_id").collect()
    _, x = quality.statistics([row.text for row in rows])
    return docs, labels, x, np.array([row.quality for row in rows], float)


def test_held_out_accuracy(labelled):
    _, _, x, y = labelled
    half = np.arange(len(y)) % 2 == 0
    monotonic = {quality.FEATURES.index(name): way for name, way in quality.MONOTONIC.items()}
    trees = quality.train_trees(x[half], y[half], monotonic)
    score = trees.score(x[~half])
    assert ((score >= 0.5) == y[~half]).mean() > 0.98
    assert (score[y[~half] == 1] >= 0.5).mean() > 0.99


def test_monotonic_features_never_raise_a_score(labelled):
    _, _, x, y = labelled
    monotonic = {quality.FEATURES.index(name): way for name, way in quality.MONOTONIC.items()}
    trees = quality.train_trees(x[:1500], y[:1500], monotonic, trees=30)
    for f in monotonic:
        values = np.linspace(0, x[:, f].max(), 40)
        many = np.repeat(x[:200], len(values), axis=0)
        many[:, f] = np.tile(values, 200)
        assert (np.diff(trees.raw(many).reshape(200, -1), axis=1) <= 1e-12).all()


def test_flat_trees_equal_a_walk(labelled):
    _, _, x, y = labelled
    trees = quality.train_trees(x[:500], y[:500], {}, trees=5, depth=3)
    for row, raw in zip(x[:50], trees.raw(x[:50])):
        total = trees.start
        for t in range(5):
            at = 0
            while at < 7:
                at = 2 * at + 1 + (row[trees.feature[t, at]] > trees.threshold[t, at])
            total += trees.leaf[t, at - 7]
        assert abs(total - raw) < 1e-9


def test_training_sample_is_bounded_and_repeatable(spark, labelled):
    docs, labels, _, _ = labelled
    first = quality.train_on_labels(docs, labels, sample=300)
    second = quality.train_on_labels(docs.repartition(5), labels.repartition(3), sample=300)
    assert np.array_equal(first.leaf, second.leaf) and np.array_equal(first.threshold, second.threshold)


def test_the_driver_gets_one_row_for_each_labelled_id(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    got, collect = [], DataFrame.collect

    def counted(self):
        rows = collect(self)
        got.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    texts = [(i, f"text {i} " * (10 + i)) for i in range(40)] + [(3, f"another text {i}") for i in range(500)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    assert quality.train_on_labels(docs, labels) is not None
    assert max(got) == 40
