"""Whitening against a plain eigendecomposition in numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import queries, whitening

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain(rows, components=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} for rows of one length."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, x in kept:
        moved = n * np.array(x, dtype=object) - sums
        for k in range(components):
            e, u = values[-1 - k], vectors[:, -1 - k]
            out.setdefault((i, k + 1), []).append((n, int((moved**2).sum()), abs(float((moved / n).astype(float) @ u) / math.sqrt(e)), e / values.sum()))
    return out


def check(got, want):
    assert sum(map(len, want.values())) == len(got)
    for row in got:
        n, deviation, size, explained = next(x for x in want[row.vec_id, row.component] if x[1] == row.deviation)
        assert row.n == n
        assert abs(row.whitened) == pytest.approx(size, abs=1e-9)
        assert row.explained == pytest.approx(explained, rel=1e-10)
        assert row.identity_error < 1e-10


def test_query(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    found = queries.op13_whitening(spark, SMALL)
    assert found.columns == COLUMNS
    check(found.collect(), plain([(r.vec_id, r.embedding) for r in table]))


def vectors(seed, n, d):
    draw = np.random.default_rng(seed)
    return (draw.standard_normal((n, d)) @ np.diag(np.linspace(3, 0.2, d))).astype(np.float32).tolist()


def test_edge_rows(spark):
    good = vectors(1, 300, 7)
    rows = [*enumerate(good), (300, None), (301, [None] * 7), (302, [math.nan, *good[0][1:]]), (303, [math.inf] * 7), (304, [-math.inf, *good[0][1:]])]
    rows += [(305, []), (None, good[3]), (7, good[8]), (0, good[0])]
    rows += [(1000 + i, good[5]) for i in range(200)]  # a third of the rows is one vector
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    clash = docs.select("*", *[F.lit(1).alias(name) for name in ("v", "x", "dims", "n", "k", "component", "whitened", "count")])
    got = whitening.whitened(clash).collect()
    assert {r.n for r in got} == {300}
    check(got, plain(rows))
    assert len({r.deviation for r in got if r.vec_id == 7}) == 2  # one id, two vectors
    signs = {}
    for r in got:  # the same component, with the same sign, for equal vectors
        if r.vec_id in (5, 1000, 1199):
            signs.setdefault(r.component, set()).add(r.whitened)
    assert all(len(found) == 1 for found in signs.values())


def test_few_or_equal_vectors(spark):
    def count(rows):
        return whitening.whitened(spark.createDataFrame(rows, SCHEMA)).count()

    assert count([]) == count([(1, None), (2, [])]) == count([(1, [1.0, 2.0])]) == count([(i, [1.0, 2.0]) for i in range(9)]) == 0
    assert count([(1, [1.0, 2.0, 0.0]), (2, [3.0, 4.0, 0.0]), (3, [5.0, 6.0, 0.0])]) == 3  # one dimension only
    mixed = [*enumerate(vectors(2, 50, 5)), *[(100 + i, v) for i, v in enumerate(vectors(3, 20, 6))]]
    assert count(mixed) == 200  # the commonest length


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e9, float(i % 5), 2.0 * (i % 7), 0.25 * (i % 3), 1e-3 * i]) for i in range(60)]
    check(whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect(), plain(rows))
    wide = [(i, [1e12 * (i % 4), float(i), 0.5 * (i % 3)]) for i in range(20)]
    got = whitening.whitened(spark.createDataFrame(wide, SCHEMA)).collect()
    assert len(got) > 0 and any(r.deviation is None for r in got)


def symmetric(values, seed=0):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("seed", range(5))
def test_inertia_counts(seed):
    a = symmetric(np.random.default_rng(seed).standard_normal(40) * 10, seed)
    values = np.linalg.eigvalsh(a)
    for shift in [*(values[:-1] + values[1:]) / 2, -1e3, 1e3, 0.0]:
        assert whitening.count_above(a, shift) == (values > shift).sum()


@pytest.mark.parametrize(
    "values",
    [np.arange(1.0, 65.0), np.r_[np.ones(60), 5, 5, 5, 5], np.r_[np.ones(62), 7, 7], np.full(10, 3.0), np.r_[np.zeros(8), 1, 2], 10.0 ** np.linspace(-12, 3, 30), np.r_[1 + 1e-6 * np.arange(20)]],
)
def test_feast_finds_all_of_the_interval(values):
    a = symmetric(values, 3)
    a = (a + a.T) / 2
    want, vectors = np.linalg.eigh(a)
    low, high, count = whitening.leading_interval(a, 4)
    found, basis = whitening.feast(a, low, high, count)
    assert count == (want > low).sum() >= min(4, (want > 1e-9).sum())
    assert np.allclose(found, want[::-1][:count], rtol=1e-12, atol=1e-13 * want.max())
    assert np.allclose(basis.T @ basis, np.eye(count), atol=1e-12)
    assert np.linalg.norm(a @ basis - basis * found) <= 1e-11 * want.max()


def test_feast_reports_a_wrong_count():
    a = symmetric(np.arange(1.0, 11.0))
    with pytest.raises(ArithmeticError):
        whitening.feast(a, 7.5, 11.0, 2)
