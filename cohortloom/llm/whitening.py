"""Whitening of embeddings; the leading components come from contour integration (FEAST).

Vectors become fixed-point integers, so that the sums behind the covariance are exact: Spark takes the distinct vectors
and adds up products of centred entries, and only the d x d covariance reaches the driver. There an interval that holds
the wanted eigenvalues is found by inertia counts; solves with the complex shifted covariance at the quadrature nodes of
a circle around it project a block of vectors onto their eigenspace; Rayleigh-Ritz extracts the components, and the
inertia count proves that none is missing. Spark then projects all vectors.

Edge cases: null vectors, and vectors with null or non-finite entries, are left out; of vectors of several lengths those
of the commonest stay (of equally common ones the longest), as covariance needs one; entries beyond 2^52 in fixed point
saturate; repeated rows are projected each but fitted once; components of an eigenvalue that is zero beside the largest
cannot be whitened and are not returned, so that equal vectors, one vector or an empty table give no rows; a deviation
that no long can hold is null. A null vec_id stays null. Other columns stay behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, stored

SCALE, LARGEST = 256.0, 1 << 52


# --- fixed-point vectors ----------------------------------------------------------------------------------------


def _packed(matrix: np.ndarray) -> list[bytes]:
    """Equal rows give equal bytes: two bytes an entry where all entries of the row fit, else eight."""
    small = (np.abs(matrix) < 1 << 15).all(axis=1)
    narrow, wide = matrix.astype("<i2"), matrix.astype("<i8")
    return [narrow[i].tobytes() if fits else wide[i].tobytes() for i, fits in enumerate(small.tolist())]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    values = column.to_pylist()
    if all(len(value) == 2 * dims for value in values):
        return np.frombuffer(b"".join(values), "<i2").reshape(-1, dims).astype(np.int64)
    return np.stack([np.frombuffer(value, "<i2" if len(value) == 2 * dims else "<i8").astype(np.int64) for value in values])


def fixed_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dims, x): floor(256 * entry) of every vector without null or non-finite entries, packed."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        vectors = batch.column(1)
        entries = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
        offsets, present = vectors.offsets.to_numpy(), vectors.is_valid().to_numpy(zero_copy_only=False)
        lengths = np.where(present, np.diff(offsets), 0)
        rows, dims, packed = [], [], []
        for length in np.unique(lengths[lengths > 0]).tolist():
            at = np.flatnonzero(lengths == length)
            found = entries[offsets[at][:, None] + np.arange(length)]
            good = np.isfinite(found).all(axis=1)
            fixed = np.clip(np.floor(SCALE * found[good]), -LARGEST, LARGEST).astype(np.int64)
            rows += at[good].tolist()
            dims += [length] * len(fixed)
            packed += _packed(fixed)
        if not rows:
            return None
        arrays = [batch.column(0).take(pa.array(rows)), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["vec_id", "dims", "x"])

    table = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return map_batches(table.filter("v IS NOT NULL"), step, "vec_id bigint, dims int, x binary", 5000)


# --- exact sums -------------------------------------------------------------------------------------------------


def _summed(parts: DataFrame, columns: int) -> list[int]:
    rows = parts.groupBy("k").agg(F.sum("v").alias("v")).collect()  # one for each of the ``columns`` sums
    out = [0] * columns
    for row in rows:
        out[row["k"]] = int(row["v"])
    return out


def _sum_rows(totals: list[int]) -> pa.RecordBatch:
    values = pa.array([Decimal(int(total)) for total in totals], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals), dtype=np.int32)), values], ["k", "v"])


_SUMS = "k int, v decimal(38,0)"


def _entry_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * (dims + 1)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), dims)
                safe = float(np.abs(x).max()) * len(x) < 1 << 62
                sums = (x if safe else x.astype(object)).sum(axis=0).tolist()
                totals = [totals[0] + len(x), *[a + b for a, b in zip(totals[1:], sums)]]
        yield _sum_rows(totals)

    n, *sums = _summed(fit.select("x").mapInArrow(run, _SUMS), dims + 1)
    return n, sums


def _products(y: np.ndarray) -> np.ndarray:
    """y'y, exact: by floating point while every partial sum is an integer that it holds."""
    largest = int(np.abs(y).max())
    if largest * largest * len(y) < 1 << 53:
        y = y.astype(np.float64)
        return (y.T @ y).astype(np.int64)
    wide = y.astype(object)
    return wide.T @ wide


def exact_covariance(fit: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, covariance with divisor n) of the packed vectors, each entry rounded once.

    Entries are centred at the integers next to their means before they are multiplied; the rest of the centring is done
    on the exact sums. A partition gives one row for each of the d (d + 3) / 2 sums, and Spark adds them.
    """
    n, sums = _entry_sums(fit, dims)
    if not n:
        return 0, sums, np.zeros((dims, dims))
    pivot = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * (dims + len(upper[0]))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                y = _matrix(batch.column(0).slice(at, 4096), dims) - pivot
                found = [*y.astype(object).sum(axis=0).tolist()] if np.abs(y).max() >= 1 << 49 else y.sum(axis=0).tolist()
                found += _products(y)[upper].tolist()
                totals = [a + b for a, b in zip(totals, found)]
        yield _sum_rows(totals)

    found = _summed(fit.select("x").mapInArrow(run, _SUMS), dims + len(upper[0]))
    rest = found[:dims]
    covariance = np.zeros((dims, dims))
    for i, j, total in zip(*(index.tolist() for index in upper), found[dims:]):
        covariance[i, j] = covariance[j, i] = (n * total - rest[i] * rest[j]) / (n * n)
    return n, sums, covariance


# --- eigenvalues in an interval ---------------------------------------------------------------------------------


def count_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed the shift: the inertia of its block LDL' factors.

    Pivots of one or two rows are chosen for size (Bunch and Parlett), so the factors stay bounded.
    """
    m = a - shift * np.eye(len(a))
    above = 0
    while len(m):
        diagonal = np.abs(np.diag(m))
        i = int(diagonal.argmax())
        off = np.abs(m - np.diag(np.diag(m)))
        largest = off.max()
        if diagonal[i] == 0 and largest == 0:
            break
        if diagonal[i] >= 0.64 * largest:
            above += bool(m[i, i] > 0)
            rows = [i]
            step = np.outer(m[:, i], m[i]) / m[i, i]
        else:
            rows = list(np.unravel_index(off.argmax(), off.shape))
            above += 1  # such a block has one eigenvalue of either sign
            step = m[:, rows] @ np.linalg.solve(m[np.ix_(rows, rows)], m[rows])
        keep = np.delete(np.arange(len(m)), rows)
        m = (m - step)[np.ix_(keep, keep)]
    return above


def leading_interval(a: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """(low, high, count): an interval with the ``wanted`` largest eigenvalues and no other, if they stand apart.

    Else the count is larger: those that cannot be told from the last one are in it. Of fewer eigenvalues above zero
    (beside the largest) the interval holds all.
    """
    high = float(np.abs(a).sum(axis=1).max()) * (1 + 1e-9)
    if high == 0:
        return 0.0, 0.0, 0
    low, top = high * 1e-13 * len(a), high
    count = count_above(a, low)
    while count > wanted and top - low > 1e-10 * high:
        middle = (low + top) / 2
        found = count_above(a, middle)
        if found < wanted:
            top = middle
        else:
            low, count = middle, found
    return low, high, count


def feast(a: np.ndarray, low: float, high: float, count: int, nodes: int = 16, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in the interval, falling, and their unit eigenvectors as columns.

    Raises if the extracted pairs are not as many as the inertia count says.
    """
    d = len(a)
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(nodes)
    turns = np.exp(-0.5j * np.pi * (points - 1))
    shifts = centre + radius * turns  # the upper half; the lower one gives the conjugates
    size = min(d, max(2 * count, count + 6))
    block = np.random.Generator(np.random.PCG64(seed)).standard_normal((d, size))
    for _ in range(60):
        projected = np.zeros((d, block.shape[1]))
        for shift, turn, weight in zip(shifts, turns, weights):
            solved = np.linalg.solve(shift * np.eye(d) - a, block.astype(complex))
            projected += weight * (radius * turn * solved).real / 2
        basis = np.linalg.qr(projected)[0]
        ritz, small = np.linalg.eigh(basis.T @ a @ basis)
        vectors = basis @ small
        inside = (ritz > low) & (ritz < high)
        residual = np.linalg.norm(a @ vectors[:, inside] - vectors[:, inside] * ritz[inside], axis=0)
        if inside.sum() == count and residual.max(initial=0.0) <= 1e-14 * d * high:
            order = np.argsort(-ritz[inside], kind="stable")
            return ritz[inside][order], vectors[:, inside][:, order]
        extra = 0 if inside.sum() <= count else min(d, block.shape[1] * 2) - block.shape[1]
        block = np.hstack([vectors, np.random.Generator(np.random.PCG64(seed + 1)).standard_normal((d, extra))])
    raise ArithmeticError(f"{inside.sum()} eigenvalues found between {low} and {high}, the inertia says {count}")


@dataclass(frozen=True)
class Whitening:
    """Unit eigenvectors as columns, eigenvalues, and the exact sums behind them."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - sums, in integers, and its quotient by n."""
        bound = self.n * max(int(np.abs(x).max(initial=0)), 1) + max(abs(s) for s in self.sums)
        if bound < 1 << 62:
            moved = self.n * x - np.array(self.sums, np.int64)
            return moved, moved / self.n
        moved = self.n * x.astype(object) - np.array(self.sums, object)
        return moved, (moved / self.n).astype(np.float64)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors / np.sqrt(self.values)


def leading_components(n: int, sums: list[int], covariance: np.ndarray, components: int = 4) -> Whitening:
    low, high, count = leading_interval(covariance, min(components, len(covariance)))
    if count:
        values, vectors = feast(covariance, low, high, count)
    else:
        values, vectors = np.zeros(0), np.zeros((len(covariance), 0))
    values, vectors = values[:components], vectors[:, :components]
    if vectors.size:  # either sign would do; the same one for every run
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return Whitening(n, sums, vectors, values, float(np.trace(covariance)))


# --- results ----------------------------------------------------------------------------------------------------


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors less the identity.

    A partition centres its own products; the partial means and products are put together on the driver, one row each.
    """
    dims, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = model.project(model.centred(_matrix(batch.column(0), dims))[1])
                count, mean, products = _merged((count, mean, products), (len(w), w.mean(axis=0), _centred_products(w)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([count]), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))],
            ["n", "mean", "products"],
        )

    parts = fit.select("x").mapInArrow(run, "n bigint, mean array<double>, products array<double>")
    total = (0, np.zeros(k), np.zeros((k, k)))
    for row in parts.toLocalIterator():
        total = _merged(total, (row["n"], np.array(row["mean"]), np.array(row["products"]).reshape(k, k)))
    return float(np.abs(total[2] / total[0] - np.eye(k)).max())


def _centred_products(w: np.ndarray) -> np.ndarray:
    w = w - w.mean(axis=0)
    return w.T @ w


def _merged(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def whitened(embeddings: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component."""
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fixed = fixed_vectors(embeddings, id_col, vector_col)
    lengths = fixed.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return embeddings.sparkSession.createDataFrame([], schema)
    dims = lengths[0]["dims"]
    rows = fixed.filter(F.col("dims") == dims).select("vec_id", "x")
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    model = leading_components(*exact_covariance(fit, dims), components)
    k = len(model.values)
    if not k:
        discard(fit)
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, model)
    discard(fit)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        moved, centred = model.centred(_matrix(batch.column(1), dims))
        size = len(moved)
        if moved.dtype == object or float(np.abs(moved).max()) ** 2 * dims >= 1 << 62:
            sums = [sum(int(v) ** 2 for v in row) for row in moved.tolist()]
            deviation = pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())
        else:
            deviation = pa.array((moved * moved).sum(axis=1))
        each = pa.array(np.repeat(np.arange(size), k))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                pa.array(np.full(size * k, model.n)),
                deviation.take(each),
                pa.array(model.project(centred).ravel()),
                pa.array(np.tile(model.values / model.trace, size)),
                pa.array(np.full(size * k, error)),
            ],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )

    return map_batches(rows, step, schema, 5000)

