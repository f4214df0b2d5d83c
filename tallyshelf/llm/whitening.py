"""Embedding whitening by spectrum slicing.

Vectors become whole numbers, so that sums and products about their rounded mean are added exactly, whatever the order, and
the covariance is rounded once. It is as wide as a vector and comes to the driver. There, LDLᵀ factorisations of the
covariance less a shift count the eigenvalues below the shift (by Sylvester's law, the negative pivots). Halving by these
counts isolates each leading eigenvalue; Rayleigh quotient iteration, which converges cubically, finds it and its vector;
and counts just below and above it certify which number it has. All rows are projected by the tasks that read them.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: entries become floor(SCALE * c) + OFFSET
SCALE, OFFSET = 64, 1_000_000
#: entries from here on do not become whole numbers that sums can hold
WIDEST = 2.0**40
#: whole numbers up to here are exact as doubles
EXACT = 2**53
#: relative width of what the counts can tell apart, and of an eigenvalue that is nothing but rounding
TIGHT, NOTHING = 1e-13, 1e-12
EXACT_SUM = "decimal(38,0)"


def negative_pivots(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie below `shift`, by an LDLᵀ factorisation with complete pivoting.

    A pivot is the largest diagonal entry or, where off-diagonal ones outgrow it, the 2 x 2 block of the largest of these;
    such a block has one negative and one positive eigenvalue.
    """
    m, below = a - shift * np.eye(len(a)), 0
    enough = (1 + 17**0.5) / 8
    while len(m):
        diagonal, off = np.abs(np.diagonal(m)), np.abs(np.triu(m, 1))
        r, (i, j) = int(diagonal.argmax()), np.unravel_index(off.argmax(), off.shape)
        if diagonal[r] == 0 and off[i, j] == 0:
            break  # what is left is zero: eigenvalues that equal the shift
        pivot = [r] if diagonal[r] >= enough * off[i, j] else [i, j]
        rest = np.delete(np.arange(len(m)), pivot)
        block, side = m[np.ix_(pivot, pivot)], m[np.ix_(rest, pivot)]
        below += 1 if len(pivot) == 2 else int(block[0, 0] < 0)
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
    return below


def rayleigh(a: np.ndarray, shift: float, known: np.ndarray) -> tuple[float, np.ndarray]:
    """Eigenvalue and unit vector near `shift`, orthogonal to the columns of `known`: two steps of inverse iteration,
    then Rayleigh quotient iteration until the residual is rounding."""
    size = max(float(np.abs(a).sum(1).max()), 1e-300)

    def step(theta: float, v: np.ndarray) -> np.ndarray:
        m = a - theta * np.eye(len(a))
        try:
            w = np.linalg.solve(m, v)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            w = np.linalg.solve(m + 4e-16 * size * np.eye(len(a)), v)
        for _ in range(2):
            w = w - known @ (known.T @ w)
            w = w / np.linalg.norm(w)
        return w

    v = np.random.default_rng(len(a)).standard_normal(len(a))
    for _ in range(2):
        v = step(shift, v)
    best = (np.inf, shift, v)
    for _ in range(30):
        theta = float(v @ a @ v)
        residual = float(np.linalg.norm(a @ v - theta * v))
        if residual >= best[0] / 2:
            break
        best = (residual, theta, v)
        v = step(theta, v)
    return best[1], best[2]


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` greatest eigenvalues of a symmetric matrix, falling, and unit vectors as columns.

    An eigenvalue is taken once the counts say that it has its number; equal ones, and those that counts cannot tell apart,
    get vectors orthogonal to each other. Those that are zero but for rounding are left out.
    """
    d = len(a)
    radius = np.abs(a).sum(1) - np.abs(np.diagonal(a))
    low, high = float((np.diagonal(a) - radius).min()), float((np.diagonal(a) + radius).max())
    size = max(abs(low), abs(high))
    if d == 0 or size == 0:
        return np.zeros(0), np.zeros((d, 0))
    cuts = {low - size * TIGHT: 0, high + size * TIGHT: d}  # shift: eigenvalues below it
    values, vectors = [], np.zeros((d, 0))
    while len(values) < min(count, d):
        rank = d - len(values)  # the eigenvalue sought has this number from below
        lower = max(s for s, n in cuts.items() if n < rank)
        upper = min(s for s, n in cuts.items() if n >= rank)
        alone = cuts[upper] - cuts[lower] == 1
        tight = upper - lower <= size * TIGHT
        if alone or tight:
            near = np.array([abs(x - upper) <= 1e-3 * size for x in values], bool)
            theta, v = rayleigh(a, (lower + upper) / 2, vectors[:, near] if len(values) else vectors)
            edge = size * TIGHT
            if tight or (lower - edge <= theta <= upper + edge and negative_pivots(a, theta - edge) < rank <= negative_pivots(a, theta + edge)):
                values.append(theta)
                vectors = np.column_stack([vectors, v])
                continue
        middle = (lower + upper) / 2
        cuts[middle] = negative_pivots(a, middle)
    values = np.array(values)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > NOTHING * size]
    return values[order], vectors[:, order]


def whole(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length of vector: the length, the rows of the batch, and their entries as whole numbers."""
    lists = batch.column("embedding")
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    begins = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        entries = flat[begins[rows][:, None] + np.arange(d)]
        yield d, rows, np.floor(SCALE * entries).astype(np.int64) + OFFSET


def usable(vectors: DataFrame) -> DataFrame:
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < WIDEST)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return kept.filter(F.col("embedding").isNotNull() & F.forall("embedding", entry))


def exact_sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Length of vector: number of vectors, and their sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, own, x in whole(batch):
                column = [pa.array(v) for v in (np.full(d + 1, d), np.arange(-1, d), np.append(len(own), x.sum(0)))]
                yield pa.RecordBatch.from_arrays(column, ["d", "i", "value"])

    added = rows.select("embedding").mapInArrow(add, "d long, i long, value long")
    added = added.groupBy("d", "i").agg(F.sum(F.col("value").cast(EXACT_SUM)).alias("value")).collect()
    found: dict[int, dict[int, int]] = {}
    for r in added:
        found.setdefault(r["d"], {})[r["i"]] = int(r["value"])
    return {d: (v[-1], [v[i] for i in range(d)]) for d, v in sorted(found.items())}


def covariances(rows: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Length of vector: covariance, divisor n. Products are of whole numbers about the rounded mean, and added exactly."""
    centres = {d: np.array([round(Fraction(s, n)) for s in total], np.int64) for d, (n, total) in sums.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, own, x in whole(batch):
                y = x - centres[d]
                most = max(int(np.abs(y).max()), 1)
                at_once = EXACT // most**2
                if at_once:
                    parts = [y[i : i + at_once].astype(float) for i in range(0, len(own), at_once)]
                    products = [(p.T @ p).astype(np.int64).astype(object) for p in parts]
                else:
                    products = [y.astype(object).T @ y.astype(object)]
                product = sum(products[1:], products[0])
                i, j = np.triu_indices(d)
                with decimal.localcontext(prec=60):
                    exact = pa.array([decimal.Decimal(int(v)) for v in product[i, j]], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), exact], ["d", "i", "j", "value"])

    added = rows.select("embedding").mapInArrow(add, f"d long, i long, j long, value {EXACT_SUM}")
    added = added.groupBy("d", "i", "j").agg(F.sum("value").alias("value")).collect()
    out = {d: np.zeros((d, d)) for d in sums}
    for r in added:
        d, i, j = r["d"], r["i"], r["j"]
        n, total = sums[d]
        left, right = (total[k] - n * int(centres[d][k]) for k in (i, j))
        out[d][i, j] = out[d][j, i] = float(Fraction(n * int(r["value"]) - left * right, n * n))
    return out


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each usable row of
    `vectors` (vec_id, embedding) and each of the leading `components`, numbered from 1 by falling eigenvalue.

    Null vectors and those with a null or non-finite entry are left out, as are those with an entry of 2^34 or more, which
    sums could not hold. Vectors of another length are whitened among themselves, an empty vector has no component, and
    a component without variance (all vectors equal, or a single one) is left out. Repeated rows and ids, also null ones,
    count and come back as they are. Equal eigenvalues get some orthogonal vectors. An empty table gives an empty
    result; other columns are not read. To the driver come a sum and a covariance per length of vector.
    """
    rows = usable(vectors)
    sums = exact_sums(rows)
    models = {}
    for d, v in covariances(rows, sums).items():
        values, axes = leading(v, components)
        models[d] = (sums[d][0], np.array(sums[d][1], object), axes / np.sqrt(values), values / np.trace(v) if len(values) else values)

    def projected(d: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, total, axes, _ = models[d]
        apart = n * x.astype(object) - total if n * int(np.abs(x).max()) >= 2**62 else n * x - total.astype(np.int64)
        return apart, (apart / n).astype(float) @ axes

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, _, x in whole(batch):
                w = projected(d, x)[1]
                w = np.column_stack([np.ones(len(w)), w])
                product = w.T @ w
                i, j = np.triu_indices(len(product))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), pa.array(product[i, j])], ["d", "i", "j", "value"])

    errors: dict[int, float] = {}
    seen = rows.select("embedding").mapInArrow(moments, "d long, i long, j long, value double")
    seen = {(r["d"], r["i"], r["j"]): r["value"] for r in seen.groupBy("d", "i", "j").agg(F.sum("value").alias("value")).collect()}
    for d, i, j in seen:
        if i > 0:
            n = models[d][0]
            apart = abs(seen[d, i, j] / n - seen[d, 0, i] / n * (seen[d, 0, j] / n) - (i == j))
            errors[d] = max(errors.get(d, 0.0), apart)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, own, x in whole(batch):
                n, _, _, explained = models[d]
                k = len(explained)
                if not k:
                    continue
                apart, w = projected(d, x)
                if apart.dtype == object or int(np.abs(apart).max()) ** 2 * d >= 2**63:
                    deviation = (apart.astype(object) ** 2).sum(1)
                else:
                    deviation = (apart**2).sum(1)
                with decimal.localcontext(prec=60):
                    deviation = pa.array([decimal.Decimal(int(v)) for v in deviation], pa.decimal128(38, 0))
                place = pa.array(np.repeat(np.arange(len(own)), k))
                columns = [
                    batch.column("vec_id").take(pa.array(own)).take(place),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))),
                    pa.array(np.full(len(place), n)),
                    deviation.take(place),
                    pa.array(w.reshape(-1)),
                    pa.array(np.tile(explained, len(own))),
                    pa.array(np.full(len(place), errors[d])),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, f"vec_id long, component int, n long, deviation {EXACT_SUM}, whitened double, explained double, identity_error double")
