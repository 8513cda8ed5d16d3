"""Whitened embeddings from an exact covariance: integers in small limbs, multiplied by float64 matrix products.

Entries become whole numbers ``floor(scale * c)``. The distinct vectors (the fit list) are multiplied with themselves
in blocks of at most 4096 rows; each number is split into limbs of 20 bits, so that no sum of a product exceeds 2^53
and every float64 product is exact. A task puts its limbs together as big integers and gives out one row for each pair
of dimensions; Spark adds them up in digits of 40 bits. What reaches the driver is one such table, bounded by the
number of dimensions and not by the rows. There the covariance, an exact fraction, is decomposed.

The eigenvectors of the rounded covariance are refined once: in their basis the covariance is formed exactly again
(with the same limbs), and rotated to a diagonal by Jacobi's method, which keeps small eigenvalues beside large ones.
The covariance of the whitened fit list, a linear map of it, is the map of its exact covariance.

Defined results: rows whose vector is null or has a null or non-finite entry are left out; entries beyond 64 bits become
the greatest or least number of 64 bits; vectors of another length are a fit list of their own; an empty vector has no
components and so no rows; repeated rows stay, but count once in the fit; a component without variance (fewer distinct
vectors than dimensions, constant entries) has whitened null and explained 0, and explained is null where nothing
varies at all; a deviation beyond 64 bits is null, its digits stand in ``deviation_digits`` all the same. Only the id and
the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import bounded_batches

LIMB = 20
BLOCK = 4096
#: Bits of a digit in which Spark adds big integers; DIGITS of them, the last with a sign.
DIGIT = 40
DIGITS = 4
_MASK = (1 << LIMB) - 1
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """float64 arrays of 20-bit parts, least first, whose weighted sum is ``x`` (int64, or objects of any size)."""
    out = []
    while x.size and (x.min() < -(1 << LIMB - 1) or x.max() >= 1 << LIMB - 1):
        out.append((x & _MASK).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def product(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The exact matrix product of two matrices given by limbs, as an array of big integers. Up to 8192 inner terms."""
    sums: dict[int, np.ndarray] = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            part = (x @ y).astype(np.int64)
            sums[i + j] = sums[i + j] + part if i + j in sums else part
    out = np.zeros((len(a[0]), b[0].shape[1]), object)
    for power, part in sums.items():
        out += part.astype(object) << LIMB * power
    return out


def self_product(x: np.ndarray) -> np.ndarray:
    """x' x, exactly, block by block."""
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), BLOCK):
        parts = limbs(x[at : at + BLOCK])
        out += product([p.T for p in parts], parts)
    return out


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * values) in 64 bits."""
    with np.errstate(over="ignore"):
        y = np.floor(values * scale)
    inside = (y >= -(2.0**63)) & (y < 2.0**63)
    return np.where(inside, np.where(inside, y, 0).astype(np.int64), np.where(y < 0, _LEAST, _MOST))


def vectors(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, whole numbers) of the usable vectors of each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    fine = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[starts])
    for size in np.unique(sizes[fine]).tolist():
        rows = np.flatnonzero(fine & (sizes == size))
        yield rows, whole(values[starts[rows][:, None] + np.arange(size)], scale)


def _narrow(x: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of bytes: the width of the narrowest integers that hold a vector, and its numbers in that width."""
    least, most = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    left = np.ones(len(x), bool)
    for width in (1, 2, 4, 8):
        half = 1 << 8 * width - 1
        now = left & (least >= -half) & (most <= half - 1)
        left &= ~now
        if now.any():
            data = x[now].astype(f"<i{width}").view(np.uint8).reshape(int(now.sum()), -1)
            yield np.hstack([np.full((len(data), 1), width, np.uint8), data])


def _wide(packed: pa.Array) -> Iterator[np.ndarray]:
    """The vectors that ``_narrow`` packed, a matrix for each length and width."""
    rows: dict[tuple[int, int], list[bytes]] = {}
    for raw in packed.to_pylist():
        rows.setdefault((raw[0], len(raw)), []).append(raw)
    for (width, size), found in rows.items():
        data = np.frombuffer(b"".join(found), np.uint8).reshape(-1, size)[:, 1:]
        yield np.ascontiguousarray(data).view(f"<i{width}").astype(np.int64)


def fit_list(df: DataFrame, column: str, scale: float) -> DataFrame:
    """Each distinct whole-number vector once, packed in bytes; a frequent one is put together in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in vectors(batch.column(0), scale):
                for data in _narrow(x):
                    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(data.shape[1]), len(data), [None, pa.py_buffer(np.ascontiguousarray(data))])
                    yield pa.record_batch([packed.cast(pa.binary())], ["packed"])

    return df.select(F.col(column).alias("_vector")).mapInArrow(run, "packed binary").distinct()


def moments(fit: DataFrame) -> dict[int, np.ndarray]:
    """By length d, the (d + 1) x (d + 1) big integers x' x of the fit list with a 1 after each vector: products, sums, count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in _wide(batch.column(0)):
                size = x.shape[1]
                made = self_product(np.hstack([x, np.ones((len(x), 1), np.int64)]))
                held[size] = held[size] + made if size in held else made
        for size, total in held.items():
            i, j = np.triu_indices(size + 1)
            left, digits = total[i, j], []
            for _ in range(DIGITS - 1):
                digits.append((left & ((1 << DIGIT) - 1)).astype(np.int64))
                left = left >> DIGIT
            columns = [np.full(len(i), size), i, j, *digits, left.astype(np.int64)]
            yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], ["size", "i", "j", *[f"d{k}" for k in range(DIGITS)]])

    parts = fit.mapInArrow(run, "size long, i long, j long, " + ", ".join(f"d{k} long" for k in range(DIGITS)))
    out: dict[int, np.ndarray] = {}
    # (d + 1) (d + 2) / 2 rows for vectors of length d.
    for r in parts.groupBy("size", "i", "j").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS)]).collect():
        total = out.setdefault(r["size"], np.zeros((r["size"] + 1,) * 2, object))
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = sum(r[f"d{k}"] << DIGIT * k for k in range(DIGITS))
    return out


def rank(c: np.ndarray, prime: int = (1 << 31) - 1) -> int:
    """The rank of a matrix of integers, by elimination modulo a prime."""
    a, found = (c % prime).astype(np.int64), 0
    for j in range(a.shape[1]):
        rows = np.flatnonzero(a[found:, j])
        if len(rows):
            pick = found + rows[0]
            a[[found, pick]] = a[[pick, found]]
            a[found] = a[found] * pow(int(a[found, j]), -1, prime) % prime
            a[found + 1 :] = (a[found + 1 :] - a[found + 1 :, j : j + 1] * a[found] % prime) % prime
            found += 1
    return found


def diagonalised(b: np.ndarray) -> np.ndarray:
    """The rotation that makes a nearly diagonal symmetric matrix diagonal, by Jacobi's method."""
    b, turn = b.copy(), np.eye(len(b))
    for _ in range(30):
        size = np.sqrt(np.abs(np.diag(b)))
        open_ = np.argwhere(np.triu(np.abs(b) > 1e-16 * np.outer(size, size), 1))
        for i, j in open_:
            if b[i, j] == 0:
                continue
            t = (b[j, j] - b[i, i]) / (2 * b[i, j])
            t = (1.0 if t >= 0 else -1.0) / (abs(t) + np.hypot(t, 1)) if np.isfinite(t) else 0.0
            c = 1 / np.hypot(t, 1)
            g = np.array([[c, t * c], [-t * c, c]])
            b[:, [i, j]] = b[:, [i, j]] @ g
            b[[i, j]] = g.T @ b[[i, j]]
            turn[:, [i, j]] = turn[:, [i, j]] @ g
        if not len(open_):
            break
    return turn


@dataclass
class Fit:
    """What a fit list of one length says: n, sums by dimension, and for each component its vector, variance, and share;
    ``error`` is the largest entry of the whitened covariance minus the identity (None without any component)."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variance: list[float]
    share: list[float | None]
    error: float | None


def decomposed(total: np.ndarray, components: int) -> Fit:
    """The first components of the exact covariance that ``moments`` gives."""
    size, n = len(total) - 1, int(total[-1, -1])
    sums = total[:-1, -1]
    c = n * total[:-1, :-1] - np.outer(sums, sums)  # n^2 times the covariance
    ratio = np.frompyfunc(lambda v, w: v / w, 2, 1)
    floats = lambda v, w: ratio(v, w).astype(np.float64)  # noqa: E731  big integers, each quotient rounded once
    count, full, one = min(components, size), rank(c), 1 << 60
    fixed = lambda q: limbs(np.frompyfunc(lambda v: int(round(v * one)), 1, 1)(q).astype(object))

    def inside(q: np.ndarray) -> np.ndarray:
        """q' c q, times 2^120."""
        parts = fixed(q)
        return product([p.T for p in parts], limbs(product(limbs(c), parts)))

    basis = np.linalg.eigh(floats(c, n * n))[1]
    basis = basis @ diagonalised(floats(inside(basis), n * n * one * one))
    basis /= np.linalg.norm(basis, axis=0)
    exact = inside(basis)
    order = np.argsort(-floats(np.diag(exact), n * n * one * one), kind="stable")[:count]
    axes, exact = basis[:, order], exact[np.ix_(order, order)]
    there = np.arange(count) < full
    variance = np.where(there, floats(np.diag(exact), n * n * one * one), 0.0)
    trace = sum(int(v) for v in np.diag(c)) / (n * n)
    share = [float(v / trace) if trace else None for v in variance]
    kept = floats(exact, n * n * one * one)[np.ix_(there, there)] / np.sqrt(np.outer(variance[there], variance[there]))
    return Fit(n, [int(s) for s in sums], axes, variance.tolist(), share, float(np.abs(kept - np.eye(len(kept))).max()) if len(kept) else None)


def deviations(x: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """(n x - S as integers, the sum of its squares by row as big integers)."""
    far = max(abs(int(x.min())), abs(int(x.max()))) * fit.n + max(abs(s) for s in fit.sums)
    wide = far >= 1 << 62
    y = (x.astype(object) if wide else x) * fit.n - np.array(fit.sums, object if wide else np.int64)
    parts, out = limbs(y), np.zeros(len(y), object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            for at in range(0, y.shape[1], BLOCK):
                out += np.einsum("ij,ij->i", a[:, at : at + BLOCK], b[:, at : at + BLOCK]).astype(np.int64).astype(object) << LIMB * (i + j)
    return y, out


def whitened(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: float = 256.0, components: int = 4) -> DataFrame:
    """For each usable row and component: id, component (from 1), n, deviation, whitened, explained, identity_error, deviation_digits."""
    bounded_batches(df.sparkSession)
    fits = {size: decomposed(total, components) for size, total in moments(fit_list(df, column, scale)).items() if size}
    kind = dict(df.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in vectors(batch.column(1), scale):
                if not x.shape[1]:
                    continue
                fit = fits[x.shape[1]]
                y, squares = deviations(x, fit)
                place = y.astype(np.float64) / fit.n
                m, ids = len(rows), batch.column(0).take(pa.array(rows))
                deviation = pa.array([v if v <= _MOST else None for v in squares.tolist()], pa.int64())
                digits = pa.array([str(v) for v in squares.tolist()])
                for k, variance in enumerate(fit.variance):
                    value = pa.array(place @ fit.axes[:, k] / np.sqrt(variance)) if variance > 0 else pa.nulls(m, pa.float64())
                    same = [pa.array([v] * m, t) for v, t in ((k + 1, pa.int32()), (fit.n, pa.int64()), (fit.share[k], pa.float64()), (fit.error, pa.float64()))]
                    yield pa.record_batch([ids, same[0], same[1], deviation, value, same[2], same[3], digits], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"])

    out = df.select(F.col(id_column).alias("id"), F.col(column).alias("_vector")).mapInArrow(
        run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
    )
    return out.withColumnRenamed("id", id_column)
