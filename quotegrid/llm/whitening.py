"""Embedding whitening from an exact scatter matrix.

Entries become whole numbers (``floor(256 c)``). The distinct vectors are the
fit list; of them n, the sums S and then the scatter of y = n x - S are wanted
exactly, though its entries leave 64 bits soon. So each task multiplies the
residues of its y, modulo one prime after another, as double matrices whose sums
stay below 2**53; Spark adds the residues of all tasks; and Chinese remaindering
gives the exact entries. Only then comes floating point: the covariance, rounded
once, goes through a double ``eigh``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, shared_dir, small_batches

COMPONENTS = 4
#: Residues lie within half a prime of zero, so a block of rows sums to less than 2**53 in double.
PRIME_BITS, BLOCK_ROWS = 20, 1 << 14
#: Eigenvalues below this part of the largest are zero.
LEAST_SHARE = 1e-12
#: Numbers of an entry before it is scaled, and the bounds of a long.
SCALE, LEAST, MOST = 256.0, -(1 << 63), (1 << 63) - 1


def primes(above: int) -> list[int]:
    """The largest primes below 2**PRIME_BITS, in falling order, whose product exceeds ``above``."""
    out, p = [], 1 << PRIME_BITS
    while prod(out) <= above:
        p -= 1
        if all(p % q for q in range(2, isqrt(p) + 1)):
            out.append(p)
    return out


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 c) as longs; what no long holds becomes the nearest one."""
    x = np.floor(SCALE * values.astype(np.float64))
    return np.where(x >= 2.0**63, MOST, np.where(x <= -(2.0**63), LEAST, np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)))


def vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are vectors of ``dim`` finite entries, and these as a matrix of longs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten(), np.diff(np.asarray(column.offsets))
    sizes[np.asarray(column.is_null())] = 0
    entries = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    ok = np.asarray(column.is_valid()) & (sizes == dim)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(entries))))
    ends = np.cumsum(sizes)
    ok &= bad[ends] == bad[ends - sizes]
    return ok, whole(entries[np.repeat(ok, sizes)]).reshape(-1, dim)


def _pack(x: np.ndarray) -> pa.Array:
    """A binary value for each row, equal for equal rows only: the bytes of an entry (1, 2, 4 or 8), then the entries."""
    out = np.empty(len(x), object)
    left = np.arange(len(x))
    for width in (1, 2, 4, 8):
        info = np.iinfo(f"i{width}")
        fits = (x[left] >= info.min).all(1) & (x[left] <= info.max).all(1)
        rows = x[left[fits]].astype(f"<i{width}")
        data = np.concatenate((np.full((len(rows), 1), width, np.uint8), rows.view(np.uint8).reshape(len(rows), width * x.shape[1])), axis=1)
        for i, row in zip(left[fits].tolist(), data):
            out[i] = row.tobytes()
        left = left[~fits]
    return pa.array(out.tolist(), pa.binary())


def _unpack(packed: pa.Array, dim: int) -> np.ndarray:
    data, bounds = raw(packed)
    out = np.empty((len(bounds) - 1, dim), np.int64)
    kinds = data[bounds[:-1]]
    for width in np.unique(kinds).tolist():
        rows = np.flatnonzero(kinds == width)
        at = bounds[rows][:, None] + 1 + np.arange(dim * width)
        out[rows] = np.ascontiguousarray(data[at]).view(f"<i{width}").reshape(len(rows), dim)
    return out


def _packed(dim: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = vectors(batch.column("embedding"), dim)
            yield pa.RecordBatch.from_arrays([_pack(x)], ["x"])

    return rows


def _digits(x: np.ndarray) -> list[np.ndarray]:
    """Longs as two parts that can be summed without overflow: the value is first * 2**32 + second."""
    return [x >> 32, x & 0xFFFFFFFF]


def _sums(dim: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, low, high = np.zeros((2, dim), np.int64), 0, np.full(dim, MOST), np.full(dim, LEAST)
        for batch in batches:
            x = _unpack(batch.column("x"), dim)
            if len(x):
                total += [p.sum(0) for p in _digits(x)]
                n, low, high = n + len(x), np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array([n] * dim, pa.int64()), *map(pa.array, (*total, low, high))], ["i", "n", "s1", "s0", "low", "high"])

    return rows


class Fit:
    """What the driver knows of the fit list: n, S, and how large the entries of y can be."""

    def __init__(self, n: int, sums: list[int], low: list[int], high: list[int]):
        self.n, self.sums = n, sums
        self.most_x = max(1, *(abs(v) for v in (*low, *high)))
        self.most_y = max([1, *(abs(n * v - s) for v, s in zip((*low, *high), (*sums, *sums)))])
        #: Whether n x, and so y, can be formed in longs.
        self.long = n * self.most_x + max([0, *map(abs, sums)]) <= MOST

    def centred(self, x: np.ndarray) -> np.ndarray:
        """y = n x - S, exactly: longs, or Python's integers where longs don't do."""
        if self.long:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)


def _scatter(fit: Fit, mods: list[int]):
    """For each task, the residues of sum y_i y_j (j >= i), numbered by prime and place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = len(fit.sums)
        upper = np.triu_indices(dim)
        total = np.zeros((len(mods), len(upper[0])), np.int64)
        some = False
        for batch in batches:
            x = _unpack(batch.column("x"), dim)
            for at in range(0, len(x), BLOCK_ROWS):
                y, some = fit.centred(x[at : at + BLOCK_ROWS]), True
                for k, p in enumerate(mods):
                    r = (y % p).astype(np.float64)
                    r -= np.where(r > p // 2, p, 0)
                    total[k] = (total[k] + (r.T @ r)[upper].astype(np.int64)) % p
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "residue"])

    return rows


def remainder(residues: list[int], mods: list[int]) -> int:
    """The number of least size with these residues."""
    value, step = 0, 1
    for r, p in zip(residues, mods):
        value += step * ((r - value) * pow(step, -1, p) % p)
        step *= p
    return value - step if value > step // 2 else value


def exact_scatter(fitted: DataFrame, fit: Fit) -> list[list[int]]:
    """sum y y^T over the fit list, in Python's integers."""
    dim = len(fit.sums)
    mods = primes(2 * fit.n * fit.most_y**2)
    found = fitted.mapInArrow(_scatter(fit, mods), "at long, residue long").groupBy("at").agg(F.sum("residue").alias("residue")).toArrow()
    each = np.zeros(len(mods) * (dim * (dim + 1) // 2), np.int64)
    each[np.asarray(found.column("at"))] = np.asarray(found.column("residue"))
    each = each.reshape(len(mods), -1) % np.array(mods)[:, None]
    out = [[0] * dim for _ in range(dim)]
    for i, j, residues in zip(*map(np.ndarray.tolist, np.triu_indices(dim)), each.T.tolist()):
        out[i][j] = out[j][i] = remainder(residues, mods)
    return out


class Whitening:
    """Components of the covariance V = scatter / n**3 by falling eigenvalue, their largest entry positive."""

    def __init__(self, fit: Fit, scatter: list[list[int]], most: int):
        self.fit = fit
        cube = fit.n**3
        v = np.array([[float(Fraction(x, cube)) for x in row] for row in scatter], np.float64).reshape(len(scatter), -1)
        values, columns = np.linalg.eigh(v) if len(v) else (np.zeros(0), np.zeros((0, 0)))
        values, columns = values[::-1], columns[:, ::-1]
        columns = columns * np.where(columns[np.abs(columns).argmax(0), np.arange(len(v))] < 0, -1.0, 1.0) if len(v) else columns
        trace = float(Fraction(sum(scatter[i][i] for i in range(len(scatter))), cube)) if len(v) else 0.0
        self.explained = values / trace if trace > 0 else np.zeros(len(values))
        self.some = values > LEAST_SHARE * max(values.max(initial=0.0), 0.0)
        self.scaled = columns / np.sqrt(np.where(self.some, values, 1.0))
        self.shown = min(most, len(values))
        self.identity_error = 0.0

    def __call__(self, y: np.ndarray, columns: slice | np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) / self.fit.n) @ self.scaled[:, columns]

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """The sums of y**2; null where no long holds one."""
        if self.fit.long and len(self.fit.sums) * self.fit.most_y**2 <= MOST:
            return (y * y).sum(1).tolist()
        sums = (sum(v * v for v in row) for row in y.tolist())
        return [s if s <= MOST else None for s in sums]


def _moments(white: Whitening):
    """For each task, n, the sums and the products of the whitened vectors (all components with a variance)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, k = len(white.fit.sums), int(white.some.sum())
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            x = _unpack(batch.column("x"), dim)
            w = np.column_stack((np.ones(len(x)), white(white.fit.centred(x), white.some)))
            total += w.T @ w
        if total[0, 0]:
            at = np.triu_indices(k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at[0]))), pa.array(total[at])], ["at", "m"])

    return rows


def _identity_error(fitted: DataFrame, white: Whitening) -> float:
    k = int(white.some.sum())
    if not k:
        return 0.0
    found = fitted.mapInArrow(_moments(white), "at long, m double").groupBy("at").agg(F.sum("m").alias("m")).toArrow()
    at = np.triu_indices(k + 1)
    flat = np.zeros(len(at[0]))
    flat[np.asarray(found.column("at"))] = np.asarray(found.column("m"))
    m = np.zeros((k + 1, k + 1))
    m[at] = flat
    m = (m + np.triu(m, 1).T) / m[0, 0]
    return float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(k)).max())


def _whitened(white: Whitening):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = vectors(batch.column("embedding"), len(white.fit.sums))
            y, k = white.fit.centred(x), white.shown
            values = white(y, slice(0, k))
            ids = batch.column("vec_id").filter(pa.array(ok)).take(pa.array(np.repeat(np.arange(len(x)), k)))
            deviation = pa.array(white.deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
            flat = pa.array(values.ravel(), pa.float64(), mask=np.tile(~white.some[:k], len(x)))
            n = len(x) * k
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(n, white.fit.n)), deviation, flat, pa.array(np.tile(white.explained[:k], len(x))), pa.array(np.full(n, white.identity_error))], WHITENED)

    return rows


WHITENED = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For each row (vec_id, embedding) that has a whole vector and each component:
    n (vectors of the fit list), deviation, whitened, explained and identity_error.

    Rows whose vector is null, or holds a null, nan or infinite entry, go; so do
    vectors whose length isn't the table's commonest (of equally common ones the
    greatest) and empty ones, for which there is no covariance. Repeated rows and
    vectors are returned each, and count once in the fit. An entry that no long
    holds becomes the nearest long, and a deviation that none holds is null. Of
    equal eigenvalues the order is the library's, the same for all rows. A
    component without variance has a null whitened value and isn't part of
    identity_error. Null ids stay; other columns are left alone; an empty table
    gives no row.

    The vectors are shuffled once, packed in as few bytes as they need and already
    distinct within a task, so a vector that very many rows share costs a row for
    each task. What reaches the driver is of the size of the covariance.
    """
    spark = table.sparkSession
    small_batches(spark)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("size(embedding) > 0")
    length = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if length is None:
        return spark.createDataFrame([], schema)
    dim = length["dim"]
    where = f"{shared_dir(spark)}/fit"
    rows.select("embedding").mapInArrow(_packed(dim), "x binary").distinct().write.parquet(where)
    fitted = spark.read.schema("x binary").parquet(where)
    high = F.sum("s1").alias("s1")
    found = fitted.mapInArrow(_sums(dim), "i int, n long, s1 long, s0 long, low long, high long").groupBy("i").agg(F.sum("n").alias("n"), high, F.sum("s0").alias("s0"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    if not found:
        return spark.createDataFrame([], schema)
    fit = Fit(found[0].n, [(r.s1 << 32) + r.s0 for r in found], [r.low for r in found], [r.high for r in found])
    white = Whitening(fit, exact_scatter(fitted, fit), components)
    white.identity_error = _identity_error(fitted, white)
    return rows.mapInArrow(_whitened(white), schema)
