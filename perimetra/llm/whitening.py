"""Whitening of embeddings from exact integer second moments, counted on bit planes.

An entry c becomes the integer x = floor(1024 c) + 100000. A block of rows is shifted by the least x of each dimension and cut into bit
planes: one bit per row, packed into 64-bit words. The sum over rows of the product of two dimensions is then the sum over pairs of their
planes of 2^(a + b) times the number of bits that both have, an AND and a population count. Blocks add up to the exact sums of the table;
they are centred as integers, and only the covariance that comes out is turned into floating point for the eigenvectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.llm.base import joined

SCALE, SHIFT = 1024, 100_000
#: Scaled entries are held within this, so that all sums fit 38 digits.
REACH = 1 << 40
#: Rows whose planes are counted at once.
BLOCK_ROWS = 8192
COMPONENTS = 8


@dataclass
class Basis:
    """What whitening needs: number of vectors, sums by dimension, components (one a column), eigenvalues, shares of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    shares: np.ndarray


def scaled(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -REACH, REACH).astype(np.int64) + SHIFT


def planes(y: np.ndarray) -> tuple[np.ndarray, int]:
    """Bit planes of non-negative rows x dimensions: (dimension x bit) x words of 64 rows, and the bits of a dimension."""
    n, d = y.shape
    bits = max(1, int(y.max(initial=0)).bit_length())
    words = -(-n // 64)
    out = np.zeros((d * bits, words * 8), dtype=np.uint8)
    for b in range(bits):
        packed = np.packbits(((y >> b) & 1).astype(bool), axis=0)
        out[b::bits, : packed.shape[0]] = packed.T
    return out.view(np.uint64), bits


def products(y: np.ndarray) -> np.ndarray:
    """Sums over rows of the products of all pairs of dimensions of non-negative integers, as exact Python integers."""
    n, d = y.shape
    cut, bits = planes(y)
    counts = np.zeros((d * bits, d * bits), dtype=np.int64)
    for p in range(d * bits):
        counts[p, p:] = np.bitwise_count(cut[p:] & cut[p]).sum(axis=1, dtype=np.int64)
    counts = np.triu(counts, 1).T + counts
    small = 2 * bits + n.bit_length() < 62
    weights = np.array([1 << b for b in range(bits)], dtype=np.int64 if small else object)
    split = counts.reshape(d, bits, d, bits).astype(weights.dtype)
    return ((split * weights).sum(axis=3) * weights[:, None]).sum(axis=1).astype(object)


def block_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and sums of products of a block of integer rows, by way of its least entries."""
    least = x.min(axis=0)
    y = x - least
    ys, low, n = y.sum(axis=0).astype(object), least.astype(object), len(x)
    across = np.outer(low, ys)
    return ys + n * low, products(y) + across + across.T + n * np.outer(low, low)


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of `d` entries, none of them null or non-finite, and where they are in the column."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    rows = np.flatnonzero(sizes == d)
    held = column.take(pa.array(rows))
    values = held.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)  # null entries become nan
    good = np.isfinite(values).all(axis=1)
    return values[good], rows[good]


def _vectors(df: DataFrame, ident: str, column: str) -> DataFrame:
    v = F.col(column)
    if df.schema[column].dataType.elementType.typeName() != "float":
        v = v.cast("array<double>")
    return df.select(F.col(ident).alias("id"), v.alias("v"))


def dimensions(vectors: DataFrame) -> int:
    """The entries that most whole vectors have; the greater number where two are as frequent. 0 where no vector is whole."""
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    top = vectors.where((F.size("v") > 0) & ~odd).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return 0 if top is None else top.d


def scatter(vectors: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """Rows, sums by dimension and sums of products of `vectors(v)` of `d` entries, exact. A task sends d (d + 3) / 2 numbers at most."""
    upper = [(i, j) for i in range(d) for j in range(i, d)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = scaled(_matrix(joined(batch.column("v")), d)[0])
            for k in range(0, len(x), BLOCK_ROWS):
                s, p = block_sums(x[k : k + BLOCK_ROWS])
                sums, total = sums + s, total + p
            n += len(x)
        if n:
            cells = [(-1, -1, n)] + [(-1, i, v) for i, v in enumerate(sums)] + [(i, j, total[i, j]) for i, j in upper]
            i, j, v = zip(*cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(x)) for x in v], pa.decimal128(38, 0))], ["i", "j", "v"]
            )

    parts = vectors.select("v").mapInArrow(run, "i int, j int, v decimal(38,0)")
    cells = {(r.i, r.j): int(r.v) for r in parts.groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}
    n = cells.get((-1, -1), 0)
    total = np.zeros((d, d), object)
    for i, j in upper:
        total[i, j] = total[j, i] = cells.get((i, j), 0)
    return n, [cells.get((-1, i), 0) for i in range(d)], total


def basis(n: int, sums: list[int], total: np.ndarray, most: int = COMPONENTS) -> Basis:
    """Components of the covariance total / n - (sums / n)(sums / n)', divisor n; centred as integers before the division."""
    s = np.array(sums, dtype=object)
    centred = n * total - np.outer(s, s)
    covariance = np.array([[int(c) / (n * n) for c in row] for row in centred], dtype=np.float64)
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:most]
    trace = sum(int(centred[i, i]) for i in range(len(s))) / (n * n)
    # what rounding alone leaves of a direction without spread
    least = trace * len(s) * np.finfo(np.float64).eps
    values = np.where(values[order] > least, values[order], 0.0)
    return Basis(n, sums, axes[:, order], values, values / trace if trace else np.full(len(order), np.nan))


def _project(x: np.ndarray, b: Basis) -> np.ndarray:
    """Rows of x whitened: centred exactly up to one rounding, projected, divided by the standard deviation; nan where there is none."""
    whole = np.array([s // b.n for s in b.sums], dtype=np.int64)
    part = np.array([(s % b.n) / b.n for s in b.sums])
    with np.errstate(divide="ignore", invalid="ignore"):
        return ((x - whole) - part) @ b.axes / np.where(b.values > 0, np.sqrt(b.values), np.nan)


def _deviations(x: np.ndarray, b: Basis) -> list[Decimal]:
    """Sum over dimensions of (n x - S)^2, exact."""
    whole = np.array([s // b.n for s in b.sums], dtype=np.int64)
    far = int(np.abs(x - whole).max(initial=0)) + 1
    if (b.n * far) ** 2 * x.shape[1] < 1 << 62:
        gap = b.n * (x - whole) - np.array([s % b.n for s in b.sums], dtype=np.int64)
        return [Decimal(v) for v in (gap * gap).sum(axis=1).tolist()]
    gap = b.n * x.astype(object) - np.array(b.sums, dtype=object)
    return [Decimal(int(v)) for v in (gap * gap).sum(axis=1)]


def identity_error(vectors: DataFrame, b: Basis) -> float | None:
    """Greatest absolute entry of the measured covariance of the whitened rows minus the identity; None without a component of any spread."""
    keep = np.flatnonzero(b.values > 0)
    d, k = len(b.sums), len(keep)
    if not k:
        return None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _project(scaled(_matrix(joined(batch.column("v")), d)[0]), b)[:, keep]
            sums, total = sums + w.sum(axis=0), total + w.T @ w
        values = pa.array(np.concatenate([total.ravel(), sums]))
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k + k), pa.int32()), values], ["k", "v"])

    rows = vectors.select("v").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    got = np.array([r.v for r in sorted(rows)])
    mean = got[k * k :] / b.n
    return float(np.abs(got[: k * k].reshape(k, k) / b.n - np.outer(mean, mean) - np.eye(k)).max())


SCHEMA = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whitened(df: DataFrame, ident: str = "vec_id", column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """`(ident, component, n, deviation, whitened, explained, identity_error)` for each vector and each of its first `most` components.

    Rows whose vector is null, empty or holds null or non-finite entries are left out, and so are vectors of another length than most have
    (they are in no common space). `n` vectors remain; `deviation` is the exact sum of (n x - S)^2 over dimensions; `whitened` has mean 0 and
    variance 1 over them and no correlation between components, null for a component without spread; `explained` is its share of the trace,
    null where nothing spreads; `identity_error` tells how far the measured covariance is from the identity. Components are numbered from 1 by
    falling eigenvalue, one sign for all rows; there are as many as dimensions if that is fewer. Repeated rows and ids stay, each with
    its own output; other columns are ignored; an empty table gives none. Entries beyond 2^40 / 1024 count as that.

    The table is read three times (moments, check, output); what the driver sees is a matrix of dimension x dimension.
    """
    name, id_type = df.schema[ident].name, df.schema[ident].dataType.simpleString()
    vectors = _vectors(df, ident, column)
    schema = f"`{name}` {id_type}, {SCHEMA}"
    d = dimensions(vectors)
    if not d:
        return df.sparkSession.createDataFrame([], schema)
    b = basis(*scatter(vectors, d), most)
    error = identity_error(vectors, b)
    k = len(b.values)
    shares = [None if math.isnan(s) else float(s) for s in b.shares]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, rows = _matrix(joined(batch.column("v")), d)
            x, m = scaled(values), len(rows)
            w = _project(x, b)
            again = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    joined(batch.column("id")).take(pa.array(np.repeat(rows, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, b.n, dtype=np.int64)),
                    pa.array(_deviations(x, b), pa.decimal128(38, 0)).take(pa.array(again)),
                    pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                    pa.array(shares * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ],
                [name, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, schema)
