"""Embedding whitening: an exact scatter matrix from GEMMs modulo several primes, joined by Chinese remaindering, then eigh."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm._common import cut, ship

#: Primes lie below 2 ** BITS, so a product of two centred residues stays below 2 ** (2 * BITS - 2).
BITS = 22
#: Rows of one GEMM: sums of so many products are whole numbers below 2 ** 53, exact in doubles.
ROWS = 1 << (53 - (2 * BITS - 2))
LONG = 1 << 63


def primes(bound: int) -> list[int]:
    """The largest primes below 2 ** BITS whose product tells all whole numbers of absolute value up to bound apart."""
    out, n = [], (1 << BITS) - 1
    while prod(out) <= 2 * bound:
        if all(n % k for k in range(3, int(n**0.5) + 1, 2)):
            out.append(n)
        n -= 2
    return out


def residue_gram(rows: np.ndarray, p: int) -> np.ndarray:
    """rows.T @ rows modulo p, of longs: float GEMMs over few enough rows to be exact."""
    out = np.zeros((rows.shape[1],) * 2, np.int64)
    for i in range(0, len(rows), ROWS):
        r = rows[i : i + ROWS] % p
        r = np.where(r > p // 2, r - p, r).astype(np.float64)
        out = (out + (r.T @ r).astype(np.int64)) % p
    return out


def remaindered(residues: dict[int, int]) -> int:
    """The whole number nearest to zero with these residues by prime."""
    whole = prod(residues)
    x = sum(r * (whole // p) * pow(whole // p, -1, p) for p, r in residues.items()) % whole
    return x - whole if 2 * x > whole else x


@dataclass(frozen=True)
class Moments:
    """n vectors, their exact sums by dimension, and the exact sums of products of two dimensions (cross[i][j])."""

    n: int
    sums: list[int]
    cross: list[list[int]]

    def covariance(self) -> np.ndarray:
        """Divisor n; every entry is its exact value rounded once."""
        d = range(len(self.sums))
        return np.array([[(self.n * self.cross[i][j] - self.sums[i] * self.sums[j]) / self.n**2 for j in d] for i in d])


def moments(fit: DataFrame, n: int, largest: int, dim: int) -> Moments:
    """The moments of the n vectors x (longs, of absolute values up to largest) of the table fit.

    A task multiplies its rows, behind a column of ones, modulo each prime and hands on residues only; their sums reach
    the driver, (dim + 1) ** 2 / 2 numbers a prime, however many rows there are.
    """
    ps = primes(n * max(1, largest) ** 2)
    upper = np.triu_indices(dim + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {p: np.zeros((dim + 1, dim + 1), np.int64) for p in ps}
        for batch in batches:
            if batch.num_rows:
                rows = np.column_stack([np.ones(batch.num_rows, np.int64), longs(batch.column(0), dim)])
                for p in ps:
                    held[p] = (held[p] + residue_gram(rows, p)) % p
        for p in ps:
            own = held[p][upper]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), p)), pa.array(np.arange(len(own))), pa.array(own)], ["p", "cell", "residue"])

    ship(fit.sparkSession)
    parts = fit.select("x").mapInArrow(run, "p long, cell long, residue long").groupBy("cell", "p").agg(F.sum("residue").alias("residue")).toArrow()
    found: dict[int, dict[int, int]] = {}
    for cell, p, residue in zip(*(parts.column(c).to_pylist() for c in ("cell", "p", "residue")), strict=True):
        found.setdefault(cell, {})[p] = residue % p
    full = [[0] * (dim + 1) for _ in range(dim + 1)]
    for cell, (i, j) in enumerate(zip(*(u.tolist() for u in upper), strict=True)):
        full[i][j] = full[j][i] = remaindered(found[cell])
    return Moments(full[0][0], full[0][1:], [row[1:] for row in full[1:]])


def longs(column: pa.ListArray, dim: int) -> np.ndarray:
    """A matrix of the column's vectors, which all have dim longs and no nulls."""
    at = int(column.offsets[0].as_py())
    return column.values.slice(at, len(column) * dim).to_numpy().reshape(-1, dim)


def deviations(rows: np.ndarray, m: Moments) -> np.ndarray:
    """n * x - S, exact: longs where they fit, else Python's whole numbers."""
    shift = [s // m.n for s in m.sums]  # rows are first moved near zero, so that n * x fits for more rows
    near, rest = rows - np.array(shift), [s - m.n * c for s, c in zip(m.sums, shift, strict=True)]
    if m.n * (int(np.abs(near).max(initial=0)) + 1) < LONG:
        return m.n * near - np.array(rest)
    return m.n * near.astype(object) - np.array(rest, dtype=object)


def squared(dev: np.ndarray) -> list[int | None]:
    """Sums of the squares of each row, exact; None where one is no long."""
    top = int(abs(dev).max(initial=0))
    if dev.dtype != object and top * top * max(1, dev.shape[1]) < LONG:
        return (dev * dev).sum(axis=1).tolist()
    return [x if x < LONG else None for x in (sum(int(v) ** 2 for v in row) for row in dev)]


def _x(vector_col: str, scale: int, offset: int) -> Column:
    return F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long"))


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each usable row and leading component.

    Entries become x = floor(scale * entry) + offset. The components are the unit eigenvectors of the covariance
    (divisor n) of the distinct x, numbered from 1 by falling eigenvalue, their largest entry positive; whitened is the
    centred x on the component over the root of its eigenvalue, explained the eigenvalue's share of the trace, deviation
    the exact sum of (n * x - S) ** 2, identity_error the largest entry of the distinct rows' whitened covariance minus
    the identity, measured on the rows.

    Rows whose vector is null, empty, or holds null or non-finite entries give no rows; vectors of unlike lengths are an
    error. Null ids stay, equal rows each give theirs. A component without variance (equal rows, or fewer distinct ones
    than components) has a null whitened and no part in identity_error; where there is no variance at all, explained and
    identity_error are null too. A deviation that is no long (from some ten million distinct rows on) is null. No rows
    give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    of_id = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {of_id}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    real = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.coalesce(real, F.lit(False))).select(F.col(id_col).alias("id"), _x(vector_col, scale, offset).alias("x"))
    fit = cut(rows.select("x").distinct())
    about = fit.agg(F.count("*"), F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))), F.min(F.size("x")), F.max(F.size("x"))).first()
    n, largest, dim, longest = about
    if not n:
        return spark.createDataFrame([], schema)
    if dim != longest:
        raise ValueError(f"vectors have from {dim} to {longest} entries")
    m = moments(fit, n, largest, dim)
    cov = m.covariance()
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    trace = sum(m.n * m.cross[i][i] - m.sums[i] ** 2 for i in range(dim)) / m.n**2
    live = values > dim * np.finfo(float).eps * max(values[0], 0)
    axes = basis / np.sqrt(np.where(live, values, np.nan))
    k = len(values)

    def projected(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        dev = deviations(longs(column, dim), m)
        return dev, (dev / m.n).astype(np.float64) @ axes

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k + 1, k + 1))
        for batch in batches:
            if batch.num_rows:
                w = np.column_stack([np.ones(batch.num_rows), projected(batch.column(0))[1]])
                held += w.T @ w
        own = held.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(own)], ["cell", "part"])

    sums = np.zeros((k + 1) ** 2)
    for r in fit.select("x").mapInArrow(spread, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("part")).collect():
        sums[r.cell] = r.part
    sums = sums.reshape(k + 1, k + 1) / m.n
    error = np.abs(sums[1:, 1:] - np.outer(sums[0, 1:], sums[0, 1:]) - np.eye(k))[np.ix_(live, live)]
    identity = float(error.max()) if live.any() else None
    shares = (values / trace).tolist() if trace > 0 else [None] * k

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                dev, w = projected(part.column(1))
                size, at = part.num_rows, pa.array(np.repeat(np.arange(part.num_rows), k))
                whitened = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                columns = [part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, m.n)), pa.array(squared(dev), pa.int64()).take(at), whitened, pa.array(shares * size, pa.float64()), pa.array([identity] * (size * k), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(rows_of, schema)
