"""Embedding whitening by mixed-precision eigenvectors of a distributed covariance.

1. Entries become whole numbers ``x = floor(scale * c)``; the covariance is taken over
   the distinct vectors. It is exact: vectors are centred at the rounded mean, products
   of these small whole numbers are summed by tasks, and the rest of the centring is
   done in whole numbers of any length, ``n * sum(y y') - sum(y) sum(y)'``.
2. Eigenvectors come from a single-precision solve and are corrected by the
   matrix-multiplication iteration of Ogita and Aishima in extended precision. Every
   step roughly squares the error. Eigenvalues that the iteration cannot tell apart are
   handled by sub-solves: the matrix, shifted by the cluster's mean and projected on
   the cluster, is a small problem of its own with far larger relative gaps.
3. Rows are centred, projected and scaled in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

SCALE = 256
MAX_DIMENSION = 4096  # the covariance of so many dimensions still fits the driver
EXACT = 2**53  # sums of products below this are exact in doubles
STEPS, ROUNDS = 24, 3  # most correction steps before clusters are solved, and rounds of both; a handful of steps is usual
LEAST_EIGENVALUE = 1e-13  # share of the trace below which a component counts as empty

Wide = np.longdouble


# --- eigenvectors ----------------------------------------------------------------------------

def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Groups of places whose sorted eigenvalues lie within ``gap`` of a neighbour."""
    order = np.argsort(-values, kind="stable")
    cut = np.flatnonzero(-np.diff(values[order]) > gap) + 1
    return np.split(order, cut)


def _correct(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One step of the iteration: better vectors, their eigenvalues, the gap it can tell apart, and the size of the correction."""
    d = len(a)
    r = np.eye(d, dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    gap = 2 * (np.sqrt((off ** 2).sum()) + np.sqrt((a ** 2).sum()) * np.sqrt((r ** 2).sum()))
    between = values[None, :] - values[:, None]
    apart = np.abs(between) > gap
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, between, 1), r / 2)
    return x + x @ e, values, float(gap), float(np.abs(e).max())


def refine(a: np.ndarray, x: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of the symmetric ``a`` in extended precision,
    from approximate vectors ``x``; in falling order."""
    a, x = a.astype(Wide), x.astype(Wide)
    tiny = float(np.finfo(Wide).eps) * len(a)
    size = float(np.sqrt((a ** 2).sum()))
    for _ in range(ROUNDS):
        last = np.inf
        for _ in range(STEPS):
            x, values, gap, change = _correct(a, x)
            if change <= 4 * tiny or change >= last / 2 and change < 1e-9:
                break
            last = change
        solved = 0
        for group in _clusters(values, gap):
            if len(group) > 1 and depth < 8:
                own = x[:, group]
                small = own.T @ (a @ own)
                small = (small + small.T) / 2
                small = small - np.eye(len(group), dtype=Wide) * (np.trace(small) / len(group))
                spread = float(np.abs(small).max())
                if spread > tiny * size:  # else the eigenvalues are equal as far as can be told
                    w = np.linalg.eigh((small / Wide(spread)).astype(np.float64))[1][:, ::-1]
                    x[:, group] = own @ refine(small / Wide(spread), w, depth + 1)[1]
                    solved += 1
        if not solved:
            break
    # rotations round: orthonormal again to the last digit
    for _ in range(2):
        r = np.eye(len(a), dtype=Wide) - x.T @ x
        x = x + x @ (r / 2)
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a covariance matrix in
    extended precision: a single-precision solve, then ``refine``."""
    if not len(covariance):
        return np.empty(0), np.empty((0, 0))
    size = np.abs(covariance).max()
    if not size:
        return np.zeros(len(covariance)), np.eye(len(covariance))
    scaled = covariance / size
    start = np.linalg.eigh(scaled.astype(np.float32))[1][:, ::-1]
    values, x = refine(scaled, start)
    return (values * size), x


# --- sums over rows --------------------------------------------------------------------------

def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, x`` for the rows with a complete, finite, non-empty vector."""
    kind = table.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            flat = v.flatten()
            ok = ~flat.is_null().to_numpy(zero_copy_only=False)
            c = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
            ok &= np.isfinite(c)
            bad = np.concatenate([[0], np.cumsum(~ok)])
            lengths = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            keep = (lengths > 0) & (bad[ends] == bad[ends - lengths])
            x = np.floor(scale * np.where(ok, c, 0.0)).clip(-2.0**62, 2.0**62).astype(np.int64)
            taken = np.repeat(keep, lengths)
            offsets = np.concatenate([[0], np.cumsum(lengths[keep])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[taken]))],
                                             names=["vec_id", "x"])

    return table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, f"vec_id {kind}, x array<long>")


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _total(rows: DataFrame, size: int, run) -> list[int]:
    """Sums by place of the arrays that ``run`` makes of every task; exact, of any size up to 38 digits."""
    parts = rows.select("x").mapInArrow(run, "part array<decimal(38,0)>")
    got = parts.select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # one row per place
    out = [0] * size
    for r in got:
        out[r["i"]] = int(r["v"])
    return out


def sums(fit: DataFrame, d: int) -> list[int]:
    """Per-dimension sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for b in batches:
            x = _matrix(b.column(0), d)
            small = len(x) and int(np.abs(x).max()) * len(x) < 2**62
            part = x.sum(axis=0).tolist() if small or not len(x) else x.astype(object).sum(axis=0).tolist()
            total = [p + q for p, q in zip(total, part)]
        yield _decimals(total)

    return _total(fit, d, run)


def _decimals(values: list[int]) -> pa.RecordBatch:
    from decimal import Decimal

    flat = pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), flat)], names=["part"])


def products(fit: DataFrame, centre: list[int]) -> list[int]:
    """Sums of the products of all pairs of centred coordinates (upper triangle, row by row)."""
    d = len(centre)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * len(upper[0])
        held = np.zeros((d, d))

        def flush() -> None:
            nonlocal total, held
            total = [p + int(q) for p, q in zip(total, held[upper].tolist())]
            held = np.zeros((d, d))

        bound = 0.0
        for b in batches:
            x = _matrix(b.column(0), d)
            if not len(x):
                continue
            most = max(abs(int(x.max()) - min(centre)), abs(int(x.min()) - max(centre)), abs(int(x.max()) - max(centre)), abs(int(x.min()) - min(centre)))
            rows = EXACT // max(1, most * most)
            if rows < 1:  # beyond doubles: whole numbers of any length
                y = x.astype(object) - np.array(centre, dtype=object)
                total = [p + q for p, q in zip(total, (y.T @ y)[upper].tolist())]
                continue
            step = min(len(x), rows)
            for lo in range(0, len(x), step):
                y = (x[lo:lo + step] - np.array(centre, dtype=np.int64)).astype(np.float64)
                if bound + len(y) * float(most) ** 2 >= EXACT:
                    flush()
                    bound = 0.0
                held += y.T @ y
                bound += len(y) * float(most) ** 2
        flush()
        yield _decimals(total)

    return _total(fit, len(upper[0]), run)


# --- the operator ----------------------------------------------------------------------------

@dataclass
class Whitening:
    """A fitted transformation: ``n`` vectors with sums ``s``, components (columns of ``vectors``) and their eigenvalues."""
    scale: int
    n: int
    s: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """``n * x - s``, exact: long, or Python integers where a long may not hold it."""
        most = self.n * (int(np.abs(x).max()) if x.size else 0) + max(map(abs, self.s), default=0)
        kind = np.int64 if most < 2**62 else object
        return x.astype(kind) * (self.n if kind is object else np.int64(self.n)) - np.array(self.s, dtype=kind)

    def project(self, dev: np.ndarray) -> np.ndarray:
        """Whitened coordinates (rows x components); NaN for an empty component."""
        root = np.sqrt(np.where(self.values > 0, self.values, np.nan))
        return (dev.astype(np.float64) / self.n) @ self.vectors / root


def fit(rows: DataFrame, components: int, scale: int = SCALE) -> Whitening | None:
    """Fit on the distinct vectors of ``rows`` (``x`` arrays of one length, a stored table); None if there are none."""
    distinct = stage(rows.select("x").distinct(), "fit_list")
    n = distinct.count()
    if not n:
        return None
    d = distinct.select(F.size("x")).first()[0]
    if d > MAX_DIMENSION:
        raise ValueError(f"vectors have {d} dimensions: at most {MAX_DIMENSION} are supported")
    s = sums(distinct, d)
    centre = [(2 * v + n) // (2 * n) for v in s]
    first = [v - n * c for v, c in zip(s, centre)]  # sums of the centred vectors
    second = products(distinct, centre)
    cov = np.zeros((d, d), dtype=Wide)
    for (i, j), v in zip(zip(*np.triu_indices(d)), second):
        exact = n * v - first[i] * first[j]  # n * n * covariance
        cov[i, j] = cov[j, i] = Wide(exact // n) / n + Wide(exact % n) / n / n
    values, vectors = eigen(cov)
    trace = float(np.trace(cov))
    k = min(components, d)
    values = np.array([float(v) if v > LEAST_EIGENVALUE * trace else 0.0 for v in values[:k]])
    model = Whitening(scale, n, s, values, vectors[:, :k].astype(np.float64), trace, 0.0)
    model.identity_error = _identity_error(distinct, model, k)
    return model


def _identity_error(fit_list: DataFrame, model: Whitening, k: int) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, over components that are not empty."""
    d = len(model.s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            w = model.project(model.deviation(_matrix(b.column(0), d)))
            w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
            total += np.nan_to_num(w).T @ np.nan_to_num(w)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, total.size], pa.int32()), pa.array(total.ravel()))], names=["part"])

    got = fit_list.select("x").mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((k + 1) ** 2)
    for r in got:
        m[r["i"]] = r["v"]
    m = m.reshape(k + 1, k + 1) / model.n
    cov = m[:k, :k] - np.outer(m[:k, k], m[:k, k])
    full = model.values > 0
    return float(np.abs(cov - np.eye(k))[np.ix_(full, full)].max()) if full.any() else 0.0


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row of
    ``rows`` (``vec_id, x``) and component."""
    kind, d, k = rows.schema["vec_id"].dataType.simpleString(), len(model.s), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), d)
            if not len(x):
                continue
            dev = model.deviation(x)
            most = int(np.abs(dev).max())
            if most * most * d < 2**63:
                deviation = pa.array((dev * dev).sum(axis=1), pa.int64())
            else:  # null where a long cannot hold it
                whole = [sum(v * v for v in r) for r in dev.tolist()]
                deviation = pa.array([v if v < 2**63 else None for v in whole], pa.int64())
            w = model.project(dev)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), model.n)),
                 deviation.take(pa.array(each)), pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                 pa.array(np.tile(model.values / model.trace if model.trace else model.values, len(x))), pa.array(np.full(len(each), model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(
        run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(table: DataFrame, *, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Whiten the vectors of ``table``: per remaining row and component
    ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    * rows whose vector is null, empty, or holds null or non-finite entries are
      dropped; so are rows of another length than the commonest (the longer of two
      that are equally common);
    * repeated rows and equal vectors: each row is returned, the fit takes a vector once;
    * null ids: kept as they are; ties in the eigenvalues: any basis of their space;
    * a component without variance (fewer vectors than components, or constant
      columns): ``whitened`` null, ``explained`` 0, not part of ``identity_error``;
      fewer dimensions than components: as many components as dimensions;
    * ``deviation`` is null where a long cannot hold it;
    * long vectors: up to ``MAX_DIMENSION`` entries, more raise; empty table: empty
      result; extra columns of any name are ignored."""
    rows = stage(whole_vectors(table, id_col, vector_col, scale), "whole_vectors")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        kind = table.schema[id_col].dataType.simpleString()
        return table.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = rows.where(F.size("x") == common["d"])
    return transform(rows, fit(rows, components, scale))
