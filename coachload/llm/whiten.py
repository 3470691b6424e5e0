"""Embedding whitening (13) by mixed-precision refinement.

An entry c becomes x = floor(256 c); the fit list is each distinct x vector
once.  Spark finds the distinct vectors, their exact sums and the covariance
(every task multiplies centred rows and adds up; bands of the matrix are summed
in groups of their own), and projects the rows.  The driver holds d x d
matrices only, whatever the number of rows.

The eigenproblem of that small matrix is solved in float32 and then corrected
by matrix multiplications in extended precision (Ogita and Aishima): with the
approximate eigenvectors X of V, R = I - X'X, S = X'VX and l = S_ii / (1 - R_ii),

    E_ij = (S_ij + l_j R_ij) / (l_j - l_i)   where l_i, l_j are well apart,
    E_ij = R_ij / 2                          else (the diagonal, a cluster)

gives X + XE, whose error is the square of X's.  Eigenvalues closer than the
residual's size form a cluster; its vectors span the right space but may be any
basis of it, so the cluster's own small problem X_c'(V - mI)X_c, scaled to its
spread, is solved the same way and its vectors turn the basis, after which the
correction separates them.

Sums are exact (integers in two halves).  A row is centred as (n x - S) / n with
the difference in integers, before anything is multiplied.

Defined cases: rows whose vector is null, empty, or holds a null, non-finite or
(after scaling) over-long entry have no result; rows of another length than the
most frequent one (of equal ones the longest) have none either; repeated
vectors and ids keep a row each; components without variance (all of them for a
single distinct vector) are numbered last and have null ``whitened``; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored

SCALE = 256
# Rows of the covariance matrix that a group sums, and rows a task multiplies at a time.
BAND = 64
ROWS = 4096
# Beyond this an entry times SCALE has no long.
LONGEST = 2.0 ** 62
# Steps of the correction; it doubles the right digits each time.
STEPS = 20
# Times that clusters are solved again, and clusters inside clusters.
ROUNDS, DEPTH = 4, 3
EXTENDED = np.longdouble


# -- the small eigenproblem -------------------------------------------------------------------------

def _step(v: np.ndarray, x: np.ndarray):
    """One correction: (X + XE, eigenvalues, size of E, width that tells
    eigenvalues apart)."""
    n = len(v)
    r = np.eye(n, dtype=EXTENDED) - x.T @ x
    s = x.T @ (v @ x)
    value = np.diag(s) / (1 - np.diag(r))
    norm = np.abs(v).sum(axis=1).max()
    off = s - np.diag(value)
    width = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
    gap = value[None, :] - value[:, None]
    far = np.abs(gap) > width
    e = np.where(far, (s + value[None, :] * r) / np.where(far, gap, 1), r / 2)
    return x + x @ e, value, np.abs(e).max(), width


def _clusters(value: np.ndarray, width) -> list[np.ndarray]:
    """Groups of two or more eigenvalues whose neighbours are within ``width``."""
    order = np.argsort(value)
    cuts = np.flatnonzero(np.diff(value[order]) > width) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def _orthogonal(x: np.ndarray) -> np.ndarray:
    for _ in range(4):
        r = np.eye(x.shape[1], dtype=EXTENDED) - x.T @ x
        x = x + x @ r / 2
        if np.abs(r).max() < 1e-10:           # the next one is below the precision
            break
    return x


def _refined(v: np.ndarray, x: np.ndarray):
    """Corrections until they stop shrinking."""
    tiny, last, slow = len(v) * np.finfo(EXTENDED).eps, np.inf, 0
    for _ in range(STEPS):
        new, value, change, width = _step(v, x)
        if not change < 0.3:                  # beyond the correction's reach: only orthogonal again
            new = _orthogonal(x)
        x = new
        slow = slow + 1 if change > last / 2 else 0
        last = change
        if change <= tiny or slow > 1:
            break
    return _orthogonal(x), value, width


def eigen(v: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric
    matrix, in extended precision."""
    v = np.asarray(v, EXTENDED)
    n = len(v)
    size = np.abs(v).max() if n else EXTENDED(0)
    if not size > 0:
        return np.zeros(n, EXTENDED), np.eye(n, dtype=EXTENDED)
    v = (v + v.T) / (2 * size)
    x = np.linalg.eigh(v.astype(np.float32))[1].astype(EXTENDED)
    for _ in range(ROUNDS):
        x, value, width = _refined(v, x)
        groups = _clusters(value, max(width, n * np.finfo(EXTENDED).eps)) if depth < DEPTH else []
        if not groups:
            break
        for own in groups:                    # the cluster's own problem, relative to its middle
            basis = _orthogonal(np.linalg.qr(x[:, own].astype(np.float64))[0].astype(EXTENDED))
            inner = basis.T @ (v @ basis - basis * value[own].mean())
            x[:, own] = basis @ eigen(inner, depth + 1)[1]
        x = _orthogonal(x)
    value = np.einsum("ij,ij->j", x, v @ x)
    order = np.argsort(-value, kind="stable")
    x, value = x[:, order], value[order]
    first = np.abs(x).argmax(axis=0)           # the sign: a vector's largest entry is positive
    return value * size, x * np.where(x[first, np.arange(n)] < 0, -1, 1)


# -- rows -------------------------------------------------------------------------------------------

def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _halves(batches: Iterator[pa.RecordBatch]):
    """One row a task: the sums of the entries, upper and lower 32 bits."""
    total = None
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column(0))
            own = [b.num_rows, *(x >> 32).sum(axis=0).tolist(), *(x & 0xFFFFFFFF).sum(axis=0).tolist()]
            total = own if total is None else [p + q for p, q in zip(total, own)]
    if total is not None:
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "s": pa.array(total, pa.int64())})


def _centred(x: np.ndarray, n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(n x - S, exact; x - S / n as double)."""
    reach = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * n + max(map(abs, total), default=0)
    if reach < 1 << 63:
        d = x * n - np.array(total, np.int64)
    else:
        d = x.astype(object) * n - np.array(total, object)
    return d, (d / n).astype(np.float64)


def _deviation(d: np.ndarray) -> list[int]:
    reach = max(abs(int(d.min(initial=0))), abs(int(d.max(initial=0))))
    if reach * reach * d.shape[1] < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    o = d.astype(object)
    return (o * o).sum(axis=1).tolist()


def _products(rows: DataFrame, make, width: int) -> np.ndarray:
    """Sum over the rows of y y' (``width`` square), y from ``make`` of x rows:
    every task adds up its own, bands are summed in groups."""
    def run(batches):
        total = np.zeros((width, width), EXTENDED)
        some = False
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                y = make(_matrix(b.slice(at, ROWS).column(0)))
                total += y.T @ y
                some = True
        if some:
            high = total.astype(np.float64)
            low = (total - high).astype(np.float64)
            at = range(0, width, BAND)
            yield pa.RecordBatch.from_pydict({"band": pa.array([i // BAND for i in at], pa.int32()),
                                              "high": pa.array([high[i:i + BAND].tobytes() for i in at], pa.binary()),
                                              "low": pa.array([low[i:i + BAND].tobytes() for i in at], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = 0
        for name in ("high", "low"):
            for x in table.column(name).to_pylist():
                total = total + np.frombuffer(x, np.float64).astype(EXTENDED)
        high = total.astype(np.float64)
        return pa.Table.from_pydict({"band": table.column("band").slice(0, 1), "high": pa.array([high.tobytes()], pa.binary()),
                                     "low": pa.array([(total - high).astype(np.float64).tobytes()], pa.binary())})

    kind = "band int, high binary, low binary"
    out = np.zeros((width, width), EXTENDED)
    for r in rows.mapInArrow(run, kind).groupBy("band").applyInArrow(add, kind).collect():
        at = r["band"] * BAND
        out[at:at + BAND] = sum(np.frombuffer(r[k], np.float64).astype(EXTENDED) for k in ("high", "low")).reshape(-1, width)
    return out


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error),
    a row for each usable vector and each of the first ``components``;
    ``deviation`` in decimal digits, exact at any size."""
    kind = "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                         F.col(f"`{vector_col}`").cast("array<double>").alias("c"))
    good = (F.size("c") > 0) & F.forall("c", lambda c: F.coalesce((F.abs(c) < LONGEST / SCALE) & ~F.isnan(c), F.lit(False)))
    rows = stored(own.where(F.col("c").isNotNull() & good)
                  .select("vec_id", F.transform("c", lambda c: F.floor(c * F.lit(float(SCALE))).cast("long")).alias("x")), "scaled")
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], kind)
    d = most["d"]
    rows = rows.where(F.size("x") == d)
    fit = stored(rows.select("x").distinct(), "fit")
    sums = {r["i"]: int(r["s"]) for r in
            fit.mapInArrow(_halves, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    n = sums[0]
    total = [(sums[1 + j] << 32) + sums[1 + d + j] for j in range(d)]
    v = _products(fit, lambda x: _centred(x, n, total)[1], d) / n
    value, vector = eigen(v)
    k = min(components, d)
    trace = np.trace(v)
    held = value[:k] > d * np.finfo(np.float64).eps * max(value[0], 0)
    turn = (vector[:, :k] / np.sqrt(np.where(held, value[:k], 1))).astype(np.float64)
    share = [float(e / trace) if trace > 0 else None for e in value[:k]]
    m = int(held.sum())
    error = _products(fit, lambda x: _centred(x, n, total)[1] @ turn[:, :m], m) / n if m else np.zeros((0, 0))
    error = float(np.abs(error - np.eye(m)).max()) if m else None

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                exact, y = _centred(_matrix(part.column(1)), n, total)
                r, w = part.num_rows, y @ turn
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(r), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array(np.full(r * k, n, np.int64)),
                    pa.array([s for s in map(str, _deviation(exact)) for _ in range(k)], pa.string()),
                    pa.array(w.ravel(), pa.float64(), mask=~np.tile(held, r)),
                    pa.array(share * r, pa.float64()), pa.array([error] * (r * k), pa.float64())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, kind)
