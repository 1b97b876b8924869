"""Whitening of embeddings with the leading eigenvectors of their covariance, by Jacobi-Davidson.

An entry c becomes the whole number x = floor(64 c) + 1,000,000. The fit list is each distinct
vector once; its count n and sums S are exact. The covariance V is never formed: a block of
vectors is multiplied by it in one pass over the fit list, each row centred as (n x - S) / n
before it is multiplied, tasks' sums added up by Spark. The driver holds a search space of a
few dozen vectors only.

A round takes the Ritz pairs of the search space, locks those whose residual has reached
double precision, and extends the space by the solutions of the projected correction equations
(I - Q Q')(V - theta I)(I - Q Q') t = -r of all others, Q being the locked and the current
vectors. A few steps of MINRES solve all of them side by side, one pass a step. The space is
cut back to its best vectors when it gets too large. Eigenvalues that are zero to double
precision have no component, so a table may have fewer than asked for, or none.

Rows whose vector is null or has null or non-finite entries are dropped, and so are vectors
whose length isn't the table's most frequent one (the longer one in a tie), as they lie in
another space, and empty ones. Equal vectors and repeated ids are rows of their own; null ids
stay. An empty table gives no rows. A batch holds ten thousand vectors at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradpath.session import cut_lineage

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: MINRES steps for a correction, and rounds after which the solver gives up.
STEPS, ROUNDS = 4, 200
#: Vectors besides those asked for in the first search space, and the factor that the space may grow by.
SPARE, GROWTH = 4, 4
#: Entries that a task multiplies at once.
SLICE = 1 << 21
EPS = float(np.finfo(np.float64).eps)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vector.isNotNull() & finite


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("bigint"))


def _matrix(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """The vectors of a list column, some at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten()).reshape(-1, d)
    step = max(SLICE // d, 1)
    for i in range(0, len(flat), step):
        yield flat[i : i + step]


@dataclass
class FitList:
    """The distinct vectors (x), their number, length and exact sums."""

    x: DataFrame
    n: int
    d: int
    sums: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        return self.n * x - self.sums

    def summed(self, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of ``part`` (``size`` numbers) over slices (n x - S) / n of the fit list."""
        n, sums, d = self.n, self.sums, self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for x in _matrix(batch.column("x"), d):
                    total += part((n * x - sums) / float(n)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["total"])

        parts = self.x.mapInArrow(run, "total array<double>").select(F.posexplode("total").alias("at", "value"))
        got = parts.groupBy("at").agg(F.sum("value").alias("value")).toArrow()  # ``size`` rows
        out = np.zeros(size)
        out[np.asarray(got["at"])] = np.asarray(got["value"])
        return out

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of vectors, in one pass."""
        return self.summed(lambda z: z.T @ (z @ block), block.size).reshape(block.shape) / self.n


def fit_list(vectors: DataFrame) -> FitList | None:
    """The fit list of ``vectors`` (x), all of one length; None without any."""
    distinct = cut_lineage(vectors.select("x").distinct())
    first = distinct.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    if not first["n"]:
        return None
    sums = distinct.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()  # d rows
    exact = np.zeros(first["d"], np.int64)
    for r in sums:
        exact[r["at"]] = int(r["s"])
    return FitList(distinct, first["n"], first["d"], exact)


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to the orthonormal blocks ``against``."""
    kept = np.zeros((len(new), 0))
    for column in new.T:
        v, size = column.copy(), np.linalg.norm(column)
        if not size or not np.isfinite(size):
            continue
        v /= size
        for _ in range(3):
            for q in (*against, kept):
                v -= q @ (q.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v /= left
        else:
            kept = np.hstack((kept, v[:, None]))
    return kept


def _minres(times: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, q: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of (I - QQ')(V - theta I)(I - QQ') t = b, a column for each theta."""
    project = lambda y: y - q @ (q.T @ y)
    inverse = lambda y: np.where(y > 0, 1 / np.where(y > 0, y, 1), 0)
    v = project(project(b))
    beta = np.linalg.norm(v, axis=0)
    v, old, x = v * inverse(beta), np.zeros_like(v), np.zeros_like(v)
    w0, w1, eta, beta = np.zeros_like(v), np.zeros_like(v), beta, np.zeros_like(beta)
    c0, c1, s0, s1 = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        y = project(project(times(v) - v * theta))
        alpha = (v * y).sum(axis=0)
        y -= v * alpha + old * beta
        after = np.linalg.norm(y, axis=0)
        delta = c1 * alpha - c0 * s1 * beta
        rho, rho2, rho3 = np.hypot(delta, after), s1 * alpha + c0 * c1 * beta, s0 * beta
        c0, c1, s0, s1 = c1, delta * inverse(rho), s1, after * inverse(rho)
        w0, w1 = w1, (v - w0 * rho3 - w1 * rho2) * inverse(rho)
        x += w1 * (c1 * eta)
        eta = -s1 * eta
        old, v, beta = v, y * inverse(after), after
    return x


def leading(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, steps: int = STEPS, rounds: int = ROUNDS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the symmetric positive operator ``times``."""
    wanted = min(wanted, d)
    start = min(wanted + SPARE, d)
    space = _orthonormal(np.random.default_rng(seed).standard_normal((d, start)))
    image = times(space)
    locked, values, top = np.zeros((d, 0)), np.zeros(0), 0.0
    for _ in range(rounds):
        small = space.T @ image
        theta, u = np.linalg.eigh((small + small.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        space, image = space @ u, image @ u  # Ritz vectors, best first
        top = max(top, theta[0], 0.0)
        left = wanted - len(values)
        residual = image[:, :left] - space[:, :left] * theta[:left]
        done = np.linalg.norm(residual, axis=0) <= max(d, 32) * EPS * top
        if space.shape[1] + len(values) == d:  # nothing is left to search: what remains is rounding
            done[:] = True
        locked, values = np.hstack((locked, space[:, :left][:, done])), np.append(values, theta[:left][done])
        if len(values) == wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        open_ = np.flatnonzero(~done)
        rest = np.concatenate((open_, np.arange(left, space.shape[1])))
        now, residual, shift = space[:, open_], residual[:, open_], theta[open_]
        most = max(GROWTH * start, start + left)
        if len(rest) + len(open_) > most:
            rest = rest[:start]
        space, image = space[:, rest], image[:, rest]
        t = _minres(times, shift, np.hstack((locked, now)), -residual, steps)
        new = _orthonormal(t, locked, space)
        if not new.shape[1]:  # corrections that add nothing: search elsewhere
            new = _orthonormal(np.random.default_rng(seed + len(values) + 1).standard_normal((d, len(open_))), locked, space)
        space, image = np.hstack((space, new)), np.hstack((image, times(new)))
    raise RuntimeError(f"{len(values)} of {wanted} eigenpairs after {rounds} rounds")


@dataclass
class Model:
    """Eigenvalues, unit eigenvectors (columns), trace, and how far the whitened covariance is from the identity."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def fit(vectors: FitList, wanted: int = COMPONENTS) -> Model:
    """The leading components of the fit list."""
    trace = float(vectors.summed(lambda z: np.array([(z * z).sum()]), 1)[0]) / vectors.n
    values, basis = leading(vectors.times, vectors.d, wanted) if trace > 0 else (np.zeros(0), np.zeros((vectors.d, 0)))
    real = values > max(vectors.d, 32) * EPS * (values[0] if len(values) else 0)
    values, basis = values[real], basis[:, real]
    k = len(values)
    if not k:
        return Model(values, basis, trace, 0.0)
    scaled = basis / np.sqrt(values)
    mean = vectors.summed(lambda z: (z @ scaled).sum(axis=0), k) / vectors.n

    def spread(z: np.ndarray) -> np.ndarray:
        w = z @ scaled - mean
        return w.T @ w

    cov = vectors.summed(spread, k * k).reshape(k, k) / vectors.n
    return Model(values, basis, trace, float(np.abs(cov - np.eye(k)).max()))


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable row of
    ``rows`` and component, numbered from 1 by falling eigenvalue."""
    schema = "id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    named = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).filter(usable(F.col("v")) & (F.size("v") > 0))
    lengths = named.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return rows.sparkSession.createDataFrame([], schema)
    ready = cut_lineage(named.filter(F.size("v") == lengths[0]["d"]).select("id", whole_numbers(F.col("v")).alias("x")))
    fitted = fit_list(ready)
    model = fit(fitted, wanted)
    k, n, d, sums = len(model.values), fitted.n, fitted.d, fitted.sums
    scaled, share, error = model.vectors / np.sqrt(model.values), model.values / (model.trace or 1.0), model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _matrix(batch.column("x"), d):
                z, m = n * x - sums, len(x)
                if m and ((z.astype(np.float64) ** 2).sum(axis=1) >= 2.0**63).any():
                    raise OverflowError("a deviation is larger than a bigint")
                deviation = (z * z).sum(axis=1)  # exact: sums below 2**63 are right whatever wraps on the way
                w = (z / float(n)) @ scaled
                ids = batch.column("id").slice(at, m).take(pa.array(np.repeat(np.arange(m), k)))
                at += m
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(np.repeat(deviation, k)), pa.array(w.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return ready.mapInArrow(run, schema)
