"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Every vector becomes whole numbers x; each distinct x counts once in the fit. The covariance V is
never formed: all that is asked of the data are products V Q with a slim block Q, each one pass
over the centred fit vectors in which tasks add up X'(X Q) and Spark sums their parts by dimension.

A short Lanczos run bounds the spectrum from below. A round then applies a Chebyshev polynomial
of V to the block by its three-term recurrence, one pass a step: small on the unwanted part of the
spectrum, steep above it. QR and a Rayleigh-Ritz step follow. Leading pairs whose residual has come
down to rounding are locked and projected out of the further steps. When all wanted ones are, a new
random block is filtered beside them: the result is certified if none of its Ritz values rises
above the least wanted one; otherwise iteration goes on with that block.

Centring keeps whole numbers whole: with sums S = n q + r, x - S/n is (x - q) - r/n.

Edge cases: vectors that are NULL or hold NULL or non-finite components take no part; of vectors of
unequal length the shorter count as padded with zeros; components beyond 2^46 count as 2^46; rows
that repeat, or share an id, are rows of their own in the result; a NULL id stays NULL. Components
whose eigenvalue is zero to double precision have no whitened values and give no rows, so one
distinct vector gives none, like an empty table. Equal eigenvalues have any orthonormal basis. A
deviation beyond the range of long is NULL. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import cut, finite_vectors, matrix_of

SHIFT = 1_000_000
GUARDS = 16
LANCZOS_STEPS = 10
DEGREES = (2, 20)
# What a round is to gain on the unwanted part of the spectrum.
GAIN = 1e7
ROUNDS = 60
# Residuals at this many roundings of the largest eigenvalue count as converged; where they no
# longer fall, up to the looser bound does.
TIGHT, LOOSE = 32, 4096
PART_BYTES, LARGEST_PART = 1 << 20, 128 << 20
EPS = float(np.finfo(float).eps)


@dataclass
class Centre:
    """The number of fit vectors and their sums, n * whole + rest."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest.astype(float) / self.n


@dataclass
class Fit:
    """The distinct vectors in packed blocks."""

    blocks: DataFrame
    centre: Centre

    def summed(self, product) -> np.ndarray:
        """The sum over all blocks of ``product(centred block)``, a matrix of a fixed shape."""
        width, centred = len(self.centre.whole), self.centre

        def part(batches):
            total = None
            for batch in batches:
                for data in batch.column("data"):
                    x = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, width)
                    here = product(centred(x))
                    total = here if total is None else total + here
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(total)), pa.int32()),
                     pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

        parts = self.blocks.mapInArrow(part, "i int, row array<double>")
        columns = len(product(np.zeros((0, width))).T)
        sums = (parts.groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}")
                                         for j in range(columns)]).collect())
        return np.array([row[1:] for row in sorted(sums)], float)

    def covariance_times(self, q: np.ndarray) -> np.ndarray:
        return self.summed(lambda x: x.T @ (x @ q)) / self.centre.n


# -- the eigenvectors --------------------------------------------------------------------------

def spectrum_floor(times, width: int, rng: np.random.Generator) -> float:
    """A value at or near the smallest eigenvalue, from below: the least Ritz value of a few
    Lanczos steps less the norm of their residual."""
    basis = [rng.standard_normal(width)]
    basis[0] /= np.linalg.norm(basis[0])
    alphas, betas = [], []
    for _ in range(min(LANCZOS_STEPS, width)):
        w = times(basis[-1][:, None])[:, 0]
        alphas.append(float(w @ basis[-1]))
        every = np.array(basis)
        for _ in range(2):
            w = w - every.T @ (every @ w)
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-12 * max(map(abs, alphas)):
            break
        basis.append(w / betas[-1])
    small = np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1)
    return max(float(np.linalg.eigvalsh(small)[0]) - betas[-1], 0.0)


def chebyshev(times, x: np.ndarray, first: np.ndarray | None, locked: np.ndarray, low: float,
              high: float, top: float, degree: int) -> np.ndarray:
    """The scaled Chebyshev polynomial of the operator on ``x``, small on [low, high] and about 1
    at ``top``; ``first`` is the operator times x, if known. The span of ``locked`` is left out."""
    half, middle = (high - low) / 2, (high + low) / 2
    out = lambda y: y - locked @ (locked.T @ y)
    sigma = half / (top - middle)
    turn = 2 / sigma
    y = out(((times(x) if first is None else first) - middle * x) * (sigma / half))
    for _ in range(degree - 1):
        following = 1 / (turn - sigma)
        x, y = y, out((times(y) - middle * y) * (2 * following / half) - sigma * following * x)
        sigma = following
    return y


def _degree(wanted: float, low: float, high: float) -> int:
    place = (wanted - (high + low) / 2) / ((high - low) / 2)
    need = np.arccosh(GAIN) / np.arccosh(max(place, 1 + 1e-12))
    return int(np.clip(np.ceil(need), *DEGREES))


def top_eigenpairs(times, width: int, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric operator without negative ones, falling,
    and unit eigenvectors as columns. ``times`` multiplies it with a block of columns."""
    rng = np.random.default_rng(seed)
    wanted = min(count, width)
    size = min(width, wanted + GUARDS)
    q = np.linalg.qr(rng.standard_normal((width, size)))[0]
    low = spectrum_floor(times, width, rng) if size < width else 0.0
    before = np.inf
    for _ in range(ROUNDS):
        z = times(q)
        small = q.T @ z
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, z = q @ turn, z @ turn
        largest = max(values[0], 0.0)
        if size == width or largest == 0:
            return values[:wanted], q[:, :wanted]
        tight, loose = TIGHT * EPS * largest, LOOSE * EPS * largest
        error = np.linalg.norm(z - q * values, axis=0)[:wanted]
        worst = error.max()
        done = worst <= tight or before / 2 < worst <= loose
        before = worst
        high = max(values[-1], 16 * EPS * largest)
        floor = low if low < 0.99 * high else 0.0
        # Locked pairs keep the order: those before the first that has not converged.
        n = wanted if done else int(np.argmin(error <= tight))
        locked, last = q[:, :n], values[wanted - 1]
        x, first = q[:, n:], z[:, n:]
        if done:
            x, first = rng.standard_normal((width, size - wanted)), None
            x -= locked @ (locked.T @ x)
        top = max(values[min(n, wanted - 1)], high * (1 + 1e-6))
        y = chebyshev(times, x, first, locked, floor, high, top, _degree(last, floor, high))
        for _ in range(2):
            y = np.linalg.qr(y - locked @ (locked.T @ y))[0]
        if done and np.linalg.eigvalsh(y.T @ times(y))[-1] <= last + loose:
            return values[:wanted], q[:, :wanted]
        q = np.hstack([locked, y])
    raise RuntimeError(f"not certified after {ROUNDS} rounds; worst residual {before:g}")


# -- the operator ------------------------------------------------------------------------------

def fit_vectors(vectors: DataFrame, width: int, rows: int) -> Fit:
    """The distinct x of ``vectors``, packed in blocks that tasks multiply."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    size = rows * width * 8
    parts = max(min(-(-size // PART_BYTES), cores), -(-size // LARGEST_PART), 1)

    def pack(batches):
        for batch in batches:
            x = matrix_of(batch.column("x"), width)
            # Per column as text: sums of many blocks may exceed 64 bits.
            sums = [str(s) for s in x.astype(object).sum(0)] if len(x) else []
            if len(x):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(x)], pa.int64()), pa.array([sums], pa.list_(pa.string())),
                     pa.array([x.tobytes()], pa.binary())], names=["n", "sums", "data"])

    distinct = vectors.select("x").dropDuplicates().coalesce(int(parts))
    blocks = cut(distinct.mapInArrow(pack, "n bigint, sums array<string>, data binary"))
    n = blocks.agg(F.sum("n")).first()[0]
    sums = (blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i")
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect())
    sums = [int(r.s) for r in sorted(sums)]
    return Fit(blocks, Centre(n, np.array([s // n for s in sums], np.int64),
                              np.array([s % n for s in sums], np.int64)))


def whiten(embeddings: DataFrame, count: int = 16, scale: int = 64) -> DataFrame:
    """For each vector and each of its ``count`` first components: vec_id, component, n, deviation,
    whitened, explained and identity_error."""
    spark = embeddings.sparkSession
    schema = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
              "explained double, identity_error double")
    rows = finite_vectors(embeddings, scale)
    facts = rows.agg(F.max(F.size("x")), F.count(F.lit(1))).first()
    width = max(facts[0] or 0, 0)
    if not width:
        return spark.createDataFrame([], schema)
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("x")))
    vectors = cut(rows.select("vec_id", F.transform(padded, lambda v: v + SHIFT).alias("x")))
    fit = fit_vectors(vectors, width, facts[1])
    trace = float(fit.summed(lambda x: np.array([[(x * x).sum()]]))[0, 0]) / fit.centre.n
    values, axes = top_eigenpairs(fit.covariance_times, width, count)
    real = values > 16 * width * EPS * max(values[0], 0.0)
    values, axes = values[real], axes[:, real]
    if not len(values):
        return spark.createDataFrame([], schema)
    # Either sign will do; the largest entry of each is made positive.
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(len(values))])
    project = axes / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ project
        return np.vstack([w.T @ w, w.sum(0)])

    sums = fit.summed(moments) / fit.centre.n
    error = float(np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(len(values))).max())
    explained = values / trace
    centred, k = fit.centre, len(values)
    n, whole, rest = centred.n, centred.whole, centred.rest

    def rows_out(batches):
        for batch in batches:
            x = matrix_of(batch.column("x"), width)
            m = len(x)
            away = x - whole
            if (n * (float(np.abs(away).max(initial=0)) + 1)) ** 2 * width < 2.0**62:
                gap = n * away - rest
                deviation = (gap * gap).sum(1)
            else:
                gap = n * away.astype(object) - rest.astype(object)
                deviation = [int(s) if s < 2**63 else None for s in (gap * gap).sum(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                 pa.array(np.full(m * k, n), pa.int64()),
                 pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array((centred(x) @ project).ravel()),
                 pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained",
                       "identity_error"])

    return vectors.mapInArrow(rows_out, schema)
