"""Whitening of embeddings by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never formed. A product V @ U of the centred covariance with a few columns U is one
Spark job over the stored vectors: every task centres its rows (exactly: n*x - S is a whole number),
multiplies twice and hands on one small matrix. Everything else is dense work on the driver with
matrices of the vectors' dimension times at most ``MOST_BASIS`` columns:

1. Rayleigh-Ritz: eigenvalues of the basis's projected matrix, largest first, and their residuals.
2. Leading pairs whose residual is at double precision are locked and taken out of the basis.
3. For the other wanted pairs the correction equation (I - QQ')(V - theta I)(I - QQ') t = -r, Q the
   locked and all current Ritz vectors, is solved by a few steps of MINRES. The steps of all pairs go
   in step, so each costs one job for all of them.
4. The corrections, made orthogonal, widen the basis; a full one is restarted from its best vectors.

Defined cases: rows whose vector is missing, empty, holds a missing or non-finite entry, or an entry
whose whole number does not fit a long, are left out, as are vectors of another length than the most
frequent one (the longer, on ties). Repeated rows count as often as they occur; other columns pass by.
Eigenvalues that are zero to rounding have no whitened coordinate: such components are left out, so
equal vectors, one vector or none give no rows. A deviation that does not fit a long is null in the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlog.llm.base import shared_dir

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Columns beyond the wanted ones in the first basis, most columns of a basis, MINRES steps a correction.
SPARE, MOST_BASIS, INNER, MOST_ROUNDS = 4, 48, 8, 60
#: A residual of this many roundings of the largest eigenvalue is double precision.
ROUNDINGS = 32
#: Up to so many tasks hand their small matrices to the driver themselves.
DIRECT_TASKS = 256
_EPS = float(np.finfo(float).eps)


@dataclass
class Whitening:
    """A fit: ``n`` vectors with sums ``total``, components in columns with their eigenvalues."""

    n: int
    total: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    rounds: int
    products: int


def whole(embedding: Column) -> Column:
    """array<long> of floor(1024 c) + 100000, null where the vector takes no part."""
    scaled = F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE).cast("double"))
    fine = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < float(1 << 62)))
    return F.when((F.size(embedding) > 0) & fine, F.transform(scaled, lambda x: x.cast("long") + SHIFT))


def packed(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """The vectors that take part, stored a block a row (``ids``, ``x``: whole numbers in a row), and their length."""
    x = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), whole(F.col(f"`{embedding}`")).alias("x")).where("x is not null")
    lengths = x.groupBy(F.size("x").alias("d")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    size = most["d"] if most else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i8")
                ids = pa.array([b.column(0).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([flat.tobytes()], pa.binary())], names=["ids", "x"])

    path = shared_dir(df.sparkSession, "vectors")
    x.where(F.size("x") == size).mapInArrow(pack, "ids array<long>, x binary").write.parquet(path)
    return df.sparkSession.read.schema("ids array<long>, x binary").parquet(path), size


def _matrix(block: bytes, size: int) -> np.ndarray:
    return np.frombuffer(block, "<i8").reshape(-1, size)


def _summed(blocks: DataFrame, tasks: int, work, shape: tuple[int, ...], kind: str = "<f8") -> np.ndarray:
    """Sum of ``work`` (an array of this shape and kind) over all blocks, which are read by so many tasks.

    Tasks add up their own blocks; a second level, as wide as their root, adds up the tasks, so what
    reaches the driver grows with the root of their number. Sums go in a fixed order.
    """

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape, kind)
        for b in parts:
            for x in b.column(0):
                total = total + work(x.as_py())
        columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "part"])

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((a, p) for b in parts for a, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if rows:
            total = np.zeros(shape, kind)
            for _, p in rows:
                total = total + np.frombuffer(p, kind).reshape(shape)
            columns = [pa.array([rows[0][0]], pa.int32()), pa.array([total.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "part"])

    sums = blocks.select("x").mapInArrow(add, "at int, part binary")
    if tasks > DIRECT_TASKS:
        sums = sums.repartition(int(np.ceil(np.sqrt(tasks))), "at").mapInArrow(gather, "at int, part binary")
    found = sums.collect()
    total = np.zeros(shape, kind)
    for r in sorted(found, key=lambda r: r["at"]):
        total = total + np.frombuffer(r["part"], kind).reshape(shape)
    return total


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S/n from the whole number n*x - S; beyond a long, from Python's whole numbers."""
    if n * int(np.abs(x).max(initial=0)) + int(np.abs(total.astype(object)).max(initial=0)) < 1 << 62:
        return (n * x - total.astype(np.int64)) / n
    return ((n * x.astype(object) - total) / n).astype(float)


def _orthogonal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal columns spanning what ``new`` adds to the given ones (Gram-Schmidt, twice)."""
    out: list[np.ndarray] = []
    for t in new.T:
        norm = np.linalg.norm(t)
        if norm == 0:
            continue
        t = t / norm
        for _ in range(2):
            for q in against:
                t = t - q @ (q.T @ t)
            for q in out:
                t = t - q * (q @ t)
        left = np.linalg.norm(t)
        if left > 1e-10:
            t = t / left
            for q in (*against, *[o[:, None] for o in out]):
                t = t - q @ (q.T @ t)
            out.append(t / np.linalg.norm(t))
    return np.stack(out, 1) if out else np.zeros((len(new), 0))


def minres(product, theta: np.ndarray, right: np.ndarray, outside: np.ndarray, steps: int) -> np.ndarray:
    """Some steps of MINRES for (I - QQ')(V - theta_j I)(I - QQ') t_j = b_j, all columns in step.

    ``product`` gives V @ U for all columns at once. Columns that are solved stay as they are.
    """
    project = lambda u: u - outside @ (outside.T @ u)
    apply = lambda u: project(product(u) - u * theta)
    b = project(right)
    beta = np.linalg.norm(b, axis=0)
    goal = beta * 1e-3
    x, old, v = np.zeros_like(b), np.zeros_like(b), b / np.where(beta > 0, beta, 1)
    w, w_old = np.zeros_like(b), np.zeros_like(b)
    eta, c, c_old, s, s_old, beta_k = beta.copy(), *(np.ones_like(beta) for _ in range(2)), *(np.zeros_like(beta) for _ in range(3))
    for _ in range(steps):
        open_ = (np.abs(eta) > goal) & (beta > 0)
        if not open_.any():
            break
        p = apply(v)
        alpha = np.sum(v * p, 0)
        p = project(p - alpha * v - beta_k * old)
        beta_next = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * beta_k
        rho = np.hypot(delta, beta_next)
        rho2, rho3 = s * alpha + c_old * c * beta_k, s_old * beta_k
        safe = np.where(rho > 0, rho, 1)
        c_old, c, s_old, s = c, np.where(rho > 0, delta / safe, 1), s, np.where(rho > 0, beta_next / safe, 0)
        step = (v - rho3 * w_old - rho2 * w) / safe
        w_old, w = w, step
        x = np.where(open_, x + (c * eta) * step, x)
        eta = np.where(open_, -s * eta, eta)
        old, v, beta_k = v, p / np.where(beta_next > 0, beta_next, 1), beta_next
        beta = np.where(beta_next > _EPS * np.abs(theta), beta, 0)
    return x


def jacobi_davidson(product, size: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` largest eigenpairs of a symmetric operator given by block products, and the rounds taken."""
    wanted = min(wanted, size)
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((size, 0)), []
    basis = _orthogonal(rng.normal(size=(size, min(size, wanted + SPARE))))
    image = product(basis)
    scale = rounds = 0.0
    while len(values) < wanted and rounds < MOST_ROUNDS and basis.shape[1]:
        rounds += 1
        h = basis.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, ritz_image = basis @ y, image @ y
        scale = max(scale, float(np.abs(theta).max(initial=0)))
        left = wanted - len(values)
        residual = ritz_image[:, :left] - ritz[:, :left] * theta[:left]
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        full = basis.shape[1] + locked.shape[1] >= size
        done = 0
        while done < len(norms) and (norms[done] <= ROUNDINGS * _EPS * scale or full):
            done += 1
        if done:
            locked = np.concatenate([locked, ritz[:, :done]], 1)
            values += theta[:done].tolist()
        basis, image, left = ritz[:, done:], ritz_image[:, done:], left - done
        if not left or not basis.shape[1]:
            continue
        if basis.shape[1] + left > MOST_BASIS:
            basis, image = basis[:, : 2 * left + SPARE], image[:, : 2 * left + SPARE]
        some = np.arange(min(left, len(norms) - done))
        outside = np.concatenate([locked, basis[:, some]], 1)
        t = minres(product, theta[done:][some], -residual[:, done:], outside, INNER)
        new = _orthogonal(t, locked, basis)
        if not new.shape[1]:  # corrections below rounding: go on with fresh directions
            new = _orthogonal(rng.normal(size=(size, left)), locked, basis)
        basis, image = np.concatenate([basis, new], 1), np.concatenate([image, product(new)], 1)
    return np.array(values), locked, int(rounds)


def fit(blocks: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """Components of the covariance (divisor n) of packed vectors."""
    none = Whitening(0, [0] * size, np.zeros((size, 0)), np.zeros(0), 0.0, 0.0, 0, 0)
    if not size:
        return none

    def moments(block: bytes) -> np.ndarray:
        x = _matrix(block, size).astype(object)
        return np.array([len(x), *x.sum(0)], object)

    totals = _whole_sums(blocks, moments, size + 1)
    n, total = totals[0], np.array(totals[1:], object)
    if not n:
        return none
    used, tasks = 0, blocks.rdd.getNumPartitions()

    def product(u: np.ndarray) -> np.ndarray:
        nonlocal used
        used += 1

        def work(block: bytes) -> np.ndarray:
            c = _centred(_matrix(block, size), n, total)
            return c.T @ (c @ u)

        return _summed(blocks, tasks, work, u.shape) / n

    def spread(block: bytes) -> np.ndarray:
        return (_centred(_matrix(block, size), n, total) ** 2).sum(0)

    trace = float(_summed(blocks, tasks, spread, (size,)).sum()) / n
    if trace <= 0:
        return Whitening(n, totals[1:], np.zeros((size, 0)), np.zeros(0), 0.0, 0.0, 0, 0)
    values, vectors, rounds = jacobi_davidson(product, size, components)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > size * ROUNDINGS * _EPS * trace]
    values, vectors = values[order], vectors[:, order]

    def second(block: bytes) -> np.ndarray:
        z = _centred(_matrix(block, size), n, total) @ vectors / np.sqrt(values)
        return np.concatenate([z.sum(0)[None], z.T @ z])

    k = len(values)
    got = _summed(blocks, tasks, second, (k + 1, k)) / n
    off = np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(k)).max(initial=0)
    return Whitening(n, totals[1:], vectors, values, trace, float(off), rounds, used)


def _whole_sums(blocks: DataFrame, work, count: int) -> list[int]:
    """Exact sums of whole numbers of any size, as decimals."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count, object)
        for b in parts:
            for x in b.column(0):
                total = total + work(x.as_py())
        from decimal import Decimal

        columns = [pa.array(list(range(count)), pa.int32()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, names=["j", "v"])

    sums = blocks.select("x").mapInArrow(run, "j int, v decimal(38,0)").groupBy("j").agg(F.sum("v").alias("v"))
    found = {r["j"]: int(r["v"]) for r in sums.collect()}
    return [found.get(j, 0) for j in range(count)]


def whitened(blocks: DataFrame, size: int, model: Whitening) -> DataFrame:
    """A row for each vector and component: ``vec_id, component, whitened`` and the vector's exact ``deviation``."""
    n, total, k = model.n, np.array(model.total, object), len(model.values)
    scaled = model.components / np.sqrt(model.values) if k else model.components

    def deviations(x: np.ndarray) -> list[int]:
        far = int(np.abs(x).max(initial=0)) * n + int(np.abs(total).max(initial=0))
        if far * far * size < 1 << 63:
            return ((n * x - total.astype(np.int64)) ** 2).sum(1).tolist()
        return ((n * x.astype(object) - total) ** 2).sum(1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not k:
                    continue
                x = _matrix(block.as_py(), size)
                z = _centred(x, n, total) @ scaled
                columns = [
                    pa.array(np.repeat(np.array(ids, object), k).tolist(), pa.int64()),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))),
                    pa.array([str(d) for d in deviations(x) for _ in range(k)]),
                    pa.array(z.ravel()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "deviation", "whitened"])

    rows = blocks.mapInArrow(run, "vec_id long, component int, deviation string, whitened double")
    return rows.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def whiten(df: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, Whitening]:
    """Fit on all vectors that take part and whiten each of them."""
    blocks, size = packed(df, vec_id, embedding)
    model = fit(blocks, size, components)
    return whitened(blocks, size, model), model
