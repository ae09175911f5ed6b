"""Whitening of embeddings by a Jacobi-Davidson solver whose products run over the rows in Spark.

The covariance is never formed. Its product with a block of vectors is one pass: each task centres its rows,
multiplies them twice and leaves as many sums as the block has entries. The solver keeps a
search space of a few such blocks: Rayleigh-Ritz on it, correction equations projected on the
complement of what is found, solved by MINRES for all vectors of a block at once (one pass a step), and
vectors set aside as soon as their residual is at the rounding of doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wavecohort.session import durable

COMPONENTS = 32
#: Vectors beside the wanted ones in the first block; steps of MINRES for one correction.
GUARD, STEPS, OUTER, SEED = 8, 10, 60, 20
EPS = float(np.finfo(float).eps)
#: Components below this share of the largest are the rounding of a list without full rank.
LEAST = 1e-11
ROWS = 4096

Product = Callable[[np.ndarray], np.ndarray]


def usable(vector: Column) -> Column:
    """Neither null nor with null, non-finite or, as multiples of 1/64, inexact entries."""
    return F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * 64) < 2.0**52, F.lit(False)))


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 64).cast("long") + F.lit(1_000_000).cast("long"))


def _rows(batch: pa.RecordBatch, length: int) -> Iterator[np.ndarray]:
    """The integer vectors of a batch, some rows at a time."""
    column = batch.column(batch.schema.names.index("x"))
    for at in range(0, len(column), ROWS):
        yield column.slice(at, ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


@dataclass(frozen=True)
class Centre:
    """Count and exact sums of the fit list, and centred rows."""

    n: int
    sums: tuple[int, ...]

    @cached_property
    def about(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole means, and what is left of the sums."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        base, rest = self.about
        return (x - base).astype(float) - rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Exact sums of ``(n*x - S)**2``; null beyond 38 digits."""
        base, rest = self.about
        near = x - base
        if (float(np.abs(near).max(initial=0)) + 1) ** 2 * float(self.n) ** 2 * x.shape[1] < 2.0**62:
            return pa.array(((near * self.n - rest) ** 2).sum(1)).cast(pa.decimal128(38, 0), safe=False)
        exact = [sum((v * self.n - r) ** 2 for v, r in zip(row, rest.tolist())) for row in near.tolist()]
        return pa.array([Decimal(e) if e < 10**38 else None for e in exact], pa.decimal128(38, 0))


def _summed(fit: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """Sums over all tasks of the ``size`` numbers that ``run`` makes in each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = run(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(sums)], names=["at", "v"])

    added = fit.mapInArrow(task, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[added.column("at").to_numpy()] = added.column("v").to_numpy()
    return out


def centre_of(fit: DataFrame, length: int) -> Centre:
    """Count and sums; the sums are added in two halves, so no number of rows wraps them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(length, np.int64), np.zeros(length, np.int64)
        for b in batches:
            for x in _rows(b, length):
                n, high, low = n + len(x), high + (x >> 26).sum(0), low + (x & (1 << 26) - 1).sum(0)
        cells = [np.arange(length, dtype=np.int32), np.full(length, n), high, low]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["at", "n", "high", "low"])

    parts = fit.mapInArrow(task, "at int, n long, high long, low long")
    rows = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("at").collect()
    return Centre(rows[0].n, tuple((r.high << 26) + r.low for r in rows))


def product_of(fit: DataFrame, centre: Centre) -> Product:
    """The covariance times a block of columns, as one pass over the rows."""
    length = len(centre.sums)

    def product(block: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(block.shape)
            for b in batches:
                for x in _rows(b, length):
                    rows = centre.centred(x)
                    out += rows.T @ (rows @ block)
            return out.ravel()

        return _summed(fit, run, block.size).reshape(block.shape) / centre.n

    return product


def _cleared(block: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """``block`` without its parts along the orthonormal columns of ``others``, cleared twice."""
    for _ in range(2):
        for q in others:
            block = block - q @ (q.T @ block)
    return block


def _orthonormal(block: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to ``others``."""
    block = _cleared(block, *others)
    block = block[:, (size := np.linalg.norm(block, axis=0)) > 0] / size[size > 0]
    left, values, _ = np.linalg.svd(block, full_matrices=False)
    return np.linalg.qr(_cleared(left[:, values > 1e-10], *others))[0]


def minres(product: Product, shifts: np.ndarray, right: np.ndarray, held: np.ndarray, steps: int, reduce: float) -> np.ndarray:
    """``steps`` of MINRES on ``(A - shift) t = right`` in the complement of ``held``, all columns in step.

    A column whose residual has fallen by ``reduce`` stays as it is.
    """
    t = np.zeros_like(right)
    beta = np.linalg.norm(right, axis=0)
    start = np.where(beta > 0, beta, 1)
    v, v_old = right / start, np.zeros_like(right)
    d, d_old = np.zeros_like(right), np.zeros_like(right)
    c, c_old, s, s_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    left, along = beta.copy(), np.zeros_like(beta)
    go = beta > 0
    for _ in range(min(steps, right.shape[0] - held.shape[1])):
        at = np.flatnonzero(go)
        if not len(at):
            break
        w = np.zeros_like(right)
        w[:, at] = _cleared(product(v[:, at]) - v[:, at] * shifts[at], held)
        alpha = (v * w).sum(0)
        w = w - v * alpha - v_old * along
        after = np.linalg.norm(w, axis=0)
        # Two old rotations and a new one make the tridiagonal matrix upper triangular.
        far, mid = s_old * along, c * c_old * along + s * alpha
        diagonal = c * alpha - s * c_old * along
        size = np.hypot(diagonal, after)
        safe = np.where(size > 0, size, 1)
        c_new, s_new = diagonal / safe, after / safe
        step = (v - d_old * far - d * mid) / safe
        go &= size > 0
        t = t + np.where(go, step * c_new * left, 0)
        left = np.where(go, -s_new * left, left)
        d_old, d, c_old, c, s_old, s = d, step, c, c_new, s, s_new
        v_old, along = v, after
        v = w / np.where(after > 0, after, 1)
        go = go & (np.abs(left) > reduce * start) & (after > EPS * np.abs(shifts).max(initial=1))
    return t


def leading(product: Product, length: int, wanted: int, space: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` eigenvalues, falling, and their unit vectors as columns.

    ``space`` bounds the search space. A last product on all found vectors confirms the residuals;
    where one is above rounding the search goes on from them.
    """
    wanted = min(wanted, length)
    space = min(length, space or max(3 * wanted, wanted + 4 * GUARD))
    draw = np.random.Generator(np.random.PCG64(SEED))
    basis = _orthonormal(draw.standard_normal((length, min(length, wanted + GUARD, space))))
    images = product(basis)
    none = np.zeros((length, 0))
    found, values, last = none, np.zeros(0), np.inf
    for _ in range(OUTER):
        small = basis.T @ images
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        basis, images = basis @ turn, images @ turn
        rounding = 4 * EPS * np.sqrt(length) * max(np.abs(ritz).max(initial=0), np.abs(values).max(initial=0))
        open_ = wanted - found.shape[1]
        residuals = _cleared(images[:, :open_] - basis[:, :open_] * ritz[:open_], found)
        bad = np.linalg.norm(residuals, axis=0) > rounding
        lock = int(np.argmax(bad)) if bad.any() else len(bad)  # from the top: none is passed over
        found, values = np.hstack([found, basis[:, :lock]]), np.concatenate([values, ritz[:lock]])
        basis, images, ritz, residuals = basis[:, lock:], images[:, lock:], ritz[lock:], residuals[:, lock:]
        if found.shape[1] == wanted:
            fresh = product(found)
            small = found.T @ fresh
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            found, fresh = found @ turn, fresh @ turn
            worst = np.linalg.norm(fresh - found * values, axis=0).max(initial=0)
            # Products and their sums round too: at twice the bound, or when it falls no more, it is done.
            if worst <= 2 * rounding or (worst <= 64 * rounding and worst > last / 2):
                return values, found
            last = worst
            basis, images, found, values = np.hstack([found, basis]), np.hstack([fresh, images]), none, np.zeros(0)
            basis, keep = np.linalg.qr(basis)
            images = np.linalg.solve(keep.T, images.T).T
            continue
        todo = residuals.shape[1]
        held = np.hstack([found, basis[:, :todo]])
        t = minres(product, ritz[:todo], -_cleared(residuals, held), held, STEPS, 0.03)
        if basis.shape[1] + todo > space - found.shape[1]:
            keep = min(basis.shape[1], todo + GUARD)
            basis, images = basis[:, :keep], images[:, :keep]
        new = _orthonormal(np.hstack([t, draw.standard_normal((length, 1))]), found, basis)[:, : max(1, min(length, space + todo) - found.shape[1] - basis.shape[1])]
        if new.shape[1]:
            basis, images = np.hstack([basis, new]), np.hstack([images, product(new)])
    raise RuntimeError(f"residuals stay above rounding after {OUTER} rounds")


def whitened(rows: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component: ``key``, component, n, deviation, whitened, explained, identity_error.

    Vectors are fitted as whole multiples of 1/64 about a million. Null vectors and those that hold null or
    non-finite entries (or ones beyond 2**46, which have no exact multiple) are left out. Where lengths differ, the
    most frequent one is fitted (of equally many the longest) and the others are left out. Repeated rows and
    keys, and null keys, count and come out each for itself; other columns are not carried. Components are as many as
    asked for, but no more than the list's rank: none for an empty list, for one vector or for equal ones. ``deviation``
    is exact, null beyond 38 digits. What reaches the driver has the size of a block of vectors, whatever the rows.
    """
    fit = durable(rows.where(usable(F.col(vector))).select(F.col(key).alias("_key"), whole(F.col(vector)).alias("x")), "fit")
    key_type = fit.schema["_key"].dataType
    schema = T.StructType.fromDDL("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    schema = T.StructType([T.StructField(key, key_type), *schema.fields])
    lengths = fit.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if lengths is None or not lengths.length:
        return rows.sparkSession.createDataFrame([], schema)
    length = lengths.length
    fit = fit.where(F.size("x") == length)
    centre = centre_of(fit, length)
    spread = _summed(fit, lambda batches: np.array([sum(float((centre.centred(x) ** 2).sum()) for b in batches for x in _rows(b, length))], float), 1)
    trace = float(spread[0]) / centre.n
    if trace == 0:
        return rows.sparkSession.createDataFrame([], schema)
    values, vectors = leading(product_of(fit, centre), length, components)
    k = int((values > LEAST * values[0]).sum())
    values, vectors = values[:k], vectors[:, :k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1, 1)
    scaled = vectors / np.sqrt(values)

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            for x in _rows(b, length):
                yield centre.centred(x) @ scaled

    mean = _summed(fit, lambda batches: sum((w.sum(0) for w in white(batches)), np.zeros(k)), k) / centre.n
    square = lambda batches: sum(((w - mean).T @ (w - mean) for w in white(batches)), np.zeros((k, k))).ravel()
    error = float(np.abs(_summed(fit, square, k * k).reshape(k, k) / centre.n - np.eye(k)).max())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(_rows(b, length)):
                w = centre.centred(x) @ scaled
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
                keys = b.column(b.schema.names.index("_key")).slice(i * ROWS, len(x))
                yield pa.RecordBatch.from_arrays([keys, centre.deviations(x), lists], names=["_key", "deviation", "w"])

    out = T.StructType([T.StructField("_key", key_type), *T.StructType.fromDDL("deviation decimal(38,0), w array<double>").fields])
    shares = F.array(*[F.lit(float(v) / trace) for v in values])
    each = fit.mapInArrow(write, out).select("_key", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        F.col("_key").alias(key), (F.col("at") + 1).alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
