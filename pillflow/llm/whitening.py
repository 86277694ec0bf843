"""Whitening of vectors by the leading eigenvectors of their covariance, found by a block Jacobi-Davidson method.

Entries are brought to whole numbers first, so that sums, means and squared deviations are exact. The covariance is
never formed: all the method asks for are products of it with a few vectors, and each such product is one Spark job in
which every task centres its rows, multiplies them twice, and adds up; the sums of tasks are added by Spark. What the
driver holds is as large as some vectors of one row's width, whatever the number of rows.

The method keeps an orthonormal subspace and its products. In each round

1. Rayleigh-Ritz on the subspace gives approximate eigenpairs and their residuals;
2. pairs, from the largest on, whose residual is down to rounding are locked;
3. for the next open pairs the correction equation, projected off everything locked and off the pairs themselves, is
   solved roughly by MINRES, all of them side by side, so that a step is one product for the whole block;
4. the corrections, made orthogonal, widen the subspace; a full one is started again from its best vectors.

It ends when all pairs are locked, and raises an error if that does not happen in ``ROUNDS`` rounds.

A null vector, and one that holds null, not-a-number, infinite or (beyond 2**40) absurd entries, takes no part; rows
with a null or repeated id all do. Shorter vectors count as filled up with zeros. Components without variance do not
exist: n equal rows, or one, have none. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pillflow.llm.common import stored

#: Entries are multiplied by ``SCALE``, rounded down and moved up by ``OFFSET``.
SCALE = 64
OFFSET = 1_000_000
ROUNDS = 200
#: Steps of MINRES per round, each one product.
INNER = 6
#: Vectors above the wanted number that the subspace starts with, and its largest size as a multiple of the wanted.
SPARE = 8
WIDEST = 4
_EPS = float(np.finfo(float).eps)


def whole_vectors(embeddings: DataFrame, identifier: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x``, the vector in whole numbers, for each row whose vector can be used."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= 2.0**40))
    whole = F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    return embeddings.where(v.isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(identifier).alias("vec_id"), whole.alias("x"))


@dataclass(frozen=True)
class Centre:
    """Number of rows and exact sums of each dimension."""

    n: int
    sums: tuple[int, ...]

    @property
    def width(self) -> int:
        return len(self.sums)

    def deviations(self, x: pa.ListArray) -> np.ndarray:
        """n * x - sums, exact: whole numbers of 64 bits where they fit, else Python's."""
        rows = matrix(x, self.width)
        largest = int(np.abs(rows).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if largest >= 1 << 62:
            rows = rows.astype(object)
        return rows * self.n - np.array(self.sums, rows.dtype)

    def centred(self, x: pa.ListArray) -> np.ndarray:
        """x less the mean: one rounding per entry."""
        return (self.deviations(x) / self.n).astype(float)


def matrix(x: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a column of arrays; shorter ones are filled with what zero becomes."""
    lengths = np.diff(x.offsets.to_numpy())
    values = x.flatten().to_numpy()
    if (lengths == width).all():
        return values.reshape(len(x), width)
    out = np.full((len(x), width), OFFSET, np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _sums(batches: Iterator[pa.RecordBatch], place: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The sum over all batches of what ``place`` gives, as rows (``pos``, ``value``)."""
    total = None
    for batch in batches:
        if batch.num_rows:
            part = place(batch).ravel()
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["pos", "value"])


def _added(rows: DataFrame, place: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``place`` over all rows, added up by Spark: as many numbers reach the driver as ``shape`` has."""
    parts = rows.mapInArrow(lambda batches: _sums(batches, place), "pos long, value double")
    out = np.zeros(int(np.prod(shape)))
    for r in parts.groupBy("pos").agg(F.sum("value").alias("value")).collect():
        out[r.pos] = r.value
    return out.reshape(shape)


def centre_of(rows: DataFrame) -> Centre:
    """Exact count and sums; a shorter vector has what zero becomes where it ends."""
    n, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not width:
        return Centre(n, ())
    entry = F.posexplode("x").alias("pos", "c")
    sums = rows.select(entry).groupBy("pos").agg(F.count("*").alias("k"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).collect()
    found = {r.pos: int(r.s) + (n - r.k) * OFFSET for r in sums}
    return Centre(n, tuple(found[d] for d in range(width)))


def covariance_product(rows: DataFrame, centre: Centre) -> Callable[[np.ndarray], np.ndarray]:
    """B -> V B for the covariance V of ``rows`` and a matrix B of a few columns."""
    context = rows.sparkSession.sparkContext

    def product(block: np.ndarray) -> np.ndarray:
        shared = context.broadcast(block)  # width x a few columns, whatever the number of rows

        def place(batch: pa.RecordBatch) -> np.ndarray:
            c = centre.centred(batch.column("x"))
            return c.T @ (c @ shared.value)

        out = _added(rows.select("x"), place, block.shape) / centre.n
        shared.unpersist()
        return out

    return product


def trace_of(rows: DataFrame, centre: Centre) -> float:
    """The sum of all variances."""
    return float(_added(rows.select("x"), lambda b: np.array([(centre.centred(b.column("x")) ** 2).sum()]), (1,))[0]) / centre.n


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of ``block`` off the given orthonormal ones; directions already in them are left out."""
    for _ in range(2):
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        before = np.ones(block.shape[1])
        for basis in against:
            block = block - basis @ (basis.T @ block)
        left = np.linalg.norm(block, axis=0)
        block = block[:, left > 1e-8 * before]
    if not block.size:
        return block
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-6 * s[0]]
    for basis in against:
        u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0]


def _minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of ``apply(x) = right``, column by column but with one call for all, by ``steps`` of MINRES.

    ``apply`` is symmetric on the space of each column. Columns whose Krylov space is used up stay as they are.
    """
    x = np.zeros_like(right)
    beta = np.linalg.norm(right, axis=0)
    old, v = np.zeros_like(right), right / np.where(beta > 0, beta, 1)
    cos, sin = -np.ones(right.shape[1]), np.zeros(right.shape[1])
    eta, delta, epsilon = beta.copy(), np.zeros_like(beta), np.zeros_like(beta)
    d_old, d = np.zeros_like(right), np.zeros_like(right)
    live = beta > 0
    last = np.zeros_like(beta)
    size = beta.copy()
    for _ in range(steps):
        w = apply(v)
        alpha = (v * w).sum(axis=0)
        w = w - alpha * v - last * old
        new = np.linalg.norm(w, axis=0)
        # Two Givens rotations make the tridiagonal matrix triangular.
        delta_2 = cos * delta + sin * alpha
        gamma = sin * delta - cos * alpha
        epsilon_2, delta = sin * new, -cos * new
        rho = np.hypot(gamma, new)
        live = live & (rho > 1e-14 * np.maximum(np.abs(alpha), new) + 1e-300)
        safe = np.where(live, rho, 1)
        cos, sin = np.where(live, gamma / safe, cos), np.where(live, new / safe, sin)
        tau, eta = cos * eta, sin * eta
        d_old, d = d, np.where(live, (v - delta_2 * d - epsilon * d_old) / safe, 0)
        epsilon = epsilon_2
        x = x + np.where(live, tau * d, 0)
        live = live & (new > 1e-12 * size) & (np.abs(eta) > 1e-13 * size)
        old, v, last = v, np.where(live, w / np.where(new > 0, new, 1), 0), new
        if not live.any():
            break
    return x


@dataclass(frozen=True)
class Eigenpairs:
    """``values`` falling, ``vectors`` in columns, ``residuals`` as norms, and the number of products it took."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, seed: int = 0) -> Eigenpairs:
    """The ``wanted`` largest eigenvalues of a symmetric positive matrix of ``width`` rows, known by its products alone."""
    wanted = min(wanted, width)
    widest = min(width, WIDEST * wanted + SPARE)
    used = 0

    def times(block: np.ndarray) -> np.ndarray:
        nonlocal used
        used += 1
        return product(block)

    space = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, min(width, wanted + SPARE))))[0]
    image = times(space)
    best = np.full(wanted, np.inf)
    for _ in range(ROUNDS):
        small = space.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        vectors, images = space @ s, image @ s
        residual = images - vectors * theta
        norms = np.linalg.norm(residual, axis=0)[:wanted]
        scale = max(theta[0], 0.0)
        # Down to rounding; or near it and, in a space that cannot be widened or improved, as small as it gets.
        done = norms <= 8 * _EPS * np.sqrt(width) * scale
        done |= (norms <= 1e-12 * scale) & ((norms >= best / 2) | (space.shape[1] == width))
        best = np.minimum(best, norms)
        locked = int(np.argmin(done)) if not done.all() else wanted
        if locked == wanted:
            return Eigenpairs(theta[:wanted], vectors[:, :wanted], norms, used)
        if space.shape[1] == width:  # nothing is left to widen by: take the products anew
            space = np.linalg.qr(vectors)[0]
            image = times(space)
            continue
        open_ = [i for i in range(locked, wanted) if not done[i]]
        fixed = vectors[:, :locked]
        chosen, shift, right = vectors[:, open_], theta[open_], residual[:, open_]

        def off(t: np.ndarray) -> np.ndarray:
            """Off everything locked, and each column off its own pair."""
            t = t - fixed @ (fixed.T @ t)
            return t - chosen * (chosen * t).sum(axis=0)

        correction = _minres(lambda t: off(times(off(t)) - shift * off(t)), -off(right), INNER)
        if space.shape[1] + len(open_) > widest:
            keep = min(space.shape[1], max(wanted + SPARE, widest - len(open_)))
            space, image = vectors[:, :keep], images[:, :keep]
        fresh = _orthonormal(np.hstack([correction, right]) if not correction.any() else correction, space)
        fresh = fresh[:, :width - space.shape[1]]
        if not fresh.size:  # the corrections lie in the space: look elsewhere
            noise = np.random.default_rng(seed + used).standard_normal((width, len(open_)))
            fresh = _orthonormal(noise, space)[:, :width - space.shape[1]]
        space, image = np.hstack([space, fresh]), np.hstack([image, times(fresh)])
    raise RuntimeError(f"not converged after {ROUNDS} rounds: residuals {norms}")


@dataclass(frozen=True)
class Whitening:
    """What whitening needs: mean, components and their variances, and how good it is."""

    centre: Centre
    pairs: Eigenpairs
    trace: float
    identity_error: float

    @property
    def weights(self) -> np.ndarray:
        """Columns that a centred row is multiplied by."""
        return self.pairs.vectors / np.sqrt(self.pairs.values)


def fit(rows: DataFrame, components: int) -> Whitening:
    """Fit on all ``rows`` (``x``); they should be stored, as they are read for every product."""
    centre = centre_of(rows)
    if not centre.width:
        return Whitening(centre, Eigenpairs(np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0), 0.0, 0.0)
    trace = trace_of(rows, centre)
    if trace == 0:
        return Whitening(centre, Eigenpairs(np.zeros(0), np.zeros((centre.width, 0)), np.zeros(0), 0), 0.0, 0.0)
    pairs = leading_pairs(covariance_product(rows, centre), centre.width, components)
    some = pairs.values > 1e-13 * centre.width * pairs.values[0]  # the rest is rounding of zero
    pairs = Eigenpairs(pairs.values[some], pairs.vectors[:, some], pairs.residuals[some], pairs.products)
    return Whitening(centre, pairs, trace, identity_error(rows, Whitening(centre, pairs, trace, 0.0)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, by two more passes."""
    shared = rows.sparkSession.sparkContext.broadcast((model.centre, model.weights))
    k = model.weights.shape[1]

    def whitened(batch: pa.RecordBatch) -> np.ndarray:
        centre, weights = shared.value
        return centre.centred(batch.column("x")) @ weights

    mean = _added(rows.select("x"), lambda b: whitened(b).sum(axis=0), (k,)) / model.centre.n

    def squares(batch: pa.RecordBatch) -> np.ndarray:
        z = whitened(batch) - mean
        return z.T @ z

    return float(np.abs(_added(rows.select("x"), squares, (k, k)) / model.centre.n - np.eye(k)).max())


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id``, ``deviation`` (exact sum of squares of n * x - sums) and ``whitened``, an array, for each row."""
    shared = rows.sparkSession.sparkContext.broadcast((model.centre, model.weights))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, weights = shared.value
        for batch in batches:
            away = centre.deviations(batch.column("x"))
            squares = _squares(away)
            z = (away / centre.n).astype(float) @ weights
            ends = (np.arange(len(z) + 1) * z.shape[1]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), squares, arrays], ["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(whiten, f"vec_id {kind}, deviation long, whitened array<double>")


def _squares(away: np.ndarray) -> pa.Array:
    """Sums of squares of each row; one that no 64 bits hold raises an error rather than a wrong number."""
    most = max(int(away.max(initial=0)), -int(away.min(initial=0)))
    if most * most * max(1, away.shape[1]) >= 1 << 63:
        away = away.astype(object)
    return pa.array((away * away).sum(axis=1).tolist(), pa.int64())


def whiten(embeddings: DataFrame, components: int, identifier: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Whitening]:
    """(whitened rows as of ``transform``, the fitted model)."""
    rows = stored(whole_vectors(embeddings, identifier, vector), "whole-vectors")
    model = fit(rows, components)
    return transform(rows, model), model


def by_component(whitened: DataFrame, model: Whitening) -> DataFrame:
    """One row for each row and component, with the figures of the fit."""
    share = [float(v) / model.trace for v in model.pairs.values]
    explained = F.element_at(F.array(*map(F.lit, share)), F.col("component")) if share else F.lit(None).cast("double")
    each: Column = F.posexplode("whitened").alias("place", "value")
    return whitened.select("vec_id", "deviation", each).withColumn("component", F.col("place") + 1).select(
        "vec_id", "component", F.lit(model.centre.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"),
        explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
