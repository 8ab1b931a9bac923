"""Whitening of embeddings by a block Jacobi-Davidson eigensolver.

The covariance is never formed: a pass over the vectors multiplies it with a block of directions, each task with its own
centred rows, and the products are added up per dimension. The driver keeps only columns as long as a vector is wide: the
subspace, its products, and the inner MINRES recurrences. Each outer step takes Ritz pairs of the subspace, locks the leading
ones whose residual is at double precision, and extends the subspace by the solutions of the projected correction equations of
the others, which MINRES solves for the whole block with one pass a step.

Entries are counted in steps of 1/64, so sums over all vectors are exact integers and centring loses nothing.

Nulls and odd tables: vectors that are null, or hold a null, NaN, infinite or larger entry than ``LARGEST`` (beyond exact
integers), are dropped. So are vectors whose length isn't the commonest one (the shorter of equally common ones). Repeated
rows, ids and null ids stay rows of their own. Components without variance can't be scaled to one and are left out: at
rounding level next to the largest (fewer vectors than dimensions, constant tables), or all for an empty table. A ``deviation``
beyond 64 bits is null. Other columns are ignored. Sums of products depend on their order in the last bits of a double.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import slices
from tablekin.session import materialize

STEPS, ZERO = 64, 1_000_000
LARGEST = 2.0**46
#: Sums of integers are kept as high and low parts of so many bits.
LOW = 26
#: Steps of the inner solver, outer steps, and blocks in the subspace before it is restarted.
INNER, OUTER, BLOCKS = 6, 200, 4
EPS = float(np.finfo(np.float64).eps)


def whole_steps(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): the entries of the usable vectors as whole numbers, floor(64 c) + 1000000; written once."""
    vector = F.col(column).cast("array<double>")
    fine = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    kept = embeddings.select("vec_id", vector.alias(column)).filter(F.col(column).isNotNull() & fine)
    common = kept.groupBy(F.size(column).alias("width")).count().orderBy(F.desc("count"), "width").first()
    whole: Column = F.transform(column, lambda c: F.floor(c * STEPS) + ZERO)
    kept = kept.filter(F.size(column) == (common["width"] if common else -1))
    return materialize(kept.select("vec_id", whole.cast("array<bigint>").alias("x")), "vectors")


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Centre:
    """Number of vectors, exact sums per dimension, and the rows less their mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.width = n, len(sums)
        near = [round(Fraction(s, n)) for s in sums]
        self.near = np.array(near, np.int64)
        self.rest = [s - n * m for s, m in zip(sums, near)]
        self.part = np.array([float(Fraction(r, n)) for r in self.rest])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)^2 as exact integers; null beyond 64 bits."""
        off = x - self.near
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if self.width * most * most < 2**63:
            return pa.array(((off * self.n - np.array(self.rest, np.int64)) ** 2).sum(1), pa.int64())
        exact = [sum((self.n * int(o) - r) ** 2 for o, r in zip(row, self.rest)) for row in off]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def centre(vectors: DataFrame) -> Centre | None:
    """Exact sums of all vectors; None if there are none or they have no entries."""
    first = vectors.select(F.size("x").alias("width")).first()
    if first is None or not first["width"]:
        return None
    width = first["width"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = _matrix(batch, width)
            n += len(x)
            high += (x >> LOW).sum(0)
            low += (x & ((1 << LOW) - 1)).sum(0)
        yield pa.record_batch([pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    parts = vectors.select("x").mapInArrow(add, "dim long, n long, high long, low long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    found = sorted(parts.groupBy("dim").agg(*exact).collect())
    return Centre(int(found[0]["n"]), [(int(r["high"]) << LOW) + int(r["low"]) for r in found])


def _add_up(vectors: DataFrame, part: Callable[[Iterator[np.ndarray]], np.ndarray], width: int, rows: int, columns: int) -> np.ndarray:
    """Sum over tasks of a rows x columns matrix that each task makes from its vectors."""
    names = [f"y{k}" for k in range(columns)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = part(_matrix(b, width) for b in slices(batches, 4096))
        yield pa.record_batch([pa.array(np.arange(rows)), *[pa.array(np.ascontiguousarray(c)) for c in total.T]], ["dim", *names])

    sent = vectors.select("x").mapInArrow(work, "dim long, " + ", ".join(f"{c} double" for c in names))
    found = sorted(sent.groupBy("dim").agg(*[F.sum(c).alias(c) for c in names]).collect())
    return np.array([r[1:] for r in found], np.float64).reshape(rows, columns)


def covariance_product(vectors: DataFrame, middle: Centre, block: np.ndarray) -> np.ndarray:
    """Covariance times each column of ``block``; a last column holds the variances. One pass."""

    def part(matrices: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros((middle.width, block.shape[1] + 1))
        for x in matrices:
            c = middle.rows(x)
            total[:, :-1] += c.T @ (c @ block)
            total[:, -1] += (c * c).sum(0)
        return total

    return _add_up(vectors, part, middle.width, middle.width, block.shape[1] + 1) / middle.n


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns of ``block`` made orthonormal to each other and to ``against``; columns that vanish are left out."""
    kept: list[np.ndarray] = []
    for column in block.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        basis = np.column_stack([against, *kept])
        for _ in range(3):
            column = column - basis @ (basis.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        else:
            kept.append(column)
    return np.column_stack(kept) if kept else np.zeros((len(block), 0))


def minres(apply: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """Approximate solutions of symmetric, possibly indefinite systems, one for each column; one ``apply`` a step for all."""
    norm = lambda y: np.maximum(np.linalg.norm(y, axis=0), np.finfo(float).tiny)
    solution, w, w_old, last = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    now = rhs
    beta = start = norm(rhs)
    before, d_bar, eps, phi_bar = np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), beta
    cs, sn = -np.ones_like(beta), np.zeros_like(beta)
    for step in range(steps):
        v = now / beta
        y = apply(v)
        if step:
            y = y - (beta / before) * last
        alpha = (v * y).sum(0)
        y = y - (alpha / beta) * now
        last, now, before, beta = now, y, beta, norm(y)
        eps_old, delta, g_bar = eps, cs * d_bar + sn * alpha, sn * d_bar - cs * alpha
        eps, d_bar = sn * beta, -cs * beta
        gamma = np.maximum(np.hypot(g_bar, beta), EPS * start)
        cs, sn = g_bar / gamma, beta / gamma
        w, w_old = (v - eps_old * w_old - delta * w) / gamma, w
        solution = solution + cs * phi_bar * w
        phi_bar = sn * phi_bar
        if (phi_bar <= tol * start).all() or (beta <= EPS * start).all():
            break
    return solution


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric operator and their unit vectors, by block Jacobi-Davidson.

    ``product`` applies the operator to a block. A pair is locked, in falling order, when its residual is at rounding level
    next to the largest eigenvalue. Ends with an error if that isn't reached.
    """
    locked, values = np.zeros((width, 0)), np.zeros(0)
    basis = orthonormal(np.random.default_rng(12).normal(size=(width, min(wanted, width))), locked)
    image = product(basis)
    scale = 0.0
    for outer in range(OUTER):
        theta, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        scale = max(scale, float(np.abs(theta).max(initial=0)))
        residual = image - basis * theta
        size = np.linalg.norm(residual, axis=0)
        tol = 8 * EPS * np.sqrt(width) * scale
        done = 0
        while done < basis.shape[1] and len(values) + done < wanted and size[done] <= tol:
            done += 1
        locked, values = np.column_stack([locked, basis[:, :done]]), np.concatenate([values, theta[:done]])
        basis, image, theta, residual = basis[:, done:], image[:, done:], theta[done:], residual[:, done:]
        left = wanted - len(values)
        if not left:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        if basis.shape[1] > BLOCKS * wanted:
            basis, image = basis[:, : 2 * wanted], image[:, : 2 * wanted]
        at, wrong, shift = basis[:, :left], residual[:, :left], theta[:left]
        fixed = np.column_stack([locked, at])
        aside = lambda y: y - fixed @ (fixed.T @ y)  # noqa: B023, E731
        more = minres(lambda y: aside(product(aside(y)) - shift * y), -aside(wrong), INNER, 0.5 ** (outer + 2))  # noqa: B023
        known = np.column_stack([locked, basis])
        more = orthonormal(more, known)
        if not more.shape[1]:  # nothing new: a random direction, unless the space is used up
            more = orthonormal(np.random.default_rng(outer).normal(size=(width, min(left, width - known.shape[1]))), known)
        if more.shape[1]:
            basis, image = np.column_stack([basis, more]), np.column_stack([image, product(more)])
        else:  # the whole space: products anew, for the rounding that rotations have left in them
            basis = orthonormal(basis, locked)
            image = product(basis)
    raise ArithmeticError(f"residuals {size} did not reach {tol}")


def whiten(embeddings: DataFrame, components: int = 32, column: str = "embedding") -> DataFrame:
    """Each usable row with each component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = whole_steps(embeddings, column)
    middle = centre(vectors)
    if middle is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    width, wanted = middle.width, min(components, middle.width)
    variances = np.zeros(width)

    def product(block: np.ndarray) -> np.ndarray:
        found = covariance_product(vectors, middle, block)
        variances[:] = found[:, -1]
        return found[:, :-1]

    values, directions = leading_pairs(product, width, wanted)
    real = values > 16 * EPS * width * max(values[0], 0.0)
    values, directions, trace = values[real], directions[:, real], variances.sum()
    if not len(values):
        return embeddings.sparkSession.createDataFrame([], schema)
    scaled, share, count = directions / np.sqrt(values), values / trace, len(values)

    def second(matrices: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros((count, count + 1))
        for x in matrices:
            w = middle.rows(x) @ scaled
            total[:, :-1] += w.T @ w
            total[:, -1] += w.sum(0)
        return total

    sums = _add_up(vectors, second, width, count, count + 1) / middle.n
    error = float(np.abs(sums[:, :-1] - np.outer(sums[:, -1], sums[:, -1]) - np.eye(count)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            x = _matrix(batch, width)
            each = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.record_batch(
                [
                    batch.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), middle.n)),
                    middle.deviations(x).take(each),
                    pa.array((middle.rows(x) @ scaled).ravel()),
                    pa.array(np.tile(share, len(x))),
                    pa.array(np.full(len(each), error)),
                ],
                [f.split()[0] for f in schema.split(", ")],
            )

    return vectors.mapInArrow(project, schema)
