"""Whitening of embeddings by FEAST contour integration.

The covariance of the distinct vectors is summed up in tasks, centred first. Its leading eigenvalues are
fenced into intervals by inertia counts; each interval is then a task of its own: a quadrature of complex
shifted solves along a circle around the interval projects random vectors onto its eigenspace, and
Rayleigh-Ritz extracts the components. The inertia counts tell how many each interval must yield, so none
is missed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.llm.tables import cut_lineage

COMPONENTS = 16
STEPS = 64  # grid steps a unit
OFFSET = 1_000_000  # added to every step
MOST_STEPS = 1 << 52  # entries beyond so many steps count as so many
NODES = 16  # quadrature nodes of a half circle
FENCED = 4  # eigenvalues of an interval, if they can be told apart
ROUNDS = 30  # contour integrations of an interval at most
RANK = 1e-12  # an eigenvalue below this share of the largest one is none
EPS = float(np.finfo(np.float64).eps)

_LONG = 1 << 62


# --- grid vectors -----------------------------------------------------------------------------------


def finite(vector: F.Column) -> F.Column:
    """Whether a vector is there and holds neither null nor non-finite entries."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(good, F.lit(False))


def grid(vector: F.Column, dims: int) -> F.Column:
    """Entries as steps of 1/64 counted from -1000000/64; shorter vectors go on with entries of 0."""
    most = F.lit(float(MOST_STEPS))
    step = F.transform(
        vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * STEPS, -most), most)) + OFFSET
    )
    return F.concat(step, F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(dims) - F.size(vector)))


def _rows(column: pa.Array, dims: int, kind=np.int64) -> np.ndarray:
    """A list column of ``dims`` entries each as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), dims)


@dataclass
class Centre:
    """Number and sums of the fit list's vectors."""

    n: int
    sums: list[int]

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n * x - S: 64-bit integers, or Python's where those do not fit."""
        most = max(map(abs, self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if most < _LONG:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return (self.exact(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 of each row, exactly; null where it does not fit a long."""
        off = self.exact(x)
        if off.dtype != object:
            most = int(np.abs(off).max(initial=0))
            if most * most * max(1, off.shape[1]) < _LONG:
                return (off * off).sum(axis=1).tolist()
        wide = (off.astype(object) ** 2).sum(axis=1).tolist()
        return [int(v) if v < 1 << 63 else None for v in wide]


def centre(fit: DataFrame, dims: int) -> Centre:
    """Sums of the fit list by dimension: one row for each dimension and task, added up by Spark."""

    def add_up(batches):
        for batch in batches:
            x = _rows(batch.column("x"), dims)
            if len(x):
                fits = int(np.abs(x).max()) * len(x) < _LONG
                sums = (x if fits else x.astype(object)).sum(axis=0).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(dims), pa.int32()),
                        pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0)),
                    ],
                    ["dim", "total"],
                )

    found = fit.select("x").mapInArrow(add_up, "dim int, total decimal(38,0)")
    sums = {r["dim"]: int(r["total"]) for r in found.groupBy("dim").agg(F.sum("total").alias("total")).collect()}
    return Centre(fit.count(), [sums.get(d, 0) for d in range(dims)])


def second_moments(fit: DataFrame, dims: int, size: int, view: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the fit list of v v', where ``view`` turns rows x into rows v of ``size`` entries.

    Each task adds up its own matrix; Spark adds them up row by row, so the driver gets one matrix,
    whatever the number of vectors.
    """

    def multiply(batches):
        total = np.zeros((size, size))
        for batch in batches:
            v = view(_rows(batch.column("x"), dims))
            total += v.T @ v
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "part"]
        )

    def add(group: pa.Table) -> pa.Table:
        parts = _rows(group.column("part"), size, np.float64)
        return pa.table({"row": group.column("row")[:1], "part": pa.array([parts.sum(axis=0)], pa.list_(pa.float64()))})

    kind = "row int, part array<double>"
    rows = fit.select("x").mapInArrow(multiply, kind).groupBy("row").applyInArrow(add, kind).toArrow()
    out = np.zeros((size, size))
    if len(rows):
        out[rows.column("row").to_numpy()] = _rows(rows.column("part"), size, np.float64)
    return (out + out.T) / 2


# --- eigenvalues: inertia counts --------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar matrix, by Householder reflections."""
    a = matrix.copy()
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        p -= (v @ p) * v
        rest -= 2 * (np.outer(v, p) + np.outer(p, v))
        a[k + 1 :, k] -= 2 * (v @ a[k + 1 :, k]) * v
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Inertia: how many eigenvalues of a tridiagonal matrix are greater than each shift."""
    shifts = np.asarray(shifts, float)
    tiny = EPS * EPS * max(1e-300, float(np.abs(diagonal).max() + (np.abs(off).max() if len(off) else 0)))
    pivot = diagonal[0] - shifts
    positive = (pivot > 0).astype(int)
    for d, e in zip(diagonal[1:], off, strict=True):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - shifts - e * e / pivot
        positive += pivot > 0
    return positive


def fences(diagonal: np.ndarray, off: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Disjoint intervals (low, high, eigenvalues in it), highest first, that hold the ``wanted`` largest.

    Halved until few eigenvalues are left in each; borders keep away from eigenvalues where they can.
    """
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    top, bottom = float((diagonal + reach).max()), float((diagonal - reach).min())
    scale = max(abs(top), abs(bottom), 1e-300)
    top, bottom = top + 1e-3 * scale, bottom - 1e-3 * scale
    out, stack = [], [(bottom, top, len(diagonal), 0)]
    while stack:
        low, high, inside, over = stack.pop()  # eigenvalues in it, and above it
        if not inside or over >= wanted:
            continue
        width = high - low
        if inside <= FENCED or width <= 1e-9 * scale:
            out.append((low, high, inside))
            continue
        cuts = low + width * np.array([0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65])
        gap = 1e-3 * width / inside
        clear = above(diagonal, off, cuts - gap) == above(diagonal, off, cuts + gap)
        cut = float(cuts[int(clear.argmax())])
        upper = int(above(diagonal, off, np.array([cut]))[0]) - over
        # the higher part is looked at first
        stack += [(low, cut, inside - upper, over + upper), (cut, high, upper, over)]
    return out


# --- eigenvectors: contour integration --------------------------------------------------------------


def feast(matrix: np.ndarray, low: float, high: float, inside: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``inside`` eigenvalues between ``low`` and ``high`` and their unit eigenvectors (columns).

    Each round integrates the resolvent along a circle through both ends (Gauss-Legendre nodes of the
    upper half; the lower one is its conjugate), which projects the subspace onto the eigenspace, then
    takes Ritz vectors. It ends when the residuals are those of rounding.
    """
    n = len(matrix)
    size = min(n, 2 * inside + 4)
    at, weight = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (1 + at)
    middle, radius = (low + high) / 2, (high - low) / 2
    norm = max(float(np.abs(matrix).sum(axis=1).max()), 1e-300)
    rng = np.random.default_rng(seed)
    space = np.linalg.qr(rng.standard_normal((n, size)))[0]
    best = None
    for _ in range(ROUNDS):
        projected = np.zeros((n, size))
        for theta, w in zip(angle, weight, strict=True):
            turn = radius * np.exp(1j * theta)
            shifted = (middle + turn) * np.eye(n) - matrix
            projected += w / 2 * (turn * np.linalg.solve(shifted, space.astype(complex))).real
        # directions that the projection leaves nothing of are filled up with new ones
        basis, strength, _ = np.linalg.svd(projected, full_matrices=False)
        weak = strength <= 1e-14 * strength[0]
        if weak.any():
            basis[:, weak] = rng.standard_normal((n, int(weak.sum())))
        basis = np.linalg.qr(basis)[0]
        values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
        space = basis @ turn
        # the Ritz values inside; if rounding at a border leaves too many or too few, the nearest ones
        outside = np.maximum(np.maximum(low - values, values - high), 0)
        chosen = np.sort(np.argsort(outside, kind="stable")[:inside])
        error = np.linalg.norm(matrix @ space[:, chosen] - space[:, chosen] * values[chosen], axis=0).max(initial=0)
        if best is None or error < best[0]:
            best = (error, values[chosen], space[:, chosen])
            stalled = 0
        else:
            stalled += 1
        if best[0] <= 4 * EPS * norm or (stalled >= 2 and best[0] <= 1e-12 * norm):
            break
    if best[0] > 1e-9 * norm:
        raise ArithmeticError(f"no {inside} eigenvectors found between {low} and {high}")
    return best[1], best[2]


FOUND = "value double, vector array<double>"


def leading_components(spark, matrix: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and unit eigenvectors (columns) of a covariance matrix.

    At most ``components``, and only those above rounding. Each interval of eigenvalues is a task.
    """
    nothing = np.zeros(0), np.zeros((len(matrix), 0))
    if not len(matrix) or not np.trace(matrix) > 0:
        return nothing
    diagonal, off = tridiagonal(matrix)
    largest = fences(diagonal, off, 1)[0][1]
    rank = int(above(diagonal, off, np.array([RANK * max(largest, EPS * np.trace(matrix))]))[0])
    wanted = min(components, rank)
    if not wanted:
        return nothing
    parts = fences(diagonal, off, wanted)

    def extract(batches):
        for batch in batches:
            for part in batch.to_pylist():
                values, vectors = feast(matrix, part["low"], part["high"], part["inside"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), pa.array(list(vectors.T), pa.list_(pa.float64()))], ["value", "vector"]
                )

    frame = spark.createDataFrame(parts, "low double, high double, inside int").repartition(len(parts), "low")
    found = frame.mapInArrow(extract, FOUND).toArrow()  # a few vectors for each component
    if len(found) != sum(p[2] for p in parts):
        raise ArithmeticError("contour integration and inertia disagree")
    # one more Ritz step makes vectors of different intervals orthogonal to rounding
    basis = np.linalg.qr(_rows(found.column("vector"), len(matrix), np.float64).T)[0]
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values)[:wanted]
    vectors = (basis @ turn)[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)])
    return values[order], vectors * sign


# --- the operator -----------------------------------------------------------------------------------


@dataclass
class Whitening:
    """What maps a vector to whitened components: bounded by dimensions times components."""

    dims: int
    centre: Centre
    values: np.ndarray
    axes: np.ndarray  # a column for each component, divided by the root of its eigenvalue
    explained: np.ndarray
    identity_error: float


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learn the whitening of all vectors that :func:`finite` lets pass; None if there is none.

    Every distinct grid vector counts once. The driver holds two matrices of dimensions x dimensions.
    """
    rows = vectors.select(F.col("embedding").alias("v")).where(finite(F.col("v")))
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    if not dims:
        return None
    fit = cut_lineage(rows.select(grid(F.col("v"), dims).alias("x")).distinct())
    middle = centre(fit, dims)
    covariance = second_moments(fit, dims, dims, middle.offsets) / middle.n
    values, vectors_ = leading_components(vectors.sparkSession, covariance, components)
    axes = vectors_ / np.sqrt(values)
    size = len(values)

    def whitened(x: np.ndarray) -> np.ndarray:
        w = middle.offsets(x) @ axes
        return np.concatenate((w, np.ones((len(w), 1))), axis=1)

    error = 0.0
    if size:
        # measured, not assumed: one more pass over the fit list; the last row holds the sums
        moments = second_moments(fit, dims, size + 1, whitened) / middle.n
        mean = moments[-1, :-1]
        error = float(np.abs(moments[:-1, :-1] - np.outer(mean, mean) - np.eye(size)).max())
    return Whitening(dims, middle, values, axes, values / np.trace(covariance), error)


def _apply(model: Whitening) -> Callable:
    def whiten(column: pa.Array) -> pa.Array:
        deviations, parts = [], []
        for at in range(0, len(column), 4096):
            x = _rows(column[at : at + 4096], model.dims)
            deviations += model.centre.deviations(x)
            parts.append(model.centre.offsets(x) @ model.axes)
        flat = np.concatenate(parts) if parts else np.zeros((0, model.axes.shape[1]))
        ends = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1])
        return pa.StructArray.from_arrays(
            [pa.array(deviations, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))],
            ["deviation", "whitened"],
        )

    return F.arrow_udf(whiten, "struct<deviation:long,whitened:array<double>>").asNondeterministic()


RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def whiten_embeddings(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Vectors that are null or hold null or non-finite entries are left out. Shorter vectors than the
    longest count as filled up with zeros; entries beyond 2^52 steps count as 2^52 steps. Repeated rows,
    and rows without an id, come out as often as they came in; repeated vectors count once in the fit.
    Components that no vector departs along (fewer distinct vectors or dimensions than ``components``)
    are left out, so a table of equal vectors, or an empty one, gives no rows. ``deviation`` is null where
    it does not fit 64 bits. Other columns are not looked at.
    """
    rows = vectors.select("vec_id", "embedding")
    model = fit_whitening(rows, components)
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], kind)
    x = grid(F.col("embedding"), model.dims)
    kept = rows.where(finite(F.col("embedding"))).select("vec_id", x.alias("x"))
    done = kept.select("vec_id", _apply(model)(F.col("x")).alias("w"))
    done = done.select("vec_id", F.col("w.deviation").alias("deviation"), F.posexplode("w.whitened").alias("k", "whitened"))
    share = F.array(*[F.lit(float(e)) for e in model.explained])
    return done.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.centre.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("k")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
