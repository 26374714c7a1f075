"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors are put on an integer grid, so that sums and deviations are exact. The covariance
is never built: every step multiplies it with a narrow block Q by one pass over the rows,
``Xc' (Xc Q) / n`` with rows centred before they are multiplied. A polynomial recurrence of
such passes damps the unwanted end of the spectrum; QR and Rayleigh-Ritz follow, and rounds
go on until the residuals of the wanted pairs certify them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrefsieve.llm.tables import cut

GRID, SHIFT = 1024, 100_000
#: entries of so many grid steps or more have no exact place on the grid
GRID_END = float(1 << 52)
#: entries multiplied at a time
CHUNK = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Bounds of the iteration. ``guard`` further columns keep the wanted ones apart from the rest."""

    components: int = 8
    guard: int = 16
    #: largest residual, as a share of the largest eigenvalue, of a certified pair
    tolerance: float = 1e-13
    #: what one round of filtering should gain, and the passes it may take
    gain: float = 1e8
    degree: int = 40
    rounds: int = 60
    #: eigenvalues below this share of the largest are no components
    rank: float = 1e-11
    seed: int = 12


@dataclass(frozen=True)
class Fit:
    """What the rows are whitened with: exact sums, directions, eigenvalues, residuals."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    trace: float
    passes: int


def on_grid(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x): rows with a usable vector, its entries as whole grid steps."""
    entries = F.col(vector)
    usable = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c.cast("double") * GRID) < GRID_END))
    whole = F.transform(entries, lambda c: F.floor(c.cast("double") * GRID) + F.lit(SHIFT).cast("long"))
    return vectors.where(entries.isNotNull() & (F.size(entries) > 0)).where(usable).select("vec_id", whole.alias("x"))


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Start row and entries of pieces of a batch."""
    step = max(1, CHUNK // width)
    for start in range(0, batch.num_rows, step):
        piece = batch.column("x").slice(start, step)
        yield start, piece.flatten().to_numpy(zero_copy_only=False).reshape(len(piece), width)


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as integers, or as Python's where those don't hold it."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _scaled(x, n, sums).astype(np.float64) / n


def _sums(width: int) -> Callable:
    """Sums of the high and low halves of each dimension's entries; dimension -1 counts the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            rows += batch.num_rows
            for _, x in _blocks(batch, width):
                high += (x >> 26).sum(axis=0)
                low += (x & ((1 << 26) - 1)).sum(axis=0)
        columns = [np.arange(-1, width), np.concatenate([[rows], high]), np.concatenate([[0], low])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["i", "high", "low"])

    return run


class Passes:
    """Products of the covariance with narrow blocks, each by one pass over the rows."""

    def __init__(self, rows: DataFrame, width: int, n: int, sums: list[int]):
        self.rows, self.width, self.n, self.sums, self.count = rows, width, n, sums, 0

    @classmethod
    def over(cls, rows: DataFrame, width: int) -> Passes:
        """Passes over rows whose number and exact sums a first pass finds."""
        found = rows.mapInArrow(_sums(width), "i long, high long, low long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
        totals = {r["i"]: (int(r["high"]) << 26) + int(r["low"]) if r["i"] >= 0 else int(r["high"]) for r in found}
        return cls(rows, width, totals.get(-1, 0), [totals.get(i, 0) for i in range(width)])

    def _summed(self, of_block: Callable, height: int, width: int) -> np.ndarray:
        """The sum over all rows of a ``height`` x ``width`` matrix made from each centred block.

        A task adds up its own rows and sends one matrix; equal places meet in a partial aggregate.
        """
        n, sums, dimensions = self.n, self.sums, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((height, width))
            for batch in batches:
                for _, x in _blocks(batch, dimensions):
                    total += of_block(_centred(x, n, sums))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height))] + [pa.array(total[:, j]) for j in range(width)], names=["i", *names])

        names = [f"v{j}" for j in range(width)]
        parts = self.rows.mapInArrow(run, "i long, " + ", ".join(f"{v} double" for v in names))
        out = np.zeros((height, width))
        for r in parts.groupBy("i").agg(*[F.sum(v).alias(v) for v in names]).collect():
            out[r["i"]] = [r[v] for v in names]
        self.count += 1
        return out

    def product(self, q: np.ndarray) -> np.ndarray:
        """Covariance times q."""
        return self._summed(lambda x: x.T @ (x @ q), *q.shape) / self.n

    def trace(self) -> float:
        return float(self._summed(lambda x: np.array([[np.einsum("ij,ij->", x, x)]]), 1, 1)[0, 0]) / self.n

    def identity_error(self, project: np.ndarray) -> float:
        """Largest difference between the covariance of the projected rows and the identity."""
        k = project.shape[1]

        def moments(x: np.ndarray) -> np.ndarray:
            w = x @ project
            return np.vstack([w.T @ w, w.sum(axis=0)])

        total = self._summed(moments, k + 1, k) / self.n
        return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def _ritz(passes: Passes, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors and residual norms in the space of a block."""
    q = np.linalg.qr(block)[0]
    image = passes.product(q)
    small = q.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    q = q @ turn
    return values, q, np.linalg.norm(image @ turn - q * values, axis=0)


def _lowest(alphas: list[float], betas: list[float], values: np.ndarray) -> float:
    """Where the spectrum begins, by a Lanczos recurrence: its smallest Ritz value less that one's residual."""
    t = np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1)
    theta, y = np.linalg.eigh(t)
    span = max(values[0] - theta[0], 0.0)
    return max(0.0, theta[0] - abs(betas[-1] * y[-1, 0]) - 0.01 * span)


class _Probe:
    """A Lanczos recurrence that rides along in the passes of the first filter."""

    def __init__(self, start: np.ndarray):
        self.v, self.before, self.beta = start / np.linalg.norm(start), np.zeros_like(start), 0.0
        self.alphas: list[float] = []
        self.betas: list[float] = []

    def step(self, image: np.ndarray) -> None:
        alpha = float(image @ self.v)
        rest = image - alpha * self.v - self.beta * self.before
        self.beta = float(np.linalg.norm(rest))
        self.alphas.append(alpha)
        self.betas.append(self.beta)
        self.before, self.v = self.v, rest / self.beta if self.beta else np.zeros_like(rest)


def _filtered(passes: Passes, block: np.ndarray, low: float, high: float, top: float, degree: int, probe: _Probe | None) -> np.ndarray:
    """The block under a Chebyshev polynomial that stays small on [low, high] and is 1 at ``top``."""
    def image(y: np.ndarray) -> np.ndarray:
        if probe is None:
            return passes.product(y)
        out = passes.product(np.column_stack([y, probe.v]))
        probe.step(out[:, -1])
        return out[:, :-1]

    half, middle = (high - low) / 2, (high + low) / 2
    sigma = half / (top - middle)
    tau, before = 2 / sigma, block
    now = (image(block) - middle * block) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (tau - sigma)
        before, now = now, (image(now) - middle * now) * (2 * following / half) - before * (sigma * following)
        sigma = following
    return now


def fit(rows: DataFrame, width: int, settings: Settings = Settings()) -> Fit:
    """The leading directions of the covariance of rows (vec_id, x) of ``width`` entries.

    Blocks of ``components + guard`` columns; if the rows are no wider, one pass settles
    it. Otherwise each round filters with the interval that the round before has shown
    (its lower end comes from a Lanczos vector that rides along in the first round), draws
    the last guard column anew, so that no direction can be missing from the start, and
    ends with QR and Rayleigh-Ritz. Done when every wanted pair's residual is within
    ``tolerance``, or no longer halves; the residuals are returned.
    """
    passes = Passes.over(rows, width)
    if passes.n == 0:
        return Fit(0, passes.sums, np.zeros((width, 0)), np.zeros(0), np.zeros(0), 0.0, 0)
    random = np.random.default_rng(settings.seed)
    trace, k = passes.trace(), min(settings.components, width)
    columns = min(width, k + settings.guard)
    values, q, residuals = _ritz(passes, np.eye(width) if columns == width else random.standard_normal((width, columns)))
    low, best = 0.0, math.inf
    for turn in range(settings.rounds if columns < width and values[0] > 0 else 0):
        wanted = int((values[:k] > settings.rank * values[0]).sum())
        worst = residuals[:wanted].max(initial=0.0)
        if worst <= settings.tolerance * values[0] or turn > 3 and worst > best / 2 and worst <= 1e-10 * values[0]:
            break
        best = min(best, worst)
        high, top = float(values[-1]), float(values[0])
        if not low < high < top:
            low = 0.0 if high > 0 else -1e-3 * top
            high = max(high, low + 1e-3 * (top - low))
        reach = math.acosh(max(1 + 1e-6, 1 + 2 * (float(values[wanted - 1]) - high) / (high - low)))
        degree = int(min(settings.degree, max(4, math.ceil(math.log(settings.gain) / reach))))
        if turn == 0:
            probe, degree = _Probe(random.standard_normal(width)), min(12, width - 1)
            q = _filtered(passes, q, low, high, top, degree, probe)
            low = _lowest(probe.alphas, probe.betas, values)
        else:
            q = _filtered(passes, q, low, high, top, degree, None)
        q[:, -1] = random.standard_normal(width)
        values, q, residuals = _ritz(passes, q)
    kept = int((values[:k] > settings.rank * max(values[0], 0.0)).sum()) if len(values) and values[0] > 0 else 0
    return Fit(passes.n, passes.sums, q[:, :kept], values[:kept], residuals[:kept], trace, passes.count)


def _deviations(scaled: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exactly; null where a long can't hold it."""
    if scaled.dtype != object and scaled.size and float(np.abs(scaled).max()) ** 2 * scaled.shape[1] < 2.0**62:
        return (scaled * scaled).sum(axis=1).tolist()
    exact = [sum(int(v) * int(v) for v in row) for row in scaled]
    return [v if v < 1 << 63 else None for v in exact]


COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"


def whiten(vectors: DataFrame, vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """Leading whitened components of every usable row of (vec_id, ``vector``).

    Rows whose vector is null, empty, or holds null, non-finite or unplaceable entries
    (``GRID_END``) take no part, nor do rows of another length than most have (ties: the
    longer). Everything else does, repeated rows and rows without vec_id included; equal
    vectors get equal results. Directions without variance are no components, so there
    may be fewer than ``components``, and none for a single row or equal rows. Equal
    eigenvalues get some orthonormal basis of their space. An empty table gives no rows.
    Other columns are not read.

    One row for each row and component: n, deviation (exact, null where it exceeds a
    long), whitened, explained (share of the trace), identity_error (of the whole
    result), residual (of the eigenpair, as a share of the largest eigenvalue).
    """
    rows = cut(on_grid(vectors, vector), "grid")
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], COLUMNS)
    width = lengths["width"]
    rows = rows.where(F.size("x") == width)
    found = fit(rows, width, settings)
    project = found.vectors / np.sqrt(found.values)
    if not project.shape[1]:
        return vectors.sparkSession.createDataFrame([], COLUMNS)
    error = Passes(rows, width, found.n, found.sums).identity_error(project)
    k, explained, residual = len(found.values), found.values / found.trace, found.residuals / found.values[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, x in _blocks(batch, width):
                scaled = _scaled(x, found.n, found.sums)
                white = (scaled.astype(np.float64) / found.n) @ project
                m = len(x)
                at = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").slice(start, m).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, found.n)), pa.array(_deviations(scaled), pa.int64()).take(pa.array(at)), pa.array(white.ravel()),
                        pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)), pa.array(np.tile(residual, m)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"],
                )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, COLUMNS)
