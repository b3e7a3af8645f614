"""Linear classifiers by a truncated Newton method, several models in one pass over the rows.

A problem is a table of sparse rows. Model ``k`` learns from the rows whose ``fold`` is not ``k`` and minimises

    (|w|^2 + p * b^2) / 2 + C * sum of class weight * loss(label, w . x' + b)

with ``p`` 1 where the intercept is penalised (as liblinear does) and 0 where it is free. ``x'`` is the row
imputed and scaled by the means and deviations of the model's own rows. That is never written out: sums run over
the stored entries alone, and the means come in as one number per model, so sparse rows stay sparse although
they are centred, and all models share one scan.

A step solves the Newton equations by conjugate gradients, scaled by the diagonal; every product with the
Hessians is one scan for all models. Few columns have their Hessians summed whole instead, which takes one scan
a step. A last scan tries all step lengths at once. Partial sums are arrays of the models' size, added up
in a tree of tasks; what reaches the driver does not depend on the rows.

Missing values (null or NaN) count as the mean of the model's rows, a column without any value there does
nothing, a constant one is centred only. Rows without a label of 0 or 1 are left out.

The scans of a fit are jobs on an RDD of packed blocks, which is persisted while the fit lasts: a scan plans no query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.operators.prep import as_number
from riskframe.session import checkpointed

#: Up to so many coefficients a model's Hessian is summed whole.
WHOLE_HESSIAN = 128
#: Partial sums that one task, or the driver, adds up.
FAN_IN = 64
#: Step lengths tried at once: 1, 1/2, 1/4, ...
STEPS = 0.5 ** np.arange(24)
#: Step lengths at which the slope along a direction is taken at once, as parts of the interval looked at.
GRID = np.arange(33) / 32
LOSSES = ("logistic", "squared_hinge")


# --- rows ----------------------------------------------------------------------------------------


def raw_rows(
    df: DataFrame, label: str, numeric: Sequence[str], bag: str | None = None, fold: str | Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """``(keep, label, fold, indices, values)``: rows as they are, missing numbers as NaN, computed once.

    Columns are ``numeric`` in order, then the entries of the sparse vector ``bag``. Without ``fold`` every row has
    fold -1, which no model leaves out.
    """
    fold = F.lit(-1) if fold is None else F.col(fold) if isinstance(fold, str) else fold
    numbers = F.array(*[F.coalesce(as_number(c), F.lit(float("nan"))) for c in numeric]) if numeric else F.array().cast("array<double>")
    places = F.array(*[F.lit(i) for i in range(len(numeric))]) if numeric else F.array().cast("array<int>")
    if bag is not None:
        vector = F.unwrap_udt(bag)
        dense = vector["type"] == 1
        own = F.when(dense, F.sequence(F.lit(0), F.size(vector["values"]) - 1)).otherwise(vector["indices"])
        # A dense vector of no entries has no places.
        own = F.when(F.size(vector["values"]) > 0, own).otherwise(F.array().cast("array<int>"))
        places = F.concat(places, F.transform(own, lambda i: i + len(numeric)))
        numbers = F.concat(numbers, vector["values"])
    target = F.when(F.col(label).isin(0, 1), F.col(label)).cast("int")
    return checkpointed(
        df.select(*keep, target.alias("_label"), fold.cast("int").alias("_fold"), places.alias("_indices"), numbers.alias("_values"))
    )


@dataclass
class Batch:
    """Rows of one Arrow batch in compressed form."""

    y: np.ndarray
    fold: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    row: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, labelled: bool = True) -> Batch:
        if labelled:
            batch = batch.filter(pc.is_valid(batch.column("_label")))
        places = batch.column("_indices")
        lengths = pc.list_value_length(places).to_numpy(zero_copy_only=False)
        label = pc.fill_null(batch.column("_label"), 0)
        return Batch(
            label.to_numpy(zero_copy_only=False).astype(np.float64),
            batch.column("_fold").to_numpy(zero_copy_only=False),
            pc.list_flatten(places).to_numpy(zero_copy_only=False),
            pc.list_flatten(batch.column("_values")).to_numpy(zero_copy_only=False),
            np.repeat(np.arange(batch.num_rows), lengths),
        )

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.indices], len(self.y))

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.indices, self.values * r[self.row], width)


Work = Callable[[Batch], np.ndarray]

#: Columns of a packed block: raw numbers of its labelled rows, and how many entries they store.
PACKED = {"_y": np.float64, "_f": np.int32, "_n": np.int32, "_i": np.int32, "_v": np.float64}
#: Entries a task is worth while there are free cores, and entries of a task beyond that.
LEAST_ENTRIES, MOST_ENTRIES = 1 << 18, 1 << 24
#: Entries of a block (one row may have more).
BLOCK_ENTRIES = 1 << 16


def packed(rows: DataFrame) -> DataFrame:
    """The labelled ``raw_rows`` in blocks of raw numbers, computed once, for the many scans of a fit.

    A scan then moves bytes instead of converting lists. Blocks are read by as many tasks as their entries are worth.
    """
    if "_y" in rows.columns:
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Batch.of(batch)
            lengths = np.bincount(own.row, minlength=len(own.y))
            ends = np.cumsum(lengths)
            start = 0
            while start < len(own.y):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_ENTRIES, "right")))
                some, cells = slice(start, stop), slice(before, ends[stop - 1])
                parts = own.y[some], own.fold[some], lengths[some], own.indices[cells], own.values[cells]
                found = [x.astype(kind).tobytes() for x, kind in zip(parts, PACKED.values())]
                size = pa.array([len(parts[-1])])
                yield pa.RecordBatch.from_arrays([*(pa.array([x]) for x in found), size], names=[*PACKED, "_size"])
                start = stop

    kinds = ", ".join(f"{n} binary" for n in PACKED)
    blocks = checkpointed(rows.select("_label", "_fold", "_indices", "_values").mapInArrow(run, f"{kinds}, _size long"))
    size = blocks.agg(F.sum("_size")).first()[0] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return blocks.coalesce(max(1, size // MOST_ENTRIES, min(size // LEAST_ENTRIES, cores)))


def _blocks(batch: pa.RecordBatch) -> Iterator[Batch]:
    yield from map(_block, zip(*(batch.column(n).to_pylist() for n in PACKED), strict=True))


def _block(cells: Sequence[bytes]) -> Batch:
    y, fold, lengths, indices, values = (np.frombuffer(x, kind) for x, kind in zip(cells, PACKED.values(), strict=True))
    return Batch(y, fold, indices.astype(np.intp), values, np.repeat(np.arange(len(y)), lengths))


def tree_sum(rows: DataFrame, work: Work, size: int) -> np.ndarray:
    """The sum of ``work(batch)``, an array of ``size`` numbers, over all rows."""

    rows = packed(rows)

    def added(batches: Iterator[pa.RecordBatch], of: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["part"])

    def payload(batch: pa.RecordBatch) -> np.ndarray:
        return sum(np.frombuffer(x, np.float64) for x in batch.column("part").to_pylist())

    plain = rows.select(*PACKED)
    parts = plain.mapInArrow(lambda it: added(it, lambda b: sum(work(block) for block in _blocks(b))), "part binary")
    tasks = rows.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = max(1, isqrt(tasks))
        parts = parts.repartition(tasks).mapInArrow(lambda it: added(it, payload), "part binary")
    total = np.zeros(size)
    for batch in parts.toArrow().to_batches():
        total += payload(batch)
    return total


# --- scaling -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Scaling:
    """Per model (rows) and column: the mean, and 1 / deviation (0 for a column without values)."""

    mean: np.ndarray
    inverse: np.ndarray

    @property
    def width(self) -> int:
        return self.mean.shape[1]

    def present(self, batch: Batch, k: int) -> np.ndarray:
        """The batch's values with the model's mean for the missing ones."""
        missing = np.isnan(batch.values)
        return np.where(missing, self.mean[k][batch.indices], batch.values) if missing.any() else batch.values


def plain_scaling(models: int, width: int) -> Scaling:
    """Values as they are; a missing one counts as 0."""
    return Scaling(np.zeros((models, width)), np.ones((models, width)))


def fit_scaling(rows: DataFrame, width: int, models: int = 1) -> Scaling:
    """Means and population deviations of each model's rows, two scans for all models.

    Deviations are those of the imputed rows, so missing values count as rows at the mean. Entries that a row does not
    store are zeros, not missing.
    """
    rows = packed(rows)
    folds = range(models)

    def in_folds(batch: Batch, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((models + 1, width))
        fold = np.where((batch.fold >= 0) & (batch.fold < models), batch.fold, models)
        for f in np.unique(fold).tolist():
            own = (fold == f)[batch.row]
            out[f] = np.bincount(batch.indices[own], weights[own], width)
        return out

    def first(batch: Batch) -> np.ndarray:
        there = ~np.isnan(batch.values)
        rows_ = np.bincount(np.where((batch.fold >= 0) & (batch.fold < models), batch.fold, models), minlength=models + 1)
        parts = [in_folds(batch, np.where(there, batch.values, 0.0)), in_folds(batch, (~there).astype(np.float64))]
        return np.concatenate([*(p.ravel() for p in parts), rows_])

    cells = (models + 1) * width
    found = tree_sum(rows, first, 2 * cells + models + 1)
    sums, missing = found[:cells].reshape(-1, width), found[cells : 2 * cells].reshape(-1, width)
    counts = found[2 * cells :]

    def others(by_fold: np.ndarray) -> np.ndarray:
        return np.stack([by_fold.sum(0) - by_fold[k] for k in folds])

    n = others(counts[:, None])
    known = n - others(missing)
    mean = np.divide(others(sums), known, out=np.zeros((models, width)), where=known > 0)
    # Squares about one value for all models, which is near every mean.
    centre = sums.sum(0) / np.maximum(counts.sum() - missing.sum(0), 1)

    def second(batch: Batch) -> np.ndarray:
        there = ~np.isnan(batch.values)
        away = np.where(there, batch.values - centre[batch.indices], 0.0)
        stored = in_folds(batch, np.ones(len(batch.values)))
        return np.concatenate([in_folds(batch, away * away).ravel(), in_folds(batch, away).ravel(), stored.ravel()])

    found = tree_sum(rows, second, 3 * cells).reshape(3, -1, width)
    # Entries not stored are zeros, which lie ``centre`` away.
    unstored = others(counts[:, None]) - others(found[2])
    square = others(found[0]) + unstored * centre**2
    away = others(found[1]) - unstored * centre
    shift = np.divide(away, known, out=np.zeros_like(mean), where=known > 0)
    # Imputed rows add nothing to the squares about the mean, but count.
    variance = np.divide(square - known * shift**2, n, out=np.zeros_like(mean), where=n > 0)
    deviation = np.sqrt(np.maximum(variance, 0.0))
    # What is left of a constant column by rounding is no deviation.
    deviation = np.where(deviation > 1e-12 * np.maximum(1.0, np.abs(mean)), deviation, 1.0)
    return Scaling(mean, np.where(known > 0, 1.0 / deviation, 0.0))


# --- the solver ----------------------------------------------------------------------------------


def _loss(kind: str, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    signed = np.where(y > 0, z, -z)
    return np.logaddexp(0.0, -signed) if kind == "logistic" else np.maximum(0.0, 1.0 - signed) ** 2


def _slopes(kind: str, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by ``z`` (of the hinge on its active side)."""
    if kind == "logistic":
        p = np.exp(-np.logaddexp(0.0, -z))
        return p - y, p * (1.0 - p)
    sign = np.where(y > 0, 1.0, -1.0)
    active = sign * z < 1.0
    return np.where(active, 2.0 * (z - sign), 0.0), np.where(active, 2.0, 0.0)


@dataclass(frozen=True)
class LinearModels:
    """Coefficients by model (rows) on the scaled columns, and the intercepts."""

    weights: np.ndarray
    intercepts: np.ndarray
    scaling: Scaling
    loss: str
    steps: int
    scans: int

    def margins(self, batch: Batch, k: int) -> np.ndarray:
        own = Batch(batch.y, batch.fold, batch.indices, self.scaling.present(batch, k), batch.row)
        w = self.weights[k] * self.scaling.inverse[k]
        return own.times(w) + self.intercepts[k] - self.scaling.mean[k] @ w


@dataclass(frozen=True)
class Problem:
    """What a task must know of the models."""

    scaling: Scaling
    class_weights: np.ndarray  # (models, 2)
    loss: str

    @property
    def models(self) -> int:
        return len(self.class_weights)

    def share(self, batch: Batch, k: int) -> np.ndarray:
        """Weights of the rows in model ``k``; 0 for its own fold."""
        return np.where(batch.fold == k, 0.0, self.class_weights[k][batch.y.astype(np.int64)])

    def each(self, batch: Batch, theta: np.ndarray) -> Iterator[tuple[int, Batch, np.ndarray, np.ndarray]]:
        """For every model: its number, its rows, their weights and margins under ``theta`` (w, then b)."""
        for k in range(self.models):
            own = Batch(batch.y, batch.fold, batch.indices, self.scaling.present(batch, k), batch.row)
            yield k, own, self.share(batch, k), self.margin(own, k, theta[k])

    def margin(self, own: Batch, k: int, theta: np.ndarray) -> np.ndarray:
        w = theta[:-1] * self.scaling.inverse[k]
        return own.times(w) + theta[-1] - self.scaling.mean[k] @ w

    def back(self, own: Batch, k: int, r: np.ndarray) -> np.ndarray:
        """The transposed product: scaled columns against ``r``, then their sum."""
        total = r.sum()
        columns = own.back(r, self.scaling.width) - self.scaling.mean[k] * total
        return np.append(columns * self.scaling.inverse[k], total)

    def diagonal(self, own: Batch, k: int, h: np.ndarray) -> np.ndarray:
        squares = Batch(own.y, own.fold, own.indices, own.values**2, own.row)
        mean, total = self.scaling.mean[k], h.sum()
        width = self.scaling.width
        columns = squares.back(h, width) - 2 * mean * own.back(h, width) + mean**2 * total
        return np.append(columns * self.scaling.inverse[k] ** 2, total)

    def whole(self, own: Batch, k: int, h: np.ndarray) -> np.ndarray:
        width = self.scaling.width
        dense = np.zeros((len(own.y), width))
        dense[own.row, own.indices] = own.values
        dense = np.column_stack([(dense - self.scaling.mean[k]) * self.scaling.inverse[k], np.ones(len(own.y))])
        return dense.T @ (dense * h[:, None])

    # What each of these gives for a batch is added up over all rows: one scan.

    def slopes(self, batch: Batch, theta: np.ndarray, curved: bool) -> np.ndarray:
        """(models, ...): loss, gradient, and either the whole Hessian or its diagonal, of the losses alone."""
        size = theta.shape[1]
        out = np.zeros((self.models, 1 + size + (size * size if curved else size)))
        for k, own, share, z in self.each(batch, theta):
            r, h = _slopes(self.loss, batch.y, z)
            out[k, 0] = share @ _loss(self.loss, batch.y, z)
            out[k, 1 : 1 + size] = self.back(own, k, share * r)
            out[k, 1 + size :] = (self.whole if curved else self.diagonal)(own, k, share * h).ravel()
        return out

    def product(self, batch: Batch, theta: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The Hessians of the losses at ``theta`` times ``v``."""
        out = np.zeros_like(theta)
        for k, own, share, z in self.each(batch, theta):
            if v[k].any():
                out[k] = self.back(own, k, share * _slopes(self.loss, batch.y, z)[1] * self.margin(own, k, v[k]))
        return out

    def losses(self, batch: Batch, theta: np.ndarray, v: np.ndarray) -> np.ndarray:
        """(models, STEPS): the losses at ``theta + step * v``."""
        out = np.zeros((self.models, len(STEPS)))
        for k, own, share, z in self.each(batch, theta):
            ahead = self.margin(own, k, v[k])
            out[k] = [share @ _loss(self.loss, batch.y, z + s * ahead) for s in STEPS]
        return out

    def along(self, batch: Batch, theta: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(models, steps): the derivatives of the losses by the step, at the steps ``at`` (models, steps) along ``v``."""
        out = np.zeros(at.shape)
        for k, own, share, z in self.each(batch, theta):
            ahead = self.margin(own, k, v[k])
            out[k] = [(share * _slopes(self.loss, batch.y, z + s * ahead)[0]) @ ahead for s in at[k]]
        return out


#: One scan: the name of a method of ``Problem`` and what it takes beside the batch, to the sum over all rows.
Scan = Callable[..., np.ndarray]


NO_ROWS = Batch(np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.intp), np.zeros(0), np.zeros(0, np.intp))


@contextmanager
def scans_of(rows: DataFrame, problem: Problem) -> Iterator[Scan]:
    """Scans of the packed rows, which are persisted until the end."""
    shared = rows.sparkSession.sparkContext.broadcast(problem)
    blocks = rows.select(*PACKED).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

    def scan(name: str, *given) -> np.ndarray:
        def part(own: Iterator[Sequence[bytes]]) -> Iterator[np.ndarray]:
            work = getattr(shared.value, name)
            total = work(NO_ROWS, *given)
            for cells in own:
                total += work(_block(cells), *given)
            yield total

        parts = blocks.mapPartitions(part)
        return parts.treeReduce(np.add) if parts.getNumPartitions() > FAN_IN else sum(parts.collect())

    try:
        yield scan
    finally:
        blocks.unpersist()
        shared.unpersist()


def _conjugate(
    product: Callable[[np.ndarray], np.ndarray], gradient: np.ndarray, scale: np.ndarray, exactness: np.ndarray, rounds: int
) -> tuple[np.ndarray, int]:
    """``H d = -gradient`` for all models at once, each until its residual falls below ``exactness`` of its gradient."""
    d, r = np.zeros_like(gradient), -gradient
    y = r / scale
    p, ry = y.copy(), (r * y).sum(1)
    goal = exactness * np.linalg.norm(gradient, axis=1)
    used = 0
    for used in range(1, rounds + 1):
        open_ = np.linalg.norm(r, axis=1) > goal
        if not open_.any():
            return d, used - 1
        p[~open_] = 0.0
        hp = product(p)
        bend = (p * hp).sum(1)
        step = np.divide(ry, bend, out=np.zeros_like(ry), where=open_ & (bend > 0))
        d += step[:, None] * p
        r -= step[:, None] * hp
        y = r / scale
        fresh = (r * y).sum(1)
        p = y + np.divide(fresh, ry, out=np.zeros_like(ry), where=ry > 0)[:, None] * p
        ry = fresh
    return d, used


def class_weights(
    rows: DataFrame, weights: Mapping[int, float] | str | None, models: int
) -> np.ndarray:
    """(models, 2): given ones, 1, or ``"balanced"`` on each model's own rows (rows / (classes * rows of the class))."""
    if weights is None:
        return np.ones((models, 2))
    if weights != "balanced":
        return np.tile([float(weights.get(0, 1.0)), float(weights.get(1, 1.0))], (models, 1))

    def work(batch: Batch) -> np.ndarray:
        outside = [batch.fold != k for k in range(models)]
        return np.array([[(o & (batch.y == label)).sum() for label in (0, 1)] for o in outside], np.float64).ravel()

    counts = tree_sum(rows, work, 2 * models).reshape(models, 2)
    there = counts > 0
    return np.divide(counts.sum(1, keepdims=True), there.sum(1, keepdims=True) * counts, out=np.zeros_like(counts), where=there)


def fit_linear(
    rows: DataFrame,
    scaling: Scaling,
    C: float = 1.0,
    weights: Mapping[int, float] | str | None = None,
    loss: str = "logistic",
    penalise_intercept: bool = True,
    tol: float = 1e-9,
    max_steps: int = 50,
    rounds: int = 200,
    whole_up_to: int = WHOLE_HESSIAN,
) -> LinearModels:
    """Fit one model per row of ``scaling`` to ``raw_rows``.

    Stops where every model's gradient has fallen to ``tol`` of its first one. Models that are there
    stay as they are while the others go on.
    """
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    rows = packed(rows)
    models, size = scaling.mean.shape[0], scaling.width + 1
    problem = Problem(scaling, C * class_weights(rows, weights, models), loss)
    penalty = np.append(np.ones(size - 1), float(penalise_intercept))

    with scans_of(rows, problem) as scan:
        theta, step, scans = _newton(problem, scan, penalty, size <= whole_up_to, tol, max_steps, rounds)
    return LinearModels(theta[:, :-1], theta[:, -1], scaling, loss, step, scans)


def _newton(
    problem: Problem, scan: Scan, penalty: np.ndarray, curved: bool, tol: float, max_steps: int, rounds: int
) -> tuple[np.ndarray, int, int]:
    """Coefficients of all models, intercepts last, the steps and the scans."""
    models, size = problem.models, len(penalty)
    theta = np.zeros((models, size))
    first, scans, step = None, 0, 0
    for step in range(max_steps + 1):
        found = scan("slopes", theta, curved)
        value, gradient, curve = found[:, 0], found[:, 1 : 1 + size], found[:, 1 + size :]
        scans += 1
        value = value + 0.5 * (theta**2 * penalty).sum(1)
        gradient = gradient + penalty * theta
        norm = np.linalg.norm(gradient, axis=1)
        first = np.maximum(norm, 1e-300) if first is None else first
        open_ = norm > tol * first
        if not open_.any() or step == max_steps:
            break
        gradient[~open_] = 0.0
        if curved:
            hessians = curve.reshape(models, size, size) + np.diag(penalty)
            d = np.stack([-np.linalg.lstsq(h, g, rcond=None)[0] for h, g in zip(hessians, gradient, strict=True)])
        else:
            diagonal = np.maximum(curve + penalty, 1e-12)
            exact = np.minimum(0.1, np.sqrt(norm / first))
            d, used = _conjugate(lambda p: scan("product", theta, p) + penalty * p, gradient, diagonal, exact, rounds)
            scans += used
        if problem.loss == "logistic":
            scans += 1
            ahead = scan("losses", theta, d)
            ahead += 0.5 * (((theta[:, None] + STEPS[:, None] * d[:, None]) ** 2) * penalty).sum(2)
            slope = (gradient * d).sum(1)
            # Near the minimum the loss no longer tells steps apart.
            slack = 1e-12 * np.abs(value)[:, None]
            good = ahead <= value[:, None] + 1e-4 * STEPS * slope[:, None] + slack
            chosen = np.where(good.any(1), STEPS[good.argmax(1)], 0.0)
        else:
            scans += 2
            own, bend = ((penalty * d * x).sum(1)[:, None] for x in (theta, d))
            chosen = _lowest(lambda at: scan("along", theta, d, at) + own + bend * at, models)
        if not (chosen * np.abs(d).max(1) > 0).any():
            break
        theta = theta + chosen[:, None] * d
    return theta, step, scans


def _lowest(slopes: Callable[[np.ndarray], np.ndarray], models: int) -> np.ndarray:
    """The steps up to 2 where a convex function is lowest, given its derivatives: two looks at a grid, then a line.

    The squared hinge bends where rows become active, so that a Newton step is often far from the lowest point.
    """
    low, high = np.zeros(models), np.full(models, 2.0)
    for _ in range(2):
        at = low[:, None] + (high - low)[:, None] * GRID
        found = slopes(at)
        after = np.where((found > 0).any(1), (found > 0).argmax(1), len(GRID) - 1)
        each, before = np.arange(models), np.maximum(after - 1, 0)
        low, high = at[each, before], at[each, after]
    down, up = found[each, before], found[each, after]
    part = np.divide(-down, up - down, out=np.zeros(models), where=up > down)
    return low + np.clip(part, 0.0, 1.0) * (high - low)


# --- scores --------------------------------------------------------------------------------------


def margins(rows: DataFrame, models: LinearModels, keep: Sequence[str]) -> DataFrame:
    """``(keep, label, fold, margins)``: what every model gives every row, as an array by model."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    names = [*keep, "_label", "_fold"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Batch.of(batch, labelled=False)
            count = len(shared.value.intercepts)
            found = np.stack([shared.value.margins(own, k) for k in range(count)], 1)
            edges = pa.array(np.arange(len(found) + 1, dtype=np.int32) * count)
            lists = pa.ListArray.from_arrays(edges, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), lists], names=[*names, "margins"])

    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    needed = rows.select(*names, "_indices", "_values")
    return needed.mapInArrow(run, f"{kinds}, margins array<double>")


def scored(margin: Column) -> dict[str, Column]:
    """``score``, the probability of class 1 by a logistic model, and ``prediction``, the class it is nearer to."""
    return {"score": 1 / (1 + F.exp(-margin)), "prediction": (margin > 0).cast("int")}


def score(rows: DataFrame, models: LinearModels, keep: Sequence[str], label: str) -> DataFrame:
    """``(keep, label, score, prediction)`` by the first model."""
    found = margins(rows, models, keep).withColumns(scored(F.get("margins", F.lit(0))))
    return found.select(*keep, F.col("_label").alias(label), "score", "prediction")


def averaged(rows: DataFrame, models: LinearModels, keep: Sequence[str], label: str) -> DataFrame:
    """``(keep, label, score)``: the mean probability over all models."""
    chances = F.transform("margins", lambda m: 1 / (1 + F.exp(-m)))
    mean = F.aggregate(chances, F.lit(0.0), lambda a, x: a + x) / F.size("margins")
    return margins(rows, models, keep).select(*keep, F.col("_label").alias(label), mean.alias("score"))


# --- folds ---------------------------------------------------------------------------------------


def fit_folds(rows: DataFrame, width: int, folds: int = 5, leaky: bool = False, **options) -> LinearModels:
    """A model for each fold, learned from the rows outside it, all in the same scans.

    Imputation and scaling are those of the model's own rows; ``leaky`` takes those of all rows instead.
    """
    if leaky:
        whole = fit_scaling(rows.withColumn("_fold", F.lit(-1)), width)
        scaling = Scaling(np.tile(whole.mean, (folds, 1)), np.tile(whole.inverse, (folds, 1)))
    else:
        rows = packed(rows)
        scaling = fit_scaling(rows, width, folds)
    return fit_linear(rows, scaling, **options)


def out_of_fold(rows: DataFrame, models: LinearModels, keep: Sequence[str], label: str) -> DataFrame:
    """``(keep, fold, label, score, prediction)``: every row by the model that has not seen it."""
    found = margins(rows, models, keep).withColumns(scored(F.get("margins", F.col("_fold"))))
    return found.select(*keep, F.col("_fold").alias("fold"), F.col("_label").alias(label), "score", "prediction")


def width_of(df: DataFrame, numeric: Sequence[str], bag: str | None = None) -> int:
    """Number of columns of ``raw_rows``."""
    first = df.select(bag).first() if bag is not None else None
    return len(numeric) + (first[0].size if first is not None else 0)


def coefficients(rows: DataFrame, models: LinearModels, names: Sequence[str]) -> DataFrame:
    """``(feature, coefficient)`` of the first model with its intercept, for the scaled columns."""
    found = [(n, float(v)) for n, v in zip(names, models.weights[0], strict=True)]
    found.append(("(intercept)", float(models.intercepts[0])))
    return rows.sparkSession.createDataFrame(found, "feature string, coefficient double")
