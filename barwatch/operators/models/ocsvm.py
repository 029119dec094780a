"""One-class SVM with an RBF kernel (Schoelkopf et al. 2001).

The kernel is approximated by random Fourier features (Rahimi and Recht
2007), which turns the fit into a smooth linear problem: each step needs one
pass over the rows for a loss and a gradient.  An exact kernel solution needs
memory quadratic in the rows.  The pulls of the rows are a dual solution but
for their sum, so every pass also bounds how far the loss is from the least.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwatch.operators.models.grouped import Fit, State, fit_groups, score_groups, to_matrix

# Fixed value: the share of rows left outside.
NU = 0.05

FEATURE_COUNT, SEED, MAX_ITER = 1024, 42, 80
# Width over which the hinge is rounded off, relative to the starting margin.
_ROUNDING = 0.05
_MEMORY = 12
# The search ends when the loss is within this share of its least value.
_GAP = 1e-3
_CHUNK = 4096


@lru_cache(maxsize=8)
def _directions(gamma: float, width: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    directions = rng.normal(scale=np.sqrt(2.0 * gamma), size=(width, count))
    return directions, rng.uniform(0.0, 2.0 * np.pi, size=count)


def fourier_features(x: np.ndarray, gamma: float, count: int, seed: int) -> np.ndarray:
    directions, phases = _directions(gamma, x.shape[1], count, seed)
    z = x @ directions
    z += phases
    np.cos(z, out=z)
    z *= np.sqrt(2.0 / count)
    return z


class Descent:
    """Limited-memory quasi-Newton steps on (w, rho), fed one evaluation at a time; ``packed`` and ``unpacked`` carry it between passes."""

    def __init__(self, start: np.ndarray):
        self.best, self.point, self.step = start, start, 1.0
        self.value, self.slope, self.direction = np.inf, None, None
        self.past: list[tuple[np.ndarray, np.ndarray]] = []
        self.done = False

    def packed(self) -> np.ndarray:
        moving = [] if self.slope is None else [self.slope, self.direction, *(v for pair in self.past for v in pair)]
        return np.concatenate([[self.step, self.value], self.best, self.point, *moving])

    @classmethod
    def unpacked(cls, values: np.ndarray, size: int) -> Descent:
        vectors = list(values[2:].reshape(-1, size))
        found = cls(vectors[0])
        found.step, found.value, found.point = float(values[0]), float(values[1]), vectors[1]
        if len(vectors) > 2:
            found.slope, found.direction = vectors[2:4]
            found.past = list(zip(vectors[4::2], vectors[5::2]))
        return found

    def feed(self, value: float, slope: np.ndarray, near: bool) -> None:
        """Take the loss at ``point`` and choose the next point, or stop there if it is ``near`` the least."""
        enough = np.inf
        if self.direction is not None:
            enough = self.value + 1e-4 * self.step * (self.slope @ self.direction)
        if value > enough:
            self.step *= 0.4
            self.done = self.step < 1e-6
        else:
            if self.slope is not None:
                moved, bent = self.point - self.best, slope - self.slope
                if moved @ bent > 1e-12:
                    self.past = [*self.past, (moved, bent)][-_MEMORY:]
            self.best, self.value, self.slope, self.step = self.point, value, slope, 1.0
            self.done = bool(near or not slope.any())
            self.direction = -self._precondition(slope)
        self.point = self.best + self.step * self.direction

    def _precondition(self, slope: np.ndarray) -> np.ndarray:
        q, shares = slope.copy(), []
        for moved, bent in reversed(self.past):
            shares.append((moved @ q) / (moved @ bent))
            q -= shares[-1] * bent
        if self.past:
            moved, bent = self.past[-1]
            q *= (moved @ bent) / (bent @ bent)
        for (moved, bent), share in zip(self.past, reversed(shares)):
            q += (share - (bent @ q) / (moved @ bent)) * moved
        return q


class SvmFit(Fit):
    """Pass 0 sets the kernel's width, pass 1 takes the mean of all features, the others descend."""

    fields = "gamma double, w array<double>"
    # The features of these rows, kept between the passes of a task, take 128 MB.
    rows_per_task = 16_384

    def __init__(self, nu: float = NU, count: int = FEATURE_COUNT, seed: int = SEED) -> None:
        self.nu, self.count, self.seed = nu, count, seed

    def start(self, width: int) -> State:
        return State(0, np.zeros(0))

    def partial(self, state: State, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        if state.phase == 0:
            return np.array([len(x), x.size, x.sum(), (x * x).sum()], dtype=float)
        z = self._features(x, state.values[0])
        if state.phase == 1:
            return np.append(len(x), z.sum(axis=0))
        gamma, width, _, search = self._read(state)
        w, rho = search.point[:-1], search.point[-1]
        short = rho - z @ w
        pull = np.clip(short / width, 0.0, 1.0)
        loss = (pull * (short - 0.5 * width * pull)).sum()
        return np.concatenate([[len(x), loss, pull.sum(), (pull * pull).sum()], pull @ z])

    def update(self, state: State, total: np.ndarray) -> State:
        if state.phase == 0:
            rows, entries, whole, squares = total
            spread = squares / entries - (whole / entries) ** 2
            # 1 / (columns * variance over all entries)
            return State(1, np.array([rows / (entries * (spread if spread > 0 else 1.0))]))
        if state.phase == 1:
            # Start from the mean of all rows: the solution in which every row counts.
            mean = total[1:] / total[0]
            search = Descent(np.append(mean, 0.5 * (mean @ mean)))
            return State(2, np.concatenate([[state.values[0], _ROUNDING * (mean @ mean)], mean, search.packed()]))
        gamma, width, mean, search = self._read(state)
        rows, loss, pulls, squares = total[:4]
        w, rho, weight = search.point[:-1], search.point[-1], 1.0 / (self.nu * total[0])
        value = 0.5 * (w @ w) - rho + weight * loss
        bound = self._dual(rows, pulls, squares, total[4:], width, mean)
        search.feed(value, np.append(w - weight * total[4:], weight * pulls - 1.0), value - bound <= _GAP * abs(bound))
        values = np.concatenate([[gamma, width], mean, search.packed()])
        return State(state.phase + 1, values, bool(search.done or state.phase > MAX_ITER))

    def result(self, state: State) -> dict[str, object]:
        gamma, _, _, search = self._read(state)
        return {"gamma": float(gamma), "w": search.best[:-1].tolist()}

    def _dual(self, rows: float, pulls: float, squares: float, pulled: np.ndarray, width: float, mean: np.ndarray) -> float:
        """A value below the least loss: the pulls, scaled or filled up evenly until they sum to one."""
        cap = 1.0 / (self.nu * rows)
        total, squared, at = cap * pulls, cap * cap * squares, cap * pulled
        if total >= 1.0:
            squared, at = squared / total**2, at / total
        else:
            fill = (1.0 - total) / (1.0 / self.nu - total)
            squared = (1 - fill) ** 2 * squared + 2 * fill * (1 - fill) * cap * total + fill * fill * rows * cap * cap
            at = (1 - fill) * at + fill * mean / self.nu
        return float(-0.5 * (at @ at) - 0.5 * width * squared / cap)

    def _read(self, state: State) -> tuple[float, float, np.ndarray, Descent]:
        gamma, width = state.values[:2]
        mean, search = np.split(state.values[2:], [self.count])
        return gamma, width, mean, Descent.unpacked(search, self.count + 1)

    def _features(self, x: np.ndarray, gamma: float) -> np.ndarray:
        held = getattr(self, "_held", None)
        if held is None or held[0] is not x or held[1] != gamma:
            held = self._held = (x, gamma, fourier_features(x, float(gamma), self.count, self.seed))
        return held[2]


def fit(
    points: DataFrame, by: str | None, nu: float = NU, count: int = FEATURE_COUNT, seed: int = SEED, rows_per_task: int | None = None
) -> DataFrame:
    """``gamma`` and weights of one model per group, or of one over all rows."""
    if by:
        return fit_groups(points, by, SvmFit(nu, count, seed), seed, rows_per_task)
    return fit_groups(points.withColumn("_all", F.lit("all")), "_all", SvmFit(nu, count, seed), seed, rows_per_task).drop("_all")


def margin(x: np.ndarray, gamma: float, w: np.ndarray, seed: int) -> np.ndarray:
    parts = [fourier_features(x[i : i + _CHUNK], gamma, len(w), seed) @ w for i in range(0, len(x), _CHUNK)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(rows: DataFrame, params: DataFrame, by: str | None, seed: int = SEED) -> DataFrame:
    """Add ``distance``, the negative margin under the weights of :func:`fit`: high outside the learnt region."""
    if by:

        def outside(x: np.ndarray, own: list[dict]) -> dict:
            return {"distance": -margin(x, own[0]["gamma"], np.array(own[0]["w"]), seed)}

        return score_groups(rows, params, by, outside, "distance double")
    only = params.first()
    gamma, w = only["gamma"], np.array(only["w"])

    @F.arrow_udf("double")
    def outside_all(features: pa.Array) -> pa.Array:
        return pa.array(-margin(to_matrix(features), gamma, w, seed))

    return rows.withColumn("distance", outside_all("features"))
