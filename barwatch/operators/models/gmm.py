"""Gaussian mixture: how ambiguous the assignment of a row is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwatch.operators.models.grouped import Fit, State, fit_groups, score_groups, to_matrix
from barwatch.operators.models.seeding import Seeding, nearest
from barwatch.operators.score import ambiguity
from barwatch.session import ship_package

# Components, seed, and the most passes.
K, SEED, MAX_ITER = 5, 1, 100

# The fit ends when a pass changes the mean log-likelihood of a row by less.
TOL = 1e-4
# Added to every variance, so that no component shrinks to a point.
_RIDGE = 1e-6


def _mixture(weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> dict[str, np.ndarray]:
    """Whitening matrices and log constants; directions without spread are left out."""
    values, vectors = np.linalg.eigh(covs)
    floor = np.finfo(float).eps * values.max(axis=1, keepdims=True) * values.shape[1]
    alive = values > np.maximum(floor, 1e-300)
    values = np.where(alive, values, 1.0)
    whiten = np.where(alive, values**-0.5, 0.0)[:, None, :] * vectors
    logs = np.log(np.maximum(weights, 1e-300)) - 0.5 * (
        np.log(values).sum(axis=1) + means.shape[1] * np.log(2 * np.pi)
    )
    return {"means": means, "whiten": whiten, "logs": logs}


def _log_joint(x: np.ndarray, mix: dict) -> np.ndarray:
    squares = [(((x - m) @ w) ** 2).sum(axis=1) for m, w in zip(mix["means"], mix["whiten"])]
    return mix["logs"] - 0.5 * np.stack(squares, axis=1)


def _posterior(x: np.ndarray, mix: dict) -> tuple[np.ndarray, np.ndarray]:
    joint = _log_joint(x, mix)
    top = joint.max(axis=1, keepdims=True)
    total = top + np.log(np.exp(joint - top).sum(axis=1, keepdims=True))
    return np.exp(joint - total), total


def _moments(x: np.ndarray, share: np.ndarray, total: float) -> np.ndarray:
    second = np.stack([(x * share[:, j : j + 1]).T @ x for j in range(share.shape[1])])
    return np.concatenate([[total], share.sum(axis=0), (share.T @ x).ravel(), second.ravel()])


def _from_moments(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = int((np.sqrt(1 + 4 * (len(sums) - 1 - k) / k) - 1) / 2)
    sizes = np.maximum(sums[1 : 1 + k], 1e-12)
    means = sums[1 + k : 1 + k + k * d].reshape(k, d) / sizes[:, None]
    covs = sums[1 + k + k * d :].reshape(k, d, d) / sizes[:, None, None] - means[:, :, None] * means[:, None, :]
    return sizes / sizes.sum(), means, covs


class MixtureFit(Fit):
    """Starting centres, a mixture of the rows nearest to each, then expectation maximisation until the mean stands still."""

    fields = "weights array<double>, means array<double>, whiten array<double>, logs array<double>"

    def __init__(self, k: int = K, seed: int = SEED) -> None:
        self.k, self.seeding = k, Seeding(k, seed)

    def start(self, width: int) -> State:
        return self.seeding.start(width)

    def partial(self, state: State, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        if state.phase <= Seeding.LAST:
            return self.seeding.partial(state, x, u)
        if state.phase == Seeding.LAST + 1:
            share = np.eye(self.k)[nearest(x, state.values[1:].reshape(self.k, -1))[0]]
            return np.append(len(x), _moments(x, share, 0.0))
        share, total = _posterior(x, _mixture(*self._read(state)))
        return np.append(len(x), _moments(x, share, total.sum()))

    def merge(self, phase: int, parts: list[np.ndarray]) -> np.ndarray:
        return self.seeding.merge(phase, parts) if phase <= Seeding.LAST else super().merge(phase, parts)

    def update(self, state: State, total: np.ndarray) -> State:
        if state.phase <= Seeding.LAST:
            return self.seeding.update(state, total)
        weights, means, covs = _from_moments(total[1:], self.k)
        first = state.phase == Seeding.LAST + 1
        if first:
            # A start with few rows borrows the spread that all of them have around their own centre.
            rows, d = weights * total[0], means.shape[1]
            pooled = np.tensordot(weights, covs, 1)
            covs = (rows[:, None, None] * covs + d * pooled) / (rows[:, None, None] + d)
        covs = covs + _RIDGE * np.eye(means.shape[1])
        reached = -np.inf if first else total[1] / total[0]
        settled = abs(reached - state.values[1]) < TOL if not first else False
        values = np.concatenate([[state.values[0], reached], weights, means.ravel(), covs.ravel()])
        return State(state.phase + 1, values, bool(settled or state.phase >= Seeding.LAST + 1 + MAX_ITER))

    def result(self, state: State) -> dict[str, object]:
        weights, means, covs = self._read(state)
        mix = _mixture(weights, means, covs)
        return {"weights": weights.tolist(), **{name: mix[name].ravel().tolist() for name in ("means", "whiten", "logs")}}

    def _read(self, state: State) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, d = self.k, int(state.values[0])
        weights, means, covs = np.split(state.values[2:], [k, k + k * d])
        return weights, means.reshape(k, d), covs.reshape(k, d, d)


def fit(points: DataFrame, by: str | None, k: int = K, seed: int = SEED, rows_per_task: int | None = None) -> DataFrame:
    """``weights``, ``means``, whitening matrices and log constants of one mixture per group, or of one over all rows."""
    if by:
        return fit_groups(points, by, MixtureFit(k, seed), seed, rows_per_task)
    return fit_groups(points.withColumn("_all", F.lit("all")), "_all", MixtureFit(k, seed), seed, rows_per_task).drop("_all")


def from_lists(row: dict) -> dict[str, np.ndarray]:
    """A mixture as the passes use it, from a row of :func:`fit_groups`."""
    k = len(row["logs"])
    d = len(row["means"]) // k
    return {
        "means": np.array(row["means"]).reshape(k, d),
        "whiten": np.array(row["whiten"]).reshape(k, d, d),
        "logs": np.array(row["logs"]),
    }


def assign(x: np.ndarray, mix: dict) -> dict[str, np.ndarray]:
    """The most probable component of each row and its probability."""
    share, _ = _posterior(x, mix)
    return {"cluster": share.argmax(axis=1).astype(np.int32), "max_prob": share.max(axis=1)}


def _score_group(x: np.ndarray, own: list[dict]) -> dict:
    return assign(x, from_lists(own[0]))


def score_with(rows: DataFrame, mix: dict[str, np.ndarray]) -> DataFrame:
    """Add ``cluster`` and ``max_prob`` under one mixture; the rows do not move."""
    ship_package(rows.sparkSession)

    @F.arrow_udf("struct<cluster:int,max_prob:double>")
    def assigned(features: pa.Array) -> pa.Array:
        found = assign(to_matrix(features), mix) if len(features) else {"cluster": np.empty(0, np.int32), "max_prob": np.empty(0)}
        return pa.StructArray.from_arrays([pa.array(found[n]) for n in ("cluster", "max_prob")], ["cluster", "max_prob"])

    return rows.withColumn("_found", assigned("features")).select("*", "_found.*").drop("_found")


def score(rows: DataFrame, params: DataFrame, by: str | None) -> DataFrame:
    """Add ``cluster`` and ``distance`` by the mixtures of :func:`fit`."""
    if by:
        scored = score_groups(rows, params, by, _score_group, "cluster int, max_prob double")
    else:
        scored = score_with(rows, from_lists(params.first().asDict()))
    return scored.withColumn("distance", ambiguity(F.col("max_prob"))).drop("max_prob")
