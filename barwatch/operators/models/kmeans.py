"""KMeans: distance to the own cluster centre."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwatch.operators.models.grouped import Fit, State, fit_groups
from barwatch.operators.models.seeding import Seeding, nearest
from barwatch.operators.score import distance_to_centre, nearest_centre
from barwatch.session import join_parameters, materialize

# Clusters, seed, and the library defaults of the fit.
K, SEED, MAX_ITER, TOL = 5, 42, 20, 1e-4

FIELDS = "centres array<array<double>>"


class KMeansFit(Fit):
    """k-means|| and then Lloyd's steps, each a pass over all rows of a group."""

    fields = FIELDS

    def __init__(self, k: int = K, seed: int = SEED) -> None:
        self.k, self.seeding = k, Seeding(k, seed)

    def start(self, width: int) -> State:
        return self.seeding.start(width)

    def partial(self, state: State, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        if state.phase <= Seeding.LAST:
            return self.seeding.partial(state, x, u)
        member = np.eye(self.k)[nearest(x, self._centres(state))[0]]
        return np.concatenate([member.sum(axis=0), (member.T @ x).ravel()])

    def merge(self, phase: int, parts: list[np.ndarray]) -> np.ndarray:
        return self.seeding.merge(phase, parts) if phase <= Seeding.LAST else super().merge(phase, parts)

    def update(self, state: State, total: np.ndarray) -> State:
        if state.phase <= Seeding.LAST:
            return self.seeding.update(state, total)
        old, sizes = self._centres(state), total[: self.k, None]
        new = np.where(sizes > 0, total[self.k :].reshape(self.k, -1) / np.maximum(sizes, 1), old)
        still = (((new - old) ** 2).sum(axis=1) <= TOL**2).all()
        return State(state.phase + 1, np.append(state.values[0], new.ravel()), bool(still or state.phase >= Seeding.LAST + MAX_ITER))

    def result(self, state: State) -> dict[str, object]:
        return {"centres": self._centres(state).tolist()}

    def _centres(self, state: State) -> np.ndarray:
        return state.values[1:].reshape(self.k, -1)


def fit(points: DataFrame, by: str | None, k: int = K, seed: int = SEED, rows_per_task: int | None = None) -> DataFrame:
    """``centres`` of one model per group, or of one over all rows."""
    if by:
        return fit_groups(points, by, KMeansFit(k, seed), seed, rows_per_task)
    vectors = points.select(array_to_vector("features").alias("features"))
    model = KMeans(featuresCol="features", k=k, seed=seed).fit(vectors)
    # k vectors of at most twelve numbers.
    centres = [centre.tolist() for centre in model.clusterCenters()]
    return materialize(points.sparkSession.createDataFrame([(centres,)], FIELDS), "models")


def score(rows: DataFrame, params: DataFrame, by: str | None) -> DataFrame:
    """Add ``cluster`` and ``distance`` by the centres of :func:`fit`."""
    if by:
        rows = join_parameters(rows, params, [by], written=True)
    else:
        rows = rows.withColumn("centres", params.select("centres").scalar())
    return assign(rows, F.col("centres")).drop("centres")


def assign(rows: DataFrame, centres) -> DataFrame:
    rows = rows.withColumn("cluster", nearest_centre(F.col("features"), centres))
    return rows.withColumn("distance", distance_to_centre(F.col("features"), centres, F.col("cluster")))
