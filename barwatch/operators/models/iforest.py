"""Isolation forest (Liu, Ting and Zhou 2008).

Each tree grows on a few hundred rows drawn by hash, in its own task; every
row is then scored against the whole forest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from barwatch.operators.models.grouped import score_groups, to_matrix, unit_hash
from barwatch.session import materialize, ship_package

# Trees, rows per tree, seed, and the constant of the harmonic number.
TREES, TREE_ROWS, SEED = 100, 256, 42
EULER_GAMMA = 0.5772156649015329

# A tree draws this much more than it needs, so that falling short is a 6-sigma event.
_SURPLUS = 1.5

_TREE_SCHEMA = (
    "tree int, feature array<int>, split array<double>, below array<int>, above array<int>, path array<double>, "
    "drawn int"
)


def mean_path(n) -> np.ndarray:
    """Average depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    many = 2.0 * (np.log(np.maximum(n - 1, 1)) + EULER_GAMMA) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


def tree_samples(points: DataFrame, group: str, trees: int, tree_rows: int, seed: int) -> DataFrame:
    """``tree_rows`` distinct rows per group and tree (all rows of a smaller group)."""
    n = F.col("group_rows")
    # A large group first draws what all trees need together; each of those
    # rows then goes to one tree on average.
    needed = _SURPLUS * trees * tree_rows
    pool = points.where(unit_hash("symbol", "_pos", seed=seed) < needed / n)
    chance = _SURPLUS * tree_rows / F.least(n, F.lit(needed))
    picked = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: unit_hash("symbol", "_pos", t, seed=seed + 1) < chance
    )
    drawn = pool.select(group, "symbol", "_pos", "features", F.explode(picked).alias("tree"))
    w = Window.partitionBy(group, "tree").orderBy(unit_hash("symbol", "_pos", "tree", seed=seed + 2), "symbol", "_pos")
    return drawn.withColumn("_draw", F.row_number().over(w)).where(F.col("_draw") <= tree_rows)


def grow(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """Split at random until rows are alone, alike, or as deep as a balanced tree."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes = {"feature": [], "split": [], "below": [], "above": [], "path": []}
    waiting = [(x, 0, None, None)]
    while waiting:
        part, depth, parent, side = waiting.pop()
        node = len(nodes["path"])
        if parent is not None:
            nodes[side][parent] = node
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        leaf = depth >= limit or len(part) <= 1 or not len(varied)
        f = -1 if leaf else int(rng.choice(varied))
        cut = 0.0 if leaf else float(rng.uniform(low[f], high[f]))
        # A leaf points to itself, so that scoring may take a fixed number of steps.
        for name, value in zip(nodes, (f, cut, node, node, float(depth + mean_path(len(part))))):
            nodes[name].append(value)
        if not leaf:
            goes_below = part[:, f] <= cut
            waiting += [(part[~goes_below], depth + 1, node, "above"), (part[goes_below], depth + 1, node, "below")]
    return nodes


def fit(points: DataFrame, by: str | None, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> DataFrame:
    """One row per group and tree, nodes as arrays; without ``by`` one forest over all rows."""
    if not by:
        return fit(points.withColumn("_all", F.lit("all")), "_all", trees, tree_rows, seed).drop("_all")
    group = by

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.sort_values("_draw")["features"])
        nodes = grow(x, np.random.default_rng([seed, int(key[1])]))
        return pd.DataFrame(
            {group: [key[0]], "tree": [int(key[1])], **{name: [v] for name, v in nodes.items()}, "drawn": [len(x)]}
        )

    ship_package(points.sparkSession)
    samples = tree_samples(points, group, trees, tree_rows, seed)
    return materialize(samples.groupBy(group, "tree").applyInPandas(build, f"{group} string, {_TREE_SCHEMA}"), "models")


def forest_score(x: np.ndarray, forest: list[dict]) -> np.ndarray:
    """Close to 1 where few splits isolate a row, below 0.5 where many do."""
    depth = np.zeros(len(x))
    at = np.arange(len(x))
    # In a fixed order, so that sums agree to the last bit.
    for tree in sorted(forest, key=lambda t: t["tree"]):
        feature, split = np.array(tree["feature"]), np.array(tree["split"])
        below, above = np.array(tree["below"]), np.array(tree["above"])
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(int(np.ceil(np.log2(max(tree["drawn"], 2))))):
            node = np.where(x[at, feature[node]] <= split[node], below[node], above[node])
        depth += np.array(tree["path"])[node]
    drawn = mean_path(forest[0]["drawn"])
    return 2.0 ** (-depth / len(forest) / max(drawn, 1e-12))


def score(rows: DataFrame, params: DataFrame, by: str | None) -> DataFrame:
    """Add ``distance``, the isolation score under the trees of :func:`fit`."""
    if by:
        return score_groups(rows, params, by, lambda x, own: {"distance": forest_score(x, own)}, "distance double")
    # At most 100 trees of 511 nodes, whatever the data: small enough to ship.
    shared = rows.sparkSession.sparkContext.broadcast([tree.asDict() for tree in params.collect()])

    @F.arrow_udf("double")
    def isolation(features: pa.Array) -> pa.Array:
        return pa.array(forest_score(to_matrix(features), shared.value))

    return rows.withColumn("distance", isolation("features"))
