"""Scores, thresholds and flags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwatch.session import join_parameters, materialize

# The default multiple of the deviation, and the share of rows
# the isolation forest and the one-class SVM call anomalous.
DEFAULT_SIGMAS = 3.0
CONTAMINATION = 0.05

# A group of values this large may be ranked by one window task.
RANKED_ROWS = 500_000
# Resolution of the sketches that narrow a quantile down.
_STEPS = 1_000


def squared_distance(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def nearest_centre(features: Column, centres: Column) -> Column:
    """0-based index of the closest centre; the first of equals."""
    distances = F.transform(centres, lambda c: squared_distance(features, c))
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def distance_to_centre(features: Column, centres: Column, cluster: Column) -> Column:
    return F.sqrt(squared_distance(features, F.get(centres, cluster)))


def ambiguity(max_posterior: Column) -> Column:
    """Mixture score: high where no component clearly owns the row."""
    return -F.log(max_posterior + F.lit(1e-9))


def score_stats(scored: DataFrame, by: list[str], score: str = "distance") -> DataFrame:
    """Mean and sample deviation over all rows, anomalies included."""
    return scored.groupBy(*by).agg(F.avg(score).alias("mean_score"), F.stddev_samp(score).alias("std_score"))


def adaptive_threshold(
    scored: DataFrame, by: list[str], k_sigma: float = DEFAULT_SIGMAS, score: str = "distance"
) -> DataFrame:
    """``mean + k * deviation`` per group; null for a group of one row."""
    stats = score_stats(scored, by, score)
    return stats.select(*by, (F.col("mean_score") + k_sigma * F.col("std_score")).alias("threshold"))


def flag(scored: DataFrame, thresholds: DataFrame, by: list[str], score: str = "distance") -> DataFrame:
    """Add ``threshold`` and ``is_anomaly`` (strictly above; never with a null threshold)."""
    if by:
        joined = join_parameters(scored, thresholds, by)
    else:
        joined = scored.withColumn("threshold", thresholds.select("threshold").scalar())
    above = F.coalesce(F.col(score) > F.col("threshold"), F.lit(False))
    return joined.withColumn("is_anomaly", above.cast("int"))


def anomalies(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col("is_anomaly") == 1)


def normals(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col("is_anomaly") == 0)


def exact_quantile(
    values: DataFrame, p: float, by: list[str], column: str = "distance", ranked_rows: int = RANKED_ROWS
) -> DataFrame:
    """Per group, the ``p`` quantile with linear interpolation, as ``cut``.

    A large group is narrowed first: quantile sketches, which merge on the map
    side, bound the two order statistics from both sides until few enough
    values lie between to rank them.  A group is done when its own count no longer
    falls, as where copies fill its bounds; the others go on.  Equal values
    collapse into one row with a count, so copies cannot swell the ranking
    either, and where a group has still more values than one task should rank,
    they are sorted by range over many.
    """
    values = values.select(*by, F.col(column).alias("v"))
    sizes = values.groupBy(*by).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    target = p * (F.col("n") - 1)
    bounds = sizes.select(
        *by,
        "n",
        "lo",
        "hi",
        F.lit(0).cast("long").alias("below"),
        F.col("n").alias("inside"),
        F.floor(target).alias("rank"),
        (target - F.floor(target)).alias("part"),
        F.lit(None).cast("long").alias("was"),
    )
    bounds = materialize(bounds, "bounds")
    grid = [i / _STEPS for i in range(_STEPS + 1)]
    large = F.col("inside") > ranked_rows
    while True:
        falls = F.col("was").isNull() | (F.col("inside") <= 0.9 * F.col("was"))
        open_ = F.coalesce(large & (F.col("lo") < F.col("hi")) & falls, F.lit(False))
        wide = bounds.where(open_)
        if wide.isEmpty():
            break
        sketch = _within(values, wide, by).groupBy(*by).agg(
            F.percentile_approx("v", grid, 100 * _STEPS).alias("grid"),
            *[F.first(c).alias(c) for c in ("n", "lo", "hi", "below", "inside", "rank", "part")],
        )
        # One grid step of slack on each side is 100 times the sketch's error.
        step = lambda rank: F.floor((rank - F.col("below")) / F.col("inside") * _STEPS)
        narrow = sketch.select(
            *by, "n", "rank", "part", F.col("inside").alias("was"),
            F.greatest("lo", F.get("grid", F.greatest(step(F.col("rank")) - 1, F.lit(0)).cast("int"))).alias("new_lo"),
            F.least("hi", F.get("grid", F.least(step(F.col("rank") + 1) + 2, F.lit(_STEPS)).cast("int"))).alias("new_hi"),
        )
        counted = _with_bounds(values, narrow, by).groupBy(*by).agg(
            *[F.first(c).alias(c) for c in ("n", "rank", "part", "was")],
            F.first("new_lo").alias("lo"),
            F.first("new_hi").alias("hi"),
            F.count_if(F.col("v") < F.col("new_lo")).alias("below"),
            F.count_if(F.col("v").between(F.col("new_lo"), F.col("new_hi"))).alias("inside"),
        )
        bounds = materialize(counted.select(*bounds.columns).union(bounds.where(~open_)), "bounds")
    tallies = _within(values, bounds, by).groupBy(*by, "v").agg(F.count("*").alias("copies"))
    if bounds.where(large).isEmpty():
        reach = _reach(_with_bounds(tallies, bounds, by).withColumn("before", F.col("below")), by)
    else:
        reach = _ranked(tallies, bounds, by, ranked_rows)
    ends = reach.groupBy(*by).agg(
        F.min(F.when(F.col("reach") > F.col("rank"), F.col("v"))).alias("v0"),
        F.min(F.when(F.col("reach") > F.col("rank") + 1, F.col("v"))).alias("v1"),
        F.first("part").alias("part"),
    )
    # At the maximum there is no next value, and nothing to interpolate.
    return ends.select(*by, (F.col("v0") + F.col("part") * (F.coalesce("v1", "v0") - F.col("v0"))).alias("cut"))


def _reach(tallies: DataFrame, parts: list[str]) -> DataFrame:
    """Adds how many values of the group lie up to each one; ``before`` lie before its part."""
    upto = Window.partitionBy(*parts).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return tallies.withColumn("reach", F.col("before") + F.sum("copies").over(upto))


def _ranked(tallies: DataFrame, bounds: DataFrame, by: list[str], ranked_rows: int) -> DataFrame:
    """As :func:`_reach`, for groups of any size.

    The values are sorted by range over tasks of about half ``ranked_rows``
    and written; the sums of each task's part of a group say in which parts the
    two wanted ranks lie, and only those are ranked.
    """
    tallies = materialize(tallies, "tallies")
    tasks = max(1, -(-2 * tallies.count() // ranked_rows))
    ordered = tallies.repartitionByRange(tasks, *by, "v").withColumn("_task", F.spark_partition_id())
    ordered = materialize(ordered, "by-range")
    before = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy(*by, "_task").agg(F.sum("copies").alias("held"))
    parts = parts.withColumn("_earlier", F.coalesce(F.sum("held").over(before), F.lit(0)))
    placed = _with_bounds(parts, bounds, by).withColumn("before", F.col("below") + F.col("_earlier"))
    wanted = placed.where((F.col("before") < F.col("rank") + 2) & (F.col("before") + F.col("held") > F.col("rank")))
    wanted = wanted.select(*by, "_task", "before", "rank", "part")
    return _reach(join_parameters(ordered, wanted, [*by, "_task"]), [*by, "_task"])


def _with_bounds(values: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    if by:
        return join_parameters(values, bounds, by)
    row = bounds.first()
    return values.withColumns({c: F.lit(row[c]) for c in bounds.columns})


def _within(values: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    return _with_bounds(values, bounds, by).where(F.col("v").between(F.col("lo"), F.col("hi")))


def contamination_cut(
    scored: DataFrame, by: list[str], share: float = CONTAMINATION, score: str = "distance", **limits
) -> DataFrame:
    """Threshold that leaves the top ``share`` of the scores strictly above it."""
    if not 0.0 < share < 1.0 or math.isnan(share):
        raise ValueError("share must lie between 0 and 1")
    cuts = exact_quantile(scored.select(*by, (-F.col(score)).alias("_low")), share, by, "_low", **limits)
    return cuts.select(*by, (-F.col("cut")).alias("threshold"))
