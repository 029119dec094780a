"""The numbers behind the result page: summary, charts, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwatch.functions.display import cluster_label
from barwatch.schema import COMPARED_FEATURES


def run_summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, anomalies and distinct clusters (0 where the model has none)."""
    clusters = F.count_distinct("cluster") if "cluster" in scored.columns else F.lit(0).cast("bigint")
    return scored.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum("is_anomaly"), F.lit(0)).alias("anomalies"),
        clusters.alias("clusters"),
    )


def anomaly_distribution(scored: DataFrame) -> DataFrame:
    found = scored.where(F.col("is_anomaly") == 1)
    counts = found.groupBy("cluster").agg(F.count("*").alias("anomalies"))
    return counts.select(cluster_label(F.col("cluster")).alias("cluster_label"), "anomalies")


def price_overlay(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The price line and, where a row is anomalous, its mark."""
    mark = F.when(F.col("is_anomaly") == 1, F.col("Close"))
    return scored.select(*keys, "Date", "Close", mark.alias("anomaly_close"))


def distance_series(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.select(*keys, "Date", "distance", "threshold")


def volume_direction(prices: DataFrame, keys: list[str]) -> DataFrame:
    direction = F.when(F.col("Close") >= F.col("Open"), "up").otherwise("down")
    return prices.select(*keys, "Date", "Volume", direction.alias("direction"))


def feature_comparison(scored: DataFrame, features: list[str] = COMPARED_FEATURES) -> DataFrame:
    """Mean size of each feature over all rows and over the anomalous ones."""
    size = {c: F.abs(F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))) for c in features}
    odd = F.col("is_anomaly") == 1
    sums = scored.agg(
        *[F.avg(size[c]).alias(f"all_{c}") for c in features],
        *[F.avg(F.when(odd, size[c])).alias(f"odd_{c}") for c in features],
    )
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"all_{c}").alias("normal"), F.col(f"odd_{c}").alias("anomaly")) for c in features]
    return sums.select(F.inline(F.array(*rows)))


def feature_comparison_normalised(scored: DataFrame, features: list[str] = COMPARED_FEATURES) -> DataFrame:
    """The comparison, divided by its single largest value."""
    compared = feature_comparison(scored, features)
    # One window over as many rows as there are features.
    largest = F.nullif(F.max(F.greatest("normal", "anomaly")).over(Window.partitionBy(F.lit(0))), F.lit(0.0))
    return compared.select("feature", (F.col("normal") / largest).alias("normal"), (F.col("anomaly") / largest).alias("anomaly"))
