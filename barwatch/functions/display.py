"""Text and date expressions for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def model_label(model: Column) -> Column:
    """``isolation_forest`` as ``Isolation Forest``; ``N/A`` without a model."""
    return F.initcap(F.translate(F.coalesce(model, F.lit("N/A")), "_", " "))


def cluster_label(cluster: Column) -> Column:
    return F.concat(F.lit("Cluster "), cluster.cast("string"))


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def long_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM dd, yyyy")


def long_time(ts: Column) -> Column:
    return F.date_format(ts, "MMM dd, yyyy HH:mm")
