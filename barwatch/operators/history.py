"""Queries over the run history.

Each function keeps all users apart by ``user_id``; filter first with
:func:`for_user` to serve one user's page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwatch.functions.display import day, long_date, long_time, model_label

RECENT_RUNS = 5
ACTIVITY_DAYS = 30


def for_user(runs: DataFrame, user_id: str) -> DataFrame:
    return runs.where(F.col("user_id") == user_id)


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("run_timestamp"), "run_id")


def recent_runs(runs: DataFrame, n: int = RECENT_RUNS) -> DataFrame:
    """The newest ``n`` runs of each user; Spark keeps only those of each task before the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.desc("run_timestamp"), "run_id")
    return runs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def most_used_model(runs: DataFrame) -> DataFrame:
    """Per user the model with most runs, of equals the one used first."""
    per_model = runs.groupBy("user_id", "model_used").agg(
        F.count("*").alias("uses"), F.min("run_timestamp").alias("first_use")
    )
    rank = F.struct(F.col("uses"), -F.unix_micros("first_use"))
    return per_model.groupBy("user_id").agg(F.max_by("model_used", rank).alias("most_used_model"))


def dashboard_summary(runs: DataFrame) -> DataFrame:
    """Per user: runs, anomalies, favourite model and last run, in one aggregation.

    Counting per model first shrinks a busy user to a few rows before the
    users' totals are formed.
    """
    found = F.coalesce(F.col("summary.anomalies_found"), F.lit(0))
    per_model = runs.groupBy("user_id", "model_used").agg(
        F.count("*").alias("uses"),
        F.sum(found).alias("found"),
        F.min("run_timestamp").alias("first_use"),
        F.max("run_timestamp").alias("last_use"),
    )
    rank = F.struct(F.col("uses"), -F.unix_micros("first_use"))
    return per_model.groupBy("user_id").agg(
        F.sum("uses").alias("total_analyses"),
        F.sum("found").alias("total_anomalies"),
        model_label(F.max_by("model_used", rank)).alias("most_used_model"),
        F.max("last_use").alias("last_analysis_date"),
    )


def user_summary(runs: DataFrame, user_id: str) -> DataFrame:
    """One row for one user, also without any run."""
    own = dashboard_summary(for_user(runs, user_id)).agg(
        F.coalesce(F.max("total_analyses"), F.lit(0)).alias("total_analyses"),
        F.coalesce(F.max("total_anomalies"), F.lit(0)).alias("total_anomalies"),
        F.coalesce(F.max("most_used_model"), F.lit("N/A")).alias("most_used_model"),
        F.max("last_analysis_date").alias("last_analysis_date"),
    )
    return own.select(F.lit(user_id).alias("user_id"), "*")


def daily_activity(runs: DataFrame, as_of: Column | None = None, days: int = ACTIVITY_DAYS) -> DataFrame:
    """Runs per user and day over the last days, oldest first."""
    as_of = F.current_timestamp() if as_of is None else as_of
    recent = runs.where(F.col("run_timestamp") >= as_of - F.make_dt_interval(F.lit(days)))
    return recent.groupBy("user_id", day(F.col("run_timestamp")).alias("day")).agg(F.count("*").alias("runs")).orderBy(
        "user_id", "day"
    )


def display(runs: DataFrame) -> DataFrame:
    """The history as its page shows it."""
    return runs.select(
        "run_id",
        long_time(F.col("run_timestamp")).alias("run_time"),
        long_date(F.col("run_timestamp")).alias("run_date"),
        F.coalesce("stock_symbol", F.lit("N/A")).alias("stock_symbol"),
        "original_filename",
        model_label(F.col("model_used")).alias("model"),
        F.coalesce(F.col("summary.anomalies_found"), F.lit(0)).alias("anomalies_found"),
        "results_filename",
    )
