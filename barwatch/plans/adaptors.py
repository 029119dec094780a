"""Price and run-history views of the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwatch.schema import OHLCV, SYMBOL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_bars(trades: DataFrame, symbol: str, date, price: str, tie_break) -> DataFrame:
    """One OHLCV bar per symbol and period; partial sums shrink hot symbols."""
    return (
        trades.groupBy(F.col(symbol).alias(SYMBOL), date.alias("Date"))
        .agg(
            F.max_by(price, tie_break).alias("Close"),
            F.max(price).alias("High"),
            F.min(price).alias("Low"),
            F.min_by(price, tie_break).alias("Open"),
            F.count("*").alias("Volume"),
        )
        .select(SYMBOL, *OHLCV)
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals, one series per order priority."""
    orders = table(spark, sf_dir, "orders")
    return to_bars(orders, "o_orderpriority", F.col("o_orderdate").cast("date"), "o_totalprice", F.col("o_orderkey"))


def bars_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of line prices, one series per brand.

    Every part key occurs once in ``part``; the join side is chosen by Spark
    from its size at run time.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_shipdate").cast("date").alias("day")
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    # The keys are not unique, so the price itself settles the remaining ties.
    tie_break = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return to_bars(lines.join(parts, "l_partkey"), "p_brand", F.col("day"), "l_extendedprice", tie_break)


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values, one series per event type."""
    events = table(spark, sf_dir, "events")
    return to_bars(events, "event_type", F.date_trunc("hour", "ts"), "value", F.col("ts"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as its own price row: three series that grow with the data."""
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias(SYMBOL),
        F.col("l_shipdate").cast("date").alias("Date"),
        price.alias("Close"),
        (price * (1 + F.col("l_tax"))).alias("High"),
        (price * (1 - F.col("l_discount"))).alias("Low"),
        (price / F.col("l_quantity")).alias("Open"),
        F.col("l_orderkey").alias("Volume"),
    )


def still_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks whose price is cut at 1,050: it stands still for hundreds of rows, until one of the few lower ones."""
    return ticks(spark, sf_dir).withColumn("Close", F.least("Close", F.lit(1050.0)))


def holed_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of which every seventh order has no price."""
    return ticks(spark, sf_dir).withColumn("Close", F.when(F.col("Volume") % 7 != 0, F.col("Close")))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as analysis runs in the shape of the history table."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("run_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").cast("timestamp").alias("run_timestamp"),
        F.concat(F.lit("upload_"), F.col("event_id").cast("string"), F.lit(".csv")).alias("original_filename"),
        # Every seventh record lacks a symbol, every fifth an anomaly count.
        F.when(F.col("event_id") % 7 != 0, F.upper("event_type")).alias("stock_symbol"),
        F.col("event_type").alias("model_used"),
        F.struct(F.lit(3.0).alias("threshold_multiplier")).alias("parameters"),
        F.struct(
            F.lit(100).cast("bigint").alias("rows_processed"),
            F.when(F.col("event_id") % 5 != 0, F.floor("value").cast("bigint")).alias("anomalies_found"),
        ).alias("summary"),
        F.concat(F.col("event_id").cast("string"), F.lit("_results.csv")).alias("results_filename"),
    )
