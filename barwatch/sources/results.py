"""Writing scored rows and keeping the run history."""

from __future__ import annotations

import hashlib
import logging
import uuid
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwatch.functions.display import day
from barwatch.session import one_file_each
from barwatch.schema import HISTORY_SCHEMA, SYMBOL, VISUAL_COLUMNS

log = logging.getLogger(__name__)


def result_file_name(at: datetime, model: str) -> str:
    return f"{at:%Y%m%d_%H%M%S}_{model}_results.csv"


def vector_text(vector: Column) -> Column:
    """``[a,b,...]``, which CSV can hold."""
    return F.concat(F.lit("["), F.concat_ws(",", vector.cast("array<string>")), F.lit("]"))


def parse_vector_text(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"[\[\]]", ""), ",").cast("array<double>")


def write_result(scored: DataFrame, path: str) -> None:
    """Scored rows as Parquet, a folder per symbol."""
    one_file_each(scored, SYMBOL).write.partitionBy(SYMBOL).parquet(path)


def write_result_csv(scored: DataFrame, path: str) -> None:
    scored.withColumn("features", vector_text(F.col("features"))).write.option("header", True).csv(path)


def select_existing(df: DataFrame, wanted: list[str] = VISUAL_COLUMNS) -> DataFrame:
    """The wanted columns that the table has, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def json_records(scored: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The visual columns as one JSON text per row, dates as ``yyyy-MM-dd``."""
    rows = select_existing(scored, [*(extra or []), *VISUAL_COLUMNS])
    if "Date" in rows.columns:
        rows = rows.withColumn("Date", day(F.col("Date")))
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("record"))


def history_record(
    scored: DataFrame,
    run_id: str,
    user_id: str,
    run_timestamp: datetime,
    original_filename: str,
    stock_symbol: str,
    model_used: str,
    threshold_multiplier: float,
    results_filename: str,
) -> DataFrame:
    """The history row of a run, counted from its scored rows."""
    counts = scored.agg(
        F.count("*").alias("rows_processed"), F.coalesce(F.sum("is_anomaly"), F.lit(0)).alias("anomalies_found")
    )
    return counts.select(
        F.lit(run_id).alias("run_id"),
        F.lit(user_id).alias("user_id"),
        F.lit(str(run_timestamp)).cast("timestamp").alias("run_timestamp"),
        F.lit(original_filename).alias("original_filename"),
        F.lit(stock_symbol).alias("stock_symbol"),
        F.lit(model_used).alias("model_used"),
        F.struct(F.lit(float(threshold_multiplier)).alias("threshold_multiplier")).alias("parameters"),
        F.struct("rows_processed", "anomalies_found").alias("summary"),
        F.lit(results_filename).alias("results_filename"),
    )


def append_history(record: DataFrame, path: str) -> bool:
    """Append a run's row to the history; a failure is logged and does not stop the run.

    The row is written to a staged folder, which readers do not see, and that
    folder renamed to one named by the run.  The rename does not overwrite, so a retried or
    concurrent append of one run leaves one row, and an append that dies in between leaves none.
    """
    spark = record.sparkSession
    try:
        staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
        record.select(*HISTORY_SCHEMA.names).to(HISTORY_SCHEMA).write.parquet(staged)
        runs = [row["run_id"] for row in spark.read.parquet(staged).select("run_id").limit(2).collect()]
        if len(runs) != 1 or runs[0] is None:
            raise ValueError("a history record is one row with a run_id")
        _rename(spark, staged, f"{path.rstrip('/')}/run-{hashlib.sha256(runs[0].encode()).hexdigest()[:32]}")
        return True
    except Exception:
        log.exception("no history row was written to %s", path)
        return False


def _rename(spark: SparkSession, staged: str, committed: str) -> None:
    """Make a staged folder visible in one step; where the committed one is there already, it stays and the staged one goes."""
    fs = spark._jvm.org.apache.hadoop.fs
    source, target = fs.Path(staged), fs.Path(committed)
    conf = spark._jsc.hadoopConfiguration()
    files = fs.FileContext.getFileContext(source.getFileSystem(conf).makeQualified(source).toUri(), conf)
    try:
        files.rename(source, target, spark.sparkContext._gateway.new_array(fs.Options.Rename, 0))
    except Py4JJavaError:
        if not files.util().exists(target):
            raise
        files.delete(source, True)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """One row a run; of several rows with one ``run_id`` the earliest, rows without one as they are."""
    rows = spark.read.schema(HISTORY_SCHEMA).option("recursiveFileLookup", True).parquet(path)
    ordered = ["run_timestamp", *[c for c in HISTORY_SCHEMA.names if c not in ("run_id", "run_timestamp")]]
    once = rows.where("run_id is not null").groupBy("run_id").agg(F.min(F.struct(*ordered)).alias("r")).select("run_id", "r.*")
    return once.select(*HISTORY_SCHEMA.names).union(rows.where("run_id is null")).to(HISTORY_SCHEMA)
