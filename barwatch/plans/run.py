"""One call from price files to a stored result, its history row and its reports."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from barwatch.functions.checks import parse_symbol
from barwatch.operators.report import run_summary
from barwatch.operators.score import DEFAULT_SIGMAS, anomalies
from barwatch.plans.detect import Model, fit_and_score, read_model
from barwatch.sources.prices import repeated_dates, scan_prices
from barwatch.sources.results import append_history, history_record, json_records, result_file_name, write_result


@dataclass(frozen=True)
class Run:
    """The stored result and model read back, a summary, all rows and the anomalies as JSON, and dates that a symbol has twice.

    ``model`` has the centres and thresholds and scores other prices; None where no row was complete.
    """

    run_id: str
    path: str
    scored: DataFrame
    summary: DataFrame
    records: DataFrame
    anomaly_records: DataFrame
    repeated: DataFrame
    model: Model | None


def run_from_csv(
    spark: SparkSession,
    csv_path: str,
    results_folder: str,
    history_path: str,
    user_id: str,
    model: str = "kmeans",
    k_sigma: float = DEFAULT_SIGMAS,
    symbol: str | None = None,
    by: str | None = None,
    at: datetime | None = None,
    intraday: bool = False,
) -> Run:
    """Scan, score, store, record and report; a failure to record does not undo the result.

    ``intraday`` is for files with times of day; the JSON records name the day, as for others.
    """
    at = at or datetime.now()
    run_id, name = uuid.uuid4().hex, result_file_name(at, model).removesuffix(".csv")
    prices = scan_prices(spark, csv_path, symbol, intraday=intraday)
    path = f"{results_folder.rstrip('/')}/{name}-{run_id}"
    fitted, scored = fit_and_score(prices, model, k_sigma, by)
    schema = scored.schema
    write_result(scored, path)
    if fitted:
        fitted.write(f"{path}-model")
        fitted = read_model(spark, f"{path}-model")
    # Named as it was scored, since a folder of numbers would be read as numbers.
    scored = spark.read.schema(schema).parquet(path).select(*schema.names)
    origin = csv_path.rstrip("/").rsplit("/", 1)[-1]
    append_history(history_record(scored, run_id, user_id, at, origin, parse_symbol(symbol), model, k_sigma, path), history_path)
    return Run(run_id, path, scored, run_summary(scored), json_records(scored), json_records(anomalies(scored)), repeated_dates(prices), fitted)
