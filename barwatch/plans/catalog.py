"""The named queries: every operator on the whole benchmark tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwatch.functions import indicators as ind
from barwatch.functions.display import model_label
from barwatch.operators import history, report
from barwatch.operators import score as sc
from barwatch.operators import stats
from barwatch.operators.ewm import alpha_from, ewm_means, levels_for, with_blocks
from barwatch.operators.features import add_rsi_and_macd, engineer_features, rolling_features
from barwatch.operators.models import kmeans
from barwatch.operators.models.gmm import MixtureFit
from barwatch.operators.series import Series, lay_out
from barwatch.plans import adaptors as tables
from barwatch.plans.detect import Model, detect_anomalies, read_model, score_features
from barwatch.plans.run import run_from_csv
from barwatch.schema import FEATURES, INDICATORS, OHLCV, SYMBOL
from barwatch.session import join_parameters, materialize, scratch_dir
from barwatch.sources import prices as px
from barwatch.sources import results

# Centres of the fixed-centre queries, in the standardised space of FIXED_SPACE.
FIXED_SPACE = ["Return", "Vol_14", "RSI_14", "MACD"]
FIXED_CENTRES = [
    [0.0, 0.0, 0.0, 0.0],
    [1.5, 0.0, 1.0, 0.5],
    [-1.0, 0.25, -1.0, -0.5],
    [0.0, 2.0, 0.0, 1.0],
    [0.5, -1.0, 0.25, -1.0],
]
# Weights of the fixed mixture, and the deviation of each component in every direction.
FIXED_WEIGHTS = [0.4, 0.2, 0.15, 0.15, 0.1]
FIXED_SPREADS = [1.0, 0.5, 0.75, 1.5, 2.0]
AS_OF = datetime(2024, 1, 31)

# Decimals kept where engines may differ in the last bits.
PRICE_DIGITS = dict.fromkeys(
    ["Close", "High", "Low", "Open", "MA_7", "MA_30", "MACD", "MACD_Signal", "RSI_14", "change", "up", "down",
     "ewm_12", "ewm_14", "ewm_5000", "anomaly_close"], 3,
)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded doubles without negative zeros, so that results compare across engines."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            (F.round(c, PRICE_DIGITS.get(c, digits)) + 0.0).alias(c) if kinds[c] == "double" else F.col(c)
            for c in df.columns
        ]
    )


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bars(spark, sf_dir)


def _daily(spark: SparkSession, sf_dir: str) -> Series:
    """Bars have one row per symbol and day, and a price on each."""
    return lay_out(_bars(spark, sf_dir), bounded=True, gapless=True)


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engineer_features(_bars(spark, sf_dir), bounded=True, gapless=True)


def _one(spark: SparkSession, sf_dir: str, name: str, build: Callable) -> DataFrame:
    series = _daily(spark, sf_dir)
    return rounded(series.rows.select(SYMBOL, "Date", build(series.window()).alias(name)))


def _smoothed(spark: SparkSession, sf_dir: str, name: str, alpha: float, column: str = "Close") -> DataFrame:
    series = _daily(spark, sf_dir)
    first_rows = 0
    if column != "Close":
        rows = series.rows.withColumn("change", ind.difference("Close", series.window()))
        series, first_rows = series.with_rows(rows.withColumn("up", ind.gain("change"))), 1
    series = ewm_means(with_blocks(series, levels_for([alpha])), {name: (column, alpha)}, first_rows)
    return rounded(series.result().select(SYMBOL, "Date", name))


def _indicator(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    series = add_rsi_and_macd(rolling_features(_daily(spark, sf_dir)))
    return rounded(series.result().select(SYMBOL, "Date", name))


def _standard_space(featured: DataFrame) -> DataFrame:
    copies = [f"z_{c}" for c in FIXED_SPACE]
    spaced = featured.withColumns({f"z_{c}": F.col(c) for c in FIXED_SPACE})
    return stats.standardise(spaced, copies).withColumn("features", F.array(*copies)).drop(*copies)


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = materialize(_featured(spark, sf_dir), "featured")
    centres = F.array(*[F.array(*[F.lit(x) for x in c]) for c in FIXED_CENTRES])
    return kmeans.assign(_standard_space(featured), centres)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars scored by their distance to fixed centres: a whole run that SQL can repeat."""
    assigned = _assigned(spark, sf_dir)
    return sc.flag(assigned, sc.adaptive_threshold(assigned, [SYMBOL]), [SYMBOL])


def _keyed(df: DataFrame, *columns: str) -> DataFrame:
    return rounded(df.select(SYMBOL, "Date", *columns))


def volatile_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose absolute return exceeds the symbol's mean by three deviations."""
    featured = materialize(_featured(spark, sf_dir).withColumn("distance", F.abs("Return")), "returns")
    flagged = sc.flag(featured, sc.adaptive_threshold(featured, [SYMBOL]), [SYMBOL])
    return _keyed(sc.anomalies(flagged), "Close", "Return", "distance", "threshold")


def ohlcv_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    px.export_prices(_bars(spark, sf_dir), folder, by_symbol=True)
    return rounded(px.scan_prices(spark, folder))


def ohlcv_csv_intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars written as CSV and read with their times."""
    folder = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    px.export_prices(tables.bars_hourly(spark, sf_dir), folder, by_symbol=True)
    return rounded(px.scan_prices(spark, folder, intraday=True))


def normalize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    shouted = _bars(spark, sf_dir).select(
        "symbol", F.col("Date").alias("DATE"), F.col("Close").alias("close"), F.col("High").alias("hIgH"),
        F.col("Low").alias("ADJ LOW"), F.col("Volume").alias("MA_7"),
    )
    return px.normalise_columns(shouted)


def _text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = (
        F.when(key % 11 == 0, F.lit("not a date"))
        .when(key % 13 == 0, F.lit("1997-13-45"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    orders = tables.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", px.parse_date(text).alias("Date"), F.col("o_totalprice").alias("Close"))


def drop_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    volume = F.col("Volume")
    holed = _bars(spark, sf_dir).withColumns(
        {
            "Close": F.when(volume % 5 != 0, F.col("Close")),
            "High": F.when(volume % 3 == 0, F.lit(float("nan"))).otherwise(F.col("High")),
        }
    )
    return rounded(holed.dropna("any"))


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    lines = tables.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 3 == 0, F.lit("  ")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(key % 3 != 0, F.col("o_orderpriority")).alias("priority"),
    )
    return px.preview(lines, "o_orderkey")


def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = results.json_records(_scored(spark, sf_dir), [SYMBOL])
    fields = "symbol string, Date string, Close double, Volume bigint, cluster int, distance double"
    parsed = records.select(F.from_json("record", fields).alias("r")).select("r.*")
    return rounded(parsed.withColumnRenamed("Date", "day"))


def result_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows through both sinks: Parquet, and CSV with vectors as text."""
    folder = f"{scratch_dir(spark)}/sink-{uuid.uuid4().hex}"
    scored = _scored(spark, sf_dir).withColumn("model_used", F.lit("kmeans"))
    results.write_result(scored, f"{folder}/parquet")
    stored = spark.read.schema(scored.schema).parquet(f"{folder}/parquet")
    results.write_result_csv(stored, f"{folder}/csv")
    text = spark.read.csv(f"{folder}/csv", header=True)
    vector = results.parse_vector_text(F.col("features"))
    return rounded(
        text.select(
            SYMBOL, F.col("Date").cast("date").alias("Date"), F.col("distance").cast("double").alias("distance"),
            F.col("is_anomaly").cast("int").alias("is_anomaly"), "model_used",
            F.size(vector).alias("width"), vector[2].alias("z_rsi"),
        ),
        5,
    )


def history_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's record appended to a history table and read back."""
    folder = f"{scratch_dir(spark)}/history-{uuid.uuid4().hex}"
    record = results.history_record(
        _scored(spark, sf_dir), "run-1", "8", AS_OF, "prices.csv", "ORDERS", "kmeans", 3.0,
        results.result_file_name(AS_OF, "kmeans"),
    )
    results.append_history(record, folder)
    return results.read_history(spark, folder).select(
        "run_id", "user_id", "run_timestamp", "original_filename", "stock_symbol", "model_used",
        "parameters.threshold_multiplier", "summary.rows_processed", "summary.anomalies_found", "results_filename",
    )


def _flat(runs: DataFrame, *extra: str) -> DataFrame:
    found = F.coalesce(F.col("summary.anomalies_found"), F.lit(0)).alias("anomalies_found")
    symbol = F.coalesce("stock_symbol", F.lit("N/A")).alias("stock_symbol")
    return runs.select("run_id", "user_id", "run_timestamp", symbol, "model_used", found, *extra)


def standardize(spark: SparkSession, sf_dir: str, ddof: int) -> DataFrame:
    featured = materialize(_featured(spark, sf_dir), "featured")
    shifted = featured.withColumn("Constant", F.lit(7.0))
    return _keyed(stats.standardise(shifted, [*INDICATORS, "Constant"], ddof=ddof), *INDICATORS, "Constant")


def select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stats.correlations(stats.with_z(materialize(_featured(spark, sf_dir), "featured"), [SYMBOL]), [SYMBOL])
    names = stats.selected_names(stats.keep_mask(F.col("corr")))
    return own.select(SYMBOL, F.explode(names).alias("feature"))


def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = stats.assemble(["Close", "Volume", "Return", "RSI_14"])
    assembled = _featured(spark, sf_dir).select(SYMBOL, "Date", vector.alias("v"))
    return rounded(assembled.select(SYMBOL, "Date", *[F.col("v")[i].alias(f"v{i}") for i in range(4)]), 3)


def _posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the fixed centres in each row, by squared distance."""
    featured = materialize(_featured(spark, sf_dir), "featured")
    weights = F.array(
        *[
            F.exp(-0.5 * sc.squared_distance(F.col("features"), F.array(*[F.lit(x) for x in c])))
            for c in FIXED_CENTRES
        ]
    )
    spaced = _standard_space(featured).withColumn("w", weights)
    total = F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x)
    return spaced.withColumn("max_prob", F.array_max(F.transform("w", lambda x: x / total)))


def contamination_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = materialize(_featured(spark, sf_dir).withColumn("distance", F.abs("Return")), "returns")
    return rounded(sc.contamination_cut(featured, [SYMBOL]))


def embedding_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's distance to the mean vector of its label."""
    vectors = tables.table(spark, sf_dir, "embeddings").withColumn(
        "features", F.col("embedding").cast("array<double>")
    )
    entries = vectors.select("label", F.posexplode("features").alias("place", "x"))
    means = entries.groupBy("label", "place").agg(F.avg("x").alias("x")).groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda e: e["x"]).alias("centre")
    )
    joined = join_parameters(vectors, means, ["label"])
    distance = F.sqrt(sc.squared_distance(F.col("features"), F.col("centre")))
    return rounded(joined.select("vec_id", "label", distance.alias("distance")))


def _detected(source: Callable, model: str, by: str | None) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detect_anomalies(source(spark, sf_dir), model, by=by, bounded=True, gapless=True)

    return query


def tick_features(spark: SparkSession, sf_dir: str, **layout) -> DataFrame:
    featured = engineer_features(tables.ticks(spark, sf_dir), keep_position=True, **layout)
    return rounded(featured.select(SYMBOL, "_pos", "Date", "Close", *INDICATORS).withColumnRenamed("_pos", "position"), 5)


def rsi_flat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = add_rsi_and_macd(rolling_features(lay_out(tables.still_ticks(spark, sf_dir)))).result()
    return rounded(rows.select(SYMBOL, F.col("_pos").alias("position"), "RSI_14"))


def ewm_slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean over 5,000 rows of series with holes, cut into chunks."""
    series = lay_out(tables.holed_ticks(spark, sf_dir), series_rows=4096, chunk_rows=8192)
    alpha = alpha_from(span=5000)
    rows = ewm_means(with_blocks(series, levels_for([alpha])), {"ewm_5000": ("Close", alpha)}).result()
    return rounded(rows.select(SYMBOL, F.col("_pos").alias("position"), "ewm_5000"))


def model_rows(spark: SparkSession, sf_dir: str, by: str | None) -> DataFrame:
    """What a model reads, an entry a row."""
    rows = stats.model_input(materialize(_featured(spark, sf_dir), "featured"), by)
    return rounded(rows.select(SYMBOL, "Date", "group_rows", F.posexplode("features").alias("place", "x")), 5)


def price_store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of dates of one symbol from a price store."""
    folder = f"{scratch_dir(spark)}/prices-{uuid.uuid4().hex}"
    px.store_prices(_bars(spark, sf_dir), folder, 10_000)
    return rounded(px.price_history(px.stored_prices(spark, folder), "1-urgent", "1996-01-01", "1998-01-01"))


def csv_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call from price files to everything it leaves: what can be counted of it."""
    folder = f"{scratch_dir(spark)}/run-{uuid.uuid4().hex}"
    px.export_prices(_bars(spark, sf_dir), f"{folder}/prices", by_symbol=True)
    done = run_from_csv(spark, f"{folder}/prices", f"{folder}/results", f"{folder}/history", "8", at=AS_OF)
    history_rows = results.read_history(spark, f"{folder}/history").select(
        "user_id", "run_timestamp", "stock_symbol", "model_used", "summary.rows_processed", F.col("summary.anomalies_found").alias("found")
    )
    counts = done.summary.select("rows", "anomalies")
    json_rows = done.records.agg(F.count(F.lit(1)).alias("json_rows"))
    centres = done.model.centres().agg(F.count(F.lit(1)).alias("centres"))
    joined = history_rows.join(counts).join(json_rows).join(centres)  # one row each
    return joined.select(
        "user_id", "run_timestamp", "stock_symbol", "model_used", "rows_processed", "json_rows", "centres",
        (F.col("found") == F.col("anomalies")).alias("counts_agree"), (F.col("rows") == F.col("rows_processed")).alias("rows_agree"),
    )


def _stored_model(spark: SparkSession, featured: DataFrame, model: str, params: DataFrame, threshold: float) -> DataFrame:
    """The rows from 1997 on, scored under a model stored with the scales of those before."""
    year = F.year("Date")
    flags = F.array(*[F.lit(c in FIXED_SPACE) for c in FEATURES])
    space = stats.feature_space(featured.where(year < 1997), SYMBOL).withColumn("keep", flags)
    folder = f"{scratch_dir(spark)}/model-{uuid.uuid4().hex}"
    Model(model, None, space, params, spark.createDataFrame([(threshold,)], "threshold double")).write(folder)
    scored = score_features(featured.where(year >= 1997), read_model(spark, folder))
    return rounded(scored.select(SYMBOL, "Date", "cluster", "distance", "threshold", "is_anomaly"), 5)


def stored_kmeans_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = materialize(_featured(spark, sf_dir), "featured")
    params = spark.createDataFrame([(FIXED_CENTRES,)], "centres array<array<double>>")
    return _stored_model(spark, featured, "kmeans", params, 2.5)


def _mixture_row() -> tuple[list[float], ...]:
    d, narrow = len(FIXED_SPACE), [[float(i == j) for j in range(len(FIXED_SPACE))] for i in range(len(FIXED_SPACE))]
    whiten = [x / s for s in FIXED_SPREADS for row in narrow for x in row]
    logs = [math.log(w) - d * math.log(s) - 0.5 * d * math.log(2 * math.pi) for w, s in zip(FIXED_WEIGHTS, FIXED_SPREADS)]
    return FIXED_WEIGHTS, [x for c in FIXED_CENTRES for x in c], whiten, logs


def stored_mixture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = materialize(_featured(spark, sf_dir), "featured").withColumn("_pos", F.monotonically_increasing_id())
    return _stored_model(spark, featured, "gmm", spark.createDataFrame([_mixture_row()], MixtureFit.fields), 0.5)


def stored_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and number of the rows of each cluster, from the centres of a model stored by symbol."""
    assigned = _assigned(spark, sf_dir).groupBy(SYMBOL, "cluster").agg(*[F.avg(F.col("features")[i]).alias(f"m{i}") for i in range(len(FIXED_SPACE))])
    centre = F.array(*[f"m{i}" for i in range(len(FIXED_SPACE))])
    params = assigned.groupBy(SYMBOL).agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", centre.alias("c")))), lambda x: x["c"]).alias("centres"))
    folder = f"{scratch_dir(spark)}/model-{uuid.uuid4().hex}"
    params = materialize(params, "centres")
    Model("kmeans", SYMBOL, params.select(SYMBOL), params, params.select(SYMBOL)).write(folder)
    centres = read_model(spark, folder).centres().select(SYMBOL, "cluster", F.posexplode("centre").alias("place", "x"))
    return rounded(centres, 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "volatile_days": volatile_days,
        # sources and sinks
        "ohlcv_csv_scan": ohlcv_csv_scan,
        "ohlcv_csv_intraday": ohlcv_csv_intraday,
        "normalize_columns": normalize_columns,
        "parse_dates": lambda s, d: _text_dates(s, d).select("o_orderkey", "Date"),
        "drop_null_dates": lambda s, d: px.drop_undated(_text_dates(s, d)),
        "drop_incomplete": drop_incomplete,
        "preview": preview,
        "price_history": lambda s, d: rounded(px.price_history(_bars(s, d), "1-urgent", "1996-01-01", "1998-01-01")),
        "price_store_range": price_store_range,
        "run_from_csv": csv_run,
        "result_sink_roundtrip": result_sink_roundtrip,
        "result_json": result_json,
        "history_record": history_record,
        # indicators
        "daily_return": lambda s, d: _one(s, d, "Return", ind.daily_return),
        "ma_7": lambda s, d: _one(s, d, "MA_7", lambda w: ind.rolling_mean("Close", 7, w)),
        "ma_30": lambda s, d: _one(s, d, "MA_30", lambda w: ind.rolling_mean("Close", 30, w)),
        "vol_14": lambda s, d: rounded(rolling_features(_daily(s, d)).rows.select(SYMBOL, "Date", "Vol_14")),
        "close_diff": lambda s, d: _one(s, d, "change", lambda w: ind.difference("Close", w)),
        "gain_loss": lambda s, d: rounded(
            rolling_features(_daily(s, d)).rows.select(
                SYMBOL, "Date", ind.gain("_change").alias("up"), ind.loss("_change").alias("down")
            )
        ),
        "ewm_span": lambda s, d: _smoothed(s, d, "ewm_12", alpha_from(span=12)),
        "ewm_com": lambda s, d: _smoothed(s, d, "ewm_14", alpha_from(com=13), "up"),
        "rsi_14": lambda s, d: _indicator(s, d, "RSI_14"),
        "rsi_flat_runs": rsi_flat_runs,
        "ewm_slow": ewm_slow,
        "macd": lambda s, d: _indicator(s, d, "MACD"),
        "macd_signal": lambda s, d: _indicator(s, d, "MACD_Signal"),
        "warmup_trim": lambda s, d: _featured(s, d).groupBy(SYMBOL).agg(
            F.count("*").alias("kept"), F.min("Date").alias("first_day"), F.max("Date").alias("last_day")
        ),
        "engineer_features": lambda s, d: rounded(_featured(s, d)),
        "engineer_features_brand": lambda s, d: rounded(
            engineer_features(tables.bars_brand(s, d), bounded=True, gapless=True)
        ),
        "engineer_features_hourly": lambda s, d: rounded(
            engineer_features(tables.bars_hourly(s, d), bounded=True, gapless=True)
        ),
        "engineer_features_ticks": tick_features,
        "engineer_features_chunked": lambda s, d: tick_features(s, d, series_rows=4096, chunk_rows=8192),
        # features
        "correlation_matrix": lambda s, d: rounded(
            stats.correlation_matrix(materialize(_featured(s, d), "featured"), [SYMBOL])
        ),
        "select_features": select_features,
        "assemble": assemble,
        "model_input": lambda s, d: model_rows(s, d, SYMBOL),
        "model_input_pooled": lambda s, d: model_rows(s, d, None),
        "standardize": lambda s, d: standardize(s, d, 1),
        "standardize_pop": lambda s, d: standardize(s, d, 0),
        # scores
        "kmeans_assign_fixed": lambda s, d: _keyed(_assigned(s, d), "cluster"),
        "distance_to_center": lambda s, d: _keyed(_assigned(s, d), "cluster", "distance"),
        "embedding_distances": embedding_distances,
        "stored_kmeans_scores": stored_kmeans_scores,
        "stored_mixture_scores": stored_mixture_scores,
        "stored_centres": stored_centres,
        "gmm_max_posterior": lambda s, d: _keyed(_posteriors(s, d), "max_prob"),
        "gmm_score": lambda s, d: _keyed(_posteriors(s, d).withColumn("score", sc.ambiguity(F.col("max_prob"))), "score"),
        "score_stats": lambda s, d: rounded(sc.score_stats(_assigned(s, d), [SYMBOL])),
        "adaptive_threshold": lambda s, d: rounded(sc.adaptive_threshold(_assigned(s, d), [SYMBOL])),
        "threshold_anomalies": lambda s, d: _keyed(sc.anomalies(_scored(s, d)), "distance", "threshold"),
        "threshold_normals": lambda s, d: _keyed(sc.normals(_scored(s, d)), "distance", "threshold"),
        "anomaly_flag": lambda s, d: _keyed(_scored(s, d), "is_anomaly"),
        "contamination_cut": contamination_cut,
        # reports
        "select_existing": lambda s, d: rounded(results.select_existing(_scored(s, d).drop("Open", "Volume"))),
        "volume_direction": lambda s, d: report.volume_direction(_bars(s, d), [SYMBOL]),
        "price_overlay": lambda s, d: rounded(report.price_overlay(_scored(s, d), [SYMBOL])),
        "distance_series": lambda s, d: rounded(report.distance_series(_scored(s, d), [SYMBOL])),
        "run_summary": lambda s, d: report.run_summary(_scored(s, d)),
        "anomaly_distribution": lambda s, d: report.anomaly_distribution(_scored(s, d)),
        "feature_comparison": lambda s, d: rounded(report.feature_comparison(_scored(s, d))),
        "feature_comparison_normalized": lambda s, d: rounded(report.feature_comparison_normalised(_scored(s, d))),
        # run history
        "history_for_user": lambda s, d: _flat(history.for_user(tables.runs(s, d), "8")),
        "history_sorted": lambda s, d: _flat(history.newest_first(tables.runs(s, d))),
        "recent_runs": lambda s, d: _flat(history.recent_runs(tables.runs(s, d)), "place"),
        "most_used_model": lambda s, d: history.most_used_model(tables.runs(s, d)),
        "user_dashboard_summary": lambda s, d: history.dashboard_summary(tables.runs(s, d)),
        "daily_activity": lambda s, d: history.daily_activity(tables.runs(s, d), F.lit(str(AS_OF)).cast("timestamp")),
        "history_display": lambda s, d: history.display(tables.runs(s, d)),
        "model_label": lambda s, d: tables.table(s, d, "events")
        .groupBy("event_type")
        .agg(F.count("*").alias("runs"))
        .select(model_label(F.concat(F.col("event_type"), F.lit("_one_class_SVM"))).alias("label"), "runs"),
    }
    for key, model in [
        ("kmeans_anomalies", "kmeans"), ("gmm_anomalies", "gmm"),
        ("isolation_forest_anomalies", "isolation_forest"), ("ocsvm_anomalies", "svm"),
    ]:
        named[key] = _detected(tables.bars, model, None)
    for model in ["kmeans", "gmm", "isolation_forest", "svm"]:
        named[f"run_{model}"] = _detected(tables.bars_hourly, model, SYMBOL)
    return named


__all__ = ["queries", "volatile_days", "FEATURES", "OHLCV"]
