"""Column lists and table schemas shared by every operator."""

from pyspark.sql import types as T

SYMBOL = "symbol"

# The input header, in the order the contract demands.
OHLCV = ["Date", "Close", "High", "Low", "Open", "Volume"]

# The indicators, and the feature order that pruning walks.
INDICATORS = ["Return", "MA_7", "MA_30", "Vol_14", "RSI_14", "MACD", "MACD_Signal"]
FEATURES = ["Close", "High", "Low", "Open", "Volume", *INDICATORS]

# Model names and the columns of the JSON result.
MODELS = ["kmeans", "gmm", "isolation_forest", "svm"]
VISUAL_COLUMNS = ["Date", "Close", "High", "Low", "Open", "Volume", "cluster", "distance"]
COMPARED_FEATURES = ["Return", "Volume", "Vol_14", "RSI_14"]

PRICE_SCHEMA = T.StructType(
    [
        T.StructField("Date", T.DateType()),
        T.StructField("Close", T.DoubleType()),
        T.StructField("High", T.DoubleType()),
        T.StructField("Low", T.DoubleType()),
        T.StructField("Open", T.DoubleType()),
        T.StructField("Volume", T.LongType()),
    ]
)

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("run_timestamp", T.TimestampType()),
        T.StructField("original_filename", T.StringType()),
        T.StructField("stock_symbol", T.StringType()),
        T.StructField("model_used", T.StringType()),
        T.StructField(
            "parameters", T.StructType([T.StructField("threshold_multiplier", T.DoubleType())])
        ),
        T.StructField(
            "summary",
            T.StructType(
                [
                    T.StructField("rows_processed", T.LongType()),
                    T.StructField("anomalies_found", T.LongType()),
                ]
            ),
        ),
        T.StructField("results_filename", T.StringType()),
    ]
)
