"""The indicator table: returns, rolling means and volatility, RSI, MACD."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwatch.functions import indicators as ind
from barwatch.operators.ewm import alpha_from, ewm_means, levels_for, with_blocks
from barwatch.operators.series import Series, fill_forward, lay_out
from barwatch.schema import INDICATORS, OHLCV, SYMBOL

# The periods that name the indicators.
RSI_COM = 13
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9

_SMOOTHING = levels_for(
    [alpha_from(com=RSI_COM), alpha_from(span=MACD_FAST), alpha_from(span=MACD_SLOW), alpha_from(span=MACD_SIGNAL)]
)


def rolling_features(series: Series) -> Series:
    """Return, MA_7, MA_30, Vol_14 and the daily change, over one sort."""
    w = series.window()
    rows = series.rows.withColumns(
        {
            "Return": ind.daily_return(w),
            "MA_7": ind.rolling_mean("Close", 7, w),
            "MA_30": ind.rolling_mean("Close", 30, w),
            "_change": ind.difference("Close", w),
        }
    )
    rows = rows.withColumn("Vol_14", ind.rolling_std("Return", 14, w))
    return series.with_rows(rows)


def add_rsi_and_macd(series: Series) -> Series:
    """RSI_14, MACD and MACD_Signal; needs ``_change``."""
    rows = series.rows.withColumns({"_up": ind.gain("_change"), "_down": ind.loss("_change")})
    series = with_blocks(series.with_rows(rows), _SMOOTHING)
    com = alpha_from(com=RSI_COM)
    series = ewm_means(series, {"_ema_up": ("_up", com), "_ema_down": ("_down", com)}, first_rows=1)
    series = ewm_means(
        series,
        {"_fast": ("Close", alpha_from(span=MACD_FAST)), "_slow": ("Close", alpha_from(span=MACD_SLOW))},
    )
    # While a price stands still, gains and losses fade alike and their ratio
    # keeps.  So RSI is taken where the price moves, where the newest term
    # dwarfs all that the blocks cut off, and stands until the next move.  The
    # early half of a halo has too little before it.
    moved = (F.col("_change") != 0) & (~F.col("_early") if series.chunked else F.lit(True))
    rows = series.rows.withColumns(
        {
            "RSI_14": F.when(moved, ind.relative_strength("_ema_up", "_ema_down")),
            "MACD": F.col("_fast") - F.col("_slow"),
        }
    )
    series = ewm_means(series.with_rows(rows), {"MACD_Signal": ("MACD", alpha_from(span=MACD_SIGNAL))})
    series = fill_forward(series, ["RSI_14"])
    return series.with_rows(series.rows.drop("_change", "_up", "_down", "_ema_up", "_ema_down", "_fast", "_slow"))


def engineer_features(prices: DataFrame, keep_position: bool = False, **layout) -> DataFrame:
    """All seven indicators per symbol, without the rows that lack any value.

    The first 29 rows of a symbol go, since MA_30 needs 30.  ``layout`` takes
    the arguments of :func:`barwatch.operators.series.lay_out`.
    """
    prices = with_symbol(prices).select(SYMBOL, *OHLCV)
    series = add_rsi_and_macd(rolling_features(lay_out(prices, **layout)))
    position = ["_pos"] if keep_position else []
    return series.result().select(SYMBOL, *OHLCV, *INDICATORS, *position).dropna("any")


def with_symbol(prices: DataFrame) -> DataFrame:
    """A table without symbols is one series."""
    return prices if SYMBOL in prices.columns else prices.withColumn(SYMBOL, F.lit("UNKNOWN"))
