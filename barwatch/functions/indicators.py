"""Column expressions for price indicators over a series window."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def daily_return(w: WindowSpec, close: str = "Close") -> Column:
    """Relative change to the row before; 0 on the first row of the series."""
    change = F.col(close) / F.nullif(F.lag(close).over(w), F.lit(0.0)) - 1
    return F.when(F.col("_pos") == 0, F.when(F.col(close).isNotNull(), F.lit(0.0))).otherwise(change)


def rolling(aggregate, column: str, n: int, w: WindowSpec) -> Column:
    """Aggregate over the last ``n`` rows, null until all ``n`` have a value."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(column).over(frame) == n, aggregate(column).over(frame))


def rolling_mean(column: str, n: int, w: WindowSpec) -> Column:
    return rolling(F.avg, column, n, w)


def rolling_std(column: str, n: int, w: WindowSpec) -> Column:
    return rolling(F.stddev_samp, column, n, w)


def difference(column: str, w: WindowSpec) -> Column:
    return F.col(column) - F.lag(column).over(w)


def gain(change: str) -> Column:
    # greatest() skips nulls, so a missing change must be kept apart.
    return F.when(F.col(change).isNotNull(), F.greatest(F.col(change), F.lit(0.0)))


def loss(change: str) -> Column:
    return F.when(F.col(change).isNotNull(), F.greatest(-F.col(change), F.lit(0.0)))


def relative_strength(up: str, down: str) -> Column:
    """RSI from smoothed gains and losses: 100 without losses, null without moves."""
    u, d = F.col(up), F.col(down)
    return (
        F.when((d == 0) & (u == 0), F.lit(None).cast("double"))
        .when(d == 0, F.lit(100.0))
        .otherwise(100 - 100 / (1 + u / F.nullif(d, F.lit(0.0))))
    )
