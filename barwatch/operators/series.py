"""Laying out price series so that windows stay bounded.

An ordinary symbol is one window partition.  A symbol with more rows than one
task should hold is cut into equal chunks by its position, and each chunk also
gets the rows just before it (the halo), enough for every frame and for
exponentially weighted state to be exact to the last bit that a double keeps.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barwatch.schema import OHLCV, SYMBOL
from barwatch.session import join_parameters, materialize

# A series up to this long is one window partition (a sort of about 100 MB).
SERIES_ROWS = 1_000_000
CHUNK_ROWS = 262_144
HALO_ROWS = 4_096


@dataclass(frozen=True)
class Series:
    """Rows with ``_pos`` (0-based place in the symbol) and the window keys."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    gapless: bool = False  # known to have no null Close
    still_halo: bool = False  # the later half of some halo may show no change of Close

    @property
    def chunked(self) -> bool:
        return "_chunk" in self.keys

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def with_rows(self, rows: DataFrame) -> Series:
        return replace(self, rows=rows)

    def result(self) -> DataFrame:
        """Each input row once: halo copies removed."""
        if not self.chunked:
            return self.rows
        return self.rows.where(~F.col("_halo")).drop("_chunk", "_halo", "_early")


def total_order(df: DataFrame) -> list[str]:
    """Date first, then every price column, so that only exact copies tie."""
    return [c for c in OHLCV if c in df.columns]


def survey_series(df: DataFrame) -> tuple[int, bool]:
    """Rows of the longest series, and whether every row has a Close."""
    per_symbol = df.groupBy(SYMBOL).agg(F.count("*").alias("n"), F.count("Close").alias("seen"))
    longest, nulls = per_symbol.agg(F.max("n"), F.sum(F.col("n") - F.col("seen"))).first()
    return longest or 0, not nulls


def lay_out(
    df: DataFrame,
    order: list[str] | None = None,
    bounded: bool = False,
    gapless: bool = False,
    series_rows: int = SERIES_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    halo_rows: int = HALO_ROWS,
) -> Series:
    """Choose the layout by the longest series, from one count per symbol.

    ``bounded=True`` says the caller knows each series is short (one row per
    symbol and day, as an aggregate by both guarantees) and skips the count;
    ``gapless=True`` then also promises that no Close is null.
    """
    order = order or total_order(df)
    longest = 0
    if not bounded:
        longest, gapless = survey_series(df)
    if longest <= series_rows:
        w = Window.partitionBy(SYMBOL).orderBy(*order)
        rows = df.withColumn("_pos", F.row_number().over(w).cast("long") - 1)
        return Series(rows, (SYMBOL,), tuple(order), gapless)
    return _chunk(df, order, gapless, chunk_rows, halo_rows)


def _chunk(df: DataFrame, order: list[str], gapless: bool, chunk_rows: int, halo_rows: int) -> Series:
    if chunk_rows < halo_rows or chunk_rows % halo_rows:
        raise ValueError("chunk_rows must be a multiple of halo_rows")
    # A range sort splits any symbol over as many tasks as it needs; the ids
    # it gets there are consecutive within a task, so the place in the series
    # follows from the row counts of the tasks before it.  Exact copies of a
    # row are interchangeable; the written number lets them split as well, and
    # a task that runs again sorts the same rows.
    numbered = materialize(df.withColumn("_copy", F.monotonically_increasing_id()), "numbered")
    ordered = numbered.orderBy(SYMBOL, *order, "_copy").drop("_copy")
    ordered = ordered.withColumn("_id", F.monotonically_increasing_id())
    ordered = materialize(ordered, "ordered").withColumn("_run", F.shiftright("_id", 33))
    before = Window.partitionBy(SYMBOL).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        ordered.groupBy(SYMBOL, "_run")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    placed = join_parameters(ordered, runs, [SYMBOL, "_run"]).withColumn(
        "_pos", F.col("_id") - F.col("_first") + F.col("_offset")
    )
    in_tail = F.pmod("_pos", F.lit(chunk_rows)) >= chunk_rows - halo_rows
    copies = F.when(in_tail, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
    rows = (
        placed.withColumn("_own", F.floor(F.col("_pos") / chunk_rows))
        .withColumn("_chunk", F.explode(copies))
        .withColumn("_halo", F.col("_chunk") > F.col("_own"))
        .withColumn("_early", F.col("_halo") & (F.pmod("_pos", F.lit(chunk_rows)) < chunk_rows - halo_rows // 2))
        .drop("_own", "_id", "_run", "_first", "_offset")
    )
    # Without nulls, two values of Close mean a change.
    still = (
        rows.where("_halo and not _early")
        .groupBy(SYMBOL, "_chunk")
        .agg(F.coalesce(F.max("Close") == F.min("Close"), F.lit(True)).alias("still"))
        .where("still")
    )
    return Series(rows, (SYMBOL, "_chunk"), ("_pos",), gapless, not gapless or not still.isEmpty())


def fill_forward(series: Series, columns: list[str]) -> Series:
    """Replace nulls by the last earlier value of the symbol, if there is one."""
    upto = series.window().rowsBetween(Window.unboundedPreceding, 0)
    rows = series.rows.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})
    if not series.still_halo:
        return series.with_rows(rows)
    # A run of nulls longer than a halo: take the value the chunks before it
    # ended with, from a table of one row per chunk.
    rows = materialize(rows, "filled")
    earlier = Window.partitionBy(SYMBOL).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where(~F.col("_halo")).groupBy(SYMBOL, "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(c) for c in columns]
    )
    carried = ends.select(
        SYMBOL, "_chunk", *[F.last(c, ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in columns]
    )
    rows = join_parameters(rows, carried, [SYMBOL, "_chunk"], "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.col(f"_carry_{c}")) for c in columns})
    return series.with_rows(rows.drop(*[f"_carry_{c}" for c in columns]))
