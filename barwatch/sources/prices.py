"""Reading and exporting price tables."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwatch.functions.checks import parse_symbol
from barwatch.schema import OHLCV, PRICE_SCHEMA, SYMBOL
from barwatch.session import one_file_each

_PRICES = ["Close", "High", "Low", "Open"]

# Everything is read as text or double first: a bad cell becomes null instead
# of failing the run, and its row is dropped later.
_RAW_SCHEMA = T.StructType(
    [T.StructField("Date", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in [*_PRICES, "Volume"]]]
)

PREVIEW_ROWS = 50


DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "M/d/yyyy", "d.M.yyyy", "d-MMM-yyyy", "MMM d, yyyy")


# The reader compares every file's header with the schema; without pruning, the whole of it.
_READ = {"header": True, "enforceSchema": False, "columnPruning": False}
_WRONG_HEADER = re.compile(r"(?:CSV header does not conform|Number of column in CSV header).*?CSV file: [^\n]+", re.S)


def check_headers(spark: SparkSession, files: list[str]) -> None:
    """Check that every header is the six names, in order and spelling, each in a task that reads no further than the first row.

    A session with its own settings, beside the caller's, gives each file one
    partition; every partition stops at its first row, which is what crosses
    to the one task of the limit.  The driver opens no file.
    """
    if not files:
        return
    beside = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name) or not name.startswith("spark."):
            beside.conf.set(name, value)
    for name in ("maxPartitionBytes", "openCostInBytes"):
        beside.conf.set(f"spark.sql.files.{name}", str(1 << 50))
    beside.conf.set("spark.sql.caseSensitive", "true")
    beside.conf.set("spark.sql.files.ignoreCorruptFiles", "false")
    rows = beside.read.schema(_RAW_SCHEMA).options(**_READ).csv(files)
    try:
        rows.limit(1).agg(F.max("Date")).collect()
    except (PySparkException, Py4JJavaError) as error:
        wrong = _WRONG_HEADER.search(str(error))
        if not wrong:
            raise
        raise ValueError(f"unexpected columns; price files have {OHLCV}. {wrong[0]}") from error


def scan_prices(
    spark: SparkSession, path: str, symbol: str | None = None, cut: str | None = None, formats: tuple[str, ...] = DATE_FORMATS,
    intraday: bool = False,
) -> DataFrame:
    """Price CSVs as a typed table, without rows whose date cannot be read.

    A folder, searched to any depth, may hold many symbols: as ``symbol=...``
    folders, or else each file's name without ``.csv`` is its symbol, up to the
    first ``cut`` if one is given.  ``symbol`` names them all.  The files whose
    headers are checked are the files that are read; a file of no bytes is none.  ``intraday`` keeps the
    time of day: ``Date`` is a timestamp, by which rows of one day are ordered.
    """
    return drop_undated(scan_rows(spark, path, symbol, cut, formats, intraday))


def scan_rows(
    spark: SparkSession, path: str, symbol: str | None = None, cut: str | None = None, formats: tuple[str, ...] = DATE_FORMATS,
    intraday: bool = False,
) -> DataFrame:
    """As :func:`scan_prices`, with the rows whose date is null as well."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    files = [row["path"] for row in listing.where(F.lower("path").endswith(".csv")).collect()]
    check_headers(spark, files)
    in_folders = bool(files) and all(f"/{SYMBOL}=" in file for file in files) and not path.lower().endswith(".csv")
    schema = T.StructType([*_RAW_SCHEMA, T.StructField(SYMBOL, T.StringType())]) if in_folders else _RAW_SCHEMA
    reader = spark.read.schema(schema).options(**_READ)
    if in_folders:
        reader = reader.option("basePath", path)
    raw = reader.csv(files) if files else spark.createDataFrame([], schema)
    if symbol is not None:
        raw = raw.withColumn(SYMBOL, F.lit(parse_symbol(symbol)))
    elif not files:
        raw = raw.withColumn(SYMBOL, F.lit(None).cast("string"))
    elif not in_folders:
        name = F.regexp_replace(F.col("_metadata.file_name"), r"(?i)\.csv$", "")
        raw = raw.withColumn(SYMBOL, F.upper(F.substring_index(name, cut, 1) if cut else name))
    return clean(raw, formats, intraday).select(SYMBOL, *OHLCV)


def undated_rows(rows: DataFrame) -> int:
    """How many rows of :func:`scan_rows` have no readable date."""
    return rows.where(F.col("Date").isNull()).count()


def repeated_dates(prices: DataFrame) -> DataFrame:
    """``symbol``, ``Date`` and ``count`` where a symbol has several rows of one date; a price series has none."""
    return prices.groupBy(SYMBOL, "Date").count().where("count > 1")


def normalise_columns(df: DataFrame) -> DataFrame:
    """First letter upper case, the rest lower: ``ADJ CLOSE`` becomes ``Adj close``."""
    return df.toDF(*[c.lower().capitalize() for c in df.columns])


def parse_date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """A date by the first format that fits, else by Spark's own reading, or null where the text is none."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats], F.try_to_timestamp(text)).cast("date")


def parse_time(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """As :func:`parse_date`, with the time of day that may follow the date; midnight without one."""
    timed = [f"{f}{time}" for f in formats for time in ("", " H:mm[:ss]")]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in timed], F.try_to_timestamp(text))


def finite(value: Column) -> Column:
    """NaN and infinities count as missing."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def clean(df: DataFrame, formats: tuple[str, ...] = DATE_FORMATS, intraday: bool = False) -> DataFrame:
    """Typed date (a timestamp if ``intraday``), finite prices, whole volume."""
    return df.withColumns(
        {
            "Date": (parse_time if intraday else parse_date)(F.col("Date"), formats),
            **{c: finite(F.col(c)) for c in _PRICES},
            "Volume": finite(F.col("Volume")).try_cast("long"),
        }
    )


def drop_undated(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["Date"])


def preview(df: DataFrame, line: str | None = None, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows, less those with only blank cells (cut first, as a page of a file is).

    ``line`` names the column that holds the place in the file, if there is one.
    """
    first = df.orderBy(line).limit(rows) if line else df.limit(rows)
    cells = [F.col(c).cast("string") for c in df.columns if c != line]
    return first.where(F.trim(F.concat_ws("", *cells)) != "")


def price_history(prices: DataFrame, symbol: str, start: str, end: str) -> DataFrame:
    """One ticker from ``start`` up to, not including, ``end``."""
    for name, value in {"symbol": symbol, "start": start, "end": end}.items():
        if not value:
            raise ValueError(f"price_history needs a {name}")
    in_range = (F.col("Date") >= F.lit(start).cast("date")) & (F.col("Date") < F.lit(end).cast("date"))
    return prices.where((F.col(SYMBOL) == parse_symbol(symbol)) & in_range).select(*OHLCV)


def store_prices(prices: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Prices laid out for :func:`price_history`: a folder per symbol, and in it files that each hold a span of dates.

    Rows are sorted by range of symbol and date over as many tasks as they
    ask for, so a hot symbol fills many files and each file, as each of its row
    groups, has narrow bounds for the date; a range read opens the
    symbol's folder and skips the others' dates.
    """
    written = prices.select(SYMBOL, *[F.col(f.name) if f.name == "Date" else F.col(f.name).cast(f.dataType) for f in PRICE_SCHEMA])
    tasks = max(1, -(-prices.count() // rows_per_file))
    by_range = written.repartitionByRange(tasks, SYMBOL, "Date", *_PRICES, "Volume").sortWithinPartitions(SYMBOL, "Date")
    by_range.write.partitionBy(SYMBOL).option("maxRecordsPerFile", rows_per_file).parquet(path)


def stored_prices(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`store_prices` wrote; symbols stay text."""
    schema = T.StructType([*PRICE_SCHEMA, T.StructField(SYMBOL, T.StringType())])
    return spark.read.schema(schema).parquet(path).select(SYMBOL, *OHLCV)


def price_file_name(symbol: str, start: str, end: str) -> str:
    return f"{parse_symbol(symbol)}_{start}_to_{end}.csv"


def export_prices(prices: DataFrame, path: str, by_symbol: bool = False) -> None:
    """Price columns as CSV with the contract's header, on request in a folder per symbol; times of day stay."""
    timed = dict(prices.dtypes)["Date"].startswith("timestamp")
    columns = [F.col(f.name) if timed and f.name == "Date" else F.col(f.name).cast(f.dataType) for f in PRICE_SCHEMA]
    if by_symbol:
        one_file_each(prices.select(SYMBOL, *columns), SYMBOL).write.partitionBy(SYMBOL).option("header", True).csv(path)
    else:
        prices.select(*columns).write.option("header", True).csv(path)
