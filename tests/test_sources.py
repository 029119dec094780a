"""Files, checks, sinks."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
import os
import time

import pytest
from pyspark.sql import functions as F

from barwatch.functions import checks
from barwatch.operators.stats import assemble
from barwatch.schema import HISTORY_SCHEMA, OHLCV
from barwatch.sources import prices as px
from barwatch.sources import results

HEADER = "Date,Close,High,Low,Open,Volume\n"


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_scan_types_and_dirty_cells(spark, tmp_path):
    path = write(
        tmp_path, "aapl_2020.csv",
        HEADER + "2020-01-02,1.5,2,1,1.2,100\nnot a date,1,1,1,1,1\n2020-01-03,text,2,1,1,7\n2020-01-06,nan,2,1,1,\n",
    )
    got = px.scan_prices(spark, str(path), cut="_").orderBy("Date").collect()
    assert [r["Date"] for r in got] == [dt.date(2020, 1, 2), dt.date(2020, 1, 3), dt.date(2020, 1, 6)]
    assert {r["symbol"] for r in got} == {"AAPL"}
    assert got[0]["Volume"] == 100 and got[1]["Close"] is None and got[2]["Close"] is None and got[2]["Volume"] is None
    assert px.scan_prices(spark, str(path), "msft").first()["symbol"] == "MSFT"


def test_a_folder_is_many_symbols(spark, tmp_path):
    for s in ("AA", "BB"):
        write(tmp_path, f"{s}.csv", HEADER + "2020-01-02,1,1,1,1,1\n")
    assert {r["symbol"] for r in px.scan_prices(spark, str(tmp_path)).collect()} == {"AA", "BB"}


def test_a_symbol_is_one_file(spark, tmp_path):
    rows = [(s, dt.date(2020, 1, d), 1.0, 1.0, 1.0, 2.0, d) for d in range(1, 29) for s in ("AA", "BB", "CC")]
    table = spark.createDataFrame(
        rows, "symbol string, Date date, Close double, High double, Low double, Open double, Volume bigint"
    ).repartition(8)
    px.export_prices(table, str(tmp_path / "out"), by_symbol=True)
    assert len(list((tmp_path / "out").glob("symbol=*/*.csv"))) == 3
    assert sorted(px.scan_prices(spark, str(tmp_path / "out")).collect()) == sorted(table.collect())


def test_nested_files_dotted_names_and_dates(spark, tmp_path):
    os.makedirs(tmp_path / "2020" / "x")
    write(tmp_path / "2020" / "x", "BRK.A.csv", HEADER + "01/02/2020,1,1,1,1,1\n2020-01-03 09:30:00,1,1,1,1,1\n")
    write(tmp_path / "2020", "BRK.B.csv", HEADER + "3.1.2020,1,1,1,1,1\nnever,1,1,1,1,1\n")
    write(tmp_path, "notes.txt", "no prices")
    rows = px.scan_rows(spark, str(tmp_path))
    assert px.undated_rows(rows) == 1
    got = px.scan_prices(spark, str(tmp_path))
    assert sorted((r["symbol"], r["Date"].day) for r in got.collect()) == [("BRK.A", 2), ("BRK.A", 3), ("BRK.B", 3)]
    assert px.repeated_dates(got).count() == 0 and px.repeated_dates(got.union(got)).count() == 3


def test_times_of_day_order_intraday_rows(spark, tmp_path):
    texts = ["2020-01-03 09:30:00", "2020-01-03T09:31:00", "1/3/2020 9:32", "3.1.2020 9:33:00", "2020/01/03 09:34", "2020-01-04", "never"]
    closes = [5, 3, 4, 1, 2, 9, 8]
    write(tmp_path, "A.csv", HEADER + "".join(f"{t},{c},1,1,1,1\n" for t, c in zip(texts, closes)))
    got = px.scan_prices(spark, str(tmp_path), intraday=True)
    assert dict(got.dtypes)["Date"] == "timestamp" and px.repeated_dates(got).count() == 0
    rows = got.orderBy("Date").collect()
    assert [r["Close"] for r in rows] == closes[:6] and rows[2]["Date"] == dt.datetime(2020, 1, 3, 9, 32)
    px.export_prices(got, str(tmp_path / "out"), by_symbol=True)
    assert sorted(px.scan_prices(spark, str(tmp_path / "out"), intraday=True).collect()) == sorted(rows)


@pytest.mark.parametrize(
    "header",
    [
        "Date,Open,High,Low,Close,Volume",
        "date,close,high,low,open,volume",
        "Date,Close,High,Low,Open,Volume,Extra",
        "Date,Close,High,Low,Open",
        "",
    ],
)
def test_any_other_header_is_rejected(spark, tmp_path, header):
    path = write(tmp_path, "x.csv", header + "\n2020-01-02,1,1,1,1,1\n")
    with pytest.raises(ValueError, match="unexpected columns"):
        px.scan_prices(spark, str(path))


def test_one_bad_file_in_a_folder_is_rejected(spark, tmp_path):
    write(tmp_path, "a.csv", HEADER + "2020-01-02,1,1,1,1,1\n")
    write(tmp_path, "b.csv", "Date,Close\n2020-01-02,1\n")
    with pytest.raises(ValueError):
        px.scan_prices(spark, str(tmp_path))


def test_headers_are_checked_in_tasks_at_the_first_row(spark, tmp_path):
    files = [write(tmp_path, f"s{i}.csv", HEADER + "2020-01-02,1,1,1,1,1\n" * 300) for i in range(40)]
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    big = write(tmp_path, "big.csv", HEADER + "2020-01-02,1,1,1,1,1\n" * 2_000_000)
    started = time.perf_counter()
    px.check_headers(spark, [*files, big])
    assert time.perf_counter() - started < 20 and spark.conf.get("spark.sql.files.openCostInBytes") == before
    os.truncate(big, len(HEADER))
    got = px.scan_prices(spark, str(tmp_path))
    assert got.count() == 40 * 300 and got.select("symbol").distinct().count() == 40
    for wrong in (HEADER.lower(), "Close," + HEADER, "Date,Close,High,Low,Open\n"):
        write(tmp_path, "s9.csv", wrong)
        with pytest.raises(ValueError, match="unexpected columns"):
            px.scan_prices(spark, str(tmp_path))


def test_file_without_rows(spark, tmp_path):
    path = write(tmp_path, "x.csv", HEADER)
    got = px.scan_prices(spark, str(path))
    assert got.columns == ["symbol", *OHLCV] and got.count() == 0


def test_argument_checks():
    assert checks.parse_symbol("aapl") == "AAPL" and checks.parse_symbol(None) == "UNKNOWN"
    assert checks.parse_threshold() == 3.0 and checks.parse_threshold("2.5") == 2.5
    assert checks.check_file_name("A.CSV") == "A.CSV"
    for call in (
        lambda: checks.parse_symbol(""),
        lambda: checks.parse_threshold("many"),
        lambda: checks.parse_threshold(None),
        lambda: checks.check_model("x"),
        lambda: checks.check_file_name("a.txt"),
        lambda: checks.check_file_name("csv"),
        lambda: checks.check_file_name(""),
    ):
        with pytest.raises(ValueError):
            call()


def test_range_read_and_export(spark, tmp_path):
    rows = [("AA", dt.date(2020, 1, d), float(d), 1.0, 1.0, 2.0, d) for d in range(1, 11)]
    table = spark.createDataFrame(
        rows, "symbol string, Date date, Close double, High double, Low double, Open double, Volume bigint"
    )
    part = px.price_history(table, "aa", "2020-01-03", "2020-01-06")
    assert [r["Date"].day for r in part.orderBy("Date").collect()] == [3, 4, 5]
    assert part.first()["Open"] == 2.0
    with pytest.raises(ValueError):
        px.price_history(table, "", "2020-01-03", "2020-01-06")
    px.export_prices(part, str(tmp_path / "out"))
    again = px.scan_prices(spark, str(tmp_path / "out"), "aa").drop("symbol")
    assert sorted(again.collect()) == sorted(part.collect())
    assert px.price_file_name("aa", "2020-01-03", "2020-01-06") == "AA_2020-01-03_to_2020-01-06.csv"


def test_range_read_prunes_and_pushes_down(spark, tmp_path):
    rows = [(s, dt.date(2020, 1, d), 1.0, 1.0, 1.0, 2.0, d) for d in range(1, 5) for s in ("AA", "BB")]
    table = spark.createDataFrame(
        rows, "symbol string, Date date, Close double, High double, Low double, Open double, Volume bigint"
    )
    table.write.partitionBy("symbol").parquet(str(tmp_path / "t"))
    plan = px.price_history(spark.read.parquet(str(tmp_path / "t")), "aa", "2020-01-02", "2020-01-04")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in text and "GreaterThanOrEqual(Date,2020-01-02)" in text


def test_preview_cuts_before_it_skips_blanks(spark):
    lines = spark.createDataFrame([(i, " " if i % 2 else "x", None) for i in range(100)], "n int, a string, b string")
    got = px.preview(lines, "n").collect()
    assert len(got) == 25 and max(r["n"] for r in got) == 48


def test_vectors_survive_csv(spark):
    row = spark.createDataFrame([([1.5, -2.0, 1e-12],)], "features array<double>")
    text = row.select(results.vector_text(F.col("features")).alias("t"))
    assert text.first()["t"] == "[1.5,-2.0,1.0E-12]"
    assert text.select(results.parse_vector_text(F.col("t")).alias("v")).first()["v"] == [1.5, -2.0, 1e-12]


def test_history_append_and_failure(spark, tmp_path):
    scored = spark.createDataFrame([(1,), (0,), (0,)], "is_anomaly int")
    record = results.history_record(
        scored, "r", "u", dt.datetime(2024, 1, 2, 3, 4, 5), "p.csv", "AA", "svm", 2.5,
        results.result_file_name(dt.datetime(2024, 1, 2, 3, 4, 5), "svm"),
    )
    path = str(tmp_path / "h")
    assert results.append_history(record, path) and results.append_history(record, path)
    got = results.read_history(spark, path)
    assert got.schema == HISTORY_SCHEMA and got.count() == 1
    row = got.first()
    assert row["summary"]["rows_processed"] == 3 and row["summary"]["anomalies_found"] == 1
    assert row["results_filename"] == "20240102_030405_svm_results.csv"
    assert row["run_timestamp"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert results.append_history(scored, path) is False


def history_row(spark, run_id, hour=3):
    scored = spark.createDataFrame([(1,), (0,)], "is_anomaly int")
    return results.history_record(scored, run_id, "u", dt.datetime(2024, 1, 2, hour), "p.csv", "AA", "svm", 2.5, f"{run_id}.csv")


def test_history_keeps_one_row_a_run(spark, tmp_path):
    path = str(tmp_path / "h")
    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(lambda run: results.append_history(history_row(spark, run), path), ["a", "a", "b/?*", "a"]))
    assert results.append_history(history_row(spark, "a", 5), path)
    got = results.read_history(spark, path).collect()
    assert sorted(r["run_id"] for r in got) == ["a", "b/?*"] and {r["run_timestamp"].hour for r in got} == {3}
    assert not [f for f in (tmp_path / "h").iterdir() if f.name.startswith("_staged")]
    # Rows of another writer, without a rename: one a run, the earliest; rows that name no run stay.
    history_row(spark, "a", 1).union(history_row(spark, "c")).union(history_row(spark, None)).union(history_row(spark, None)).write.parquet(f"{path}/more")
    got = results.read_history(spark, path).collect()
    assert sorted((r["run_id"] or "-", r["run_timestamp"].hour) for r in got) == [("-", 3), ("-", 3), ("a", 1), ("b/?*", 3), ("c", 3)]


def test_history_append_that_dies_before_its_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    assert results.append_history(history_row(spark, "a"), path)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(results, "_rename", die)
        assert results.append_history(history_row(spark, "b"), path) is False
    assert [r["run_id"] for r in results.read_history(spark, path).collect()] == ["a"]
    assert results.append_history(history_row(spark, "b"), path)
    assert sorted(r["run_id"] for r in results.read_history(spark, path).collect()) == ["a", "b"]
    assert results.append_history(history_row(spark, None), path) is False


def test_price_store_skips_folders_and_dates(spark, tmp_path):
    day = dt.date(2000, 1, 1)
    rows = [(s, day + dt.timedelta(i), float(i), 1.0, 1.0, 2.0, i) for i in range(3000) for s in ("HOT", "007")][: 3000 + 500]
    rows += [("HOT", day + dt.timedelta(i), float(i), 1.0, 1.0, 2.0, i) for i in range(3000, 9000)]
    table = spark.createDataFrame(rows, "symbol string, Date date, Close double, High double, Low double, Open double, Volume bigint").repartition(5)
    path = str(tmp_path / "store")
    px.store_prices(table, path, 1000)
    stored = px.stored_prices(spark, path)
    assert sorted(stored.collect()) == sorted(table.collect())
    assert len(list((tmp_path / "store" / "symbol=HOT").glob("*.parquet"))) >= 6
    part = px.price_history(stored, "hot", "2010-01-01", "2010-02-01")
    text = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in text and "GreaterThanOrEqual(Date,2010-01-01)" in text
    assert part.count() == 31 and px.price_history(stored, "007", "2000-01-01", "2000-01-03").count() == 2
    # Files hold spans of dates, so that only one or two can have the month.
    spans = stored.where("symbol = 'HOT'").groupBy(F.input_file_name()).agg(F.min("Date").alias("a"), F.max("Date").alias("b")).collect()
    assert sum(r["a"] < dt.date(2010, 2, 1) and r["b"] >= dt.date(2010, 1, 1) for r in spans) <= 2


def test_assemble_refuses_holes(spark):
    rows = spark.createDataFrame([(1.0, None)], "a double, b double")
    with pytest.raises(Exception, match="null or NaN"):
        rows.select(assemble(["a", "b"])).collect()
