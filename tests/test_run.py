"""From a CSV to its stored result."""

import datetime as dt
import json

import numpy as np

from barwatch.plans.detect import score_with
from barwatch.plans.run import run_from_csv
from barwatch.sources.prices import scan_prices
from barwatch.sources.results import read_history


def test_one_call_stores_records_and_reports(spark, tmp_path):
    rng = np.random.default_rng(3)
    closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 120)))
    closes[80] *= 1.5
    day = dt.date(2020, 1, 1)
    lines = [f"{day + dt.timedelta(i)},{c},{c + 1},{c - 1},{c},{1000 + i}" for i, c in enumerate(closes)]
    (tmp_path / "ab.c.csv").write_text("Date,Close,High,Low,Open,Volume\n" + "\n".join(lines) + "\n")
    run = run_from_csv(spark, str(tmp_path / "ab.c.csv"), str(tmp_path / "results"), str(tmp_path / "history"), "u1", symbol="ab.c")
    summary = run.summary.first()
    assert summary["rows"] == 91 and summary["anomalies"] == run.anomaly_records.count() >= 1
    assert "2020-03-22" in {json.loads(r["record"])["Date"] for r in run.anomaly_records.collect()} and run.records.count() == 91
    row = read_history(spark, str(tmp_path / "history")).first()
    assert row["run_id"] == run.run_id and row["stock_symbol"] == "AB.C" and row["summary"]["rows_processed"] == 91
    assert {r["symbol"] for r in run.scored.select("symbol").distinct().collect()} == {"AB.C"} and run.repeated.count() == 0
    assert run.model.centres().count() == 5 and run.model.thresholds.first()["threshold"] == run.scored.first()["threshold"]
    again = score_with(scan_prices(spark, str(tmp_path / "ab.c.csv"), "ab.c"), run.model)
    assert sorted(r["distance"] for r in again.collect()) == sorted(r["distance"] for r in run.scored.collect())
