"""Pruning, scaling, thresholds, exact quantiles, reports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwatch.operators import report, stats
from barwatch.operators import score as sc
from barwatch.operators.history import user_summary
from barwatch.schema import HISTORY_SCHEMA


def mask(spark, corr, features):
    row = spark.createDataFrame([(corr,)], "corr array<double>")
    return row.select(stats.keep_mask(F.col("corr"), features=features).alias("k")).first()["k"]


def test_a_dropped_feature_still_drops_others(spark):
    # pairs: AB, AC, BC
    assert mask(spark, [0.99, 0.1, 0.97], ["A", "B", "C"]) == [True, False, False]
    assert mask(spark, [None, 0.95, -0.2], ["A", "B", "C"]) == [True, True, False]
    assert mask(spark, [-0.96, 0.0, 0.0], ["A", "B", "C"]) == [True, False, True]


def test_correlation_matches_numpy_and_survives_constants(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3)) + 1e6
    rows = [("a", *map(float, r), 5.0) for r in x] + [("b", *map(float, r), 5.0) for r in x[:50]]
    df = spark.createDataFrame(rows, "symbol string, p double, q double, r double, k double")
    got = {
        (r["symbol"], r["col_i"], r["col_j"]): r["corr"]
        for r in stats.correlation_matrix(df, ["symbol"], ["p", "q", "r", "k"]).collect()
    }
    for name, part in (("a", x), ("b", x[:50])):
        want = np.corrcoef(part.T)
        for i, c in enumerate("pqr"):
            assert got[name, c, "k"] is None
            for j in range(i + 1, 3):
                assert got[name, c, "pqr"[j]] == pytest.approx(want[i, j], abs=1e-7)
    whole = {(r["col_i"], r["col_j"]): r["corr"] for r in stats.correlation_matrix(df.where("symbol = 'a'"), [], ["p", "q", "r"]).collect()}
    assert whole["p", "q"] == pytest.approx(np.corrcoef(x.T)[0, 1], abs=1e-7)


@pytest.mark.parametrize("ddof", [0, 1])
def test_standardise(spark, ddof):
    values = [1.0, 2.0, 4.0, 9.0]
    df = spark.createDataFrame([("a", v, 3.0) for v in values], "symbol string, x double, k double")
    got = stats.standardise(df, ["x", "k"], ddof=ddof).toPandas()
    want = (np.array(values) - np.mean(values)) / np.std(values, ddof=ddof)
    np.testing.assert_allclose(sorted(got.x), sorted(want))
    assert (got.k == 0).all()


def test_threshold_of_one_row_is_null_and_flags_nothing(spark):
    one = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("b", 2.0)], "symbol string, distance double")
    flagged = sc.flag(one, sc.adaptive_threshold(one, ["symbol"]), ["symbol"])
    row = flagged.where("symbol = 'a'").first()
    assert row["threshold"] is None and row["is_anomaly"] == 0
    assert sc.anomalies(flagged).count() == 0 and sc.normals(flagged).count() == 3
    whole = sc.flag(one, sc.adaptive_threshold(one, [], 0.5), [])
    assert {r["is_anomaly"] for r in whole.collect()} == {0, 1}


@pytest.mark.parametrize("limit", [40, 10_000])
def test_exact_quantile_with_and_without_narrowing(spark, limit):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=3001), "b": np.repeat([1.0, 2.0], [1500, 20]), "c": np.array([4.0]), "d": rng.integers(0, 9, 700) * 1.0}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "symbol string, distance double")
    for p in (0.05, 0.5, 0.999):
        got = {r["symbol"]: r["cut"] for r in sc.exact_quantile(df, p, ["symbol"], ranked_rows=limit).collect()}
        for g, x in groups.items():
            assert got[g] == pytest.approx(np.quantile(x, p), abs=1e-12), (g, p)
    alone = sc.exact_quantile(df.where("symbol = 'a'"), 0.05, [], ranked_rows=limit).first()["cut"]
    assert alone == pytest.approx(np.quantile(groups["a"], 0.05), abs=1e-12)


def test_copies_in_one_group_do_not_stop_another(spark):
    """Half the rows are copies that no bounds can split; the other groups are still narrowed and ranked by parts."""
    rng = np.random.default_rng(9)
    groups = {"copies": np.append(np.full(6000, 3.0), rng.normal(3, 1e-9, 40)), "wide": rng.normal(size=5000), "mixed": np.append(np.full(2500, 0.1), rng.normal(size=2500))}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "symbol string, distance double").repartition(5)
    for p in (0.05, 0.6, 1.0):
        for limit in (30, 100):
            got = {r["symbol"]: r["cut"] for r in sc.exact_quantile(df, p, ["symbol"], ranked_rows=limit).collect()}
            assert got == pytest.approx({g: np.quantile(x, p) for g, x in groups.items()}, abs=1e-12)
        whole = sc.exact_quantile(df, p, [], ranked_rows=100).first()["cut"]
        assert whole == pytest.approx(np.quantile(np.concatenate(list(groups.values())), p), abs=1e-12)


@pytest.mark.parametrize("by", [["symbol"], []])
def test_no_task_ranks_more_than_its_share(spark, by, monkeypatch):
    """Values too close together for the bounds to part them are ranked by range, a part a task."""
    rng = np.random.default_rng(3)
    values = rng.permutation(4000).astype(float)
    df = spark.createDataFrame([("a", float(v)) for v in values], "symbol string, distance double").repartition(3)
    monkeypatch.setattr(sc, "_STEPS", 1)  # bounds that never close in
    seen = []
    reach = sc._reach
    monkeypatch.setattr(sc, "_reach", lambda rows, parts: seen.append(rows.groupBy(*parts).count().toPandas()["count"].max()) or reach(rows, parts))
    assert sc.exact_quantile(df, 0.05, by, ranked_rows=500).first()["cut"] == pytest.approx(np.quantile(values, 0.05))
    assert seen and max(seen) <= 500


def test_contamination_flags_the_top_share(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1000)], "symbol string, distance double")
    flagged = sc.flag(df, sc.contamination_cut(df, ["symbol"]), ["symbol"])
    assert sc.anomalies(flagged).count() == 50
    with pytest.raises(ValueError):
        sc.contamination_cut(df, ["symbol"], 1.5)


def test_ambiguity_of_a_certain_row(spark):
    row = spark.createDataFrame([(1.0,), (0.2,)], "p double").select(sc.ambiguity(F.col("p")).alias("s")).collect()
    assert [r["s"] for r in row] == pytest.approx([-np.log(1 + 1e-9), -np.log(0.2 + 1e-9)])


def test_comparison_without_anomalies_and_with_zeros(spark):
    scored = spark.createDataFrame([(0.0, 0, 0.0, None, 0)], "Return double, Volume bigint, Vol_14 double, RSI_14 double, is_anomaly int")
    got = report.feature_comparison_normalised(scored).collect()
    assert len(got) == 4 and all(r["normal"] is None and r["anomaly"] is None for r in got)
    assert report.run_summary(scored).first().asDict() == {"rows": 1, "anomalies": 0, "clusters": 0}


def test_summary_of_a_user_without_runs(spark):
    none = spark.createDataFrame([], HISTORY_SCHEMA)
    assert user_summary(none, "u").first().asDict() == {
        "user_id": "u", "total_analyses": 0, "total_anomalies": 0, "most_used_model": "N/A", "last_analysis_date": None,
    }
