"""Models: invariants, quality, and independence from partitioning."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwatch.operators.models import gmm, iforest, kmeans, ocsvm
from barwatch.operators.models.seeding import Seeding
from barwatch.plans.detect import RESULT, detect_anomalies, fit_and_score, read_model, score_with
from barwatch.schema import MODELS


def points_frame(spark, groups, parts=4):
    rows = [
        (name, i, [float(v) for v in row], len(x)) for name, x in groups.items() for i, row in enumerate(x)
    ]
    return spark.createDataFrame(rows, "symbol string, _pos bigint, features array<double>, group_rows bigint").repartition(parts)


def heavy_tails(n, d, seed, planted=20):
    rng = np.random.default_rng(seed)
    x = rng.standard_t(4, size=(n, d))
    x = (x - x.mean(0)) / x.std(0)
    x[:planted] += rng.choice([-20.0, 20.0], size=(planted, d))
    return (x - x.mean(0)) / x.std(0)


def prices(spark, days=400):
    rng = np.random.default_rng(3)
    rows = []
    for s, level in [("A", 20.0), ("B", 900.0)]:
        close = level * np.exp(np.cumsum(rng.normal(0, 0.01, days)))
        close[days // 2] *= 1.6
        for i, c in enumerate(close):
            day = dt.date(2020, 1, 1) + dt.timedelta(days=i)
            rows.append((s, day, float(c), float(c * 1.01), float(c * 0.98), float(c * 0.995), int(rng.integers(100, 999))))
    return spark.createDataFrame(
        rows, "symbol string, Date date, Close double, High double, Low double, Open double, Volume bigint"
    )


@pytest.mark.parametrize("by", [None, "symbol"])
@pytest.mark.parametrize("model", MODELS)
def test_every_model_flags_by_its_own_threshold(spark, model, by):
    got = detect_anomalies(prices(spark), model, 3.0, by=by).toPandas()
    assert list(got.columns) == RESULT
    assert len(got) == 2 * (400 - 29)
    assert (got.is_anomaly == (got.distance > got.threshold).astype(int)).all()
    assert set(got.model_used) == {model}
    assert got.threshold.nunique() == (2 if by else 1)
    for _, part in got.groupby("symbol") if by else [("all", got)]:
        if model in ("kmeans", "gmm"):
            assert part.threshold.iloc[0] == pytest.approx(part.distance.mean() + 3 * part.distance.std())
            assert part.cluster.between(0, 4).all()
        else:
            assert part.is_anomaly.sum() == pytest.approx(0.05 * len(part), abs=1.5)
            assert part.cluster.isna().all()
    if model == "isolation_forest":
        jump = got[got.Date == dt.date(2020, 7, 19)]
        assert (jump.is_anomaly == 1).all()


def test_unknown_model_and_scope(spark):
    with pytest.raises(ValueError, match="dbscan"):
        detect_anomalies(prices(spark, 40), "dbscan")
    with pytest.raises(ValueError):
        detect_anomalies(prices(spark, 40), "kmeans", by="Volume")


@pytest.mark.parametrize("model", MODELS)
def test_too_short_a_series_gives_an_empty_result(spark, model):
    got = detect_anomalies(prices(spark, 29), model)
    assert got.columns == RESULT and got.count() == 0


@pytest.mark.parametrize("rows_per_task", [None, 40])
def test_kmeans_groups_reach_a_fixed_point(spark, rows_per_task):
    rng = np.random.default_rng(0)
    blobs = np.concatenate([rng.normal(c, 0.05, size=(60, 3)) for c in ([0, 0, 0], [5, 0, 0], [0, 5, 0], [0, 0, 5], [5, 5, 5])])
    pts = points_frame(spark, {"a": blobs, "b": blobs[::-1] * 2, "c": blobs[:30]})
    params = kmeans.fit(pts, "symbol", rows_per_task=rows_per_task)
    fitted = {r["symbol"]: np.array(r["centres"]) for r in params.collect()}
    for name, x in {"a": blobs, "b": blobs * 2}.items():
        near = ((x[:, None] - fitted[name]) ** 2).sum(2).argmin(1)
        again = np.array([x[near == j].mean(0) for j in range(5)])
        np.testing.assert_allclose(again, fitted[name], atol=1e-3)
        assert (np.bincount(near) == 60).all()
    scored = kmeans.score(pts, params, "symbol").toPandas()
    for _, row in scored.iterrows():
        gaps = np.sqrt(((np.array(row.features) - fitted[row.symbol]) ** 2).sum(1))
        assert row.distance == pytest.approx(gaps.min(), abs=1e-9) and row.cluster == gaps.argmin()


def test_a_rare_cluster_gets_a_centre(spark):
    """One row in ten thousand, by one task and by many."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 1.0, size=(10_000, 2)) for c in ([0, 0], [30, 0], [0, 30], [30, 30])] + [rng.normal([400, 400], 1.0, size=(4, 2))])
    pts = points_frame(spark, {"a": x}, 6)
    found = [np.array(kmeans.fit(pts, "symbol", rows_per_task=n).first()["centres"]) for n in (None, 9_000)]
    for centres in found:
        assert (np.abs(centres - [400, 400]).max(axis=1) < 3).sum() == 1
    np.testing.assert_allclose(*[c[np.lexsort(c.T)] for c in found], rtol=1e-9)


def test_equal_rows_have_equal_centres(spark):
    pts = points_frame(spark, {"a": np.ones((50, 3)), "b": np.ones((1, 3))})
    for n in (None, 20):
        assert {str(r["centres"]) for r in kmeans.fit(pts, "symbol", rows_per_task=n).collect()} == {str([[1.0] * 3] * 5)}


def test_seeds_of_parts_merge_to_those_of_the_whole():
    rng = np.random.default_rng(2)
    x, u, seeding = rng.normal(size=(500, 4)), rng.random(500), Seeding(3, 1)
    state = seeding.start(4)
    while state.phase <= Seeding.LAST:
        total = seeding.partial(state, x, u)
        parts = [seeding.partial(state, x[i::7], u[i::7]) for i in range(7)]
        np.testing.assert_array_equal(seeding.merge(state.phase, [seeding.merge(state.phase, parts[:3]), seeding.merge(state.phase, parts[3:])]), total)
        state = seeding.update(state, total)
    assert state.values[1:].reshape(3, 4).shape == (3, 4)


@pytest.mark.parametrize("rows_per_task", [None, 100])
def test_mixture_of_a_group_separates_blobs(spark, rows_per_task):
    rng = np.random.default_rng(1)
    blobs = np.concatenate([rng.normal(c, 0.2, size=(150, 2)) for c in ([0, 0], [6, 0], [0, 6], [6, 6], [3, 12])])
    pts = points_frame(spark, {"a": blobs})
    params = gmm.fit(pts, "symbol", rows_per_task=rows_per_task)
    got = gmm.score(pts, params, "symbol").orderBy("_pos").toPandas()
    assert got.distance.between(-1e-8, np.log(5) + 1e-6).all()
    assert got.cluster.to_numpy().reshape(5, 150).std(axis=1).max() == 0 and got.cluster.nunique() == 5
    np.testing.assert_allclose(params.first()["weights"], [0.2] * 5, atol=1e-6)
    # Collinear features leave a direction without spread; it must not break the fit.
    flat = points_frame(spark, {"a": np.column_stack([blobs, np.zeros(len(blobs))])})
    again = gmm.score(flat, gmm.fit(flat, "symbol", rows_per_task=rows_per_task), "symbol")
    assert again.where(F.isnan("distance") | F.col("distance").isNull()).count() == 0


def mixture_passes(x, u):
    fit = gmm.MixtureFit()
    state, passes = fit.start(x.shape[1]), 0
    while not state.done:
        state, passes = fit.update(state, fit.partial(state, x, u)), passes + 1
    return passes


def test_a_mixture_takes_as_many_passes_on_copies_of_the_rows():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, s, size=(300, 3)) for c, s in ([(0, 0, 0), 1.0], [(4, 0, 1), 0.5], [(0, 5, 2), 2.0])])
    u = rng.random(len(x))
    once, often = mixture_passes(x, u), mixture_passes(np.tile(x, (100, 1)), rng.random(100 * len(x)))
    fit = gmm.MixtureFit()
    # From one start, the steps themselves do not see how many copies there are.
    state = fit.start(3)
    while state.phase <= Seeding.LAST:
        state = fit.update(state, fit.partial(state, x, u))
    counts = []
    for rows in (x, np.tile(x, (100, 1))):
        s, n = state, 0
        while not s.done:
            s, n = fit.update(s, fit.partial(s, rows, np.zeros(len(rows)))), n + 1
        counts.append(n)
    assert counts[0] == counts[1] < gmm.MAX_ITER and max(once, often) < gmm.MAX_ITER


@pytest.mark.parametrize("model", MODELS)
@pytest.mark.parametrize("by", [None, "symbol"])
def test_a_stored_model_scores_as_it_did(spark, tmp_path, model, by):
    rows = prices(spark, 120)
    fitted, scored = fit_and_score(rows, model, by=by)
    fitted.write(f"{tmp_path}/m")
    stored = read_model(spark, f"{tmp_path}/m")
    again = score_with(rows, stored)
    order = ["symbol", "Date"]
    pd.testing.assert_frame_equal(
        again.orderBy(*order).toPandas(), scored.orderBy(*order).toPandas(), rtol=1e-12
    )
    # A second file: one symbol, other prices; its scales and thresholds are still the stored ones.
    other = rows.where("symbol = 'A'").withColumn("Close", F.col("Close") * 3).union(rows.where("symbol = 'B'").withColumn("symbol", F.lit("NEW")))
    found = score_with(other, stored).toPandas()
    assert set(found.symbol) == {"A"} and len(found) == 91
    assert set(found.threshold) <= set(scored.toPandas().threshold)
    if model in ("kmeans", "gmm"):
        centres = stored.centres()
        width = {len(r["columns"]) for r in stored.columns().collect()}
        assert centres.count() == (10 if by else 5) and {len(r["centre"]) for r in centres.collect()} <= width
    else:
        with pytest.raises(ValueError):
            stored.centres()


def test_forest_is_the_same_for_any_partitioning_and_finds_outliers(spark):
    x = heavy_tails(2000, 5, 2)
    scores = []
    for parts in (2, 7):
        pts = points_frame(spark, {"a": x}, parts)
        scores.append(iforest.score(pts, iforest.fit(pts, None), None).orderBy("_pos").toPandas().distance.to_numpy())
    np.testing.assert_array_equal(scores[0], scores[1])
    assert (scores[0][:20] > np.quantile(scores[0], 0.95)).all()


def test_forest_samples_are_full_and_distinct(spark):
    pts = points_frame(spark, {"a": heavy_tails(3000, 2, 3), "b": heavy_tails(100, 2, 4)})
    counts = iforest.tree_samples(pts, "symbol", 20, 256, 42).groupBy("symbol", "tree").agg(
        F.count("*").alias("n"), F.count_distinct("_pos").alias("d")
    ).toPandas()
    assert (counts.n == counts.d).all()
    assert set(counts[counts.symbol == "a"].n) == {256} and set(counts[counts.symbol == "b"].n) == {100}


def exact_svm(x, nu, gamma, steps=4000):
    """The kernel dual by accelerated projected gradient."""
    n, squares = len(x), (x**2).sum(1)
    k = np.exp(-gamma * np.maximum(squares[:, None] + squares - 2 * x @ x.T, 0))
    cap = 1 / (nu * n)

    def project(v):
        low, high = v.min() - cap - 1, v.max() + 1
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if np.clip(v - mid, 0, cap).sum() > 1 else (low, mid)
        return np.clip(v - low, 0, cap)

    size = np.linalg.norm(k, 2)
    a = y = np.full(n, 1 / n)
    t = 1.0
    for _ in range(steps):
        b = project(y - k @ y / size)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, a, t = b + (t - 1) / t_next * (b - a), b, t_next
    margin = k @ a
    inner = (a > 1e-8 * cap) & (a < cap * (1 - 1e-6))
    return margin, np.median(margin[inner])


@pytest.mark.parametrize("rows_per_task", [None, 700])
def test_svm_agrees_with_the_exact_kernel_solution(spark, rows_per_task):
    x = heavy_tails(2000, 7, 0)
    exact, rho = exact_svm(x, 0.05, 1 / 7)
    pts = points_frame(spark, {"a": x})
    params = ocsvm.fit(pts, None, rows_per_task=rows_per_task)
    got = -ocsvm.score(pts, params, None).orderBy("_pos").toPandas().distance.to_numpy()
    assert np.corrcoef(pd.Series(exact).rank(), pd.Series(got).rank())[0, 1] >= 0.9
    outside = exact < rho * (1 - 1e-4)
    flagged = got < np.quantile(got, 0.05)
    assert (flagged & outside).sum() / outside.sum() >= 0.75
    assert flagged[:20].all()


def test_svm_search_ends_near_its_least_loss_and_can_be_carried_on():
    x = heavy_tails(800, 4, 3)
    fit = ocsvm.SvmFit(count=64)
    state, passes = fit.start(4), 0
    while not state.done:
        # The state goes through numbers alone, as between tasks.
        state = fit.update(state._replace(values=np.array(state.values.tolist())), fit.partial(state, x, None))
        passes += 1
    gamma, width, mean, search = fit._read(state)
    total = fit.partial(state, x, None)
    assert passes < ocsvm.MAX_ITER
    longer, least = state, search.value
    for _ in range(60):
        longer = fit.update(longer, fit.partial(longer, x, None))
        least = min(least, fit._read(longer)[3].value)
    assert search.value - least <= 1.5 * ocsvm._GAP * abs(least)
    assert fit._dual(*total[[0, 2, 3]], total[4:], width, mean) <= least + 1e-12
