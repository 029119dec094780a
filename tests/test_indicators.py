"""Indicators against pandas, on random and on awkward series, in every layout."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barwatch.operators.ewm import alpha_from, block_rows, ewm_means, levels_for, slowest_decay, with_blocks
from barwatch.operators.features import engineer_features
from barwatch.operators.series import fill_forward, lay_out
from barwatch.schema import INDICATORS

SCHEMA = "symbol string, Date date, Close double, High double, Low double, Open double, Volume bigint"


def make_prices(spark, closes_by_symbol, shuffle=True):
    rows = []
    for symbol, closes in closes_by_symbol.items():
        for i, c in enumerate(closes):
            c = None if c is None or c != c else float(c)
            rows.append((symbol, dt.date(1990, 1, 1) + dt.timedelta(days=i), c, 2.0, 1.0, 1.5, i % 7 + 1))
    if shuffle:
        np.random.default_rng(0).shuffle(rows)
        rows = [(str(r[0]), r[1], *r[2:6], int(r[6])) for r in rows]
    return spark.createDataFrame(rows, SCHEMA)


def expected(closes):
    c = pd.Series([np.nan if x is None else x for x in closes], dtype=float)
    r = (c / c.shift(1).replace(0, np.nan) - 1)
    if len(r):
        r.iloc[0] = 0.0 if c.iloc[0] == c.iloc[0] else np.nan
    d = c.diff()
    up = d.clip(lower=0).ewm(com=13, adjust=False).mean()
    down = (-d).clip(lower=0).ewm(com=13, adjust=False).mean()
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    table = pd.DataFrame(
        {
            "Return": r,
            "MA_7": c.rolling(7).mean(),
            "MA_30": c.rolling(30).mean(),
            "Vol_14": r.rolling(14).std(),
            "RSI_14": 100 - 100 / (1 + up / down),
            "MACD": macd,
            "MACD_Signal": macd.ewm(span=9, adjust=False).mean(),
        }
    )
    return table[c.notna()].dropna()


def check(spark, series, **layout):
    got = engineer_features(make_prices(spark, series), keep_position=True, **layout).toPandas()
    for symbol, closes in series.items():
        want, mine = expected(closes), got[got.symbol == symbol].set_index("_pos").sort_index()
        assert list(mine.index) == list(want.index)
        scale = max([abs(c) for c in closes if c == c and c is not None], default=1.0)
        for name in INDICATORS:
            size = 1.0 if name in ("Return", "Vol_14") else 100.0 if name == "RSI_14" else scale
            np.testing.assert_allclose(mine[name], want[name], rtol=1e-9, atol=1e-9 * size)


def walk(n, seed, nulls=0.0):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return [float(x) if rng.random() >= nulls else None for x in c]


SERIES = {
    "plain": walk(900, 1),
    "gaps": walk(900, 2, 0.02),
    "long_gap": walk(400, 3) + [None] * 300 + walk(400, 4),
    "flat": [5.0] * 60,
    "rise": [float(i) for i in range(1, 80)],
    "zero": walk(50, 5) + [0.0] + walk(80, 6),
    "short": walk(29, 7),
    "just": walk(30, 8),
}


@pytest.mark.parametrize("layout", [{"bounded": True}, {}])
def test_features_match_pandas(spark, layout):
    check(spark, SERIES, **layout)


def test_gapless_path_matches_pandas(spark):
    check(spark, {k: v for k, v in SERIES.items() if None not in v}, bounded=True, gapless=True)


def test_chunks_give_the_same_rows(spark):
    series = {"long": walk(9000, 11), "gaps": walk(9000, 12, 0.01), "short": walk(40, 13)}
    check(spark, series, series_rows=100, chunk_rows=4096)


def test_chunks_of_a_gapless_table(spark):
    check(spark, {"a": walk(9500, 14), "b": walk(4200, 15)}, series_rows=100, chunk_rows=4096)


def test_rsi_stands_while_the_price_does(spark):
    """A price at rest for longer than a halo keeps the ratio it had."""
    closes = walk(200, 16) + [50.0] * 9000
    prices = make_prices(spark, {"x": closes})
    whole = engineer_features(prices, keep_position=True, bounded=True, gapless=True)
    cut = engineer_features(prices, keep_position=True, series_rows=100, chunk_rows=4096)
    a, b = (d.select("_pos", "RSI_14").toPandas().set_index("_pos").sort_index() for d in (whole, cut))
    assert len(a) == len(b) == len(closes) - 29
    np.testing.assert_allclose(a.RSI_14, b.RSI_14, rtol=1e-9)
    want = expected(closes[:4000]).RSI_14
    np.testing.assert_allclose(a.RSI_14.loc[want.index], want, rtol=1e-9)


@pytest.mark.parametrize("layout", [{}, {"bounded": True}, {"bounded": True, "gapless": True}, {"series_rows": 100, "chunk_rows": 4096}])
@pytest.mark.parametrize("nulls", [0.0, 0.01])
def test_rsi_is_exact_over_a_long_rest(spark, layout, nulls):
    if nulls and "gapless" in layout:
        pytest.skip("the layout promises no nulls")
    closes = walk(4098, 17, nulls) + [50.0] * 5000 + walk(60, 18, nulls)
    check(spark, {"x": closes, "y": walk(100, 19) + [70.0] * 8200 + walk(5, 20)}, **layout)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.one_of(st.none(), st.floats(0.5, 500.0), st.sampled_from([10.0, 0.0])), min_size=0, max_size=90
    )
)
def test_any_short_series(spark, closes):
    if closes:
        check(spark, {"h": closes}, bounded=True)


def test_partitions_do_not_matter(spark):
    series = {f"s{i}": walk(120, 20 + i) for i in range(6)}
    results = []
    for n in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            rows = engineer_features(make_prices(spark, series), bounded=True).toPandas()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        results.append(rows.sort_values(["symbol", "Date"]).reset_index(drop=True))
    pd.testing.assert_frame_equal(results[0], results[1], check_exact=True)
    pd.testing.assert_frame_equal(results[0], results[2], check_exact=True)


@pytest.mark.parametrize(
    "values, alpha, want",
    [
        ([1, 2, None, 4, 5], alpha_from(span=3), [1, 1.5, 1.5, 3.1666666666666665, 4.083333333333333]),
        ([None, 1, 2, 3], alpha_from(com=13), [None, 1, 1.0714285714285714, 1.2091836734693877]),
    ],
)
def test_smoothed_mean_cases(spark, values, alpha, want):
    series = lay_out(make_prices(spark, {"x": values}), bounded=True)
    out = ewm_means(with_blocks(series, levels_for([alpha])), {"y": ("Close", alpha)}).result()
    got = [r["y"] for r in out.orderBy("_pos").collect()]
    assert got == pytest.approx(want)


def test_smoothed_mean_over_a_null_run_longer_than_a_halo(spark):
    values = [1.0, 3.0] + [None] * 9000 + [5.0, 6.0]
    series = lay_out(make_prices(spark, {"x": values}), series_rows=100, chunk_rows=4096)
    alpha = alpha_from(span=9)
    series = fill_forward(ewm_means(with_blocks(series, levels_for([alpha])), {"y": ("Close", alpha)}), ["y"])
    got = series.result().orderBy("_pos").toPandas()["y"]
    want = pd.Series([np.nan if v is None else v for v in values]).ewm(span=9, adjust=False).mean()
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_blocks_forget_enough_and_fit_a_double():
    for alpha in [0.01, 1 / 14, 2 / 27, 2 / 13, 0.2, 0.5, 0.99]:
        rows = block_rows(alpha)
        assert 1e19 < (1 - alpha) ** -float(rows) < 1e250
        if alpha > 0.03:
            assert slowest_decay(alpha) * rows >= 44


@pytest.mark.parametrize("layout", [{"bounded": True}, {"series_rows": 100, "chunk_rows": 4096}])
@pytest.mark.parametrize("alpha", [alpha_from(span=5000), 0.01])
def test_any_decay_over_gaps_equals_pandas(spark, layout, alpha):
    series = {
        "plain": walk(9000, 30), "gaps": walk(9000, 31, 0.3), "late": [None] * 5000 + walk(4000, 32, 0.05), "short": walk(3, 33),
        "hole": walk(4000, 34) + [None] * 9000 + walk(1500, 35, 0.5), "none": [None] * 50, "rare": walk(9000, 36, 0.999),
    }
    laid = lay_out(make_prices(spark, series, shuffle=False), **layout)
    got = ewm_means(with_blocks(laid, levels_for([alpha, 0.2])), {"y": ("Close", alpha), "fast": ("Close", 0.2)}).result().toPandas()
    for symbol, closes in series.items():
        mine = got[got.symbol == symbol].sort_values("_pos")
        prices = pd.Series([np.nan if c is None else c for c in closes], dtype=float)
        np.testing.assert_allclose(mine.y, prices.ewm(alpha=alpha, adjust=False).mean(), rtol=1e-10)
        assert list(mine._pos) == list(range(len(closes)))


def test_slow_decay_of_a_gapless_series(spark):
    closes = walk(9000, 30)
    for layout in ({"bounded": True, "gapless": True}, {"series_rows": 100, "chunk_rows": 4096}):
        whole = lay_out(make_prices(spark, {"x": closes}), **layout)
        got = ewm_means(with_blocks(whole, levels_for([0.001])), {"y": ("Close", 0.001)}).result().orderBy("_pos").toPandas()["y"]
        np.testing.assert_allclose(got, pd.Series(closes).ewm(alpha=0.001, adjust=False).mean(), rtol=1e-10)


def test_rsi_small_cases(spark):
    from barwatch.functions import indicators as ind

    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], "u double, d double")
    got = [r[0] for r in rows.select(ind.relative_strength("u", "d")).collect()]
    assert got == [None, 100.0, 50.0]


GOLDEN_CLOSES = [60.09313201904297, 67.29277801513672]


def test_published_return(spark):
    """Consecutive rows of a published result file."""
    series = lay_out(make_prices(spark, {"x": GOLDEN_CLOSES}), bounded=True)
    from barwatch.functions import indicators as ind

    got = series.rows.select("_pos", ind.daily_return(series.window()).alias("r")).orderBy("_pos").collect()
    assert got[1]["r"] == pytest.approx(0.11980813371172339, abs=1e-15)


def test_equal_dates_are_ordered_by_price(spark):
    day = dt.date(2020, 1, 1)
    rows = [("x", day, float(c), 1.0, 1.0, 1.0, 1) for c in [3, 1, 2, 2]]
    series = lay_out(spark.createDataFrame(rows, SCHEMA), bounded=True)
    assert [r["Close"] for r in series.rows.orderBy("_pos").collect()] == [1.0, 2.0, 2.0, 3.0]
    chunked = lay_out(spark.createDataFrame(rows, SCHEMA), series_rows=1, chunk_rows=4096)
    assert [r["Close"] for r in chunked.result().orderBy("_pos").collect()] == [1.0, 2.0, 2.0, 3.0]


def test_plan_has_one_exchange_and_two_sorts(spark):
    prices = spark.createDataFrame([], SCHEMA)
    plan = engineer_features(prices, bounded=True, gapless=True)
    text = plan._jdf.queryExecution().sparkPlan().toString() + plan._jdf.queryExecution().executedPlan().toString()
    executed = text.split("AdaptiveSparkPlan")[-1]
    assert executed.count("Exchange hashpartitioning") == 1
    assert executed.count("+- Sort [") == 2 or executed.count("Sort [") == 2
