"""The same queries in DuckDB SQL, written from the definitions.

Smoothed means follow their recursion row by row (a recursive CTE), not the
block form that the Spark operators use.
"""

from __future__ import annotations

from itertools import combinations

from barwatch.plans.catalog import FIXED_CENTRES, FIXED_SPACE, FIXED_SPREADS, FIXED_WEIGHTS, PRICE_DIGITS
from barwatch.schema import FEATURES, INDICATORS, OHLCV

_PRICE_COLUMNS = '"Close", "High", "Low", "Open", "Volume"'

BARS = """bars AS MATERIALIZED (
  SELECT o_orderpriority AS symbol, o_orderdate::DATE AS "Date", arg_max(o_totalprice, o_orderkey) AS "Close",
         max(o_totalprice) AS "High", min(o_totalprice) AS "Low", arg_min(o_totalprice, o_orderkey) AS "Open",
         count(*)::BIGINT AS "Volume"
  FROM orders GROUP BY 1, 2)"""

BARS_BRAND = """bars AS MATERIALIZED (
  SELECT p_brand AS symbol, l_shipdate::DATE AS "Date",
         arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS "Close",
         max(l_extendedprice) AS "High", min(l_extendedprice) AS "Low",
         arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS "Open",
         count(*)::BIGINT AS "Volume"
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""

BARS_HOURLY = """bars AS MATERIALIZED (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS "Date", arg_max(value, ts) AS "Close",
         max(value) AS "High", min(value) AS "Low", arg_min(value, ts) AS "Open", count(*)::BIGINT AS "Volume"
  FROM events GROUP BY 1, 2)"""

TICKS = """bars AS MATERIALIZED (
  SELECT l_returnflag AS symbol, l_shipdate::DATE AS "Date", l_extendedprice AS "Close",
         l_extendedprice * (1 + l_tax) AS "High", l_extendedprice * (1 - l_discount) AS "Low",
         l_extendedprice / l_quantity AS "Open", l_orderkey AS "Volume"
  FROM lineitem)"""

STILL = TICKS.replace('l_extendedprice AS "Close"', 'least(l_extendedprice, 1050.0::DOUBLE) AS "Close"')

# The recursion over the rows that have a price; a share of 2 / 5001 a row.
_SLOW = """ordered AS MATERIALIZED (
  SELECT symbol, x, row_number() OVER (PARTITION BY symbol ORDER BY "Date", x NULLS FIRST, "High", "Low", "Open", "Volume") AS rn
  FROM (SELECT *, CASE WHEN "Volume" % 7 <> 0 THEN "Close" END AS x FROM bars)),
seen AS MATERIALIZED (
  SELECT symbol, rn, x, row_number() OVER w AS i, pow(1 - 2 / 5001.0::DOUBLE, rn - lag(rn) OVER w) AS kept
  FROM ordered WHERE x IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
slow AS (
  SELECT symbol, rn, i, x AS y FROM seen WHERE i = 1
  UNION ALL
  SELECT n.symbol, n.rn, n.i, (n.kept * s.y + 2 / 5001.0::DOUBLE * n.x) / (n.kept + 2 / 5001.0::DOUBLE)
  FROM slow s JOIN seen n ON n.symbol = s.symbol AND n.i = s.i + 1)"""

# Rows in order, changes, and the four smoothed means in one recursion.
_FEATURES = """ordered AS MATERIALIZED (
  SELECT *, row_number() OVER w AS rn, "Close" - lag("Close") OVER w AS change,
         CASE WHEN row_number() OVER w = 1 THEN 0.0 ELSE "Close" / nullif(lag("Close") OVER w, 0) - 1 END AS "Return"
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY "Date", "Close", "High", "Low", "Open", "Volume")),
moves AS MATERIALIZED (
  SELECT *, CASE WHEN change IS NOT NULL THEN greatest(change, 0.0) END AS up,
         CASE WHEN change IS NOT NULL THEN greatest(-change, 0.0) END AS down FROM ordered),
smooth AS (
  SELECT symbol, rn, "Close" AS fast, "Close" AS slow, 0.0::DOUBLE AS sig, NULL::DOUBLE AS eu, NULL::DOUBLE AS ed
  FROM moves WHERE rn = 1
  UNION ALL
  SELECT m.symbol, m.rn, s.fast * (11 / 13.0::DOUBLE) + m."Close" * (2 / 13.0::DOUBLE),
         s.slow * (25 / 27.0::DOUBLE) + m."Close" * (2 / 27.0::DOUBLE),
         s.sig * 0.8::DOUBLE + 0.2::DOUBLE * ((s.fast * (11 / 13.0::DOUBLE) + m."Close" * (2 / 13.0::DOUBLE))
                              - (s.slow * (25 / 27.0::DOUBLE) + m."Close" * (2 / 27.0::DOUBLE))),
         CASE WHEN s.eu IS NULL THEN m.up ELSE s.eu * (13 / 14.0::DOUBLE) + m.up * (1 / 14.0::DOUBLE) END,
         CASE WHEN s.ed IS NULL THEN m.down ELSE s.ed * (13 / 14.0::DOUBLE) + m.down * (1 / 14.0::DOUBLE) END
  FROM smooth s JOIN moves m ON m.symbol = s.symbol AND m.rn = s.rn + 1),
indicated AS MATERIALIZED (
  SELECT m.*, s.fast, s.eu, s.ed,
         CASE WHEN count("Close") OVER f7 = 7 THEN avg("Close") OVER f7 END AS "MA_7",
         CASE WHEN count("Close") OVER f30 = 30 THEN avg("Close") OVER f30 END AS "MA_30",
         CASE WHEN count("Return") OVER f14 = 14 THEN stddev_samp("Return") OVER f14 END AS "Vol_14",
         CASE WHEN s.ed = 0 AND s.eu = 0 THEN NULL WHEN s.ed = 0 THEN 100.0
              ELSE 100 - 100 / (1 + s.eu / s.ed) END AS "RSI_14",
         s.fast - s.slow AS "MACD", s.sig AS "MACD_Signal"
  FROM moves m JOIN smooth s USING (symbol, rn)
  WINDOW f7 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         f14 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
         f30 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
featured AS MATERIALIZED (
  SELECT * FROM indicated
  WHERE "MA_7" IS NOT NULL AND "MA_30" IS NOT NULL AND "Vol_14" IS NOT NULL AND "RSI_14" IS NOT NULL
    AND "Return" IS NOT NULL)"""


def _z(column: str, deviation: str = "stddev_samp") -> str:
    over = "OVER (PARTITION BY symbol)"
    return f'coalesce(("{column}" - avg("{column}") {over}) / nullif({deviation}("{column}") {over}, 0), 0.0)'


def _squares(centre: list[float]) -> str:
    return " + ".join(f"(z{i} - ({x}::DOUBLE)) * (z{i} - ({x}::DOUBLE))" for i, x in enumerate(centre))


_SPACE = f"""space AS MATERIALIZED (
  SELECT *, {", ".join(f"{_z(c)} AS z{i}" for i, c in enumerate(FIXED_SPACE))} FROM featured)"""

_SCORED = f"""{_SPACE},
reach AS MATERIALIZED (
  SELECT *, {", ".join(f"sqrt({_squares(c)}) AS d{i}" for i, c in enumerate(FIXED_CENTRES))} FROM space),
assigned AS MATERIALIZED (
  SELECT *, least({", ".join(f"d{i}" for i in range(len(FIXED_CENTRES)))}) AS distance,
         list_position([{", ".join(f"d{i}" for i in range(len(FIXED_CENTRES)))}],
                       least({", ".join(f"d{i}" for i in range(len(FIXED_CENTRES)))}))::INTEGER - 1 AS cluster
  FROM reach),
stats AS MATERIALIZED (
  SELECT symbol, avg(distance) AS mean_score, stddev_samp(distance) AS std_score,
         avg(distance) + 3.0::DOUBLE * stddev_samp(distance) AS threshold
  FROM assigned GROUP BY symbol),
scored AS MATERIALIZED (
  SELECT a.*, s.threshold, coalesce(a.distance > s.threshold, false)::INTEGER AS is_anomaly
  FROM assigned a JOIN stats s USING (symbol))"""


def _r(column: str, digits: int | None = None, source: str | None = None) -> str:
    places = digits or PRICE_DIGITS.get(column, 6)
    return f'round({source or _q(column)}, {places}) + 0.0 AS {_q(column)}'


def _q(column: str) -> str:
    return f'"{column}"'


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def _over_features(select: str, source: str = BARS) -> str:
    return _with(source, _FEATURES) + select


def _over_scored(select: str) -> str:
    return _with(BARS, _FEATURES, _SCORED) + select


def _feature_table(source: str) -> str:
    prices = ", ".join(_r(c) if c != "Volume" else '"Volume"' for c in OHLCV[1:])
    return _over_features(
        f'SELECT symbol, "Date", {prices}, {", ".join(_r(c) for c in INDICATORS)} FROM featured', source
    )


def _tick_table() -> str:
    columns = ", ".join(_r(c, PRICE_DIGITS.get(c, 5)) for c in ["Close", *INDICATORS])
    return _over_features(f'SELECT symbol, rn - 1 AS position, "Date", {columns} FROM featured', TICKS)


_RUNS = """runs AS (
  SELECT event_id::VARCHAR AS run_id, user_id::VARCHAR AS user_id, ts AS run_timestamp,
         'upload_' || event_id || '.csv' AS original_filename,
         CASE WHEN event_id % 7 <> 0 THEN upper(event_type) END AS stock_symbol, event_type AS model_used,
         CASE WHEN event_id % 5 <> 0 THEN floor(value)::BIGINT END AS anomalies_found,
         event_id || '_results.csv' AS results_filename
  FROM events)"""

_RUN_COLUMNS = """run_id, user_id, run_timestamp, coalesce(stock_symbol, 'N/A') AS stock_symbol, model_used,
  coalesce(anomalies_found, 0) AS anomalies_found"""


def _title(text: str) -> str:
    words = f"string_split(replace({text}, '_', ' '), ' ')"
    return f"list_aggregate(list_transform({words}, lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', ' ')"


_TEXT_DATES = """dated AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate::DATE END AS "Date",
         o_totalprice AS "Close" FROM orders)"""

_PAIRS = list(combinations(FEATURES, 2))


def _pair_rows() -> str:
    # DuckDB's corr() of a constant column is NaN, which counts as undefined.
    return " UNION ALL ".join(
        f"""SELECT symbol, {i} AS i, {FEATURES.index(b)} AS j, '{a}' AS col_i, '{b}' AS col_j,
        CASE WHEN isnan(corr("{a}", "{b}")) THEN NULL ELSE corr("{a}", "{b}") END AS corr FROM featured GROUP BY symbol"""
        for a, b in _PAIRS
        for i in [FEATURES.index(a)]
    )


_COMPARED = ["Return", "Volume", "Vol_14", "RSI_14"]
_COMPARISON = "compared AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, avg(abs(coalesce("{c}", 0))) AS normal,
    avg(CASE WHEN is_anomaly = 1 THEN abs(coalesce("{c}", 0)) END) AS anomaly FROM scored"""
    for c in _COMPARED
) + ")"

_POSTERIOR = f"""{_SPACE},
weighed AS (SELECT *, {", ".join(f"exp(-0.5::DOUBLE * ({_squares(c)})) AS w{i}" for i, c in enumerate(FIXED_CENTRES))} FROM space),
posterior AS (
  SELECT *, greatest({", ".join(f"w{i}" for i in range(len(FIXED_CENTRES)))})
            / ({" + ".join(f"w{i}" for i in range(len(FIXED_CENTRES)))}) AS max_prob FROM weighed)"""


# What models read: scales of each symbol, and the columns that no earlier one is collinear with.
_ENTRIES = "entries AS MATERIALIZED (" + " UNION ALL ".join(
    f'SELECT symbol, "Date", {i} AS j, {_z(c)} AS x FROM featured' for i, c in enumerate(FEATURES)
) + ")"
_PLACES = f"(VALUES {', '.join(f'({i})' for i in range(len(FEATURES)))}) f(j)"
_KEPT = f"""pairs AS MATERIALIZED ({_pair_rows()}),
kept AS (
  SELECT s.symbol, f.j, row_number() OVER (PARTITION BY s.symbol ORDER BY f.j)::INTEGER - 1 AS place, s.group_rows
  FROM (SELECT symbol, count(*)::BIGINT AS group_rows FROM featured GROUP BY symbol) s CROSS JOIN {_PLACES}
  WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.symbol = s.symbol AND p.j = f.j AND abs(p.corr) >= 0.95))"""
_KEPT_POOLED = f"""pairs AS MATERIALIZED ({_pair_rows()}),
sizes AS (SELECT symbol, count(*)::BIGINT AS n FROM featured GROUP BY symbol),
pooled AS (SELECT j, sum(corr * (n - 1)) / sum(n - 1) AS r FROM pairs JOIN sizes USING (symbol) WHERE corr IS NOT NULL GROUP BY i, j),
kept AS (
  SELECT s.symbol, f.j, row_number() OVER (PARTITION BY s.symbol ORDER BY f.j)::INTEGER - 1 AS place, (SELECT sum(n)::BIGINT FROM sizes) AS group_rows
  FROM sizes s CROSS JOIN {_PLACES} WHERE NOT EXISTS (SELECT 1 FROM pooled p WHERE p.j = f.j AND abs(p.r) >= 0.95))"""
_MODEL_ROWS = 'SELECT symbol, "Date", group_rows, place, round(x, 5) + 0.0 AS x FROM entries JOIN kept USING (symbol, j)'

# Rows from 1997 on in the scales of those before.
_STORED_SPACE = "space AS MATERIALIZED (SELECT f.*, " + ", ".join(
    f'coalesce((f."{c}" - m{i}) / nullif(s{i}, 0), 0.0) AS z{i}' for i, c in enumerate(FIXED_SPACE)
) + " FROM featured f JOIN (SELECT symbol, " + ", ".join(
    f'avg("{c}") AS m{i}, stddev_samp("{c}") AS s{i}' for i, c in enumerate(FIXED_SPACE)
) + """ FROM featured WHERE year("Date") < 1997 GROUP BY symbol) USING (symbol) WHERE year("Date") >= 1997)"""
_REACH = ", ".join(f"sqrt({_squares(c)})" for c in FIXED_CENTRES)
_SHARES = ", ".join(
    f"{w}::DOUBLE * pow({s}::DOUBLE, -{len(FIXED_SPACE)}) * exp(-0.5::DOUBLE * ({_squares(c)}) / ({s * s}::DOUBLE))"
    for w, s, c in zip(FIXED_WEIGHTS, FIXED_SPREADS, FIXED_CENTRES)
)


def _stored(score: str, threshold: float) -> str:
    return _with(BARS, _FEATURES, _STORED_SPACE) + f"""SELECT symbol, "Date", cluster, round(distance, 5) + 0.0 AS distance,
    {threshold}::DOUBLE AS threshold, (distance > {threshold}::DOUBLE)::INTEGER AS is_anomaly FROM ({score})"""


def _standardised(deviation: str) -> str:
    columns = ", ".join(_r(c, source=_z(c, deviation)) for c in INDICATORS)
    return _over_features(f'SELECT symbol, "Date", {columns}, 0.0::DOUBLE AS "Constant" FROM featured')


def _indicator(column: str, expression: str | None = None) -> str:
    return _over_features(f'SELECT symbol, "Date", {_r(column, source=expression)} FROM indicated')


def _plain(select: str) -> str:
    return _with(BARS) + select


_ROLL = 'PARTITION BY symbol ORDER BY "Date" ROWS BETWEEN {n} PRECEDING AND CURRENT ROW'


def _moving_average(n: int) -> str:
    frame = f"({_ROLL.format(n=n - 1)})"
    value = f'CASE WHEN count("Close") OVER {frame} = {n} THEN avg("Close") OVER {frame} END'
    return _plain(f'SELECT symbol, "Date", {_r(f"MA_{n}", source=value)} FROM bars')


def oracle_sql() -> dict[str, str]:
    scored_prices = ", ".join(_r(c) for c in ["Close", "High", "Low"])
    return {
        "volatile_days": _over_features(
            f"""SELECT f.symbol, f."Date", {_r("Close")}, {_r("Return")}, {_r("distance", source='abs("Return")')},
            {_r("threshold")} FROM featured f JOIN (SELECT symbol, avg(abs("Return")) + 3.0::DOUBLE * stddev_samp(abs("Return"))
            AS threshold FROM featured GROUP BY symbol) USING (symbol) WHERE abs("Return") > threshold"""
        ),
        "ohlcv_csv_scan": _plain(f'SELECT symbol, "Date", {", ".join(_r(c) for c in OHLCV[1:5])}, "Volume" FROM bars'),
        "ohlcv_csv_intraday": _with(BARS_HOURLY) + f'SELECT symbol, "Date", {", ".join(_r(c) for c in OHLCV[1:5])}, "Volume" FROM bars',
        "rsi_flat_runs": _over_features(f'SELECT symbol, rn - 1 AS position, {_r("RSI_14")} FROM indicated', STILL),
        "ewm_slow": _with(TICKS, _SLOW) + f"""SELECT symbol, rn - 1 AS position, {_r("ewm_5000", source='last_value(y IGNORE NULLS) OVER w')}
        FROM ordered LEFT JOIN slow USING (symbol, rn)
        WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "model_input": _with(BARS, _FEATURES, _ENTRIES, _KEPT) + _MODEL_ROWS,
        "model_input_pooled": _with(BARS, _FEATURES, _ENTRIES, _KEPT_POOLED) + _MODEL_ROWS,
        "stored_kmeans_scores": _stored(
            f"SELECT *, list_min(d) AS distance, list_position(d, list_min(d))::INTEGER - 1 AS cluster FROM (SELECT *, [{_REACH}] AS d FROM space)", 2.5
        ),
        "stored_mixture_scores": _stored(
            f"""SELECT *, -ln(list_max(w) / list_sum(w) + 1e-9::DOUBLE) AS distance, list_position(w, list_max(w))::INTEGER - 1 AS cluster
            FROM (SELECT *, [{_SHARES}] AS w FROM space)""", 0.5
        ),
        "stored_centres": _over_scored(
            "SELECT symbol, row_number() OVER (PARTITION BY symbol, place ORDER BY c)::INTEGER - 1 AS cluster, place, round(x, 5) + 0.0 AS x FROM ("
            + " UNION ALL ".join(f"SELECT symbol, cluster AS c, {i} AS place, avg(z{i}) AS x FROM assigned GROUP BY 1, 2" for i in range(len(FIXED_SPACE)))
            + ")"
        ),
        "run_from_csv": _over_features(
            """SELECT '8' AS user_id, TIMESTAMP '2024-01-31 00:00:00' AS run_timestamp, 'UNKNOWN' AS stock_symbol, 'kmeans' AS model_used,
            count(*)::BIGINT AS rows_processed, count(*)::BIGINT AS json_rows, 5::BIGINT AS centres, true AS counts_agree, true AS rows_agree
            FROM featured"""
        ),
        "normalize_columns": _plain(
            """SELECT symbol AS "Symbol", "Date", "Close", "High", "Low" AS "Adj low", "Volume" AS "Ma_7" FROM bars"""
        ),
        "parse_dates": _with(_TEXT_DATES) + 'SELECT o_orderkey, "Date" FROM dated',
        "drop_null_dates": _with(_TEXT_DATES) + 'SELECT * FROM dated WHERE "Date" IS NOT NULL',
        "drop_incomplete": _plain(
            f"""SELECT symbol, "Date", {", ".join(_r(c) for c in OHLCV[1:5])}, "Volume" FROM bars
            WHERE "Volume" % 5 <> 0 AND "Volume" % 3 <> 0"""
        ),
        "preview": """SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority
            FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50) WHERE o_orderkey % 3 <> 0""",
        "price_history": _plain(
            f"""SELECT "Date", {", ".join(_r(c) for c in OHLCV[1:5])}, "Volume" FROM bars
            WHERE symbol = '1-URGENT' AND "Date" >= DATE '1996-01-01' AND "Date" < DATE '1998-01-01'"""
        ),
        "price_store_range": _plain(
            f"""SELECT "Date", {", ".join(_r(c) for c in OHLCV[1:5])}, "Volume" FROM bars
            WHERE symbol = '1-URGENT' AND "Date" >= DATE '1996-01-01' AND "Date" < DATE '1998-01-01'"""
        ),
        "result_sink_roundtrip": _over_scored(
            """SELECT symbol, "Date", round(distance, 5) + 0.0 AS distance, is_anomaly, 'kmeans' AS model_used,
            4 AS width, round(z2, 5) + 0.0 AS z_rsi FROM scored"""
        ),
        "result_json": _over_scored(
            f"""SELECT symbol, strftime("Date", '%Y-%m-%d') AS day, {_r("Close")}, "Volume", cluster, {_r("distance")}
            FROM scored"""
        ),
        "history_record": _over_scored(
            """SELECT 'run-1' AS run_id, '8' AS user_id, TIMESTAMP '2024-01-31 00:00:00' AS run_timestamp,
            'prices.csv' AS original_filename, 'ORDERS' AS stock_symbol, 'kmeans' AS model_used,
            3.0::DOUBLE AS threshold_multiplier, count(*)::BIGINT AS rows_processed,
            sum(is_anomaly)::BIGINT AS anomalies_found, '20240131_000000_kmeans_results.csv' AS results_filename
            FROM scored"""
        ),
        "daily_return": _plain(
            """SELECT symbol, "Date", CASE WHEN row_number() OVER w = 1 THEN 0.0
            ELSE round("Close" / nullif(lag("Close") OVER w, 0) - 1, 6) + 0.0 END AS "Return"
            FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY "Date")"""
        ),
        "ma_7": _moving_average(7),
        "ma_30": _moving_average(30),
        "vol_14": _indicator("Vol_14"),
        "close_diff": _indicator("change"),
        "gain_loss": _over_features(f'SELECT symbol, "Date", {_r("up")}, {_r("down")} FROM moves'),
        "ewm_span": _indicator("ewm_12", "fast"),
        "ewm_com": _indicator("ewm_14", "eu"),
        "rsi_14": _indicator("RSI_14"),
        "macd": _indicator("MACD"),
        "macd_signal": _indicator("MACD_Signal"),
        "warmup_trim": _plain(
            """SELECT symbol, count(*) AS kept, min("Date") AS first_day, max("Date") AS last_day
            FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "Date") AS rn FROM bars)
            WHERE rn >= 30 GROUP BY symbol"""
        ),
        "engineer_features": _feature_table(BARS),
        "engineer_features_brand": _feature_table(BARS_BRAND),
        "engineer_features_hourly": _feature_table(BARS_HOURLY),
        "engineer_features_ticks": _tick_table(),
        "engineer_features_chunked": _tick_table(),
        "correlation_matrix": _over_features(
            f"SELECT symbol, col_i, col_j, {_r('corr')} FROM ({_pair_rows()})"
        ),
        "select_features": _over_features(
            f"""SELECT s.symbol, f.feature FROM (SELECT DISTINCT symbol FROM featured) s
            CROSS JOIN (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(FEATURES))}) f(j, feature)
            WHERE NOT EXISTS (SELECT 1 FROM ({_pair_rows()}) p
                              WHERE p.symbol = s.symbol AND p.j = f.j AND abs(p.corr) >= 0.95)"""
        ),
        "assemble": _over_features(
            """SELECT symbol, "Date", round("Close", 3) + 0.0 AS v0, "Volume"::DOUBLE AS v1,
            round("Return", 3) + 0.0 AS v2, round("RSI_14", 3) + 0.0 AS v3 FROM featured"""
        ),
        "standardize": _standardised("stddev_samp"),
        "standardize_pop": _standardised("stddev_pop"),
        "kmeans_assign_fixed": _over_scored('SELECT symbol, "Date", cluster FROM assigned'),
        "distance_to_center": _over_scored(f'SELECT symbol, "Date", cluster, {_r("distance")} FROM assigned'),
        "embedding_distances": """WITH entries AS (
              SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS place FROM embeddings),
            means AS (SELECT label, place, avg(x) AS m FROM entries GROUP BY 1, 2)
            SELECT vec_id, label, round(sqrt(sum((x - m) * (x - m))), 6) + 0.0 AS distance
            FROM entries JOIN means USING (label, place) GROUP BY 1, 2""",
        "gmm_max_posterior": _with(BARS, _FEATURES, _POSTERIOR)
        + f'SELECT symbol, "Date", {_r("max_prob")} FROM posterior',
        "gmm_score": _with(BARS, _FEATURES, _POSTERIOR)
        + f"""SELECT symbol, "Date", {_r("score", source="-ln(max_prob + 1e-9::DOUBLE)")} FROM posterior""",
        "score_stats": _over_scored(f"SELECT symbol, {_r('mean_score')}, {_r('std_score')} FROM stats"),
        "adaptive_threshold": _over_scored(f"SELECT symbol, {_r('threshold')} FROM stats"),
        "threshold_anomalies": _over_scored(
            f'SELECT symbol, "Date", {_r("distance")}, {_r("threshold")} FROM scored WHERE distance > threshold'
        ),
        "threshold_normals": _over_scored(
            f'SELECT symbol, "Date", {_r("distance")}, {_r("threshold")} FROM scored WHERE distance <= threshold'
        ),
        "anomaly_flag": _over_scored('SELECT symbol, "Date", is_anomaly FROM scored'),
        "contamination_cut": _over_features(
            f"""SELECT symbol, {_r("threshold", source='-quantile_cont(-abs("Return"), 0.05)')}
            FROM featured GROUP BY symbol"""
        ),
        "select_existing": _over_scored(
            f'SELECT "Date", {scored_prices}, cluster, {_r("distance")} FROM scored'
        ),
        "volume_direction": _plain(
            """SELECT symbol, "Date", "Volume", CASE WHEN "Close" >= "Open" THEN 'up' ELSE 'down' END AS direction
            FROM bars"""
        ),
        "price_overlay": _over_scored(
            f"""SELECT symbol, "Date", {_r("Close")},
            {_r("anomaly_close", source='CASE WHEN is_anomaly = 1 THEN "Close" END')} FROM scored"""
        ),
        "distance_series": _over_scored(f'SELECT symbol, "Date", {_r("distance")}, {_r("threshold")} FROM scored'),
        "run_summary": _over_scored(
            """SELECT count(*)::BIGINT AS "rows", sum(is_anomaly)::BIGINT AS anomalies,
            count(DISTINCT cluster)::BIGINT AS clusters FROM scored"""
        ),
        "anomaly_distribution": _over_scored(
            """SELECT 'Cluster ' || cluster AS cluster_label, count(*)::BIGINT AS anomalies FROM scored
            WHERE is_anomaly = 1 GROUP BY cluster"""
        ),
        "feature_comparison": _with(BARS, _FEATURES, _SCORED, _COMPARISON)
        + f"SELECT feature, {_r('normal')}, {_r('anomaly')} FROM compared",
        "feature_comparison_normalized": _with(BARS, _FEATURES, _SCORED, _COMPARISON)
        + f"""SELECT feature, {_r("normal", source="normal / m")}, {_r("anomaly", source="anomaly / m")}
        FROM compared, (SELECT max(greatest(normal, anomaly)) AS m FROM compared)""",
        "history_for_user": _with(_RUNS) + f"SELECT {_RUN_COLUMNS} FROM runs WHERE user_id = '8'",
        "history_sorted": _with(_RUNS) + f"SELECT {_RUN_COLUMNS} FROM runs ORDER BY run_timestamp DESC, run_id",
        "recent_runs": _with(_RUNS)
        + f"""SELECT {_RUN_COLUMNS}, row_number() OVER (PARTITION BY user_id ORDER BY run_timestamp DESC, run_id)::INTEGER
        AS place FROM runs QUALIFY place <= 5""",
        "most_used_model": _with(_RUNS)
        + """SELECT user_id, model_used AS most_used_model FROM (
            SELECT user_id, model_used, count(*) AS uses, min(run_timestamp) AS first_use FROM runs GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY uses DESC, first_use) = 1""",
        "user_dashboard_summary": _with(_RUNS)
        + f"""SELECT t.*, {_title("m.model_used")} AS most_used_model FROM (
            SELECT user_id, count(*)::BIGINT AS total_analyses, sum(coalesce(anomalies_found, 0))::BIGINT AS total_anomalies,
                   max(run_timestamp) AS last_analysis_date FROM runs GROUP BY 1) t
        JOIN (SELECT user_id, model_used FROM (
                SELECT user_id, model_used, count(*) AS uses, min(run_timestamp) AS first_use FROM runs GROUP BY 1, 2)
              QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY uses DESC, first_use) = 1) m USING (user_id)""",
        "daily_activity": _with(_RUNS)
        + """SELECT user_id, strftime(run_timestamp, '%Y-%m-%d') AS day, count(*)::BIGINT AS runs FROM runs
        WHERE run_timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY GROUP BY 1, 2 ORDER BY 1, 2""",
        "history_display": _with(_RUNS)
        + f"""SELECT run_id, strftime(run_timestamp, '%b %d, %Y %H:%M') AS run_time,
        strftime(run_timestamp, '%b %d, %Y') AS run_date, coalesce(stock_symbol, 'N/A') AS stock_symbol,
        original_filename, {_title("model_used")} AS model,
        coalesce(anomalies_found, 0) AS anomalies_found, results_filename FROM runs""",
        "model_label": f"""SELECT {_title("event_type || '_one_class_SVM'")} AS label, count(*)::BIGINT AS runs
        FROM events GROUP BY event_type""",
    }
