"""Queries of the window features and of the recursive indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.functions import recursive
from tidemark.sources.bars import derive_bars, with_bars

KEYS = ("instrument_id", "trade_date")
P = "PARTITION BY instrument_id ORDER BY trade_date"


def rounded(df: DataFrame, names, digits: int = 8) -> DataFrame:
    return df.select(*KEYS, *[F.round(n, digits).alias(n) for n in names])


# ---- DuckDB text of the same definitions


def q_full(agg: str, x: str, n: int, last: int = 0) -> str:
    """``agg`` over a full frame of ``n`` rows ending ``-last`` rows ago."""
    end = "CURRENT ROW" if last == 0 else f"{-last} PRECEDING"
    over = f"OVER ({P} ROWS BETWEEN {n - 1 - last} PRECEDING AND {end})"
    return f"CASE WHEN count({x}) {over} = {n} THEN {agg}({x}) {over} END"


def q_lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({P})"


def q_cross(fast: str, slow: str) -> str:
    """Over columns ``fast``, ``slow`` and their lags ``fast_1``, ``slow_1``."""
    return f"CASE WHEN {fast} IS NOT NULL AND {slow} IS NOT NULL AND {fast}_1 IS NOT NULL AND {slow}_1 IS NOT NULL THEN CASE WHEN {fast} > {slow} AND {fast}_1 <= {slow}_1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END"


TR = f"""tr AS (
  SELECT *, CASE WHEN p IS NOT NULL THEN greatest(high - low, abs(high - p), abs(low - p)) END AS tr, ln(close / p) AS lr, close * volume AS dv
  FROM (SELECT *, {q_lag("close")} AS p FROM bars))"""


def q_rounded(columns: dict[str, str], source: str, *ctes: str) -> str:
    return with_bars("SELECT instrument_id, trade_date, " + ", ".join(f"round({x}, 8) AS {n}" for n, x in columns.items()) + f" FROM {source}", *ctes)


INITIAL = {
    "sma_50": q_full("avg", "close", 50),
    "sma_200": q_full("avg", "close", 200),
    "atr_14": q_full("avg", "tr", 14),
    "return_60": f"close / {q_lag('close', 60)} - 1",
    "avg_dollar_volume_20": q_full("avg", "dv", 20),
    "rolling_range_pct_30": f"({q_full('max', 'high', 30)} - {q_full('min', 'low', 30)}) / close * 100",
}

SMAS = "smas AS (SELECT *, " + ", ".join(f"{q_full('avg', 'close', n)} AS sma_{n}" for n in (20, 50, 200)) + " FROM tr)"
SMAS_LAG = f"lagged AS (SELECT *, {q_lag('sma_50')} AS sma_50_1, {q_lag('sma_200')} AS sma_200_1 FROM smas)"
MARKET = {
    **{f"return_{n}": f"close / {q_lag('close', n)} - 1" for n in (5, 20, 252)},
    "realized_volatility_20": f"({q_full('stddev_samp', 'lr', 20)}) * sqrt(252)",
    "relative_volume_20": f"volume / ({q_full('avg', 'volume', 20, -1)})",
    "average_dollar_volume_20": q_full("avg", "dv", 20, -1),
    "atr_pct_14": f"({q_full('avg', 'tr', 14)}) / close * 100",
    **{f"distance_sma_{n}_pct": f"(close / sma_{n} - 1) * 100" for n in (20, 50, 200)},
    **{f"sma_{n}_slope_20_pct": f"(sma_{n} / {q_lag(f'sma_{n}', 20)} - 1) * 100" for n in (50, 200)},
    "sma_50_200_spread_pct": "(sma_50 / sma_200 - 1) * 100",
    "sma_50_200_cross_up": q_cross("sma_50", "sma_200"),
    **{f"distance_prior_high_{n}_pct": f"(close / ({q_full('max', 'high', n, -1)}) - 1) * 100" for n in (20, 55)},
    "range_position_prior_20": f"CASE WHEN ({q_full('max', 'high', 20, -1)}) - ({q_full('min', 'low', 20, -1)}) > 0 THEN (close - ({q_full('min', 'low', 20, -1)})) / (({q_full('max', 'high', 20, -1)}) - ({q_full('min', 'low', 20, -1)})) END",
}

BANDS = f"bands AS (SELECT *, {q_full('avg', 'close', 20)} AS mid, {q_full('stddev_pop', 'close', 20)} AS sd FROM bars)"
EDGES = "edges AS (SELECT *, mid + 2 * sd AS up, mid - 2 * sd AS low_band FROM bands)"
EDGES_LAG = f"edges_lag AS (SELECT *, {q_lag('close')} AS close_1, {q_lag('mid')} AS mid_1, {q_lag('up')} AS up_1, {q_lag('low_band')} AS low_band_1 FROM edges)"
BOLLINGER = {
    "bb_upper_distance_pct": "close / up * 100 - 100",
    "bb_middle_distance_pct": "close / mid * 100 - 100",
    "bb_lower_distance_pct": "close / low_band * 100 - 100",
    "bb_upper_reached": "CAST(high >= up AS DOUBLE)",
    "bb_lower_reached": "CAST(low <= low_band AS DOUBLE)",
    "bb_upper_cross_up": q_cross("close", "up"),
    "bb_lower_cross_down": q_cross("low_band", "close"),
    "bb_middle_cross_up": q_cross("close", "mid"),
    "bb_middle_cross_down": q_cross("mid", "close"),
    "bb_bandwidth_pct": "(up - low_band) / mid * 100",
    "bb_position": "CASE WHEN up - low_band > 0 THEN (close - low_band) / (up - low_band) END",
}

PARAMETERISED = {
    "sma_10_distance_pct": f"(close / ({q_full('avg', 'close', 10)}) - 1) * 100",
    "roc_15_pct": f"(close / {q_lag('close', 15)} - 1) * 100",
    "rvol_10": f"volume / ({q_full('avg', 'volume', 10, -1)})",
    "adv_30": q_full("avg", "dv", 30, -1),
    "hv_30_pct": f"({q_full('stddev_samp', 'lr', 30)}) * sqrt(252) * 100",
    "prior_high_40_distance_pct": f"(close / ({q_full('max', 'high', 40, -1)}) - 1) * 100",
    "prior_high_40_breakout": f"CASE WHEN ({q_full('max', 'high', 40, -1)}) IS NOT NULL THEN CAST(close > ({q_full('max', 'high', 40, -1)}) AS DOUBLE) END",
    "narrow_range_7": f"CASE WHEN ({q_full('min', '(high - low)', 6, -1)}) IS NOT NULL THEN CAST((high - low) < ({q_full('min', '(high - low)', 6, -1)}) AS DOUBLE) END",
}


def feat_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.with_initial(derive_bars(spark, sf_dir)), INITIAL)


def feat_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.with_market(derive_bars(spark, sf_dir)), MARKET)


def pi_bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.with_bollinger(derive_bars(spark, sf_dir)), BOLLINGER)


def pi_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, v = F.col("close"), F.col("volume")
    df = derive_bars(spark, sf_dir).withColumn("lr", ind.log_return(c))
    df = (
        df.withColumn("sma_10_distance_pct", (c / ind.sma(c, 10) - 1) * 100)
        .withColumn("roc_15_pct", ind.roc_pct(c, 15))
        .withColumn("rvol_10", v / ind.full(F.avg, v, 10, -1))
        .withColumn("adv_30", ind.full(F.avg, c * v, 30, -1))
        .withColumn("hv_30_pct", ind.historical_volatility_pct(30))
        .withColumn("prior_high_40_distance_pct", (c / ind.full(F.max, F.col("high"), 40, -1) - 1) * 100)
        .withColumn("prior_high_40_breakout", ind.prior_high_breakout(40))
        .withColumn("narrow_range_7", ind.narrow_range(7))
    )
    return rounded(df, PARAMETERISED)


def sp_bandwidth_pctile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ind.with_bollinger(derive_bars(spark, sf_dir)).withColumn("bw", F.round("bb_bandwidth_pct", 8))
    return rounded(df.withColumn("bandwidth_percentile_60", ind.share_at_most(F.col("bw"), 60)), ["bandwidth_percentile_60"])


BANDWIDTH_SQL = with_bars(
    f"""SELECT a.instrument_id, a.trade_date, round(CASE WHEN n = 60 THEN 100.0 * len(list_filter(vals, lambda v: v <= bw)) / 60 END, 8) AS bandwidth_percentile_60
FROM (SELECT *, count(bw) OVER w AS n, list(bw) OVER w AS vals FROM (SELECT *, round((up - low_band) / mid * 100, 8) AS bw FROM edges)
      WINDOW w AS ({P} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) a""",
    BANDS,
    EDGES,
)


def feat_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by feature and availability status."""
    needs = {"sma_50": 50, "sma_200": 200, "atr_14": 15, "return_60": 61, "avg_dollar_volume_20": 20, "rolling_range_pct_30": 30}
    df = ind.with_initial(derive_bars(spark, sf_dir))
    status = df.select(*[ind.availability(n, k).alias(n) for n, k in needs.items()])
    pairs = ", ".join(f"'{n}', `{n}`" for n in needs)
    return status.selectExpr(f"stack({len(needs)}, {pairs}) as (feature_name, status)").groupBy("feature_name", "status").agg(F.count("*").alias("n"))


AVAILABILITY_SQL = with_bars(
    " UNION ALL ".join(
        f"SELECT '{n}' AS feature_name, CASE WHEN {x} IS NOT NULL THEN 'AVAILABLE' WHEN signal_index + 1 < {k} THEN 'WARMUP' ELSE 'INPUT_UNAVAILABLE' END AS status, count(*) AS n FROM vals GROUP BY ALL"
        for n, x, k in (("sma_50", "sma_50", 50), ("sma_200", "sma_200", 200), ("atr_14", "atr_14", 15), ("return_60", "return_60", 61), ("avg_dollar_volume_20", "avg_dollar_volume_20", 20), ("rolling_range_pct_30", "rolling_range_pct_30", 30))
    ),
    TR,
    "vals AS (SELECT signal_index, " + ", ".join(f"{x} AS {n}" for n, x in INITIAL.items()) + " FROM tr)",
)


def feature_store_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature store's long form, as (feature, rows, available rows, rounded sum)."""
    long = ind.to_long(ind.with_initial(derive_bars(spark, sf_dir)), list(INITIAL))
    return long.groupBy("feature_name").agg(F.count("*").alias("n_rows"), F.count("value").alias("n_values"), F.round(F.max("value"), 6).alias("max_value"))


FEATURE_STORE_SQL = with_bars(
    " UNION ALL ".join(f"SELECT '{n}' AS feature_name, count(*) AS n_rows, count({n}) AS n_values, round(max({n}), 6) AS max_value FROM vals" for n in INITIAL),
    TR,
    "vals AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in INITIAL.items()) + " FROM tr)",
)

# ---- recursive indicators: one pass a series in a grouped kernel; SQL by recursion over signal_index


def feat_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = recursive.apply(derive_bars(spark, sf_dir), {"ema_12": recursive.ema_of("close", 12), "ema_26": recursive.ema_of("close", 26)})
    return rounded(df, ["ema_12", "ema_26"], 6)


def feat_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recursive.apply(derive_bars(spark, sf_dir), {"rsi_14": recursive.rsi_of("close", 14)}), ["rsi_14"], 6)


def feat_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recursive.apply(derive_bars(spark, sf_dir), recursive.macd_set(12, 26, 9)), ["macd_line_pct", "macd_signal_pct", "macd_histogram_pct", "macd_bullish_cross"], 6)


def pi_atr_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recursive.apply(derive_bars(spark, sf_dir), {"atr_wilder_pct_14": recursive.atr_pct_of(14)}), ["atr_wilder_pct_14"], 6)


def sp_keltner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recursive.apply(derive_bars(spark, sf_dir), recursive.keltner_set(20, 10, 2.0)), ["kc_upper_distance_pct", "kc_lower_distance_pct", "kc_bandwidth_pct", "kc_position", "kc_upper_cross_up", "kc_lower_cross_down"], 6)


def _q_ema(n: int, name: str, source: str = "bars", x: str = "close", first: int = 0) -> str:
    """Recursive CTE: seed with the mean of ``n`` values, then smooth. ``first`` is the first usable signal_index."""
    a = 2.0 / (n + 1)
    return f"""{name} AS (
  SELECT instrument_id, {first + n - 1}::BIGINT AS i, avg({x}) AS e FROM {source} WHERE signal_index BETWEEN {first} AND {first + n - 1} GROUP BY 1 HAVING count(*) = {n}
  UNION ALL
  SELECT b.instrument_id, b.signal_index, {a!r}::DOUBLE * b.{x} + {1 - a!r}::DOUBLE * r.e FROM {name} r JOIN {source} b ON b.instrument_id = r.instrument_id AND b.signal_index = r.i + 1)"""


def recursive_sql(body: str, *ctes: str) -> str:
    return with_bars(body, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


EMA_SQL = recursive_sql("SELECT b.instrument_id, b.trade_date, round(a.e, 6) AS ema_12, round(c.e, 6) AS ema_26 FROM bars b LEFT JOIN e12 a ON a.instrument_id = b.instrument_id AND a.i = b.signal_index LEFT JOIN e26 c ON c.instrument_id = b.instrument_id AND c.i = b.signal_index", _q_ema(12, "e12"), _q_ema(26, "e26"))

RSI_SQL = recursive_sql(
    """SELECT b.instrument_id, b.trade_date, round(CASE WHEN g IS NULL THEN NULL WHEN g = 0 AND l = 0 THEN 50 WHEN l = 0 THEN 100 WHEN g = 0 THEN 0 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi_14
FROM bars b LEFT JOIN w ON w.instrument_id = b.instrument_id AND w.i = b.signal_index""",
    f"moved AS MATERIALIZED (SELECT *, greatest(close - {q_lag('close')}, 0) AS up, greatest({q_lag('close')} - close, 0) AS down FROM bars)",
    """w AS (
  SELECT instrument_id, 14::BIGINT AS i, avg(up) AS g, avg(down) AS l FROM moved WHERE signal_index BETWEEN 1 AND 14 GROUP BY 1 HAVING count(*) = 14
  UNION ALL
  SELECT m.instrument_id, m.signal_index, (w.g * 13 + m.up) / 14, (w.l * 13 + m.down) / 14 FROM w JOIN moved m ON m.instrument_id = w.instrument_id AND m.signal_index = w.i + 1)""",
)

ATR_WILDER_SQL = recursive_sql(
    "SELECT b.instrument_id, b.trade_date, round(a / close * 100, 6) AS atr_wilder_pct_14 FROM bars b LEFT JOIN w ON w.instrument_id = b.instrument_id AND w.i = b.signal_index",
    TR.replace("tr AS (", "tr AS MATERIALIZED (", 1),
    """w AS (
  SELECT instrument_id, 14::BIGINT AS i, avg(tr) AS a FROM tr WHERE signal_index BETWEEN 1 AND 14 GROUP BY 1 HAVING count(*) = 14
  UNION ALL
  SELECT m.instrument_id, m.signal_index, (w.a * 13 + m.tr) / 14 FROM w JOIN tr m ON m.instrument_id = w.instrument_id AND m.signal_index = w.i + 1)""",
)

MACD_SQL = recursive_sql(
    f"""SELECT instrument_id, trade_date, round(line / close * 100, 6) AS macd_line_pct, round(sig / close * 100, 6) AS macd_signal_pct, round((line - sig) / close * 100, 6) AS macd_histogram_pct,
  CASE WHEN line_1 IS NOT NULL AND sig_1 IS NOT NULL AND sig IS NOT NULL THEN CAST(line > sig AND line_1 <= sig_1 AS DOUBLE) END AS macd_bullish_cross
FROM (SELECT *, {q_lag('line')} AS line_1, {q_lag('sig')} AS sig_1 FROM (
  SELECT b.instrument_id, b.trade_date, b.close, m.line, s.e AS sig FROM bars b LEFT JOIN lines m ON m.instrument_id = b.instrument_id AND m.signal_index = b.signal_index
  LEFT JOIN e9 s ON s.instrument_id = b.instrument_id AND s.i = b.signal_index))""",
    _q_ema(12, "e12"),
    _q_ema(26, "e26"),
    "lines AS MATERIALIZED (SELECT a.instrument_id, a.i AS signal_index, a.e - c.e AS line FROM e12 a JOIN e26 c ON c.instrument_id = a.instrument_id AND c.i = a.i)",
    _q_ema(9, "e9", "lines", "line", 25),
)

_KC = {
    "kc_upper_distance_pct": "(close / up - 1) * 100",
    "kc_lower_distance_pct": "(close / down - 1) * 100",
    "kc_bandwidth_pct": "(up - down) / e * 100",
    "kc_position": "CASE WHEN up - down > 0 THEN (close - down) / (up - down) END",
    "kc_upper_cross_up": q_cross("close", "up"),
    "kc_lower_cross_down": q_cross("down", "close"),
}
KELTNER_SQL = recursive_sql(
    f"""SELECT instrument_id, trade_date, {", ".join(f"round({x}, 6) AS {n}" for n, x in _KC.items())}
FROM (SELECT *, {q_lag("close")} AS close_1, {q_lag("up")} AS up_1, {q_lag("down")} AS down_1 FROM (
  SELECT b.*, m.e, m.e + 2 * w.a AS up, m.e - 2 * w.a AS down FROM bars b LEFT JOIN e20 m ON m.instrument_id = b.instrument_id AND m.i = b.signal_index LEFT JOIN w ON w.instrument_id = b.instrument_id AND w.i = b.signal_index))""",
    TR.replace("tr AS (", "tr AS MATERIALIZED (", 1),
    _q_ema(20, "e20"),
    """w AS (
  SELECT instrument_id, 10::BIGINT AS i, avg(tr) AS a FROM tr WHERE signal_index BETWEEN 1 AND 10 GROUP BY 1 HAVING count(*) = 10
  UNION ALL
  SELECT m.instrument_id, m.signal_index, (w.a * 9 + m.tr) / 10 FROM w JOIN tr m ON m.instrument_id = w.instrument_id AND m.signal_index = w.i + 1)""",
)

QUERIES = {
    "feat_initial": (feat_initial, q_rounded(INITIAL, "tr", TR)),
    "feat_market": (feat_market, q_rounded(MARKET, "lagged", TR, SMAS, SMAS_LAG)),
    "pi_bollinger": (pi_bollinger, q_rounded(BOLLINGER, "edges_lag", BANDS, EDGES, EDGES_LAG)),
    "pi_windows": (pi_windows, q_rounded(PARAMETERISED, "tr", TR)),
    "sp_bandwidth_pctile": (sp_bandwidth_pctile, BANDWIDTH_SQL),
    "feat_availability": (feat_availability, AVAILABILITY_SQL),
    "feature_store_long": (feature_store_long, FEATURE_STORE_SQL),
    "feat_ema": (feat_ema, EMA_SQL),
    "feat_rsi_wilder": (feat_rsi, RSI_SQL),
    "feat_macd": (feat_macd, MACD_SQL),
    "pi_atr_wilder": (pi_atr_wilder, ATR_WILDER_SQL),
    "sp_keltner": (sp_keltner, KELTNER_SQL),
}
