"""Queries over prices: events as ticks of derived tickers, orders as long histories."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import prices as P
from tessera.sources import market

EVENTS = ("2024-01-01", "2024-01-31")
ORDERS = ("1995-01-01", "2001-08-01")
SERIES = ["cpi", "gdp", "unemployment"]


def _epoch():
    """Seconds since 1970 of ts, which has no time zone, as UTC."""
    return F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def event_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _events(spark, sf_dir).withColumn("ticker", F.concat_ws("_", "event_type", (F.col("user_id") % 20).cast("string")))
    return ticks.groupBy("ticker", F.to_date("ts").alias("date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))


def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    # sums of cents are exact, so the mean doesn't depend on the order of rows
    mean = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / F.count("*") / 100
    return rows.groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(mean.alias("close"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("return_1d", F.round("return_1d", 6))


def price_clean(spark, sf_dir):
    return _rounded(P.clean_prices(event_prices(spark, sf_dir), *EVENTS))


def price_outliers(spark, sf_dir):
    return _rounded(P.clean_prices(order_prices(spark, sf_dir), *ORDERS)).where("is_outlier").select("ticker", "date", "return_1d")


def price_missing_days(spark, sf_dir):
    return P.missing_days(event_prices(spark, sf_dir), *EVENTS)


def price_stats(spark, sf_dir):
    return P.price_stats(event_prices(spark, sf_dir), *EVENTS).unionByName(P.price_stats(order_prices(spark, sf_dir), *ORDERS))


def bars_of_events(spark, sf_dir):
    ticks = _events(spark, sf_dir).withColumn("ticker", F.col("event_type"))
    return P.bars(ticks, F.col("ts"), F.col("value"), F.col("event_id"))


def ohlcv_bars(spark, sf_dir):
    return bars_of_events(spark, sf_dir)


def lineitem_bars(spark, sf_dir):
    ticks = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("ticker", F.col("l_returnflag"))
    return P.bars(ticks, F.col("l_shipdate"), F.col("l_extendedprice"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice"))


def prices_wide(spark, sf_dir):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return P.wide(ohlcv_bars(spark, sf_dir), kinds, ["open", "close", "volume"])


def payload_flatten(spark, sf_dir):
    """Each type of event as one payload; every seventh has no adjusted close, every eleventh no close."""
    e = _events(spark, sf_dir)
    row = F.struct(
        "event_id",
        _epoch().alias("t"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("c"),
        F.when((F.col("event_id") % 7 != 0) & (F.col("event_id") % 11 != 0), F.col("value") / 2).alias("a"),
    )
    packed = e.groupBy(F.concat_ws("_", "event_type", "user_id").alias("ticker")).agg(F.array_sort(F.collect_list(row)).alias("x"))
    at = lambda f: F.col(f"x.{f}")
    quote = F.struct(at("c").alias("open"), at("c").alias("high"), at("c").alias("low"), at("c").alias("close"), at("event_id").alias("volume"))
    result = F.struct(at("t").alias("timestamp"), F.struct(F.array(quote).alias("quote"), F.array(F.struct(at("a").alias("adjclose"))).alias("adjclose")).alias("indicators"))
    payloads = packed.select("ticker", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"}).alias("payload"))
    return market.flatten_payload(payloads)


def epoch_to_trading_date(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", market.trading_date(_epoch()).alias("date"))


def macro_synthetic(spark, sf_dir):
    return market.synthetic_macro(spark, SERIES, "1995-01-15", "2001-08-01")


_event_prices = "SELECT event_type || '_' || (user_id % 20) AS ticker, ts::DATE AS date, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY ALL"
_order_prices = "SELECT o_orderpriority AS ticker, o_orderdate::DATE AS date, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*) / 100 AS close FROM orders GROUP BY ALL"


def _clean(source: str, start: str, end: str) -> str:
    return f"""
p AS MATERIALIZED (SELECT * FROM ({source}) WHERE isodow(date) < 6),
cal AS (SELECT d::DATE AS date FROM range(DATE '{start}', DATE '{end}' + 1, INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6),
grid AS MATERIALIZED (SELECT t.ticker, cal.date, p.close AS raw FROM (SELECT DISTINCT ticker FROM p) t CROSS JOIN cal LEFT JOIN p ON p.ticker = t.ticker AND p.date = cal.date),
filled AS (
  SELECT ticker, date, raw, last_value(raw IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS close FROM grid
), held AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS h FROM filled),
ret AS (SELECT *, h / nullif(lag(h) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r FROM held),
clean AS MATERIALIZED (
  SELECT ticker, date, close, raw, r AS return_1d, coalesce(abs((r - avg(r) OVER (PARTITION BY ticker)) / nullif(stddev_samp(r) OVER (PARTITION BY ticker), 0)) > 5, false) AS is_outlier FROM ret
)"""


def _stats(source: str, start: str, end: str) -> str:
    return f"""
SELECT c.ticker, original_rows, missing AS missing_days_count, round(100.0 * missing / days, 2)::DOUBLE AS missing_days_pct, outlier_count, outlier_dates FROM (
  WITH {_clean(source, start, end)}
  SELECT ticker, count(*) AS days, count(*) FILTER (raw IS NULL) AS missing, count(*) FILTER (is_outlier) AS outlier_count,
    coalesce(string_agg(CASE WHEN is_outlier THEN date::VARCHAR END, ',' ORDER BY date), '') AS outlier_dates FROM clean GROUP BY ticker
) c JOIN (SELECT ticker, count(*) AS original_rows FROM ({source}) WHERE isodow(date) < 6 GROUP BY ticker) n ON n.ticker = c.ticker"""


def _bars(ticker: str, table: str, time: str, value: str, tie: str) -> str:
    return (
        f"SELECT {ticker} AS ticker, {time}::DATE AS date, arg_min({value}, ({time}, {tie})) AS open, max({value}) AS high, min({value}) AS low, "
        f"arg_max({value}, ({time}, {tie})) AS close, count(*) AS volume FROM {table} GROUP BY ALL"
    )


_event_bars = _bars("event_type", "events", "ts", "value", "event_id")
_ny = "(({t}) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE"
_all = (price_clean, price_outliers, price_missing_days, price_stats, ohlcv_bars, lineitem_bars, prices_wide, payload_flatten, epoch_to_trading_date, macro_synthetic)
_sql = {
    "price_clean": f"WITH {_clean(_event_prices, *EVENTS)} SELECT ticker, date, close, round(return_1d, 6) AS return_1d, is_outlier FROM clean",
    "price_outliers": f"WITH {_clean(_order_prices, *ORDERS)} SELECT ticker, date, round(return_1d, 6) AS return_1d FROM clean WHERE is_outlier",
    "price_missing_days": f"WITH {_clean(_event_prices, *EVENTS)} SELECT ticker, date FROM clean WHERE raw IS NULL",
    "price_stats": _stats(_event_prices, *EVENTS) + " UNION ALL " + _stats(_order_prices, *ORDERS),
    "ohlcv_bars": _event_bars,
    "lineitem_bars": _bars("l_returnflag", "lineitem", "l_shipdate", "l_extendedprice", "l_orderkey, l_linenumber, l_extendedprice"),
    "prices_wide": "SELECT date, "
    + ", ".join(f"max({f}) FILTER (ticker = '{t}') AS {t}_{f}" for t in ("click", "error", "purchase", "signup", "view") for f in ("open", "close", "volume"))
    + f" FROM ({_event_bars}) WHERE ticker IN ('click', 'error', 'purchase', 'signup', 'view') GROUP BY date",
    "payload_flatten": f"""SELECT event_type || '_' || user_id AS ticker, {_ny.format(t="date_trunc('second', ts)")} AS date, value AS open, value AS high, value AS low,
      CASE WHEN event_id % 7 <> 0 THEN value / 2 ELSE value END AS close, event_id AS volume FROM events WHERE event_id % 11 <> 0""",
    "epoch_to_trading_date": f"SELECT event_id, {_ny.format(t='ts')} AS date FROM events",
    "macro_synthetic": "SELECT d::DATE AS date, 1.0::DOUBLE AS value, s AS series FROM range(DATE '1995-02-01', DATE '2001-08-02', INTERVAL 1 MONTH) t(d), (VALUES ('cpi'), ('gdp'), ('unemployment')) v(s)",
}


def _dates_as_text(query):
    """Clients differ in how they read dates; as text they are the same everywhere."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumn("date", F.col("date").cast("string")) if "date" in df.columns else df

    return run


QUERIES = {f.__name__: _dates_as_text(f) for f in _all}
SQL = {k: s if k == "price_stats" else f"SELECT * REPLACE (date::VARCHAR AS date) FROM ({s})" for k, s in _sql.items()}
