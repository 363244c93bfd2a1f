"""Daily prices on a business calendar: gaps, bounded fill, returns and outliers. Long tables (ticker, date, fields); one shuffle by ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILL = 3
OUTLIER = 5.0


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(date), Monday to Friday."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return days.where(F.weekday("date") < 5)


def trading_rows(prices: DataFrame) -> DataFrame:
    """Rows of weekdays; rows without ticker or date go."""
    return prices.where("ticker is not null and date is not null").where(F.weekday("date") < 5)


def _grid(prices: DataFrame, start: str, end: str) -> DataFrame:
    # a calendar is a few thousand dates, however many tickers there are
    return prices.select("ticker").distinct().crossJoin(F.broadcast(business_days(prices.sparkSession, start, end)))


def missing_days(prices: DataFrame, start: str, end: str) -> DataFrame:
    """(ticker, date) of the calendar's days that a ticker lacks."""
    rows = trading_rows(prices)
    return _grid(rows, start, end).join(rows.select("ticker", "date"), ["ticker", "date"], "left_anti")


def reindex(prices: DataFrame, start: str, end: str) -> DataFrame:
    """Each ticker on the whole calendar; a date that a ticker has twice is an error."""
    rows = trading_rows(prices)
    fields = [c for c in rows.columns if c not in ("ticker", "date")]
    twice = F.assert_true(F.count("*") == 1, F.concat(F.lit("more than one row: "), F.col("ticker"), F.lit(" "), F.col("date").cast("string")))
    one = rows.groupBy("ticker", "date").agg(*(F.first(c).alias(c) for c in fields), twice.alias("once")).where("once is null").drop("once")
    return _grid(rows, start, end).join(one, ["ticker", "date"], "left")


def fill(grid: DataFrame, fields: list[str], limit: int = FILL) -> DataFrame:
    """P5: each field forward, over at most `limit` days."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-limit, 0)
    return grid.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in fields})


def returns(grid: DataFrame, gaps: str = "pad") -> DataFrame:
    """return_1d of close. gaps: 'pad' holds the last close through any gap (0.0); 'null' has none there. A zero price gives null."""
    if gaps not in ("pad", "null"):
        raise ValueError("gaps must be 'pad' or 'null'")
    w = Window.partitionBy("ticker").orderBy("date")
    held = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if gaps == "pad" else F.col("close")
    return grid.withColumn("__held", held).withColumn("return_1d", F.try_divide(F.col("__held"), F.lag("__held").over(w)) - 1).drop("__held")


def flag_outliers(rows: DataFrame, limit: float = OUTLIER) -> DataFrame:
    """is_outlier where a return is more than `limit` sample deviations from its ticker's mean; false without a return or a deviation."""
    w = Window.partitionBy("ticker")
    z = F.try_divide(F.col("return_1d") - F.avg("return_1d").over(w), F.nullif(F.stddev_samp("return_1d").over(w), F.lit(0.0)))
    return rows.withColumn("is_outlier", F.coalesce(F.abs(z) > limit, F.lit(False)))


def clean_prices(prices: DataFrame, start: str, end: str, gaps: str = "pad") -> DataFrame:
    """P1 to P9. Without a column close there are neither returns nor outliers (P10)."""
    fields = [c for c in prices.columns if c not in ("ticker", "date")]
    out = fill(reindex(prices, start, end), fields)
    return flag_outliers(returns(out, gaps)) if "close" in fields else out


def price_stats(prices: DataFrame, start: str, end: str, gaps: str = "pad") -> DataFrame:
    """(ticker, original_rows, missing_days_count, missing_days_pct, outlier_count, outlier_dates joined by commas)."""
    rows = trading_rows(prices)
    n = rows.groupBy("ticker").agg(F.count("*").alias("original_rows"))
    gone = missing_days(prices, start, end).groupBy("ticker").agg(F.count("*").alias("missing"))
    out = clean_prices(prices, start, end, gaps).groupBy("ticker").agg(
        F.count("*").alias("days"),
        F.count_if("is_outlier").alias("outlier_count"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("is_outlier"), F.col("date").cast("string")))), ",").alias("outlier_dates"),
    )
    missing = F.coalesce("missing", F.lit(0))
    return n.join(out, "ticker").join(gone, "ticker", "left").select(
        "ticker", "original_rows", missing.alias("missing_days_count"), F.round(100.0 * missing / F.col("days"), 2).alias("missing_days_pct"), "outlier_count", "outlier_dates"
    )


def bars(ticks: DataFrame, time: Column, value: Column, tie: Column) -> DataFrame:
    """(ticker, date, open, high, low, close, volume) of ticks with a column ticker; volume counts them. One pass."""
    at = F.struct(time, tie)
    return ticks.groupBy("ticker", F.to_date(time).alias("date")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").alias("volume")
    )


def wide(prices: DataFrame, tickers: list[str], fields: list[str]) -> DataFrame:
    """A row for each date, columns ticker_field. The tickers are given, so that no extra pass finds them; no ticker is an error."""
    if not tickers:
        raise ValueError("no tickers")
    cells = [F.max(F.when(F.col("ticker") == t, F.col(f))).alias(f"{t}_{f}") for t in tickers for f in fields]
    return prices.where(F.col("ticker").isin(tickers)).groupBy("date").agg(*cells)
