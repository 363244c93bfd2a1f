"""Prices and macro series: payloads, CSV files and offline stand-ins."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PRICE_SCHEMA = "Date date, Open double, High double, Low double, Close double, Volume long, ticker string, pulled_at string"
#: Of a fetch: tries, the seconds between them, and the seconds that one may take.
TRIES, PAUSE, TIMEOUT = 3, 2.0, 15.0
MACRO_SCHEMA = "date date, value double, series string"
_quote = "open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>"
PAYLOAD = f"chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<{_quote}>>,adjclose:array<struct<adjclose:array<double>>>>>>>"


def trading_date(epoch):
    """The day in New York of seconds since 1970, in a session of any time zone."""
    zero = F.lit(0)
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(zero, zero, zero, epoch.cast("decimal(18,6)"))
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), utc))


def flatten_payload(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """Rows of (ticker, json) as bars; close is the adjusted one if there is one, the other fields are raw. Rows without a close, and payloads that can't be read, go."""
    read = payloads.select("ticker", F.from_json(json_col, PAYLOAD).alias("p")).select("ticker", F.get(F.col("p.chart.result"), 0).alias("r"))
    quote, adjusted = F.get(F.col("r.indicators.quote"), 0), F.get(F.col("r.indicators.adjclose"), 0)["adjclose"]
    flat = read.select("ticker", F.inline(F.arrays_zip(F.col("r.timestamp").alias("ts"), *(quote[c].alias(c) for c in ("open", "high", "low", "close", "volume")), adjusted.alias("adjclose"))))
    close = F.coalesce("adjclose", "close")
    return flat.select("ticker", trading_date(F.col("ts")).alias("date"), "open", "high", "low", close.alias("close"), "volume").where("close is not null")


def flatten_series(pulled: DataFrame) -> DataFrame:
    """(date, value, series) of rows (ticker, payload) of `chart_source`, the ticker being the series: JSON {"observations": [{"date", "value"}]}. Series that failed have no row; values that are no number are null."""
    shape = "observations array<struct<date:string,value:string>>"
    rows = pulled.select(F.col("ticker").alias("series"), F.inline(F.from_json("payload", shape)["observations"]))
    return rows.select(F.col("date").cast("date").alias("date"), F.expr("try_cast(value as double)").alias("value"), "series")


def macro_or_synthetic(spark: SparkSession, pulled: DataFrame | None, series: list[str], start: str, end: str) -> DataFrame:
    """The series that were pulled; without a client or a key (None) the stand-in for all."""
    return synthetic_macro(spark, series, start, end) if pulled is None else flatten_series(pulled)


def synthetic_macro(spark: SparkSession, series: list[str], start: str, end: str) -> DataFrame:
    """1.0 on the first of each month from start to end."""
    first = F.when(F.dayofmonth(F.lit(start).cast("date")) == 1, F.lit(start).cast("date")).otherwise(F.trunc(F.add_months(F.lit(start).cast("date"), 1), "month"))
    last = F.lit(end).cast("date")
    dates = spark.range(1).select(F.explode(F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))).alias("date"))
    return dates.crossJoin(spark.createDataFrame([(s,) for s in series], "series string")).select("date", F.lit(1.0).alias("value"), "series")


def write_csv_by(rows: DataFrame, key: str, path: str) -> None:
    """K3, K5: CSV files with a header, a folder for each value of key, which stays a column of the files."""
    rows.withColumn("__by", F.col(key)).withColumnRenamed("__by", f"by_{key}").write.mode("overwrite").partitionBy(f"by_{key}").csv(path, header=True)


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """Price CSV files; the columns of the pull are dropped, the ticker is kept as the key."""
    rows = spark.read.schema(PRICE_SCHEMA).option("recursiveFileLookup", True).csv(path, header=True)
    return rows.drop("pulled_at").select("ticker", *(F.col(c).alias(c.lower()) for c in ("Date", "Open", "High", "Low", "Close", "Volume")))


def load_macro(spark: SparkSession, path: str) -> DataFrame:
    """S12."""
    return spark.read.schema(MACRO_SCHEMA).option("recursiveFileLookup", True).csv(path, header=True)


def _within(seconds: float, fetch, *args):
    """What fetch gives; TimeoutError after so many seconds. A call that hangs is left to its thread, which doesn't keep the worker from ending."""
    got: list = []

    def call():
        try:
            got.append((fetch(*args), None))
        except Exception as e:  # raised again where it is waited for
            got.append((None, e))

    thread = threading.Thread(target=call, daemon=True)
    thread.start()
    thread.join(seconds)
    if not got:
        raise TimeoutError(f"no answer in {seconds:g} s")
    if got[0][1]:
        raise got[0][1]
    return got[0][0]


class _Ticker(InputPartition):
    def __init__(self, ticker: str):
        self.ticker = ticker


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: Callable[[str, str, str], str]):
        self.options, self.fetch = options, fetch

    def partitions(self) -> list[InputPartition]:
        return [_Ticker(t) for t in self.options["tickers"].split(",") if t]

    def read(self, partition: _Ticker) -> Iterator[tuple]:
        tries, pause, limit = (float(self.options.get(k, d)) for k, d in (("tries", TRIES), ("pause", PAUSE), ("timeout", TIMEOUT)))
        error = "no try"
        for k in range(int(tries)):
            if k:
                time.sleep(pause)
            try:
                yield partition.ticker, _within(limit, self.fetch, partition.ticker, self.options.get("start", ""), self.options.get("end", "")), None
                return
            except Exception as e:  # one ticker's failure is a row, not the job's
                error = f"{type(e).__name__}: {e}"
        yield partition.ticker, None, error


def chart_source(fetch: Callable[[str, str, str], str], name: str = "charts") -> type[DataSource]:
    """A data source whose rows are (ticker, payload, error), a partition for each ticker or series; fetch(ticker, start, end) gives the JSON. Options: tickers, start, end, tries, pause, timeout. Register it with spark.dataSource.register."""

    class Charts(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "ticker string, payload string, error string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(dict(self.options), fetch)

    return Charts


def manifest(pulled: DataFrame) -> DataFrame:
    """K6: (status, n) over rows of (ticker, payload, error)."""
    return pulled.groupBy(F.when(F.col("error").isNull() & F.col("payload").isNotNull(), "success").otherwise("failure").alias("status")).agg(F.count("*").alias("n"))
