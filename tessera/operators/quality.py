"""Reports over split filings. Lists are joined, so that every column is a scalar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.config import ANNUAL
from tessera.operators.sections import KEY, verdict, verdicts

NO_ANNUAL, NO_FILES = "no_10k", "no_files"


def _filings():
    return F.array_join(F.transform(F.array_sort(F.collect_list("filing_id")), lambda x: x.cast("string")), ",").alias("filings")


def status_tally(status: DataFrame) -> DataFrame:
    """Q2: (status, n, filings). Its list names every filing of a status, as the report does; a null status is 'failed'."""
    return status.groupBy(F.coalesce("status", F.lit("failed")).alias("status")).agg(F.count("*").alias("n"), _filings())


def company_status(companies: DataFrame, files: DataFrame, status: DataFrame) -> DataFrame:
    """Q2 by company: (ticker, filing_id, status), the status of its first annual filing by file name; no_files without any file, no_10k without an annual one.

    companies: (ticker); files: (ticker, file, form_type, filing_id); status: (filing_id, status). Null tickers go; names of files that tie go by filing_id.
    """
    own = files.where("ticker is not null").groupBy("ticker").agg(F.min(F.when(F.col("form_type") == "10-K", F.struct("file", "filing_id"))).alias("first"), F.count("*").alias("n"))
    rows = companies.where("ticker is not null").select("ticker").distinct().join(own, "ticker", "left").select("ticker", "n", F.col("first.filing_id").alias("filing_id"))
    rows = rows.join(status.select("filing_id", "status"), "filing_id", "left")
    said = F.when(F.col("n").isNull(), NO_FILES).when(F.col("filing_id").isNull(), NO_ANNUAL).otherwise(F.coalesce("status", F.lit("failed")))
    return rows.select("ticker", "filing_id", said.alias("status"))


def missing_items(status: DataFrame) -> DataFrame:
    """Q3: (item, filings) of items without a header, in filings whose content isn't elsewhere (Q5)."""
    rows = status.where("zero_occurrence <> '' and status <> 'incorporated_by_reference'")
    return rows.select("filing_id", F.explode(F.split("zero_occurrence", ",")).alias("item")).groupBy("item").agg(_filings())


def length_failures(sections: DataFrame) -> DataFrame:
    """Q4: (item, filing_id, verdict) of sections out of their bounds."""
    return verdicts(sections).where(F.col("verdict").startswith("too_")).select("item", "filing_id", "verdict")


def diagnose(split: DataFrame) -> DataFrame:
    """Q1: (filing_id, item, diagnosis): MISSING without a header, NOT SELECTED with one but no section, FLAGGED with the reason, or ok. An expression on the row of each filing."""
    items = F.array(*(F.lit(i) for i in ANNUAL.order if i != ANNUAL.boundary_only))

    def said(item):
        own = F.filter("sections", lambda s: s["item"] == item)[0]
        v = verdict(item, own["words"], own["combined"])
        flagged = F.when(v.startswith("too_"), F.concat(F.lit("FLAGGED: "), v)).otherwise("ok")
        has = F.exists("headers", lambda h: h["item"] == item)
        return F.struct(item.alias("item"), F.when(~has, "MISSING").when(F.size(F.filter("sections", lambda s: s["item"] == item)) == 0, "NOT SELECTED").otherwise(flagged).alias("diagnosis"))

    return split.select(KEY, F.inline(F.transform(items, said)))
