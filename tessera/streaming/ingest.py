"""Filings as a stream of files, through the same narrow transforms as in batch."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import financial_sentences
from tessera.operators.html import with_extracted_text
from tessera.sources.filings import RAW, filing_id


def clean_filings(spark: SparkSession, root: str, out: str, state: str) -> StreamingQuery:
    """Financial sentences (filing_id, ticker, sentence) of the raw filings that are new below root, as Parquet; it ends when all are done. state: the checkpoint's folder, which lets it go on after a failure."""
    rows = spark.readStream.schema(RAW).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    text = with_extracted_text(rows.select(filing_id().alias("filing_id"), "ticker", "raw_html"), "raw_html")
    kept = text.select("filing_id", "ticker", F.explode(financial_sentences(F.col("text"))).alias("sentence"))
    return kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
