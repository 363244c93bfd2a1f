"""Filings to financial sentences and their statistics. Sentences are rows, so that the patterns run in generated code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import is_financial, strict_sentences, word_count


def sentence_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with ord and sentence: all sentences (C1), of null none."""
    rest = [c for c in docs.columns if c != text_col]
    return docs.select(*rest, F.posexplode(strict_sentences(F.col(text_col))).alias("ord", "sentence"))


def financial_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Of `sentence_rows` those that are financial."""
    return sentence_rows(docs, text_col).where(is_financial(F.col("sentence")))


def cleaning_stats(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, token_count_raw, token_count_clean, n_sentences, boilerplate_removed_pct). Rows of equal keys, nulls among them, count together; a null text has 0 words. What is shuffled is a row of counts for each of docs."""
    cut = docs.select(*keys, F.coalesce(word_count(F.col(text_col)), F.lit(0)).alias("raw"), F.col(text_col).alias("text"))
    rows = cut.select(*keys, "raw", F.posexplode_outer(strict_sentences(F.col("text"))).alias("ord", "sentence"))
    kept = F.coalesce(is_financial(F.col("sentence")), F.lit(False))
    rows = rows.select(*keys, F.when(F.coalesce("ord", F.lit(0)) == 0, F.col("raw")).otherwise(0).alias("raw"), F.when(kept, word_count(F.col("sentence"))).alias("words"))
    sums = rows.groupBy(*keys).agg(F.sum("raw").alias("token_count_raw"), F.coalesce(F.sum("words"), F.lit(0)).alias("token_count_clean"), F.count("words").alias("n_sentences"))
    removed = F.round((1 - F.col("token_count_clean") / F.greatest("token_count_raw", F.lit(1))) * 100, 1)
    return sums.withColumn("boilerplate_removed_pct", removed)
