"""One query for each operator of this package, over its whole table, and DuckDB's SQL where it can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, embeddings, html, licenses, mixing, rules, sharding, simhash, substring, warc
from tessera.llm._shared import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 50 words or more that occur earlier, of all documents."""
    return substring.repeats(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, and the first capture of each URL and content read back."""
    index = warc.write_pages(_table(spark, sf_dir, "pages"))
    return warc.read_records(warc.first_captures(index))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, and the md5 of what they decode to."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"))


def op4_shard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard, of 64, of all documents, those with one text together."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken, by sources and labels."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return mixing.mix_sources(docs, quality=mixing.label_weights(labels), unknown=mixing.UNKNOWN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learned rule that rejects each document, if any."""
    docs = _table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit(docs, _table(spark, sf_dir, "labels")))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates among all documents."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in all documents."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near vectors, those of the table and a near copy of every twentieth."""
    return embeddings.near_duplicates(embeddings.with_near_copies(_table(spark, sf_dir, "embeddings")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content region of all pages."""
    pages = _table(spark, sf_dir, "pages")
    return html.extract_pages(pages, html.fit(pages))


_all = (
    op1_substring_dedup, op2_warc, op3_bpe_round_trip, op4_shard_groups, op5_mix_sources,
    op6_quality_rules, op7_simhash_near_dedup, op8_license_scan, op9_embedding_near_dedup, op10_html_extraction,
)
QUERIES = {f.__name__: f for f in _all}
#: None for BPE, quality rules, license scans and HTML extraction, which are tested against brute force.
SQL = {
    "op1_substring_dedup": substring.SQL,
    "op2_warc": warc.SQL,
    "op4_shard_groups": sharding.SQL,
    "op5_mix_sources": mixing.SQL,
    "op7_simhash_near_dedup": simhash.SQL,
    "op9_embedding_near_dedup": embeddings.SQL,
}
