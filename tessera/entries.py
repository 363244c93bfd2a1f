"""From files to results: the chains that a user runs whole. Each step is a table (`stored`) where two others read it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.config import ANNUAL, CURRENT
from tessera.operators import chunks as C
from tessera.operators import cleaning
from tessera.operators import clusters as K
from tessera.operators import sections as S
from tessera.operators.html import with_extracted_text
from tessera.sources.filings import label_chunks
from tessera.storage import stored

KEYS = ["filing_id", "ticker", "form_type", "filing_date"]


class Cleaned(NamedTuple):
    sentences: DataFrame  # (filing_id, ticker, form_type, filing_date, ord, sentence)
    stats: DataFrame  # a row for each filing, see `cleaning.cleaning_stats`


def clean_filings(raw: DataFrame) -> Cleaned:
    """Raw filings (with raw_html, '' or null if missing) to financial sentences and statistics, of which every filing has a row."""
    text = stored(with_extracted_text(raw.select(*KEYS, F.col("raw_html").alias("html")), "html").drop("html"), "text")
    return Cleaned(cleaning.financial_rows(text), cleaning.cleaning_stats(text, KEYS))


def split_raw(raw: DataFrame) -> DataFrame:
    """Sections (filing_id, ticker, filing_type, filing_date, section_id, text) of annual and current reports, by form_type; filings of other forms have none."""
    about = raw.select("filing_id", "ticker", F.col("form_type").alias("filing_type"), "filing_date")
    html = lambda form: raw.where(F.col("form_type") == form).select("filing_id", F.col("raw_html").alias("html"))
    annual, current = (S.sections(S.split_filings(html(name), form, retry)) for name, form, retry in (("10-K", ANNUAL, True), ("8-K", CURRENT, False)))
    both = annual.unionByName(current).select("filing_id", F.col("item").alias("section_id"), "text")
    return both.join(about, "filing_id").select("filing_id", "ticker", "filing_type", "filing_date", "section_id", "text")


def chunk_filings(raw: DataFrame, embed: C.Embed = C.hashed_vectors) -> DataFrame:
    """Raw filings to chunks."""
    return C.semantic_chunks(split_raw(raw), embed)


class Clustered(NamedTuple):
    members: DataFrame  # (id, chunk_id, cluster_id), -1 for noise
    summaries: DataFrame  # see `clusters.summaries`
    totals: DataFrame
    chunks: DataFrame  # with cluster_id and is_cluster_head


def cluster_chunks(chunks: DataFrame, components: int | None = None, labeler: K.Labeler | None = None, distance: float = K.NOISE_DISTANCE) -> Clustered:
    """Chunks to clusters with their summaries. ids are numbers by the order of chunk_id, which is unique; components: of `reduce_dimensions`."""
    from pyspark.sql import Window

    # an order over all chunks needs their ids alone, in ranges
    keyed = chunks.select("chunk_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "ticker", "filing_date", F.col("section_name").alias("section"), "text")
    part = stored(keyed.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").withColumn("p", F.spark_partition_id()), "ordered")
    sizes = part.groupBy("p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p", "before")
    own = F.row_number().over(Window.partitionBy("p").orderBy("chunk_id")) - 1
    rows = stored(part.withColumn("k", own).join(before, "p").withColumn("id", F.col("before") + F.col("k")).drop("p", "k", "before"), "numbered")
    labels = K.density_clusters(K.reduce_dimensions(rows.select("id", "vec"), components))
    members = stored(K.reassign_noise(rows.select("id", "chunk_id", "vec").join(labels, "id"), distance), "members")
    found = stored(K.summaries(members, rows.select("id", "ticker", "filing_date", "section", "text"), labeler), "summaries")
    heads = found.join(rows.select(F.col("id").alias("head_id"), "chunk_id"), "head_id").select("chunk_id")
    return Clustered(members.select("id", "chunk_id", "cluster_id"), found, K.totals(members), label_chunks(chunks, members.select("chunk_id", "cluster_id"), heads))
