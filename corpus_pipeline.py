"""The corpus pipeline: from raw documents to token sequences.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before kept, and gives a DataFrame; all but the last give the columns of docs, which may be more than those of documents and have
any names. An empty table goes through every stage as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, mixing, rules, simhash, substring
from tessera.llm._shared import stored


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the learned decision list rejects.

    Documents with a null or empty text, null ids and rows that repeat are judged by their text alone: a null one stays. Without a label there is no rule, and all stay.
    """
    return rules.keep_good(docs, rules.fit(docs, _labels(spark, sf_dir)))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id.

    Rows that repeat an id are one document, and all stay or go; null ids, and null and wordless texts, are near to none and stay.
    """
    return simhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages that occur earlier in the corpus; a document that has nothing else goes.

    Rows that repeat an id with one text are one document and are cut alike. Null ids, null texts and texts of fewer than 50 words stay as they are.
    """
    return substring.cut_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the budget of its source allows; the budget over all sources is what docs have.

    Rows that repeat an id are one document with the tokens of all, each as often; a null source is one of its own; rows with a null id go; texts that are null or empty cost nothing. Keys that tie go by id.
    """
    return mixing.mixed(docs, quality=mixing.label_weights(_labels(spark, sf_dir)), unknown=mixing.UNKNOWN)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, tokens, text_md5), the tokens decoded again for text_md5: a row for each row of docs, with nulls for a null text and an empty list for an empty one; a null id stays."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mix_sources),
    ("bpe encoding", bpe_encoding),
]

#: The quality rules are learned and BPE has no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the others keep is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
