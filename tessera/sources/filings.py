"""Filings as JSON files, and the sinks of the pipeline. Explicit schemas, nothing inferred."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip

RAW = "raw_html string, ticker string, form_type string, filing_date string, accession_number string"
#: Characters of files that a task gives out together.
READ = 4_000_000
PROCESSED = "ticker string, filing_id string, filing_type string, filing_date string, sections map<string,string>"


def filing_id():
    """The accession number, else ticker, form and date."""
    return F.coalesce("accession_number", F.concat_ws("_", "ticker", "form_type", "filing_date"))


def _hidden(name: str) -> bool:
    return name[0] in "._"


def _listed(root: str, pattern: str):
    """The paths of the files below folders; hidden ones are passed over, as Spark does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            todo = batch.column(0).to_pylist()
            while todo:
                found = [x for x in system.get_file_info(fs.FileSelector(todo.pop())) if not _hidden(x.base_name)]
                todo += [x.path for x in found if x.type == fs.FileType.Directory]
                paths = [x.path for x in found if x.type == fs.FileType.File and fnmatchcase(x.base_name, pattern)]
                for at in range(0, len(paths), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(paths[at : at + 10_000], pa.string())], names=["path"])

    return run


def _bodies(root: str):
    """(folder, file, body) of paths, some megabytes at a time. What isn't in an encoding of JSON is no JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(root)
        out: list[tuple[str, str, str]] = []
        size = 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["folder", "file", "body"])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(path, compression=None) as f:
                    body = f.read()
                try:
                    text = body.decode(json.detect_encoding(body))
                except UnicodeDecodeError:
                    text = "\ufffd"
                out.append((*path.rsplit("/", 2)[-2:], text))
                size += len(text)
                if size >= READ or len(out) >= 10_000:
                    yield give()
                    out, size = [], 0
        if out:
            yield give()

    return run


def _read_json(spark: SparkSession, root: str, pattern: str, schema: str) -> DataFrame:
    """(folder, file and the schema's columns) of all JSON files below root, an object or a list of them each; what is no JSON gives nulls, an empty file no row. An object where
    a text is expected gives its JSON without white space.

    The driver lists root alone; tasks list the folders in it and read the files, which are dealt to all cores evenly by their paths: Spark's own scan lists every file in the driver and makes a task
    of some thirty of them.
    """
    system, base = fs.FileSystem.from_uri(root)
    top = [x for x in system.get_file_info(fs.FileSelector(base)) if not _hidden(x.base_name)]
    cores = spark.sparkContext.defaultParallelism
    folders = [(x.path,) for x in top if x.type == fs.FileType.Directory]
    here = [(x.path,) for x in top if x.type == fs.FileType.File and fnmatchcase(x.base_name, pattern)]
    table = lambda rows: spark.createDataFrame(pa.table({"path": pa.array([r[0] for r in rows], pa.string())}))
    paths = table(folders).repartition(max(1, min(len(folders), 4 * cores))).mapInArrow(_listed(root, pattern), "path string").union(table(here))
    files = paths.repartition(4 * cores, "path").mapInArrow(_bodies(root), "folder string, file string, body string").where(F.length(strip(F.col("body"))) > 0)
    kind = f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>"
    one = F.array(F.lit(None).cast(kind[len("array<") : -1]))
    return files.select("folder", "file", F.explode(F.coalesce(F.from_json("body", kind), one)).alias("x")).select("folder", "file", "x.*")


def read_raw(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Raw filings below root, a folder for each ticker and a JSON object for each file. prefix: of the file's name, such as '10K_'. raw_html is '' where it is missing."""
    rows = _read_json(spark, root, f"{prefix}*.json", RAW)
    return rows.select(filing_id().alias("filing_id"), F.coalesce("ticker", "folder").alias("ticker"), "form_type", "filing_date", F.coalesce("raw_html", F.lit("")).alias("raw_html"), "file")


def read_processed(spark: SparkSession, root: str) -> DataFrame:
    """(filing_id, ticker, filing_type, filing_date, section_id, text), a row for each section; filings without sections have one row with nulls."""
    rows = _read_json(spark, root, "*.json", PROCESSED)
    return rows.select("filing_id", "ticker", "filing_type", "filing_date", F.explode_outer("sections").alias("section_id", "text"))


def _files(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            paths = []
            for ticker, file, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if ticker not in made:
                    system.create_dir(f"{base}/{ticker}", recursive=True)
                    made.add(ticker)
                # a task that is lost leaves a hidden file; its next attempt has another
                part = f"{base}/{ticker}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part, compression=None) as f:
                    f.write(body.encode())
                system.move(part, f"{base}/{ticker}/{file}")
                paths.append(f"{ticker}/{file}")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return run


def write_files(rows: DataFrame, root: str) -> int:
    """K1, K4: a file for each row of (ticker, file, body), in a folder for each ticker; how many. A row without one of these is an error; of two with one name one stays."""
    need = F.assert_true(F.col("ticker").isNotNull() & F.col("file").isNotNull() & F.col("body").isNotNull(), "a file needs a ticker, a name and a body")
    cut = rows.select("ticker", "file", "body", need.alias("ok")).where("ok is null").select("ticker", "file", "body")
    return cut.mapInArrow(_files(root), "path string").count()


def write_by_ticker(rows: DataFrame, path: str) -> None:
    """K1, K3-K5: Parquet, a folder for each ticker."""
    rows.write.mode("overwrite").partitionBy("ticker").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """K2: one CSV file of a small report; arrays and maps become JSON."""
    kinds = dict(rows.dtypes)
    flat = rows.select(*(F.to_json(c).alias(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c) for c in rows.columns))
    flat.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    """K6, K9."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def label_chunks(chunks: DataFrame, labels: DataFrame, heads: DataFrame) -> DataFrame:
    """K7: chunks with cluster_id and is_cluster_head, from (chunk_id, cluster_id) and (chunk_id)."""
    head = heads.select("chunk_id", F.lit(True).alias("head"))
    return chunks.join(labels.select("chunk_id", "cluster_id"), "chunk_id", "left").join(head, "chunk_id", "left").withColumn("is_cluster_head", F.coalesce("head", F.lit(False))).drop("head")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K8: the rows of new, and those of old whose key isn't in new."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
