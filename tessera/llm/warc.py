"""WARC: index first, then coalesced reads.

Pages are written as WARC 1.0 resource records, each a gzip member of its own, to files in the shared folder, while an index of offset, length, URL
and digest of each record is written as a table. Each attempt of a task writes a file of its own name, and the index has the rows of attempts that
ended well alone, so that a lost executor leaves at most a file that nothing points to. Records are selected in the index; the byte
ranges of those selected are sorted by file and offset, neighbours are read at once, and every digest is verified.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import new_path

DATE = "2024-01-01T00:00:00Z"
#: A file is followed by the next beyond so many bytes.
FILE_BYTES = 1 << 30
#: Ranges with at most this many bytes between them are read at once, up to SPAN bytes.
GAP, SPAN = 256 << 10, 16 << 20
#: Bytes of content that are given out at once, but for one record.
OUT = 64 << 20
INDEX = "page_id long, url string, digest string, n_bytes long, file string, offset long, length long"


def record(url: str | None, payload: bytes, digest: str, number: str) -> bytes:
    """One record; line ends in the URL are escaped."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = (
        f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{number}>\r\nWARC-Target-URI: {target}\r\nWARC-Date: {DATE}\r\n"
        f"WARC-Payload-Digest: {digest}\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    )
    return head.encode() + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def _digest(payload: bytes) -> str:
    return "sha256:" + hashlib.sha256(payload).hexdigest()


def _write(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                rows = []
                some = batch.slice(part, 1000)
                for page, url, text in zip(*(some.column(k) for k in range(3))):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    payload = text.as_buffer().to_pybytes()
                    digest = _digest(payload)
                    z = zlib.compressobj(4, zlib.DEFLATED, 31)
                    raw = z.compress(record(url.as_py(), payload, digest, str(uuid.uuid4()))) + z.flush()
                    out.write(raw)
                    rows.append((page.as_py(), url.as_py(), digest, len(payload), f"{folder}/{name}", at, len(raw)))
                    at += len(raw)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()

    return run


def write_pages(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages as WARC files below folder and gives the index, itself a table there. Pages with a null html have no record; an empty one has an empty payload; a null
    id or URL stays null in the index. Rows that repeat have a record each.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    cut = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).where("html is not null")
    cut.mapInArrow(_write(f"{folder}/records", file_bytes), INDEX).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def _members(read, block: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of a stream; of one that isn't compressed, of its records."""
    held, at, done = read(block), 0, False
    if held[:2] != b"\x1f\x8b":
        while held or not done:
            head = held.find(b"\r\n\r\n")
            size = head + 8 + int(parse(held[: head + 4])[0]["content-length"]) if head >= 0 else -1
            if 0 <= size <= len(held):
                yield at, size, held[:size]
                held, at = held[size:], at + size
            elif done:
                if held.strip():
                    raise ValueError("the file ends within a record")
                return
            else:
                more = read(block)
                held, done = held + more, not more
        return
    while held:
        z, out, size = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not held:
                held = read(block)
                if not held:
                    raise ValueError("the file ends within a record")
            out.append(z.decompress(held))
            size += len(held) - len(z.unused_data)
            held = z.unused_data
        yield at, size, b"".join(out)
        at += size
        held = held or read(block)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in INDEX.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    for batch in batches:
        for name in batch.column(0).to_pylist():
            system, path = fs.FileSystem.from_uri(name)
            rows = []
            with system.open_input_stream(path, compression=None) as f:
                for at, length, raw in _members(f.read):
                    headers, payload = parse(raw)
                    if headers.get("warc-type") in ("resource", "response", "conversion"):
                        rows.append((None, headers.get("warc-target-uri"), _digest(payload), len(payload), name, at, length))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
                        rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def index_files(files: DataFrame) -> DataFrame:
    """The index of WARC files that are there, of a column of their URIs, a task for each file at most: of records with content, whose page_id is null. The payload is the record's block, with HTTP headers where it has them."""
    uris = files.select(F.col(files.columns[0]).alias("file")).where("file is not null")
    return uris.repartition(max(1, uris.sparkSession.sparkContext.defaultParallelism), "file").mapInArrow(_index, INDEX)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def first_captures(index: DataFrame) -> DataFrame:
    """Of each URL and digest the record with the least page_id, a null one last; null URLs count as one."""
    cols = [F.col(c) for c in ("page_id", "n_bytes", "file", "offset", "length")]
    order = F.struct(F.col("page_id").isNull().alias("none"), *cols)
    return index.groupBy("url", "digest").agg(F.min(order).alias("x")).select("url", "digest", "x.page_id", "x.n_bytes", "x.file", "x.offset", "x.length")


def coalesced(ranges: list[tuple[str, int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int]]:
    """(first, last + 1) of runs of sorted (file, offset, length) that are read at once."""
    out, start = [], 0
    for i in range(1, len(ranges) + 1):
        if i < len(ranges):
            (f, o, n), (g, p, m) = ranges[i - 1], ranges[i]
            if f == g and p - (o + n) <= gap and p + m - ranges[start][1] <= span:
                continue
        out.append((start, i))
        start = i
    return out if ranges else []


def _read(gap: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "file", "offset", "length")}
            ranges = list(zip(cols["file"], cols["offset"], cols["length"]))
            for first, last in coalesced(ranges, gap, span):
                if ranges[first][0] != name:
                    if file is not None:
                        file.close()
                    name = ranges[first][0]
                    system, path = fs.FileSystem.from_uri(name)
                    file = system.open_input_file(path)
                base = ranges[first][1]
                block = file.read_at(max(o + n for _, o, n in ranges[first:last]) - base, base)
                texts, start, size = [], first, 0
                for i in range(first, last):
                    o, n = ranges[i][1] - base, ranges[i][2]
                    raw = block[o : o + n]
                    _, payload = parse(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
                    if _digest(payload) != cols["digest"][i]:
                        raise ValueError(f"digest differs: {ranges[i]}")
                    texts.append(payload)
                    size += len(payload)
                    if size > OUT or i == last - 1:
                        own = slice(start, i + 1)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cols["page_id"][own], pa.int64()), pa.array(cols["url"][own], pa.string()), pa.array(cols["digest"][own]), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.decode(errors="replace") for t in texts], pa.string())],
                            names=["page_id", "url", "digest", "n_bytes", "html"],
                        )
                        texts, start, size = [], i + 1, 0
        if file is not None:
            file.close()

    return run


def read_records(selected: DataFrame, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """(page_id, url, digest, n_bytes, html) of the index rows in `selected`; a digest that isn't that of the payload is an error. Rows that repeat are read each; of an empty selection there is no row; extra columns go."""
    sorted_ranges = selected.select("page_id", "url", "digest", "file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return sorted_ranges.mapInArrow(_read(gap, span), "page_id long, url string, digest string, n_bytes long, html string")


SQL = """
SELECT min(page_id) AS page_id, url, 'sha256:' || sha256(html) AS digest, octet_length(encode(html))::BIGINT AS n_bytes, html
FROM pages WHERE html IS NOT NULL GROUP BY url, html
"""
