"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of the last 16 bytes says so, so that documents that share a passage share its chunks. Documents come together by the
least of their chunks' hashes, copies and near copies with them. Of what comes together the hashes of all chunks and texts are counted first, and what repeats is encoded once: a text that repeats as
a whole, else its chunks that do; a run of chunks that don't is encoded at once, as if it weren't cut. Tokens at the joins of chunks
aren't those of the whole text, so joins are repaired: the bytes about a join are encoded anew, further and further on either side, until both ends agree with
a place where the pretokenizer cuts any text that has these bytes (a letter or digit, one space, a letter or digit). From there on
the tokens of the chunk are those of the whole text. The result is exactly the encoding of the whole text.

Copies may be a third of all documents: a task sends TOGETHER of those with one least hash to where it belongs, the next ones elsewhere, so that each place gets TOGETHER of each task at most.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrays import U, mix, pack, parts, unpack
from tessera.llm._shared import buckets

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes under the rolling hash, and the mean length of chunks.
WINDOW, CHUNK = 16, 1024
#: Distinct chunks and joins that a task keeps; beyond, those not used for longest go.
KEPT = 60_000
#: Documents of one least hash that a task sends to one place.
TOGETHER = 4
#: A place that is always the end of a pretoken, right after the letter or digit.
ANCHOR = re.compile(rb"[A-Za-z0-9](?= [A-Za-z0-9])")
PACKED = "bucket int, id binary, flags binary, size binary, cut binary, hash binary, whole binary, text binary"
KINDS = {"id": np.int64, "flags": np.int8, "size": np.int64, "cut": np.int32, "hash": np.uint64, "whole": np.uint64}


@cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, bytes) of all tokens by id."""
    e = encoding(path)
    all_bytes = [b""] * e.n_vocab
    for t, i in e._mergeable_ranks.items():
        all_bytes[i] = t
    return np.concatenate([[0], np.cumsum([len(t) for t in all_bytes])]), np.frombuffer(b"".join(all_bytes), np.uint8)


def cuts(offsets: np.ndarray, data: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): all starts of chunks, those of texts among them, and the hash of the bytes before each. None is within a character."""
    n = len(data)
    h, size = data.astype(np.uint32) * np.uint32(2654435761) + np.uint32(12345), 1
    while size < WINDOW:
        h[: n - size] = h[: n - size] * np.uint32(pow(0x9E3779B1, size, 1 << 32)) + h[size:] if n > size else h[: n - size]
        size *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    at = np.flatnonzero((h[: max(0, n - WINDOW)] >> np.uint32(8)) % np.uint32(chunk) == 0) + WINDOW
    at = at[(data[at] & 0xC0) != 0x80]
    start = offsets[np.searchsorted(offsets, at, "right") - 1]
    at = at[at - start >= WINDOW]
    return np.union1d(at, offsets[:-1][np.diff(offsets) > 0]), h


class Encoder:
    """Encodes texts by chunks. What repeats is kept, least recently used first to go; counts what was encoded and reused, and the joins that were repaired."""

    def __init__(self, path: str = VOCABULARY, kept: int = KEPT):
        self.encoding, self.bounds, self.kept = encoding(path), token_bytes(path)[0], kept
        self.small = self.encoding.n_vocab <= 1 << 16
        self.new: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.texts = self.encoded = self.reused = self.repaired = 0

    def _tokens(self, raw: bytes) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(raw.decode()), np.uint16 if self.small else np.uint32)

    def _anchored(self, raw: bytes) -> tuple:
        """(tokens, place of the first anchor, tokens before it, place of the last anchor, tokens before it); places are -1 without an anchor."""
        tokens = self._tokens(raw)
        m = ANCHOR.search(raw)
        if not m:
            return tokens, -1, 0, -1, 0
        ends = np.cumsum(self.bounds[tokens.astype(np.int64) + 1] - self.bounds[tokens])
        first = last = m.end()
        at = len(raw)
        while True:  # the last anchor, from the end on
            at = max(at - 64, first - 1)
            late = [x.end() for x in ANCHOR.finditer(raw, at)]
            if late or at == first - 1:
                last = late[-1] if late else first
                break
        return tokens, first, int(np.searchsorted(ends, first)) + 1, last, int(np.searchsorted(ends, last)) + 1

    def _kept(self, raw: bytes, make):
        found = self.new.get(raw) or self.old.get(raw)
        if found:
            self.reused += 1
        else:
            self.encoded += 1
            found = make(raw)
        self.new[raw] = found
        if len(self.new) > self.kept:
            self.old, self.new = self.new, {}
        return found

    def encode(self, chunks: list[tuple[bytes, bool]]) -> list[np.ndarray]:
        """Pieces of the encoding of the joined text of (chunk, does it repeat)."""
        self.texts += 1
        if not chunks:
            return []
        if len(chunks) == 1:
            raw, repeats = chunks[0]
            if repeats:
                return [self._kept(raw, self._anchored)[0]]
            self.encoded += 1
            return [self._tokens(raw)]
        parts = []
        for raw, repeats in chunks:
            if repeats:
                parts.append(self._kept(raw, self._anchored))
            else:
                self.encoded += 1
                parts.append(self._anchored(raw))
        out: list[np.ndarray] = []
        pending: list[bytes] = []  # bytes since the last place that agrees
        held = None  # the chunk since such a place, with the token to go on from
        for (raw, _), part in zip(chunks, parts):
            if not pending and held is None:
                held = (raw, part, 0)  # the start of the text agrees
                continue
            if held is not None:
                h_raw, (tokens, _, _, last, before), at = held
                if last >= 0:
                    out.append(tokens[at:before])
                    pending = [h_raw[last:]]
                else:
                    pending = [h_raw]
                held = None
            _, first, before, _, _ = part
            if first < 0:
                pending.append(raw)
                continue
            pending.append(raw[:first])
            out.append(self._join(b"".join(pending)))
            pending, held = [], (raw, part, before)
        if held is not None:
            out.append(held[1][0][held[2] :])
        elif pending:
            out.append(self._join(b"".join(pending)))
        return out

    def _join(self, raw: bytes) -> np.ndarray:
        self.repaired += 1
        return self._tokens(raw)


def runs(raw: bytes, cut: list[int], again: list[bool]) -> list[tuple[bytes, bool]]:
    """(bytes, does it repeat) of a text's chunks, which start at `cut`; neighbours that don't repeat are one."""
    out, start = [], 0
    for k in range(1, len(cut) + 1):
        if k == len(cut) or again[k] or again[k - 1]:
            out.append((raw[cut[start] : cut[k] if k < len(cut) else len(raw)], again[start]))
            start = k
    return out


def _together(n: int, chunk: int, together: int):
    """Packs texts by the least hash of their chunks, with the places and hashes of the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        sent: dict[int, int] = {}
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            flags = np.asarray(ids.is_valid()).astype(np.int8) + 2 * np.asarray(texts.is_valid()).astype(np.int8)
            ids = ids.fill_null(0).to_numpy()
            for a, b, offsets, data in parts(texts):
                at, _ = cuts(offsets, data, chunk)
                raw = data.tobytes()
                row = np.searchsorted(offsets, at, "right") - 1
                ends = np.append(at[1:], len(data))
                hashes = np.array([xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(at.tolist(), ends.tolist())], U)
                least = np.full(b - a, np.iinfo(np.uint64).max, U)
                np.minimum.at(least, row, hashes)
                # a text without a chunk goes anywhere
                blank = np.diff(offsets) == 0
                least[blank] = mix(np.arange(a, a + int(blank.sum())).astype(U))
                turn = np.zeros(b - a, U)
                for i, key in enumerate(least.tolist()):
                    k = sent[key] = sent.get(key, -1) + 1
                    turn[i] = k // together
                if len(sent) > 500_000:
                    sent = {}
                bucket = (mix(least + turn * U(0x9E3779B97F4A7C15)) % U(n)).astype(np.int64)
                order = np.lexsort((least, bucket))
                first = np.searchsorted(row, np.arange(b - a + 1))
                cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [b - a]])
                sizes, rows = np.diff(offsets), []
                for s, e in zip(cut[:-1], cut[1:]):
                    some = order[s:e]
                    mine = np.concatenate([np.arange(first[i], first[i + 1]) for i in some]) if e > s else np.zeros(0, np.int64)
                    joined = b"".join(raw[offsets[i] : offsets[i + 1]] for i in some)
                    whole = [xxhash.xxh3_64_intdigest(raw[offsets[i] : offsets[i + 1]]) for i in some]
                    x = {"id": ids[a + some], "flags": flags[a + some], "size": sizes[some], "cut": at[mine] - offsets[row[mine]], "hash": hashes[mine], "whole": np.array(whole, U)}
                    rows.append((int(bucket[some[0]]), *(x[c].astype(t).tobytes() for c, t in KINDS.items()), codec.compress(joined, asbytes=True) if joined else b""))
                kinds = (pa.int32(), *(pa.binary() for _ in range(len(KINDS) + 1)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["bucket", *KINDS, "text"])

    return run


def _list(pieces: list[list[np.ndarray]], null: np.ndarray) -> pa.Array:
    flat = [x for p in pieces for x in p]
    lengths = np.array([sum(len(x) for x in p) for p in pieces], np.int64)
    values = pa.array(np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32))
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.append(null, False))
    return pa.ListArray.from_arrays(offsets, values)


def _twice(batches: list[pa.RecordBatch], column: str) -> np.ndarray:
    """The hashes that the packed rows have more than once, sorted."""
    x = np.sort(unpack(batches, {column: U})[column])
    same = x[1:] == x[:-1]
    return np.unique(x[1:][same])


def _repeats(hashes: np.ndarray, twice: np.ndarray) -> np.ndarray:
    return twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes if len(twice) else np.zeros(len(hashes), bool)


def _each_text(batches: Iterator[pa.RecordBatch]):
    """(packed row, ids, flags, [chunks of each text]) of all packed rows of a task, which are held as they came, compressed."""
    held = list(batches)
    codec = pa.Codec("zstd", 1)
    chunks_twice, texts_twice = _twice(held, "hash"), _twice(held, "whole")
    for batch in held:
        for r in range(batch.num_rows):
            one = batch.slice(r, 1)
            x = unpack([one], KINDS)
            offsets = np.concatenate([[0], np.cumsum(x["size"])])
            raw = one.column("text")[0].as_buffer()
            raw = codec.decompress(raw, int(offsets[-1]), asbytes=True) if offsets[-1] else b""
            again, whole = _repeats(x["hash"], chunks_twice), _repeats(x["whole"], texts_twice)
            # a chunk that starts a text has place 0, and each text with bytes has one
            start = np.append(np.flatnonzero(x["cut"] == 0), len(x["cut"]))
            k, out = 0, []
            for i in range(len(x["id"])):
                text = raw[offsets[i] : offsets[i + 1]]
                if not text:
                    out.append([])
                    continue
                own = slice(int(start[k]), int(start[k + 1]))
                k += 1
                out.append([(text, True)] if whole[i] else runs(text, x["cut"][own].tolist(), again[own].tolist()))
            yield x["id"], x["flags"], out


def _encode(path: str, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, kept)
        for ids, flags, texts in _each_text(batches):
            for at in range(0, len(ids), 500):
                part = slice(at, at + 500)
                tokens = _list([encoder.encode(t) for t in texts[part]], flags[part] < 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[part], mask=flags[part] % 2 == 0), tokens], names=["doc_id", "tokens"])

    return run


def _counts(path: str, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, kept)
        for _, _, texts in _each_text(batches):
            for t in texts:
                encoder.encode(t)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (encoder.texts, encoder.encoded, encoder.reused, encoder.repaired)], names=["texts", "encoded", "reused", "repaired"])

    return run


def _moved(docs: DataFrame, chunk: int, together: int, id_col: str, text_col: str) -> DataFrame:
    n = buckets(docs.sparkSession)
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cut.mapInArrow(_together(n, chunk, together), PACKED).repartitionById(n, "bucket")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, kept: int = KEPT, id_col: str = "doc_id", text_col: str = "text", together: int = TOGETHER) -> DataFrame:
    """(doc_id, tokens array<int>), one row for each row of docs, those that repeat too; null for a null text, empty for an empty one. A null id stays null, other columns aren't looked at, and an empty
    table gives no row. The vocabulary's file must be at that path on every machine."""
    return _moved(docs, chunk, together, id_col, text_col).mapInArrow(_encode(vocabulary, kept), "doc_id long, tokens array<int>")


def reuse(docs: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, kept: int = KEPT, id_col: str = "doc_id", text_col: str = "text", together: int = TOGETHER) -> DataFrame:
    """(texts, encoded, reused, repaired) of `encode`: texts, pieces that were encoded and that were taken from those kept, and joins that were encoded anew."""
    rows = _moved(docs, chunk, together, id_col, text_col).mapInArrow(_counts(vocabulary, kept), "texts long, encoded long, reused long, repaired long")
    return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("texts", "encoded", "reused", "repaired")))


def decoded(tokens: pa.ListArray, path: str) -> pa.Array:
    """The texts of lists of tokens; null for null. Bytes that aren't UTF-8 become U+FFFD."""
    bounds, table = token_bytes(path)
    flat = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = bounds[flat + 1] - bounds[flat]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    raw = table[np.arange(int(ends[-1])) + np.repeat(bounds[flat] - ends[:-1], lengths)]
    valid = np.asarray(tokens.is_valid())
    counts = np.where(valid, np.diff(np.asarray(tokens.offsets)), 0)
    at = ends[np.concatenate([[0], np.cumsum(counts)])]
    arr = pa.Array.from_buffers(pa.large_binary(), len(tokens), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
    try:
        out = arr.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        out = pa.array([x.as_py().decode(errors="replace") for x in arr], pa.string())
    return pa.array(out.to_pylist(), pa.string(), mask=~valid) if not valid.all() else out


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("tokens"), decoded(some.column("tokens"), path)], names=["doc_id", "tokens", "text"])

    return run


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, text) of (doc_id, tokens)."""
    return tokens.select("doc_id", "tokens").mapInArrow(_decode(vocabulary), "doc_id long, tokens array<int>, text string")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens, text_md5): the md5 of the text that the tokens decode to; nulls for a null text. A row for each row of docs, see `encode`."""
    back = decode(encode(docs, vocabulary), vocabulary)
    return back.select("doc_id", F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("n_tokens"), "tokens", F.md5("text").alias("text_md5"))
