"""Substring dedup by difference-cover anchors.

A word is a run of anything but ASCII white space. A passage of `min_words` words is a repeat where the same words occur
earlier: in a document with a smaller doc_id, or further ahead in the same one. Its spans are the runs of such passages.

D is a perfect difference set modulo v: any two places of the corpus come into D together within the next v - 1 words. So only
the windows of min_words - v + 1 words that start at a place in D (modulo v, within their document) are hashed and shuffled, as
anchors; two equal passages share an aligned anchor at the same depth. Where an anchor's hash occurs twice, all passages around it are
candidates, and the anchor is extended to these: their own hashes are grouped, the first place of each is its origin and
all others are repeats. All repeats of the length are found. Passages are told apart by 96 bits: of 10^13 passages, 100 TB, two
that differ are taken for one with a chance of 1 in 1600; anchors by 64, as a chance match only adds a candidate.

A passage may be in a third of all documents. A task that reads documents settles what it sees twice itself and sends each hash on once; only the first KEPT places of a
passage that it meets go where the hash is, the others wait where the document is and are told its origin. So of one passage, one task gets KEPT + 1 places from each of the others at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrays import PACKED_AT_ONCE, U, mix, pack, packed, parts, unpack, windows, word_hashes, words
from tessera.llm._shared import buckets

MIN_WORDS = 50
#: Perfect difference sets: every difference modulo v comes up exactly once.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63)}
#: Anchors that a task looks for repeats among at once, and places of a passage that it sends to where its hash is.
AT_ONCE, KEPT = 3_000_000, 8
#: kind 0: places to be looked up by their hash; 1: places that are known to be repeats; 2: the first place of a hash of which more wait, `at` the bucket where they do.
PACKED = "bucket int, kind int, hash binary, check binary, doc binary, pos binary, at binary"
KINDS = {"hash": np.uint64, "check": np.uint32, "doc": np.int64, "pos": np.int32, "at": np.int32}


def _rows(kind: int, bucket: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed places; columns that aren't given are empty."""
    full = {c: columns[c].astype(t) for c, t in KINDS.items() if c in columns}
    for batch in packed(bucket.astype(np.int64), full):
        n = batch.num_rows
        none = pa.array([None] * n, pa.binary())
        cols = [batch.column("bucket"), pa.array(np.full(n, kind, np.int32)), *(batch.column(c) if c in full else none for c in KINDS)]
        yield pa.RecordBatch.from_arrays(cols, names=["bucket", "kind", *KINDS])


def _by_kind(batches: Iterator[pa.RecordBatch], kinds: tuple[int, ...]) -> dict[int, list[pa.RecordBatch]]:
    out: dict[int, list[pa.RecordBatch]] = {k: [] for k in kinds}
    for batch in batches:
        of = batch.column("kind").to_numpy()
        for k in kinds:
            if (of == k).any():
                out[k].append(batch.filter(pa.array(of == k)))
    return out


def period_for(min_words: int) -> int:
    """The largest period that leaves anchors of at least 40 % of the length, which keeps chance matches rare."""
    if min_words < 4:
        raise ValueError("min_words must be 4 or more")
    return max(v for v in COVERS if v == 3 or min_words - v + 1 >= 0.4 * min_words)


def _doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return (doc ^ (doc >> 15)) % n


def _doc_bucket_column(n: int):
    return F.expr(f"cast(pmod(doc_id ^ shiftright(doc_id, 15), {n}L) as int)")


def _laid_out(offsets: np.ndarray, data: np.ndarray, n_docs: int):
    """(hashes, document, place in the document, words of the document) of all words."""
    starts, ends, row = words(offsets, data)
    count = np.bincount(row, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count[:-1])]) if n_docs else count
    return word_hashes(data, starts, ends), row, np.arange(len(row)) - first[row], count


def _hash_bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> U(33)) % U(n)).astype(np.int64)


def _anchors(n: int, min_words: int, period: int, at_once: int):
    """Anchors that a task has once, by their hash; those that it has several times, once by their hash and all by their documents, as repeats."""

    def settled(hashes, docs, places):
        h, doc, pos = np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        alone = np.zeros(len(h), bool)
        alone[order] = new & np.concatenate([new[1:], [True]])
        first = np.zeros(len(h), bool)
        first[order[new]] = True
        yield from _rows(0, _hash_bucket(h[first], n), hash=h[first], doc=doc[first], pos=pos[first])
        if not alone.all():
            again = ~alone
            yield from _rows(1, _doc_bucket(doc[again], n), doc=doc[again], pos=pos[again])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = min_words - period + 1
        cover = np.isin(np.arange(period), COVERS[period])
        held, size = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for a, b, offsets, data in parts(batch.column("text")):
                h, row, pos, count = _laid_out(offsets, data, b - a)
                keep = cover[pos % period] & (pos + width <= count[row]) & (count[row] >= min_words)
                if keep.any():
                    held.append((windows(h, width)[keep], ids[a + row[keep]], pos[keep].astype(np.int32)))
                    size += len(held[-1][0])
                    if size > at_once:
                        yield from settled(*zip(*held))
                        held, size = [], 0
        if held:
            yield from settled(*zip(*held))

    return run


def _repeated(n: int):
    """Places of the anchors whose hash is there twice, and those known before, packed by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _by_kind(batches, (0, 1))
        yield from of[1]
        x = unpack(of[0], {k: KINDS[k] for k in ("hash", "doc", "pos")})
        order = np.argsort(x["hash"], kind="stable")
        h = x["hash"][order]
        same = h[1:] == h[:-1]
        twice = np.zeros(len(h), bool)
        twice[1:] |= same
        twice[:-1] |= same
        order = order[twice]
        if len(order):
            doc = x["doc"][order]
            yield from _rows(1, _doc_bucket(doc, n), doc=doc, pos=x["pos"][order])

    return run


def _check(data: np.ndarray, offsets: np.ndarray, min_words: int) -> np.ndarray:
    """32 more bits of the passage from each word on, by other powers than the hash."""
    starts, ends, _ = words(offsets, data)
    return (windows(mix(word_hashes(data, starts, ends) ^ U(0xA5A5A5A5A5A5A5A5)), min_words) >> U(32)).astype(np.uint32)


def _candidates(n: int, min_words: int, width: int, kept: int, at_once: int):
    """The passages around repeated anchors. In each partition the flags come before the texts. Of a passage that is met more than `kept` times, the first of each part of the texts go to its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, docs, places, bounds = [], None, None, None
        met: dict[str, list[np.ndarray]] = {k: [] for k in ("hash", "check", "doc", "pos")}
        size, bucket = 0, None

        def settled():
            h, check, doc, pos = (np.concatenate(met[k]) for k in ("hash", "check", "doc", "pos"))
            order = np.lexsort((pos, doc, check, h))
            h, check, doc, pos = h[order], check[order], doc[order], pos[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
            start = np.flatnonzero(new)
            count = np.diff(np.append(start, len(h)))
            many = np.repeat(count > kept, count)
            few = np.flatnonzero(~many)
            few = few[np.lexsort((pos[few], doc[few]))]
            yield from _rows(0, _hash_bucket(h[few], n), hash=h[few], check=check[few], doc=doc[few], pos=pos[few])
            if many.any():
                head = start[count > kept]
                yield from _rows(2, _hash_bucket(h[head], n), hash=h[head], check=check[head], doc=doc[head], pos=pos[head], at=np.full(len(head), bucket))
                yield from _rows(1, np.full(int(many.sum()), bucket), hash=h[many], check=check[many], doc=doc[many], pos=pos[many])

        for batch in batches:
            bucket = batch.column("bucket")[0].as_py() if batch.num_rows and bucket is None else bucket
            is_text = batch.column("kind").to_numpy() == 3
            if docs is None:
                head = batch.slice(0, int(np.searchsorted(is_text, True)))
                flags.append(head.select(["doc", "pos"]))
                if not is_text.any():
                    continue
                x = unpack(flags, {"doc": np.int64, "pos": np.int32})
                order = np.argsort(x["doc"], kind="stable")
                docs, first = np.unique(x["doc"][order], return_index=True)
                places, bounds = x["pos"][order], np.append(first, len(order))
                flags = []
            batch = batch.slice(int(np.searchsorted(is_text, True)))
            batch = batch.filter(pa.array(np.isin(batch.column("doc_id").to_numpy(), docs)))
            ids = batch.column("doc_id").to_numpy()
            for a, b, offsets, data in parts(batch.column("text")):
                h, row, pos, count = _laid_out(offsets, data, b - a)
                first = np.concatenate([[0], np.cumsum(count[:-1])])
                which = np.searchsorted(docs, ids[a:b])
                k = bounds[which + 1] - bounds[which]
                doc = np.repeat(np.arange(b - a), k)
                at = places[np.arange(len(doc)) + np.repeat(bounds[which] - np.concatenate([[0], np.cumsum(k[:-1])]), k)].astype(np.int64)
                # rows that repeat an id with another text can have fewer words than the flags say
                ok = (at + width <= count[doc]) & (count[doc] >= min_words)
                doc, at = doc[ok], at[ok]
                low = np.maximum(at - (min_words - width), 0)
                high = np.minimum(at, count[doc] - min_words) + 1
                ok = low < high
                mark = np.zeros(len(h) + 1, np.int32)
                np.add.at(mark, first[doc[ok]] + low[ok], 1)
                np.add.at(mark, first[doc[ok]] + high[ok], -1)
                keep = np.cumsum(mark[:-1]) > 0
                if keep.any():
                    for name, values in (("hash", windows(h, min_words)[keep]), ("check", _check(data, offsets, min_words)[keep]), ("doc", ids[a + row[keep]]), ("pos", pos[keep].astype(np.int32))):
                        met[name].append(values)
                    size += len(met["hash"][-1])
                    if size > at_once:
                        yield from settled()
                        met, size = {k: [] for k in met}, 0
        if size:
            yield from settled()

    return run


def _later(n: int):
    """All places but the first of each passage, with the first's document, packed by document; and the first place of each passage of which more wait, packed by where they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _by_kind(batches, (0, 1, 2))
        for waiting in of[1]:
            yield waiting.append_column("origin", pa.array([None] * waiting.num_rows, pa.binary()))
        kinds = {k: KINDS[k] for k in ("hash", "check", "doc", "pos")}
        x, y = unpack(of[0], kinds), unpack(of[2], KINDS)
        own = len(x["hash"])
        h, check, doc, pos = (np.concatenate([x[k], y[k]]) for k in kinds)
        if not len(h):
            return
        order = np.lexsort((pos, doc, check, h))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])])
        first = np.empty(len(h), np.int64)
        first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = np.flatnonzero((doc != doc[first]) | (pos != pos[first]))
        later = later[later < own]
        later = later[np.lexsort((pos[later], doc[later]))]
        if len(later):
            yield from _with_origin(0, _doc_bucket(doc[later], n), doc[first[later]], doc=doc[later], pos=pos[later])
        told = np.arange(own, len(h))
        if len(told):
            yield from _with_origin(2, y["at"].astype(np.int64), doc[first[told]], hash=h[told], check=check[told], pos=pos[first[told]])

    return run


def _with_origin(kind: int, bucket: np.ndarray, origin: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(bucket), PACKED_AT_ONCE):
        part = slice(a, a + PACKED_AT_ONCE)
        batch = pack(bucket[part].astype(np.int64), {**{c: v[part].astype(KINDS[c]) for c, v in columns.items()}, "origin": origin[part].astype(np.int64)})
        none = pa.array([None] * batch.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(np.full(batch.num_rows, kind, np.int32)), *(batch.column(c) if c in columns else none for c in KINDS), batch.column("origin")], names=["bucket", "kind", *KINDS, "origin"])


def _spans(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _by_kind(batches, (0, 1, 2))
        x = unpack(of[0], {"doc": np.int64, "pos": np.int32, "origin": np.int64})
        doc, pos, origin = x["doc"], x["pos"], x["origin"]
        if of[1]:
            wait = unpack(of[1], {k: KINDS[k] for k in ("hash", "check", "doc", "pos")})
            told = unpack(of[2], {"hash": np.uint64, "check": np.uint32, "pos": np.int32, "origin": np.int64})
            key = lambda y: mix(y["hash"] ^ (y["check"].astype(U) << U(32)))
            order = np.argsort(key(told), kind="stable")
            at = order[np.searchsorted(key(told)[order], key(wait))]
            later = (wait["doc"] != told["origin"][at]) | (wait["pos"] != told["pos"][at])
            doc, pos, origin = np.concatenate([doc, wait["doc"][later]]), np.concatenate([pos, wait["pos"][later]]), np.concatenate([origin, told["origin"][at][later]])
        order = np.lexsort((origin, pos, doc))
        doc, pos, origin = doc[order], pos[order], origin[order]
        if not len(doc):
            return
        # rows that repeat an id give the same places again
        fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])])
        doc, pos, origin = doc[fresh], pos[fresh], origin[fresh]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (origin[1:] != origin[:-1])]))
        last = np.append(first[1:], len(doc)) - 1
        for at in range(0, len(first), 100_000):
            f, e = first[at : at + 100_000], last[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[f]), pa.array(pos[f].astype(np.int32)), pa.array((pos[e] + min_words).astype(np.int32)), pa.array(origin[f])],
                names=["doc_id", "start_word", "end_word", "first_doc_id"],
            )

    return run


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id): spans of words, the end excluded, whose passages occur first in first_doc_id.

    Spans of one document that differ in their origin can overlap. A text that repeats itself has itself as origin. Null ids and
    null texts, and texts of fewer than min_words words, have none. doc_id names the document: rows that repeat it with the
    same text are one document; with other texts, each place belongs to the id and the spans hold for all its rows.
    """
    spark, period = docs.sparkSession, period_for(min_words)
    n, width = buckets(spark), min_words - period + 1
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    anchors = cut.mapInArrow(_anchors(n, min_words, period, AT_ONCE), PACKED).repartitionById(n, "bucket")
    flags = anchors.mapInArrow(_repeated(n), PACKED).select("bucket", "kind", F.lit(0).cast("long").alias("doc_id"), F.lit("").alias("text"), "doc", "pos")
    nothing = F.lit(None).cast("binary")
    texts = cut.select(_doc_bucket_column(n).alias("bucket"), F.lit(3).alias("kind"), "doc_id", "text", nothing.alias("doc"), nothing.alias("pos"))
    both = flags.unionAll(texts).repartitionById(n, "bucket").sortWithinPartitions("kind")
    passages = both.mapInArrow(_candidates(n, min_words, width, KEPT, AT_ONCE), PACKED).repartitionById(n, "bucket")
    later = passages.mapInArrow(_later(n), PACKED + ", origin binary").repartitionById(n, "bucket")
    return later.mapInArrow(_spans(min_words), "doc_id long, start_word int, end_word int, first_doc_id long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without the words of its spans, for rows of (row, text, spans)."""
    for batch in batches:
        texts, spans = batch.column("text"), batch.column("spans").to_pylist()
        out = [None] * batch.num_rows
        for a, b, offsets, data in parts(texts):
            starts, ends, row = words(offsets, data)
            count = np.bincount(row, minlength=b - a)
            first = np.concatenate([[0], np.cumsum(count)])
            for i in range(a, b):
                own, k = first[i - a], int(count[i - a])
                gone = np.zeros(k + 1, np.int32)
                for s in spans[i]:
                    gone[min(s["start_word"], k)] += 1
                    gone[min(s["end_word"], k)] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
                # white space before a kept run stays if there is text before it
                pieces = [data[starts[own + x] if not p else ends[own + x - 1] : ends[own + y - 1]].tobytes() for p, (x, y) in enumerate(zip(edge[::2], edge[1::2]))]
                out[i] = b"".join(pieces).decode()
        text = pa.array(out, pa.string())
        yield batch.drop_columns(["text", "spans"]).append_column("text", text)


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs without the words of their repeats; a document of which no word is left goes.

    Rows without a span are as they were, null ids and texts among them. Where the text is cut, chars_col, if there is such a
    column, becomes its length. White space that stood before a kept word stays, but at the start.
    """
    spans = repeats(docs, min_words, id_col, text_col).groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    names = docs.columns
    text = names.index(text_col)
    # the columns have other names until the end, as theirs may be any
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    found = rows.join(spans, F.col(f"c{names.index(id_col)}").cast("long") == F.col("doc_id"), "left")
    whole = found.where("spans is null").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
    hit = found.where("spans is not null").select(*(f"c{i}" for i in range(len(names)) if i != text), F.col(f"c{text}").alias("text"), "spans")
    kinds = {c: docs.schema[c].dataType.simpleString() for c in names}
    schema = ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(names) if i != text) + ", text string"
    cut = hit.mapInArrow(_cut, schema).where("text <> ''")
    back = [
        (F.col("text") if c == text_col else F.length("text").cast(kinds[c]) if c == chars_col else F.col(f"c{i}")).alias(c)
        for i, c in enumerate(names)
    ]
    return whole.unionAll(cut.select(*back))


#: Every passage of the corpus, grouped by its words.
SQL = f"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(text, '[^\\t\\n\\x0B\\f\\r ]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), p AS MATERIALIZED (
  SELECT doc_id, pos, md5(list_aggregate(ws[pos + 1 : pos + {MIN_WORDS}], 'string_agg', ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(len(ws) - {MIN_WORDS - 1})) AS pos FROM w WHERE len(ws) >= {MIN_WORDS})
), g AS (
  SELECT doc_id, pos, first_value(doc_id) OVER o AS d0, first_value(pos) OVER o AS p0 FROM p WINDOW o AS (PARTITION BY h ORDER BY doc_id, pos)
), r AS (
  SELECT doc_id, pos, d0, pos - row_number() OVER (PARTITION BY doc_id, d0 ORDER BY pos) AS island FROM g WHERE (doc_id, pos) <> (d0, p0)
)
SELECT doc_id, min(pos)::INT AS start_word, (max(pos) + {MIN_WORDS})::INT AS end_word, d0 AS first_doc_id FROM r GROUP BY doc_id, d0, island
"""
