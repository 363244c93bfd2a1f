"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has 128 bits: bit i is set where more than half of its distinct words (runs of letters and digits,
lower case) have bit i set in their own hash. Documents are near when at most `distance` bits differ; groups are the
connected components of that relation.

The bits are cut into blocks, and near fingerprints differ in at most their share of the distance in some block. The anchors of a block are the words of a covering code; fingerprints are
compared at each anchor. The code follows the number N of distinct fingerprints, so that comparing doesn't outgrow placing:

- up to SPARSE of them and 15 bits: 8 blocks of 16, of which two near ones differ in at most 1 bit of some block. The code is a perfect Hamming code on 15 of the bits, times the free 16th: 4,096 anchors
  with covering radius 1. Each fingerprint lies at its own anchor and is replicated to every anchor within the radius plus the share, 2, which are 8 or 9. It meets 0.017 N others.
- beyond: so few and wide blocks that the share is 2, 6 of 21 or 22 bits for 15 bits of distance. The code has radius 0, every value being an anchor, and the share is split between both sides: each
  fingerprint lies at the 22 or 23 values within 1 of its own, and two that differ in at most 2 bits of the block meet at one between them. It meets 0.0014 N others.

No pair within the distance is missed, and there is no cap on partners.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrays import ALNUM, U, components, hash_sql, mix, mix_sql, pack, parts, times_sql, unpack, word_hashes, words
from tessera.llm._shared import buckets, connected, joined, letters, stored

DISTANCE = 15
BITS = 128
BLOCKS, BLOCK_BITS = 8, 16
#: Distinct fingerprints up to which the sparse code places for less than its comparisons cost.
SPARSE = 100_000
K1, K2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
KINDS = {"anchor": np.int64, "home": np.int8, "id": np.int64, "hi": np.uint64, "lo": np.uint64}
PACKED = "bucket int, anchor binary, home binary, id binary, hi binary, lo binary"


@cache
def covering() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(own anchor of each 16-bit value, bounds and list of the anchors within 2 of each value, number of anchors)."""
    x = np.arange(1 << BLOCK_BITS)
    syndrome = np.zeros(len(x), np.int64)
    for i in range(1, 16):
        syndrome ^= np.where(x >> (i - 1) & 1, i, 0)
    number = np.cumsum(syndrome == 0) - 1
    own = number[np.where(syndrome > 0, x ^ (1 << np.maximum(syndrome - 1, 0)), x)]
    single = [1 << i for i in range(BLOCK_BITS)]
    masks = [0, *single, *(a | b for k, a in enumerate(single) for b in single[:k])]
    near = np.stack([syndrome[x ^ m] == 0 for m in masks], axis=1)
    value, mask = np.nonzero(near)
    bounds = np.concatenate([[0], np.cumsum(near.sum(axis=1))])
    return own, bounds, number[value ^ np.array(masks)[mask]], int(number[-1]) + 1


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, last, offsets, data in parts(batch.column(1)):
            starts, ends, row = words(offsets, data, ALNUM)
            n = last - first
            key = np.unique((row.astype(U) << U(48)) | (word_hashes(data, starts, ends) >> U(16)))
            row, feature = (key >> U(48)).astype(np.int64), key & U((1 << 48) - 1)
            out = np.zeros((n, 2), U)
            if len(key):
                bits = np.stack([mix(feature * U(K1)), mix(feature * U(K2))], axis=1)
                bits = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")
                at = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
                count = np.diff(np.concatenate([at, [len(row)]]))
                ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
                out[row[at]] = np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(U)
            none = np.bincount(row, minlength=n) == 0
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, n), *(pa.array(out[:, k].view(np.int64), pa.int64(), mask=none) for k in (0, 1))], names=["doc_id", "hi", "lo"]
            )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hi, lo): the halves of the fingerprint; null for a null or wordless text. One row for each row of docs."""
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), letters(F.col(text_col)).alias("text"))
    return cut.mapInArrow(_fingerprints, "doc_id long, hi long, lo long")


def blocks_for(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of as few blocks as leave a share of 2."""
    m = distance // 3 + 1
    edges = [BITS * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _values(hi: np.ndarray, lo: np.ndarray, first: int, bits: int) -> np.ndarray:
    """The bits of a block, hi having the first 64."""
    mask = U((1 << bits) - 1) if bits < 64 else U(0xFFFFFFFFFFFFFFFF)
    if first >= 64:
        return (lo >> U(first - 64)) & mask
    low = hi >> U(first)
    return (low | (lo << U(64 - first) if first and first + bits > 64 else low)) & mask


def _replicate_within(n: int, distance: int):
    """For a share of 2: a bucket has the values of equal upper half, so that a fingerprint goes to one for its own value, from where `near_pairs` places it at those that differ in the lower half, and to one for each bit of the upper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = blocks_for(distance)
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                some = batch.slice(at, 10_000)
                ids, hi, lo = (some.column(k).to_numpy() for k in (0, 1, 2))
                anchor, bucket, home, rows = [], [], [], []
                for k, (first, bits) in enumerate(blocks):
                    lower = bits // 2
                    masks = np.array([0, *(1 << i for i in range(lower, bits))], np.int64)
                    value = (_values(hi.view(U), lo.view(U), first, bits).astype(np.int64)[:, None] ^ masks).ravel()
                    # the block's number is in the anchor, above its bits
                    anchor.append(value | (k << 56))
                    bucket.append((mix((value >> lower).astype(U) + (U(k) << U(56))) % U(n)).astype(np.int64))
                    home.append(np.tile(masks == 0, len(ids)).astype(np.int8))
                    rows.append(np.repeat(np.arange(len(ids)), len(masks)))
                anchor, bucket, home, rows = map(np.concatenate, (anchor, bucket, home, rows))
                yield pack(bucket, {"anchor": anchor, "home": home, "id": ids[rows], "hi": hi[rows], "lo": lo[rows]})

    return run


def _replicate(n: int, distance: int = DISTANCE, wide: bool | None = None):
    if distance >= 2 * BLOCKS if wide is None else wide:
        return _replicate_within(n, distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bounds, near, anchors = covering()
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                some = batch.slice(at, 20_000)
                ids, hi, lo = (some.column(k).to_numpy() for k in (0, 1, 2))
                blocks = np.stack([hi, lo], axis=1).view(np.uint16).astype(np.int64)
                rows, anchor, home = [], [], []
                for k in range(BLOCKS):
                    value = blocks[:, k]
                    rows.append(np.arange(len(value)))
                    anchor.append(own[value] + k * anchors)
                    home.append(np.ones(len(value), np.int8))
                    count = bounds[value + 1] - bounds[value]
                    shift = np.repeat(bounds[value] - np.concatenate([[0], np.cumsum(count[:-1])]), count)
                    rows.append(np.repeat(np.arange(len(value)), count))
                    anchor.append(near[np.arange(int(count.sum())) + shift] + k * anchors)
                    home.append(np.zeros(int(count.sum()), np.int8))
                rows, anchor, home = np.concatenate(rows), np.concatenate(anchor).astype(np.int64), np.concatenate(home)
                yield pack(anchor % n, {"anchor": anchor, "home": home, "id": ids[rows], "hi": hi[rows], "lo": lo[rows]})

    return run


def _pairs_of_all(cuts, ids, hi, lo, distance: int, small: int = 64) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pairs within the distance, each fingerprint compared with those after it at its anchor; cuts bound the anchors."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(i, j):
        left.append(np.minimum(ids[i], ids[j]))
        right.append(np.maximum(ids[i], ids[j]))

    sizes = np.diff(cuts)
    end = np.repeat(cuts[1:], sizes)
    at, k = np.flatnonzero(np.repeat(sizes <= small, sizes)), 1
    while len(at := at[at + k < end[at]]):
        i = at[np.bitwise_count(hi[at] ^ hi[at + k]).astype(np.int16) + np.bitwise_count(lo[at] ^ lo[at + k]) <= distance]
        add(i, i + k)
        k += 1
    for s, e in zip(cuts[:-1][sizes > small], cuts[1:][sizes > small]):
        step = max(1, min((e - s + 3) // 4, 2_000_000 // (e - s)))
        for at in range(s, e, step):
            to = min(e, at + step)
            apart = np.bitwise_count(hi[at:to, None] ^ hi[None, at:e]).astype(np.int16) + np.bitwise_count(lo[at:to, None] ^ lo[None, at:e])
            i, j = np.nonzero(apart <= distance)
            keep = i < j
            add(at + i[keep], at + j[keep])
    return left, right


def near_pairs(anchor, home, ids, hi, lo, distance: int, wide: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the distance among the fingerprints of some anchors: of those at home with the others, or for a share of 2, of all."""
    wide = distance >= 2 * BLOCKS if wide is None else wide
    if wide:
        parts_ = [(np.arange(len(anchor)), np.zeros(len(anchor), np.int64))]
        for k, (_, bits) in enumerate(blocks_for(distance)):
            own = np.flatnonzero((anchor >> 56 == k) & (home > 0))
            parts_.append((np.repeat(own, bits // 2), np.tile(1 << np.arange(bits // 2, dtype=np.int64), len(own))))
        rows, flip = (np.concatenate(x) for x in zip(*parts_))
        anchor, home, ids, hi, lo = anchor[rows] ^ flip, home[rows], ids[rows], hi[rows], lo[rows]
    order = np.lexsort((home, anchor))
    anchor, home, ids, hi, lo = anchor[order], home[order], ids[order], hi[order], lo[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)]]) if len(anchor) else np.zeros(1, np.int64)
    if wide:
        return tuple(map(np.concatenate, _pairs_of_all(cuts, ids, hi, lo, distance)))
    homes = np.concatenate([[0], np.cumsum(home)])
    left, right = [], []
    for s, e in zip(cuts[:-1], cuts[1:]):
        m = e - int(homes[e] - homes[s])
        if m == e:
            continue
        step = max(1, 2_000_000 // (e - m))
        for at in range(s, m, step):
            to = min(m, at + step)
            apart = np.bitwise_count(hi[at:to, None] ^ hi[None, m:e]).astype(np.int16) + np.bitwise_count(lo[at:to, None] ^ lo[None, m:e])
            i, j = np.nonzero(apart <= distance)
            a, b = ids[at + i], ids[m + j]
            keep = a < b
            left.append(a[keep])
            right.append(b[keep])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _compare(distance: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = unpack(list(batches), KINDS)
        a, b = near_pairs(x["anchor"], x["home"], x["id"], x["hi"].view(U), x["lo"].view(U), distance, wide)
        # a spanning star of what is connected here says as much as all its pairs
        nodes, root = components(a, b)
        other = nodes != root
        for at in range(0, int(other.sum()), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(root[other][at : at + 100_000]), pa.array(nodes[other][at : at + 100_000])], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, n_group, kept): the documents that have near duplicates, group_id the least doc_id of the group, which is kept.

    Documents without a near duplicate, with a null id, or with a null or wordless text are in no group. doc_id names the document:
    rows that repeat it are one document, whose fingerprint is the least of theirs. Other columns are not looked at.
    """
    if not 0 <= distance < BITS // 2:
        raise ValueError(f"distance must be within 0 and {BITS // 2 - 1}")
    spark = docs.sparkSession
    prints = fingerprints(docs, id_col, text_col).where("doc_id is not null and hi is not null")
    prints = prints.groupBy("doc_id").agg(F.min(F.struct("hi", "lo")).alias("p"))
    prints = stored(prints.select("doc_id", "p.*"), "fingerprints")
    distinct = stored(prints.groupBy("hi", "lo").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "distinct")
    n = buckets(spark)
    wide = distance >= 2 * BLOCKS or distinct.count() > SPARSE
    moved = distinct.select("id", "hi", "lo").mapInArrow(_replicate(n, distance, wide), PACKED)
    edges = moved.repartitionById(n, "bucket").mapInArrow(_compare(distance, wide), "a long, b long")
    grouped = distinct.join(connected(edges), "id", "left").select("hi", "lo", "n", F.coalesce("root", "id").alias("group_id"))
    sized = grouped.groupBy("group_id").agg(F.sum("n").alias("n_group"), F.count("*").alias("own")).where("n_group > 1")
    # copies have one fingerprint, which may be that of a third of all documents
    found = joined(prints, joined(grouped, sized, ["group_id"], "own", "hi"), ["hi", "lo"], "n", "doc_id")
    return found.select("doc_id", "group_id", "n_group", (F.col("doc_id") == F.col("group_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one document of each group of near duplicates; documents in no group stay, see `near_duplicates`."""
    dropped = near_duplicates(docs, distance, id_col, text_col).where("not kept").select("doc_id")
    # the columns have other names meanwhile, as theirs may be any
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    kept = rows.join(dropped, F.col(f"c{docs.columns.index(id_col)}").cast("long") == F.col("doc_id"), "left_anti")
    return kept.toDF(*docs.columns)


_bits = f"[{mix_sql(times_sql('f', K1))}, {mix_sql(times_sql('f', K2))}]"
#: Brute force over all pairs of distinct fingerprints.
SQL = f"""
WITH RECURSIVE vocabulary AS MATERIALIZED (
  SELECT w, {hash_sql("w")} >> 16 AS f
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')) AS w FROM documents WHERE doc_id IS NOT NULL)
), hashed AS MATERIALIZED (SELECT w, f, {_bits} AS h FROM vocabulary),
doc_words AS MATERIALIZED (
  SELECT DISTINCT doc_id, f, h FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')) AS w FROM documents WHERE doc_id IS NOT NULL) JOIN hashed USING (w)
), ones AS (
  SELECT doc_id, b, 2 * sum((h[1 + b // 64] >> (b % 64)) & 1) > count(*) AS bit FROM doc_words, range(128) AS t(b) GROUP BY doc_id, b
), prints AS MATERIALIZED (
  SELECT doc_id, sum(CASE WHEN bit AND b < 64 THEN 1::UBIGINT << b ELSE 0 END)::UBIGINT AS hi, sum(CASE WHEN bit AND b >= 64 THEN 1::UBIGINT << (b - 64) ELSE 0 END)::UBIGINT AS lo
  FROM ones GROUP BY doc_id
), edges AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM prints x, prints y WHERE x.doc_id <> y.doc_id AND bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= {DISTANCE}
), reach AS (
  SELECT doc_id AS id, doc_id AS root FROM prints
  UNION
  SELECT b, root FROM reach JOIN edges ON id = a
), grouped AS (SELECT id AS doc_id, min(root) AS group_id FROM reach GROUP BY id)
SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS n_group, doc_id = group_id AS kept FROM grouped
QUALIFY n_group > 1
"""
