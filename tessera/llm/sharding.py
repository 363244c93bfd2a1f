"""Sharding by longest-processing-time scheduling: groups that must stay together, sorted by size, go to the least-loaded shard.

Groups are taken by size, the largest first, those of one size in an order by the md5 of their key; of equally loaded shards the first takes the group. What is scheduled is the classes of equal size, of
which there are as many as distinct sizes, however many groups there are. N characters have at most sqrt(2 N) of these (14 million of 100 TB), so one task goes through them in order and writes what it
decides class by class; nothing comes to the driver. Fewer groups than shards go through a heap, and their shards are written; of more, each shard has taken its share when the load has risen to a common
level, which is found by bisection, and the loads before are written: the same arithmetic gives the shard of the group with a given rank, where the groups are.

Ranks within a class are prefix sums over slices of the md5, so that no task gets a whole class. The table is read once: keys and lengths are stored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import joined, stored

SHARDS = 64


def _below(loads: np.ndarray, size: int, level: int) -> np.ndarray:
    """Groups that each shard has taken when it takes no more at a load of `level` or above."""
    return np.maximum(0, -((loads - level) // size))


def fill(loads: np.ndarray, size: int, count: int) -> np.ndarray:
    """Loads after `count` groups of one size."""
    if size <= 0 or count <= 0:
        return loads
    if count < len(loads):
        heap = [(int(x), k) for k, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            x, k = heap[0]
            heapq.heapreplace(heap, (x + size, k))
        loads = loads.copy()
        for x, k in heap:
            loads[k] = x
        return loads
    low, high = int(loads.min()), int(loads.max()) + size * (count // len(loads) + 2)
    while high - low > 1:  # the highest level that takes at most count
        mid = (low + high) // 2
        low, high = (mid, high) if int(_below(loads, size, mid).sum()) <= count else (low, mid)
    taken = _below(loads, size, low)
    rest = count - int(taken.sum())
    loads = loads + taken * size
    # those left go to the shards that stand at the level, the first ones first
    loads[np.flatnonzero(loads == low)[:rest]] += size
    return loads


def shard_of(loads: np.ndarray, size: int, ranks: np.ndarray) -> np.ndarray:
    """The shard of the groups with these ranks, from 0, of a class of one size, given the loads before it."""
    if size <= 0:
        return np.full(len(ranks), int(np.argmin(loads)))
    low = np.full(len(ranks), int(loads.min()))
    high = np.full(len(ranks), int(loads.max()) + size * (int(ranks.max()) // len(loads) + 2))
    while (high - low > 1).any():
        mid = (low + high) // 2
        few = _below(loads[None, :], size, mid[:, None]).sum(axis=1) <= ranks
        low, high = np.where(few, mid, low), np.where(few, high, mid)
    taken = _below(loads[None, :], size, low[:, None])
    rest = ranks - taken.sum(axis=1)
    at_level = loads[None, :] + taken * size == low[:, None]
    return np.argmax(np.cumsum(at_level, axis=1) == rest[:, None] + 1, axis=1)


def schedule(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(size, shards of the groups by rank, loads before) of classes (size, count), the largest first. Of classes of fewer groups than shards the loads are left out, of others the shards."""
    loads = np.zeros(shards, np.int64)
    for size, count in classes:
        if size > 0 and count < shards:
            heap = [(int(x), k) for k, x in enumerate(loads)]
            heapq.heapify(heap)
            taken = []
            for _ in range(count):
                x, k = heap[0]
                heapq.heapreplace(heap, (x + size, k))
                taken.append(k)
                loads[k] += size
            yield size, taken, []
        else:
            yield size, [], loads.tolist()
            loads = fill(loads, size, count)


PLAN = "size long, taken array<int>, loads array<long>"


def _scheduled(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = (c for b in batches for c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        plan = schedule(classes, shards)
        while some := list(islice(plan, 1000)):
            cols = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))], names=["size", "taken", "loads"])

    return run


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, rank = (batch.column(c).to_numpy() for c in ("size", "rank"))
        out = np.zeros(len(size), np.int32)
        loads = batch.column("loads")
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            before = np.array(loads[int(at[0])].as_py(), np.int64)
            for k in range(0, len(at), 20_000):
                part = at[k : k + 20_000]
                out[part] = shard_of(before, int(s), rank[part])
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("alone"), batch.column("size"), batch.column("n"), pa.array(out)], names=["key", "alone", "size", "n", "shard"])


def shard_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(key, alone, size, n, shard) of groups (key string, alone boolean, size long, n long), key and alone unique together; n goes through.

    Groups of size 0 all go to the shard that is least loaded when all others have been placed.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    # slices of a class: by the first three digits of the md5
    rows = groups.withColumn("h", F.md5("key")).withColumn("s", F.substring("h", 1, 3))
    counts = rows.groupBy("size", "s").agg(F.count("*").alias("count"))
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("size").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ordered = counts.groupBy("size").agg(F.sum("count").alias("count")).repartition(1).sortWithinPartitions(F.desc("size"))
    plan = stored(ordered.mapInArrow(_scheduled(shards), PLAN), "plan")
    placed = before.join(plan, "size").select("size", F.col("s"), "before", "taken", "loads")
    own = F.row_number().over(Window.partitionBy("size", "s").orderBy("h", "key", "alone")) - 1
    # of size 0 no rank is needed, and all groups without a text may be of it
    sized = rows.where("size > 0").withColumn("k", own)
    ranked = sized.join(placed, ["size", "s"]).withColumn("rank", (F.col("before") + F.col("k")).cast("long"))
    few = ranked.where(F.size("taken") > 0).select("key", "alone", "size", "n", F.get("taken", F.col("rank").cast("int")).alias("shard"))
    filled = ranked.where(F.size("taken") == 0).select("key", "alone", "size", "n", "rank", "loads").mapInArrow(_assign, "key string, alone boolean, size long, n long, shard int")
    least = plan.where("size <= 0").select(F.expr("cast(array_position(loads, array_min(loads)) - 1 as int)").alias("shard"))
    empty = rows.where("size <= 0").select("key", "alone", "size", "n").crossJoin(F.broadcast(least.limit(1)))
    return few.unionAll(filled).unionAll(empty)


def copies_key(text: Column) -> Column:
    """Documents with the same text have the same key."""
    return F.md5(text)


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_key, group_size, shard), one row for each row of docs. group_size: code points of the group's texts.

    key: what must stay together; None: documents with the same text. Rows with a null key are together if they have the same id, and their group_key is 'id:' and the id; rows with both null are one
    group, 'id:'. Such a group is another than that of a key that reads the same. A null text has size 0; groups of size 0 all go to one shard. Rows that repeat stay, and so does a group of however
    many rows: its rows are split over tasks, not over shards. An empty table gives no row; other columns aren't looked at.
    """
    key = copies_key(F.col(text_col)) if key is None else key.cast("string")
    alone = F.concat(F.lit("id:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(key, alone).alias("key"), key.isNull().alias("alone"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "keys")
    groups = stored(rows.groupBy("key", "alone").agg(F.sum("chars").alias("size"), F.count("*").alias("n")), "groups")
    placed = joined(rows, shard_groups(groups, shards), ["key", "alone"], "n", "row")
    return placed.select("doc_id", F.col("key").alias("group_key"), F.col("size").alias("group_size"), "shard")


#: One group after the other.
SQL = f"""
WITH RECURSIVE g AS MATERIALIZED (
  SELECT group_key, group_size, row_number() OVER (ORDER BY group_size DESC, md5(group_key), group_key) AS k
  FROM (SELECT coalesce(md5(text), 'id:' || coalesce(doc_id::VARCHAR, '')) AS group_key, sum(coalesce(length(text), 0))::BIGINT AS group_size FROM documents GROUP BY 1)
), s AS (
  SELECT 0::BIGINT AS k, list_transform(range({SHARDS}), lambda x: 0::BIGINT) AS loads, -1 AS shard
  UNION ALL
  SELECT g.k, list_transform(range({SHARDS}), lambda i: loads[i + 1] + CASE WHEN i + 1 = list_position(loads, list_min(loads)) THEN group_size ELSE 0 END), list_position(loads, list_min(loads)) - 1
  FROM s JOIN g ON g.k = s.k + 1
)
SELECT doc_id, group_key, group_size, shard::INT AS shard
FROM documents JOIN g ON group_key = coalesce(md5(text), 'id:' || coalesce(doc_id::VARCHAR, '')) JOIN s ON s.k = g.k
"""
