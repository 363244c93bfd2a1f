"""Embedding near-dedup by lattice hashing.

In each of several tables a random projection takes a unit vector to eight dimensions, scaled, where it is decoded to the nearest point
of the lattice E8. A vector lies in its own cell and probes the cells of those neighbours of its point that it is closest to. What meets in a cell is compared by cosine, with
8-bit components whose error is bounded: pairs that this decides are done, the few within the error are verified with the vectors themselves. Groups are the connected components.
Cells shrink as vectors grow in number, and a table then finds fewer of the pairs; `layout` takes as many tables as make up for it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrays import U, components, mix, pack, unpack
from tessera.llm._shared import buckets, connected, joined, stored

COSINE = 0.9
TABLES, PROBES = 4, 4
#: Vectors that a cell of the lattice should hold on average, were they spread evenly: the scale of the projection follows from it.
CELL = 24
#: Share that the tables should find of pairs just at the threshold; nearer pairs are found more often. SIZES times CELL are the cells to choose from.
RECALL = 0.95
SIZES = (1, 4, 16, 64)
KINDS = {"cell": np.uint64, "home": np.int8, "id": np.int64, "scale": np.float32, "error": np.float32, "q": np.int8}
PACKED = "bucket int, cell binary, home binary, id binary, scale binary, error binary, q binary"

ROOTS = np.array(
    [v for v in itertools.product((-1, 0, 1), repeat=8) if sum(map(abs, v)) == 2] + [tuple(x / 2 for x in v) for v in itertools.product((-1, 1), repeat=8) if sum(x < 0 for x in v) % 2 == 0],
    float,
)


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: the closer one of D8 and D8 shifted by a half."""

    def d8(y):
        r = np.rint(y)
        off = y - r
        k = np.argmax(np.abs(off), axis=1)
        odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
        r[odd, k[odd]] += np.where(off[odd, k[odd]] >= 0, 1.0, -1.0)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(near[:, None], a, b)


def cell_keys(points: np.ndarray, table: int) -> np.ndarray:
    h = np.full(len(points), table + 1, U)
    for k in range(8):
        h = mix(h + (2 * points[:, k]).astype(np.int64).view(U) * U(0x9E3779B97F4A7C15))
    return h


def projections(dim: int, tables: int, seed: int = 0) -> np.ndarray:
    """(tables, dim, 8), orthonormal columns where dim allows."""
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, 8)))[0] if dim >= 8 else rng.standard_normal((dim, 8)) / np.sqrt(8) for _ in range(tables)])


def scale_for(n: int, dim: int, cell: int = CELL) -> float:
    """Of n unit vectors in all directions, a cell holds about `cell`: components have deviation scale / sqrt(dim) and an E8 cell volume 1."""
    return max(1.0, n / cell) ** 0.125 * np.sqrt(dim) / np.sqrt(2 * np.pi * np.e)


def neighbours(x: np.ndarray, own: np.ndarray, probes: int) -> np.ndarray:
    """(rows, probes) of the roots that lead from the own points to those probed."""
    return np.argpartition(-((x - own) @ ROOTS.T), probes - 1, axis=1)[:, :probes]


def layout(n: int, dim: int, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, cell: int = CELL) -> tuple[int, float]:
    """(tables, scale) for n vectors: `tables` or as many more as find RECALL of drawn pairs at `cosine`, with the cells for which placing and comparing costs least."""
    if dim < 2 or not -1 < cosine < 1:
        return tables, scale_for(n, dim, cell)
    rng = np.random.default_rng(1)
    u, w = (v / np.linalg.norm(v, axis=1)[:, None] for v in rng.standard_normal((2, 2000, dim)))
    w -= (u * w).sum(axis=1)[:, None] * u
    w = cosine * u + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w, axis=1)[:, None]
    best = None
    p = projections(dim, tables)
    for size in SIZES:
        scale, cost = scale_for(n, dim, size * cell), 1 + size / 4  # comparing in cells of 4 * CELL takes about as long as placing
        found, t = np.zeros(len(u), bool), 0
        while (t < tables or found.mean() < RECALL) and (best is None or (t + 1) * cost < best[0]):
            if t == len(p):
                p = projections(dim, 2 * t)
            x, y = u @ p[t] * scale, w @ p[t] * scale
            a, b = nearest_e8(x), nearest_e8(y)
            found |= (a == b).all(axis=1)
            if probes:
                for z, own, other in ((x, a, b), (y, b, a)):
                    found |= (ROOTS[neighbours(z, own, probes)] == (other - own)[:, None]).all(axis=2).any(axis=1)
            t += 1
        if t >= tables and found.mean() >= RECALL and (best is None or t * cost < best[0]):
            best = t * cost, t, scale
    return best[1:]


def _place(n: int, dim: int, tables: int, probes: int, scale: float):
    def packed(rows, cells, home, ids, step, error, q) -> pa.RecordBatch:
        rows, cells, home = map(np.concatenate, (rows, cells, home))
        q = q[rows].view(f"V{dim}").ravel()
        return pack((cells >> U(33)) % U(n), {"cell": cells, "home": home, "id": ids[rows], "scale": step[rows].astype(np.float32), "error": error[rows].astype(np.float32), "q": q})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = projections(dim, tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                some = batch.slice(at, 4000)
                ids, v = some.column("id").to_numpy(), some.column("v").flatten().to_numpy().reshape(-1, dim).astype(np.float64)
                step = np.maximum(np.abs(v).max(axis=1), 1e-30) / 127
                q = np.rint(v / step[:, None]).astype(np.int8)
                error = np.linalg.norm(v - q * step[:, None], axis=1) + 1e-6
                rows, cells, home = [], [], []
                for t in range(tables):
                    if t and t % TABLES == 0:
                        yield packed(rows, cells, home, ids, step, error, q)
                        rows, cells, home = [], [], []
                    x = v @ p[t] * scale
                    own = nearest_e8(x)
                    rows.append(np.arange(len(ids)))
                    cells.append(cell_keys(own, t))
                    home.append(np.ones(len(ids), np.int8))
                    if probes:
                        close = neighbours(x, own, probes)
                        rows.append(np.repeat(np.arange(len(ids)), probes))
                        cells.append(cell_keys(np.repeat(own, probes, axis=0) + ROOTS[close.ravel()], t))
                        home.append(np.zeros(len(ids) * probes, np.int8))
                yield packed(rows, cells, home, ids, step, error, q)

    return run


def near_in_cells(x: dict[str, np.ndarray], dim: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sure) of pairs of one cell that are, or within the error may be, as near as `cosine`."""
    order = np.lexsort((x["home"], x["cell"]))
    cell, home, ids, step, error = (x[c][order] for c in ("cell", "home", "id", "scale", "error"))
    q = x["q"].reshape(-1, dim)[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]]) if len(cell) else np.zeros(1, np.int64)
    homes = np.concatenate([[0], np.cumsum(home)])
    out = []
    for s, e in zip(cuts[:-1], cuts[1:]):
        m = e - int(homes[e] - homes[s])
        if m == e or e - s < 2:
            continue
        right = q[m:e].astype(np.float32) * step[m:e, None]
        width = max(1, 4_000_000 // (e - m))
        for at in range(s, e, width):
            to = min(e, at + width)
            sim = (q[at:to].astype(np.float32) * step[at:to, None]) @ right.T
            slack = error[at:to, None] + error[None, m:e] + error[at:to, None] * error[None, m:e] + 1e-5
            i, j = np.nonzero(sim + slack >= cosine)
            a, b, sure = ids[at + i], ids[m + j], (sim - slack)[i, j] >= cosine
            keep = (a != b) & ((at + i < m) | (a < b))
            out.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], sure[keep]))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def _compare(dim: int, cosine: float, spanning: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = unpack(list(batches), {k: v for k, v in KINDS.items()})
        a, b, sure = near_in_cells(x, dim, cosine)
        if spanning:
            # a spanning star of what is connected for sure says as much; what is unsure within a component doesn't matter
            nodes, root = components(a[sure], b[sure])
            if len(nodes):
                to = lambda z: np.where(np.isin(z, nodes), root[np.minimum(np.searchsorted(nodes, z), len(nodes) - 1)], z)
                open_ = ~sure & (to(a) != to(b))
            else:
                open_ = ~sure
            star = nodes != root
            a, b, sure = np.concatenate([root[star], a[open_]]), np.concatenate([nodes[star], b[open_]]), np.concatenate([np.ones(int(star.sum()), bool), np.zeros(int(open_.sum()), bool)])
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(z[at : at + 100_000]) for z in (a, b, sure)], names=["a", "b", "sure"])

    return run


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 10_000):
            ids, vectors = (batch.slice(at, 10_000).column(k) for k in (0, 1))
            sizes = np.diff(vectors.offsets.to_numpy())
            sizes[np.asarray(vectors.is_null())] = 0
            flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float)
            # a null is no number here
            whole = sizes > 0
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            norm = np.zeros(len(sizes))
            if whole.any():
                norm[whole] = np.sqrt(np.add.reduceat(flat * flat, starts[whole]))
            good = whole & np.isfinite(norm) & (norm > 0)
            of = np.repeat(np.arange(len(sizes)), sizes)
            keep = good[of]
            values = pa.array((flat[keep] / norm[of[keep]]).astype(np.float32))
            offsets = np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["id", "v"])


def unit_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): vectors at unit length, of rows that repeat an id one of them. Null ids and vectors, vectors with a null or non-finite component, and zero or empty vectors are left out."""
    cut = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null")
    return cut.mapInArrow(_unit, "id long, v array<float>").groupBy("id").agg(F.min("v").alias("v"))


def near_pairs(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, cell: int = CELL, spanning: bool = False) -> DataFrame:
    """(a, b), a < b, of (id, v) at cosine or above, by at least `tables` tables; spanning: only as many as connect what is connected. ids are unique; an empty table has no pair."""
    spark, n = vectors.sparkSession, buckets(vectors.sparkSession)
    kinds = {r["d"]: r["n"] for r in vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    found = spark.createDataFrame([], "a long, b long")
    for dim, count in sorted(kinds.items()):  # vectors of different length are never near
        some = vectors.where(F.size("v") == dim)
        wide, scale = layout(count, dim, cosine, tables, probes, cell)
        moved = some.mapInArrow(_place(n, dim, wide, probes, scale), PACKED).repartitionById(n, "bucket")
        pairs = stored(moved.mapInArrow(_compare(dim, cosine, spanning), "a long, b long, sure boolean"), "pairs")
        open_ = pairs.where("not sure").select("a", "b").distinct()
        dot = F.aggregate(F.zip_with(F.col("x.v"), F.col("y.v"), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
        checked = open_.join(some.alias("x"), F.col("a") == F.col("x.id")).join(some.alias("y"), F.col("b") == F.col("y.id")).where(dot >= cosine).select("a", "b")
        found = found.unionAll(pairs.where("sure").select("a", "b").unionAll(checked))
    return found.distinct()


def near_duplicates(rows: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, group_id, n_group, kept) of the vectors that have near duplicates; group_id is the least id of the group, which is kept. See `unit_vectors` for what is left out.

    Rows that repeat an id are one vector, the least of theirs; equal vectors are near. An empty table gives no row; other columns aren't looked at.
    """
    vectors = stored(unit_vectors(rows, id_col, vec_col), "vectors")
    equal = stored(vectors.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct")
    root = connected(near_pairs(equal.select("id", "v"), cosine, tables, probes, spanning=True))
    grouped = equal.join(root, "id", "left").select("v", "n", "id", F.coalesce("root", "id").alias("group_id"))
    sized = grouped.groupBy("group_id").agg(F.sum("n").alias("n_group"), F.count("*").alias("own")).where("n_group > 1")
    # copies of one vector may be a third of all rows
    found = joined(vectors.withColumnRenamed("id", "vec_id"), joined(grouped, sized, ["group_id"], "own", "id").drop("id"), ["v"], "n", "vec_id")
    return found.select("vec_id", "group_id", "n_group", (F.col("vec_id") == F.col("group_id")).alias("kept"))


def with_near_copies(rows: DataFrame, every: int = 20, shift: int = 1_000_000_000, by: float = 0.2) -> DataFrame:
    """(vec_id, embedding) of the rows, and a copy of every twentieth, which has one component moved by a fifth of its length: the same vectors in the query and its SQL, so that near ones are there at any size."""
    own = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    moved = F.transform("embedding", lambda x, i: F.when(i == F.pmod(F.col("vec_id"), F.size("embedding")), x + by * norm).otherwise(x))
    return own.unionAll(own.where(F.col("vec_id") % every == 0).select(F.col("vec_id") + shift, moved))


SQL = f"""
WITH RECURSIVE own AS (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
v AS MATERIALIZED (
  SELECT * FROM own UNION ALL
  SELECT vec_id + 1000000000, list_transform(embedding, lambda x, i: CASE WHEN i = 1 + vec_id % len(embedding) THEN x + 0.2 * sqrt(list_dot_product(embedding, embedding)) ELSE x END) FROM own WHERE vec_id % 20 = 0
),
edges AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x, v y WHERE x.vec_id <> y.vec_id AND list_cosine_similarity(x.embedding, y.embedding) >= {COSINE}
), reach AS (
  SELECT vec_id AS id, vec_id AS root FROM v
  UNION
  SELECT b, root FROM reach JOIN edges ON id = a
), grouped AS (SELECT id AS vec_id, min(root) AS group_id FROM reach GROUP BY id)
SELECT vec_id, group_id, count(*) OVER (PARTITION BY group_id) AS n_group, vec_id = group_id AS kept FROM grouped QUALIFY n_group > 1
"""
