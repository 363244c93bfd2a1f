"""Semantic chunks of sections: sentences, paragraphs, topic shifts, merging, splitting and links between neighbours.

A section is a row, and all its steps are one narrow Arrow pass: nothing is shuffled. Vectors come from `embed`, a function of a list of texts that gives as many rows of numbers;
it is called once for the paragraphs of a section and once for the pieces that are embedded anew. A model is given as such a function that loads it when it is first called, once in each
Python worker. The default hashes words.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.config import DEFAULT_THRESHOLD, SECTION_NAMES, THRESHOLDS
from tessera.functions.numbers import half_up
from tessera.functions.text import LOOSE_BREAK, sentences, strip, word_count
from tessera.functions.vectors import DIM
from tessera.operators.html import SLICE

PARAGRAPH, SMALL, LARGE, TINY, OVERLAP, CONTEXT = 150, 100, 800, 20, 2, 200
Embed = Callable[[list[str]], np.ndarray]
Piece = tuple[str, int, np.ndarray]
_break = re.compile(LOOSE_BREAK)
_places: dict[str, int] = {}
#: Words whose place a worker keeps, some 10 MB; common ones come early, and most others are met once.
PLACES = 50_000
#: x * y + s, rounded once; before Python 3.13 by way of fractions.
fma = getattr(math, "fma", None) or (lambda x, y, s: float(Fraction(x) * Fraction(y) + Fraction(s)))


def hashed_vectors(texts: list[str]) -> np.ndarray:
    """T5's default: counts of the lower-case words by the md5 of each, at unit length; zeros for a text without words. As `functions.vectors.hashed_embedding`."""
    out = np.zeros((len(texts), DIM))
    for row, text in zip(out, texts):
        at = []
        for w in text.lower().split():
            k = _places.get(w)
            if k is None:
                k = int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % DIM
                if len(_places) < PLACES:
                    _places[w] = k
            at.append(k)
        row += np.bincount(at, minlength=DIM) if at else 0
        if n := np.sqrt(row @ row):
            row /= n
    return out


def greedy(parts: Column, limit: int) -> Column:
    """Joins strings in order while a group has at most `limit` words; one longer string is a group of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))
    items = F.transform(parts, lambda s: F.struct(s.alias("s"), word_count(s).alias("w")))

    def step(a, x):
        flush = (a["n"] > 0) & (a["n"] + x["w"] > limit)
        joined = F.when(a["n"] > 0, F.concat(a["now"], F.lit(" "), x["s"])).otherwise(x["s"])
        return F.struct(
            F.when(flush, F.array_append(a["done"], a["now"])).otherwise(a["done"]).alias("done"),
            F.when(flush, x["s"]).otherwise(joined).alias("now"),
            F.when(flush, x["w"]).otherwise(a["n"] + x["w"]).alias("n"),
        )

    return F.aggregate(items, start, step, lambda a: F.when(a["n"] > 0, F.array_append(a["done"], a["now"])).otherwise(a["done"]))


def paragraphs(text: Column, limit: int = PARAGRAPH) -> Column:
    """T3."""
    return greedy(sentences(text), limit)


def split_sentences(text: str) -> list[str]:
    """T1 of one text."""
    return [s for s in _break.split(" ".join(text.split())) if s]


def fold(parts: Sequence[str], limit: int) -> list[tuple[str, int]]:
    """(text, words) of `greedy` over one list."""
    out: list[tuple[list[str], int]] = []
    for s in parts:
        n = len(s.split())
        if out and out[-1][1] + n <= limit:
            out[-1][0].append(s)
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append(([s], n))
    return [(" ".join(p), n) for p, n in out]


def dot(a: np.ndarray, b: np.ndarray) -> float:
    """The sum in order, each product and sum rounded once, as DuckDB's list_dot_product: any other order or rounding may put a cosine on the other side of a threshold or of half a digit."""
    s = 0.0
    for x, y in zip(a.tolist(), b.tolist()):
        s = fma(x, y, s)
    return s


def norm(a: np.ndarray) -> float:
    return math.sqrt(dot(a, a))


def cosine(a: np.ndarray, b: np.ndarray, norms: tuple[float, float] | None = None) -> float:
    """T4: a zero vector is equal to any. norms: those of a and b, where they are known."""
    x, y = norms or (norm(a), norm(b))
    n = x * y
    return dot(a, b) / n if n > 0 else 1.0


def threshold_of(section: str | None) -> float:
    """A split happens below it."""
    return THRESHOLDS.get(section, DEFAULT_THRESHOLD)


def section_name(section: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in SECTION_NAMES.items() for x in kv))
    return F.coalesce(known[section], section)


def topics_of(text: str, section: str | None, embed: Embed = hashed_vectors) -> list[tuple[str, int, np.ndarray, float | None, int]]:
    """(text, words, vector, cosine with the one before, number of its raw chunk) of each paragraph; the first has no cosine."""
    parts = fold(split_sentences(text), PARAGRAPH)
    vectors = np.asarray(embed([t for t, _ in parts]), float) if parts else np.zeros((0, DIM))
    norms = [norm(v) for v in vectors] if len(parts) > 1 else []
    out, group = [], 0
    for k, ((t, n), v) in enumerate(zip(parts, vectors)):
        sim = cosine(vectors[k - 1], v, (norms[k - 1], norms[k])) if k else None
        group += sim is not None and sim < threshold_of(section)
        out.append((t, n, v, sim, group))
    return out


def raw_of(topics: list) -> list[tuple[str, int, list[np.ndarray]]]:
    """(text, words, vectors) of the paragraphs between topic shifts."""
    out: list[tuple[list[str], int, list[np.ndarray]]] = []
    for k, (t, n, v, _, group) in enumerate(topics):
        if k and group == topics[k - 1][4]:
            texts, words, vectors = out[-1]
            texts.append(t)
            vectors.append(v)
            out[-1] = (texts, words + n, vectors)
        else:
            out.append(([t], n, [v]))
    return [(" ".join(t), n, v) for t, n, v in out]


def merged_of(raw: list) -> list[tuple[str, int, list[np.ndarray]]]:
    """A chunk joins what is buffered while both have fewer than SMALL words; else the buffer is a chunk."""
    out: list[tuple[list[str], int, list[np.ndarray]]] = []
    for text, n, vectors in raw:
        if out and out[-1][1] + n < SMALL:
            out[-1] = (out[-1][0] + [text], out[-1][1] + n, out[-1][2] + vectors)
        else:
            out.append(([text], n, list(vectors)))
    return [(" ".join(t), n, v) for t, n, v in out]


def pieces_of(text: str, section: str | None, embed: Embed = hashed_vectors) -> list[Piece]:
    """(text, words, vector) of the chunks of a section. The vector is the mean of its paragraphs' (T9); chunks beyond LARGE words are cut at sentences and embedded anew."""
    n = len(text.split())
    if n < TINY:
        return []
    if n <= SMALL:
        return [(text.strip(), n, np.asarray(embed([text]), float)[0])]
    out: list[list] = []
    for chunk, words, vectors in merged_of(raw_of(topics_of(text, section, embed))):
        out += [[chunk, words, np.mean(vectors, axis=0)]] if words <= LARGE else [[t, w, None] for t, w in fold(split_sentences(chunk), LARGE)]
    again = [p for p in out if p[2] is None]
    for p, v in zip(again, np.asarray(embed([p[0] for p in again]), float) if again else ()):
        p[2] = v
    return [tuple(p) for p in out]


def linked(pieces: list[Piece]) -> list[tuple]:
    """(number from 1, of how many, text, last sentences before, first sentences after, start of the one before, words, topic shift, vector)."""
    split, out = [split_sentences(t) for t, _, _ in pieces], []
    for k, (text, words, v) in enumerate(pieces):
        before = " ".join(split[k - 1][-OVERLAP:]) if k else ""
        after = " ".join(split[k + 1][:OVERLAP]) if k + 1 < len(pieces) else ""
        context = pieces[k - 1][0][:CONTEXT] + "..." if k else ""
        out.append((k + 1, len(pieces), text, before, after, context, words, half_up(1 - cosine(pieces[k - 1][2], v), 3) if k else None, v.astype(np.float32)))
    return out


def _pass(sections: DataFrame, keys: list[str], rows: Callable[[str, str | None], list[tuple]], kinds: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """Rows of each section's text behind its keys, the last of which is section_id; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                index, out = [], []
                for k, (section, text) in enumerate(zip(some.column(len(keys) - 1), some.column(len(keys)))):
                    found = rows(text.as_py() or "", section.as_py())
                    index += [k] * len(found)
                    out += found
                cols = zip(*out) if out else [()] * len(kinds)
                own = [some.column(k).take(pa.array(index, pa.int64())) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, (_, t) in zip(cols, kinds))], names=[*(f"k{k}" for k in range(len(keys))), *(n for n, _ in kinds)])

    cut = sections.select(*(F.col(c).alias(f"k{k}") for k, c in enumerate(keys)), F.col("text"))
    types = ", ".join(f"k{k} {cut.schema[f'k{k}'].dataType.simpleString()}" for k in range(len(keys)))
    out = cut.mapInArrow(run, f"{types}, {schema}")
    return out.select(*(F.col(f"k{k}").alias(c) for k, c in enumerate(keys)), *(n for n, _ in kinds))


def topics(sections: DataFrame, embed: Embed = hashed_vectors) -> DataFrame:
    """(filing_id, section_id, ord, text, words, sim, grp) of paragraphs; sim is null for the first of a section."""
    kinds = [("ord", pa.int32()), ("text", pa.string()), ("words", pa.int32()), ("sim", pa.float64()), ("grp", pa.int32())]
    rows = lambda text, section: [(k, t, n, sim, g) for k, (t, n, _, sim, g) in enumerate(topics_of(text, section, embed))]
    return _pass(sections, ["filing_id", "section_id"], rows, kinds, "ord int, text string, words int, sim double, grp int")


def raw_chunks(sections: DataFrame, embed: Embed = hashed_vectors) -> DataFrame:
    """(filing_id, section_id, grp, text, words, paragraphs, centroid) of what topic shifts part."""
    kinds = [("grp", pa.int32()), ("text", pa.string()), ("words", pa.int32()), ("paragraphs", pa.int64()), ("centroid", pa.list_(pa.float64()))]
    rows = lambda text, section: [(k, t, n, len(v), np.mean(v, axis=0)) for k, (t, n, v) in enumerate(raw_of(topics_of(text, section, embed)))]
    return _pass(sections, ["filing_id", "section_id"], rows, kinds, "grp int, text string, words int, paragraphs long, centroid array<double>")


def semantic_chunks(sections: DataFrame, embed: Embed = hashed_vectors) -> DataFrame:
    """The rows of A8 for sections (filing_id, ticker, filing_type, filing_date, section_id, text).

    Fewer than 20 words give no chunk, up to 100 one, whose text is only stripped (T11). Chunks are numbered from 1 (T12). Null texts count as empty; extra columns go; rows that
    repeat give chunks that repeat.
    """
    keys = ["ticker", "filing_id", "filing_type", "filing_date", "section_id"]
    kinds = [("chunk_index", pa.int32()), ("total_chunks", pa.int32()), *((c, pa.string()) for c in ("text", "overlap_previous", "overlap_next", "preceding_context")), ("word_count", pa.int32()), ("topic_shift_score", pa.float64()), ("embedding", pa.list_(pa.float32()))]
    schema = "chunk_index int, total_chunks int, text string, overlap_previous string, overlap_next string, preceding_context string, word_count int, topic_shift_score double, embedding array<float>"
    rows = _pass(sections, keys, lambda text, section: linked(pieces_of(text, section, embed)), kinds, schema)
    number = F.concat("filing_id", F.lit("_"), "section_id", F.format_string("_%03d", "chunk_index"))
    return rows.select(*keys, section_name(F.col("section_id")).alias("section_name"), number.alias("chunk_id"), *(n for n, _ in kinds))


def filing_documents(chunks: DataFrame) -> DataFrame:
    """A row for each filing with its chunks in order."""
    inner = [c for c in chunks.columns if c not in ("filing_id", "ticker", "filing_type", "filing_date")]
    rows = chunks.groupBy("filing_id", "ticker", "filing_type", "filing_date").agg(F.count("*").alias("total_chunks"), F.array_sort(F.collect_list(F.struct("section_id", "chunk_index", *(c for c in inner if c not in ("section_id", "chunk_index"))))).alias("chunks"))
    return rows


def filing_status(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(filing_id, status, total_chunks): empty without any text, no_chunks, or ok."""
    n = chunks.groupBy("filing_id").agg(F.count("*").alias("n"))
    some = sections.groupBy("filing_id").agg(F.max(F.coalesce(F.length(strip(F.col("text"))), F.lit(0))).alias("longest"))
    status = F.when(F.col("longest") == 0, "empty").when(F.col("n").isNull(), "no_chunks").otherwise("ok")
    return some.join(n, "filing_id", "left").select("filing_id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("total_chunks"))
