"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags; comments and the bodies of script and style are left out, and one that isn't closed goes to the end, as in browsers.
Each word scores +1 and each tag a negative weight. One linear scan of the running sum finds the best contiguous region,
and its words are the content. The weights are learned from pages whose content is labelled: by their longest <article> element here.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that weights are learned from at most, those with the least hash of their id.
MAX_LABELLED = 400
LEAST = 0.05
SCALES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<script\b[^<>]*>(?:.*?</script\s*>|.*\Z)|<style\b[^<>]*>(?:.*?</style\s*>|.*\Z)|<[^<>]*>|[^<\s]+|<", re.S | re.I)
NAME = re.compile(r"<\s*(/?)\s*([A-Za-z][\w:-]*)")
BLOCKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article blockquote pre".split())


def kind(token: str) -> str | None:
    """'' for a word, None for what is left out, else the tag's name with a slash in front if it closes."""
    if token[0] != "<":
        return ""
    m = NAME.match(token)
    if not m or m[2].lower() in ("script", "style"):
        return None
    return m[1] + m[2].lower()


def tokenize(page: str) -> list[tuple[str, str]]:
    """(token, kind) of words and tags, in order."""
    return [(t, k) for t in TOKEN.findall(page) if (k := kind(t)) is not None]


def best_region(scores: np.ndarray) -> tuple[int, int, float]:
    """(first, last + 1, score) of the contiguous run with the largest sum; the earliest end of such, and its longest run; (0, 0, 0.0) if no sum is positive."""
    if not len(scores):
        return 0, 0, 0.0
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    low = np.minimum.accumulate(sums[:-1])
    gain = sums[1:] - low
    end = int(np.argmax(gain))
    if gain[end] <= 0:
        return 0, 0, 0.0
    return int(np.argmax(sums[: end + 1] == low[end])), end + 1, float(gain[end])


def _labelled(tokens: list[tuple[str, str]]) -> tuple[int, int] | None:
    """(first, last + 1) of the tokens inside the article element with the most words, the first of such; of nested ones the outer, and one that isn't closed goes to the end. None without an article that has a word."""
    spans, start, depth = [], 0, 0
    for i, (_, k) in enumerate(tokens):
        if k == "article":
            start, depth = (i + 1, 1) if not depth else (start, depth + 1)
        elif k == "/article" and depth:
            depth -= 1
            if not depth:
                spans.append((start, i))
    if depth:
        spans.append((start, len(tokens)))
    words = [sum(not k for _, k in tokens[a:b]) for a, b in spans]
    return spans[words.index(max(words))] if any(words) else None


def learn(pages: list[str]) -> dict[str, float]:
    """Weights of tags, '' for any other tag: the less often a tag is inside the content, the lower; the scale is that with the best F1 over words."""
    seen, inside, cases = Counter(), Counter(), []
    for page in pages:
        tokens = tokenize(page or "")
        at = _labelled(tokens)
        if not at:
            continue
        cases.append((tokens, at))
        for i, (_, k) in enumerate(tokens):
            if k:
                seen[k] += 1
                inside[k] += at[0] <= i < at[1]
    best = None
    for scale in SCALES:
        weights = {k: -LEAST - scale * (1 - (inside[k] + 0.5) / (n + 1)) for k, n in seen.items()} | {"": -LEAST - scale}
        hit = wrong = missed = 0
        for tokens, (a, b) in cases:
            words = np.array([not k for _, k in tokens])
            first, last, _ = best_region(score(tokens, weights))
            both = int(words[max(a, first) : max(min(b, last), max(a, first))].sum())
            hit, wrong, missed = hit + both, wrong + int(words[first:last].sum()) - both, missed + int(words[a:b].sum()) - both
        f1 = 2 * hit / (2 * hit + wrong + missed) if hit else 0.0
        if best is None or f1 > best[0]:
            best = (f1, weights)
    return best[1]


def score(tokens: list[tuple[str, str]], weights: dict[str, float]) -> np.ndarray:
    other = weights[""]
    return np.array([1.0 if not k else weights.get(k, other) for _, k in tokens])


def extract(page: str | None, weights: dict[str, float], cache: dict[str, str | None] | None = None) -> tuple[int, int, int, float, str]:
    """(first token, last token + 1, words, score, text) of the content; of a null or wordless page (0, 0, 0, 0.0, '').

    Words are joined by a space, or by a line break where a tag of a block is between them; entities are decoded.
    """
    cache = {} if cache is None else cache
    other, tokens, scores = weights[""], [], []
    for t in TOKEN.findall(page or ""):
        if t[0] != "<":
            tokens.append(t)
            scores.append(1.0)
            continue
        k = cache.get(t, 0)
        if k == 0:
            k = kind(t)
            if len(cache) < 50_000:
                cache[t] = k
        if k is not None:
            tokens.append("\0" + k)
            scores.append(weights.get(k, other))
    first, last, total = best_region(np.array(scores))
    out, gap, n = [], "", 0
    for t in tokens[first:last]:
        if t[0] == "\0":
            if t.strip("\0/") in BLOCKS:
                gap = "\n"
            continue
        if out:
            out.append(gap or " ")
        out.append(t)
        gap, n = "", n + 1
    return first, last, n, total, entities.unescape("".join(out))


def fit(pages: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Weights learned from at most max_labelled pages with an article element, those with the least hash of their id. Without one, every tag has the weight of the smallest scale.

    Null and empty pages, pages of which the article has no word, and an empty table have no label; rows that repeat count as often as they come among those. Ties of the hash go by the id.
    They are counted first: only pages below the hash that about twice as many have come to the driver, not so many from each task.
    """
    labelled, h = pages.where(F.lower(html_col).contains("<article")), F.xxhash64(id_col)
    n = labelled.count()
    share, rows = 2 * max_labelled / max(n, 1), []
    while n and max_labelled > 0:
        some = labelled if share >= 1 else labelled.where(h <= int(-(1 << 63) + share * (1 << 64)))
        rows = some.orderBy(h, id_col).select(html_col).limit(max_labelled).collect()
        if share >= 1 or len(rows) >= max_labelled:
            break
        share *= 2
    return learn([r[0] for r in rows])


def _run(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str | None] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                found = [extract(p.as_py(), weights, cache) for p in some.column("html")]
                cols = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), *cols], names=["page_id", "url", "first_token", "end_token", "n_words", "score", "text"])

    return run


def extract_pages(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, first_token, end_token, n_words, score, text), one row for each row of pages; see `extract`."""
    cut = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return cut.mapInArrow(_run(weights), "page_id long, url string, first_token int, end_token int, n_words int, score double, text string")
