"""Queries against their SQL, and the pipeline stage by stage against plain Python, which shares no code with it."""

import hashlib
import math
import re
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import bpe, mixing, queries, rules, simhash
from tests.llm.test_operators import odd, plain_rule
from tests.oracle import SF, same

MASK = (1 << 64) - 1


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.SQL[name])


def spread_bits(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def fingerprint(text):
    """128 bits, each by a vote of the distinct words; None without a word."""
    features = set()
    for w in set(re.findall(r"[^\W_]+", text.lower())):
        h = sum((b + 1) * pow(0x1B873593CC9E2D51, i, 1 << 64) for i, b in enumerate(w.encode())) & MASK
        features.add(spread_bits(h) >> 16)
    if not features:
        return None
    bits = [spread_bits(f * 0x9E3779B97F4A7C15 & MASK) | spread_bits(f * 0xC2B2AE3D27D4EB4F & MASK) << 64 for f in features]
    return sum((2 * sum(b >> k & 1 for b in bits) > len(bits)) << k for k in range(128))


def plain_near(docs):
    """Ids that stay."""
    prints = {}
    for d, t in docs:
        p = None if d is None or t is None else fingerprint(t)
        if p is not None:
            # as two signed halves, the first the low one
            prints[d] = min(prints.get(d, (9e99,)), tuple(x - (x >> 63 << 64) for x in (p & MASK, p >> 64)))
    full = {d: (p[0] & MASK) | (p[1] & MASK) << 64 for d, p in prints.items()}
    root = {d: d for d in full}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(full)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (full[a] ^ full[b]).bit_count() <= simhash.DISTANCE:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in full if find(d) == d}, set(full)


def plain_cut(docs, n=50):
    """{id: words that stay} by the words of all passages that came before, ids in order."""
    seen, out = set(), {}
    for d, t in sorted({(d, t) for d, t in docs if d is not None and t is not None}):
        ws = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]
        gone = set()
        for k in range(len(ws) - n + 1):
            passage = tuple(ws[k : k + n])
            if passage in seen:
                gone.update(range(k, k + n))
            seen.add(passage)
        out[d] = ([w for k, w in enumerate(ws) if k not in gone], bool(gone))
    return out


def plain_mix(docs, labels):
    """Copies of each id, source by source, in the order of the keys."""
    units, best = {}, {}
    for d, t, s in docs:
        if d is not None:
            n = len([w for w in re.split(r"[ \t\n\x0b\f\r]+", t or "") if w])
            old = units.get(d, (s or "", 0))
            units[d] = (min(old[0], s or ""), old[1] + n)
    for d, q in labels:
        if q is not None:
            best[d] = max(best.get(d, 0), q)
    total = Counter()
    for s, n in units.values():
        total[s] += n
    every = sum(total.values())
    power = {s: n**mixing.TEMPERATURE if n else 0.0 for s, n in total.items()}
    copies = {}
    for source in total:
        target = math.floor(every * power[source] / sum(power.values())) if sum(power.values()) else 0
        epochs = target // total[source] if total[source] else 0
        rest, upto = target - epochs * total[source], 0
        keyed = []
        for d, (s, n) in units.items():
            if s == source:
                u = (int(hashlib.md5(f"0:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                weight = 0.5 if d not in best else 1.0 if best[d] > 0 else 0.25
                keyed.append((-math.log(u) / weight, d, n))
        for _, d, n in sorted(keyed):
            upto += n
            copies[d] = epochs + (upto <= rest)
    return {d: k for d, k in copies.items() if k}


@pytest.mark.parametrize("made", [False, True])
def test_pipeline_stage_by_stage(spark, made):
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()]
    first = odd(spark) if made else spark.read.parquet(f"{SF}/documents.parquet")
    plain, now, stages = bpe.encoding(bpe.VOCABULARY), first, dict(corpus_pipeline.STAGES)
    key = lambda r: (str(r["doc_id"]), str(r["text"]))

    def step(name):
        before = sorted(now.collect(), key=key)
        out = stages[name](spark, now, SF)
        assert name == "bpe encoding" or out.columns == first.columns
        rows = out.collect()
        return before, rows, spark.createDataFrame(rows, out.schema)

    before, rows, now = step("quality rules")
    learned = rules.fit(first, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert sorted(rows, key=key) == [r for r in before if not plain_rule(r["text"], learned)]
    before, rows, now = step("simhash near-dedup")
    stay, known = plain_near([(r["doc_id"], r["text"]) for r in before])
    assert sorted(rows, key=key) == [r for r in before if r["doc_id"] not in known or r["doc_id"] in stay]
    before, rows, now = step("substring dedup")
    cut = plain_cut([(r["doc_id"], r["text"]) for r in before])
    want = [r for r in before if r["doc_id"] not in cut or r["text"] is None or not cut[r["doc_id"]][1] or cut[r["doc_id"]][0]]
    assert len(rows) == len(want)
    for a, b in zip(sorted(rows, key=lambda r: str(r["doc_id"])), sorted(want, key=lambda r: str(r["doc_id"]))):
        assert a["doc_id"] == b["doc_id"]
        if b["text"] is not None and cut.get(b["doc_id"], (0, False))[1]:
            assert re.split(r"[ \t\n\x0b\f\r]+", a["text"].strip()) == cut[b["doc_id"]][0]
        else:
            assert a["text"] == b["text"]
    before, rows, now = step("mixing sources")
    copies = plain_mix([(r["doc_id"], r["text"], r["source"]) for r in before], labels)
    assert sorted(rows, key=key) == [r for r in before for _ in range(copies.get(r["doc_id"], 0))]
    before, rows, _ = step("bpe encoding")
    tokens = lambda t: None if t is None else plain.encode_ordinary(t)
    want = sorted(((r["doc_id"], tokens(r["text"]), None if r["text"] is None else hashlib.md5(r["text"].encode()).hexdigest()) for r in before), key=str)
    assert sorted(((r["doc_id"], r["tokens"], r["text_md5"]) for r in rows), key=str) == want and all(r["n_tokens"] == (None if r["tokens"] is None else len(r["tokens"])) for r in rows)
    assert made or (len(learned) > 0 and len(before) < first.count())


def test_pipeline_of_nothing(spark):
    now = odd(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0


def test_pipeline_runs_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows and {r["doc_id"] for r in rows} < docs
