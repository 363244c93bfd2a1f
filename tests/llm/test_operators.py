"""The ten operators on small rows: nulls, empty and long texts, ties, repeated rows, empty tables and extra columns; and against brute force."""

import hashlib
import html as entities
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, embeddings, html, licenses, mixing, rules, sharding, simhash, substring, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, hash int, words string, id string"


def table(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those inside the operators."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None if k % 4 == 3 else f"s{k % 2}", None if t is None else len(t), "b", k, "w", "x") for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


def words(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    rng = random.Random(3)
    passage, base = words(rng, 60), words(rng, 300)
    near = base.split()
    near[5] = "changed"
    return [
        None, "", "   \n", "one", base, base, " ".join(near), f"{words(rng, 90)} {passage} {words(rng, 20)}", f"{passage}\n{words(rng, 70)} {passage}", words(rng, 60_000), "ünï " * 120, words(rng, 49),
    ]


def brute_repeats(texts, n):
    seen, out = {}, {}
    for d, t in enumerate(texts):
        ws = (t or "").split(" ") if t is None else t.split()
        for k in range(len(ws) - n + 1):
            key = tuple(ws[k : k + n])
            if key in seen:
                out.setdefault(d, set()).update(range(k, k + n))
            else:
                seen[key] = (d, k)
    return out


@pytest.mark.parametrize("n", [4, 10, 50])
def test_repeats(spark, n):
    texts = corpus()
    got = {}
    for r in substring.repeats(table(spark, texts), n).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert got == brute_repeats(texts, n)
    kept = {r["doc_id"]: r["text"] for r in substring.cut_repeats(table(spark, texts), n).collect()}
    for d, t in enumerate(texts):
        left = None if t is None else [w for k, w in enumerate(t.split()) if k not in got.get(d, ())]
        if d in got:
            assert (kept[d].split() if d in kept else []) == left
        else:
            assert kept[d] == t
    assert substring.repeats(table(spark, []), n).count() == 0 and substring.cut_repeats(table(spark, ["x"], [None])).count() == 1


def test_simhash(spark):
    texts = corpus()
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert got[4] == got[5] == got[6] == 4 and not {0, 1, 2, 3, 9} & set(got)
    kept = simhash.drop_near_duplicates(table(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k in range(len(texts)) if got.get(k, k) == k] and kept.columns == table(spark, []).columns
    assert simhash.near_duplicates(table(spark, [])).count() == 0 and simhash.near_duplicates(table(spark, ["a b"] * 3, [None, 1, 1])).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_simhash_pairs_are_complete(wide):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, (30, 2), np.int64).view(np.uint64)
    rows = [base]
    for flips in (1, 8, 15, 16):
        x = base.copy()
        for r in x:
            for b in rng.choice(128, flips, replace=False):
                r[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        rows.append(x)
    x = np.concatenate(rows)
    import pyarrow as pa

    ids = np.arange(len(x))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x[:, 0].view(np.int64)), pa.array(x[:, 1].view(np.int64))], names=["id", "hi", "lo"])
    moved = simhash.unpack(list(simhash._replicate(1, 15, wide)([batch])), simhash.KINDS)
    a, b = simhash.near_pairs(moved["anchor"], moved["home"], moved["id"], moved["hi"].view(np.uint64), moved["lo"].view(np.uint64), 15, wide)
    apart = np.bitwise_count(x[:, None, :] ^ x[None]).sum(2)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if apart[i, j] <= 15}


@pytest.mark.parametrize("distance", [3, 16, 20, 23, 31])
def test_simhash_pairs_are_complete_beyond_a_share_of_1(distance):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (60, 2), np.int64).view(np.uint64)
    x = np.concatenate([base, base, base, base[:1].repeat(90, 0)])  # the last share their anchors
    for k in range(60, len(x)):
        for b in rng.choice(128, (distance - 1, distance, distance + 1)[k % 3], replace=False):
            x[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), *(pa.array(x[:, k].view(np.int64)) for k in (0, 1))], names=["id", "hi", "lo"])
    moved = simhash.unpack(list(simhash._replicate(1, distance)([batch])), simhash.KINDS)
    a, b = simhash.near_pairs(moved["anchor"], moved["home"], moved["id"], moved["hi"].view(np.uint64), moved["lo"].view(np.uint64), distance)
    apart = np.bitwise_count(x[:, None, :] ^ x[None]).sum(2)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if apart[i, j] <= distance}


def test_simhash_finds_edited_texts(spark):
    """Against the Jaccard similarity of 3-grams, of texts of common and rare words with words changed."""
    rng = random.Random(8)
    vocabulary, texts = [f"w{k}" for k in range(5000)], []
    weights = [1 / (k + 20) for k in range(5000)]
    for k in range(150):
        ws = rng.choices(vocabulary, weights, k=rng.randrange(60, 900))
        edited = list(ws)
        for at in rng.sample(range(len(ws)), int(len(ws) * rng.uniform(0.02, 0.08))):
            edited[at] = rng.choice(vocabulary)
        texts += [" ".join(ws), " ".join(edited)]
    grams = [set(zip(w, w[1:], w[2:])) for w in map(str.split, texts)]
    alike = {(i, j): len(grams[i] & grams[j]) / len(grams[i] | grams[j]) for i in range(len(texts)) for j in range(i + 1, len(texts))}
    want = {p for p, s in alike.items() if s >= 0.6}
    group = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(table(spark, texts), 20).collect()}
    got = {(i, j) for i, j in alike if i in group and group[i] == group.get(j)}
    assert len(want) > 100 and len(want & got) >= 0.95 * len(want) and all(alike[p] >= 0.2 for p in got), (len(want), len(want & got), len(got))


def test_bpe_is_exact(spark):
    texts = corpus() + ["don't  stop\n\n  now 123abc <|endoftext|>", "😀é" * 3000, "a" * 5000, words(random.Random(9), 5000)]
    plain = bpe.encoding(bpe.VOCABULARY)
    for chunk in (64, bpe.CHUNK):
        got = {r["doc_id"]: r["tokens"] for r in bpe.encode(table(spark, texts), chunk=chunk).collect()}
        assert got == {k: None if t is None else plain.encode_ordinary(t) for k, t in enumerate(texts)}
    md5 = {r["doc_id"]: r["text_md5"] for r in bpe.round_trip(table(spark, texts)).collect()}
    assert md5 == {k: None if t is None else hashlib.md5(t.encode()).hexdigest() for k, t in enumerate(texts)}
    assert bpe.round_trip(table(spark, [])).count() == 0 and bpe.round_trip(table(spark, ["x", "x"], [None, None])).count() == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 7))
def test_lpt(sizes, shards):
    """Class by class as group by group."""
    loads, want = [0] * shards, {}
    for s in sorted(sizes, reverse=True):
        k = loads.index(min(loads))
        loads[k] += s
        want.setdefault(s, []).append(k)
    classes = sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True)
    for s, taken, before in sharding.schedule(classes, shards):
        assert (taken or sharding.shard_of(np.array(before), s, np.arange(sizes.count(s))).tolist()) == want[s]


def test_sharding(spark):
    from pyspark.sql import functions as F

    texts = corpus() + [f"t{k % 9}" * (k % 5) for k in range(60)]
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in sharding.shard_documents(docs, 3).collect()}
    groups = {}
    for k, t in enumerate(texts):
        groups.setdefault(hashlib.md5(t.encode()).hexdigest() if t is not None else f"id:{k}", []).append(k)
    size = {g: sum(len(texts[k] or "") for k in ks) for g, ks in groups.items()}
    loads = [0] * 3
    for g in sorted(groups, key=lambda g: (-size[g], hashlib.md5(g.encode()).hexdigest())):
        k = loads.index(min(loads))
        loads[k] += size[g]
        assert all((got[d]["group_key"], got[d]["group_size"], got[d]["shard"]) == (g, size[g], k) for d in groups[g])
    assert len(got) == len(texts) and sharding.shard_documents(table(spark, []), 3).count() == 0
    # a key that reads like that of a document without one; nulls in both; rows that repeat
    rows = spark.createDataFrame([(5, "aaaa", None), (6, "bb", "id:5"), (None, "c", None), (None, "d", None), (7, "x", "k"), (7, "x", "k")], "doc_id long, text string, key string")
    found = [(r["doc_id"], r["group_key"], r["group_size"]) for r in sharding.shard_documents(rows, 2, F.col("key")).collect()]
    assert sorted(found, key=str) == sorted([(5, "id:5", 4), (6, "id:5", 2), (None, "id:", 2), (None, "id:", 2), (7, "k", 2), (7, "k", 2)], key=str)


def test_join_splits_hot_keys(spark):
    from tessera.llm import _shared

    rows = spark.createDataFrame([(k, "a" if k % 3 else f"b{k % 4}") for k in range(60)] + [(99, None)], "i long, k string")
    own = rows.where("k is not null").groupBy("k").count().selectExpr("k", "count", "concat(k, '!') AS said")
    got = sorted(tuple(r) for r in _shared.joined(rows, own, ["k"], "count", "i", hot=7).select("i", "k", "said").collect())
    assert got == sorted((r["i"], r["k"], r["k"] + "!") for r in rows.where("k is not null").collect())


def test_connected(spark, monkeypatch):
    from tessera.llm import _shared

    rng = random.Random(6)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(200, k) for k in range(201, 240)] + [(3, 3), (None, 4)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    monkeypatch.setattr(_shared.joined, "__defaults__", ("inner", 5))
    got = {r["id"]: r["root"] for r in _shared.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_mixing(spark):
    texts = [words(random.Random(k), 10 + k) for k in range(40)]
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in mixing.mix_sources(docs, {"s0": 3.0, "s1": 1.0}, 4000).collect()}
    for s, target in (("s0", 3000), ("s1", 1000)):
        own = [k for k in range(40) if k % 4 != 3 and f"s{k % 2}" == s]
        total = sum(10 + k for k in own)
        taken = sum(got[k]["copies"] * got[k]["n_tokens"] for k in own if k in got)
        assert target - 50 < taken <= target and all(got[k]["copies"] in (target // total, target // total + 1) for k in own if k in got)
    assert mixing.mix_sources(table(spark, [])).count() == 0 and mixing.mixed(table(spark, ["a", "a", None], [None, 1, 1])).count() == 2


def test_rules(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learned = rules.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = rules.judge(docs, learned).join(labels.where("doc_id % 2 = 1"), "doc_id").select("rejected", "quality").collect()
    good = [r["rejected"] for r in rows if r["quality"] == 1]
    bad = [r["rejected"] for r in rows if r["quality"] == 0]
    assert learned and sum(good) <= 0.02 * len(good) and sum(bad) >= 0.7 * len(bad), (sum(good), len(good), sum(bad), len(bad))
    odd = table(spark, corpus())
    assert rules.judge(odd, learned).count() == len(corpus()) and rules.fit(odd.limit(0), labels) == []
    assert {r["doc_id"] for r in rules.judge(odd, learned).where("rejected").collect()}.isdisjoint({0})


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    ws = mit.split()
    changed = " ".join(w for k, w in enumerate(ws) if k % 9)
    texts = [f"{words(random.Random(1), 500)} {mit} {words(random.Random(2), 30_000)}", changed, " ".join(ws[: len(ws) // 2]), None, "", mit + " " + mit]
    got = {r["doc_id"]: r["coverage"] for r in licenses.scan(table(spark, texts)).where("license = 'MIT'").collect()}
    assert set(got) == {0, 1, 5} and got[0] == got[5] == 1.0 and 0.8 <= got[1] < 1
    assert licenses.scan(table(spark, [])).count() == 0


@pytest.mark.parametrize("inserted, changed", [(0.3, 0.1), (0.3, 0.15), (0.5, 0.1), (0.1, 0.15), (1.0, 0.0)])
def test_spread_licenses(inserted, changed):
    """Copies with words put in and changed, wherever they lie in the text."""
    rng = random.Random(5)
    for name in ("MIT", "Apache-2.0-header", "GPL-3.0-header"):
        template = licenses.template_words(licenses.TEMPLATES[name])
        other = set(rng.sample(range(len(template)), int(changed * len(template))))
        for offset in range(0, 200, 40):
            copy = []
            for k, w in enumerate(template):
                copy += [f"x{k}" if k in other else w] + [f"y{k}"] * (rng.random() < inserted)
            text = words(rng, offset).split() + copy + words(rng, 300).split()
            coverage, first, last = licenses.best_match(text, template)
            assert coverage >= 1 - len(other) / len(template) - 1e-9 and first >= offset and last <= offset + len(copy)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=18), st.lists(st.integers(0, 3), min_size=1, max_size=8))
def test_spread_is_the_longest_common_subsequence_within_reach(text, template):
    far, best, ends = licenses.reach(len(template)), 0, {}
    for j, w in enumerate(text):
        for i, t in enumerate(template):
            if w == t:
                ends[i, j] = 1 + max((c for (x, y), c in ends.items() if x < i and j - far <= y < j), default=0)
                best = max(best, ends[i, j])
    got = licenses.spread(text, template, 1)
    assert (got[0] if got else 0) == best
    assert got is None or (text[got[1]] in template and text[got[2] - 1] in template)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 6), max_size=25))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = licenses.align(a, b)
    lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            lcs[i + 1][j + 1] = lcs[i][j] + 1 if a[i] == b[j] else max(lcs[i][j + 1], lcs[i + 1][j])
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < r[0] and p[1] < r[1] for p, r in zip(pairs, pairs[1:])) and len(pairs) <= lcs[-1][-1]
    assert len(licenses.align(a, a)) == len(a)


def test_embedding_recall(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = [base]
    for cosine in (0.999, 0.97, 0.93, 0.91):
        other = rng.standard_normal((400, 64))
        other -= (other * base[:400]).sum(1)[:, None] * base[:400]
        other /= np.linalg.norm(other, axis=1)[:, None]
        rows.append(cosine * base[:400] + np.sqrt(1 - cosine**2) * other)
    v = np.concatenate(rows).astype(np.float32)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {(r["a"], r["b"]) for r in embeddings.near_pairs(embeddings.unit_vectors(df)).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    i, j = np.nonzero(np.triu(u @ u.T >= embeddings.COSINE, 1))
    want = set(zip(i.tolist(), j.tolist()))
    assert len(got - want) <= 2 and len(got & want) >= 0.9 * len(want), (len(got & want), len(want))
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (None, [1.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    assert {r["vec_id"]: r["group_id"] for r in embeddings.near_duplicates(odd).collect()} == {3: 3, 4: 3}
    assert embeddings.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("n, dim", [(3_000, 64), (1_000_000, 64), (75_000_000, 64), (1_000_000, 384)])
def test_embedding_recall_at_size(n, dim):
    """Pairs just at the threshold, placed as among n vectors."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in rng.standard_normal((2, 600, dim)))
    b -= (a * b).sum(1)[:, None] * a
    b = 0.901 * a + np.sqrt(1 - 0.901**2) * b / np.linalg.norm(b, axis=1)[:, None]
    v = np.concatenate([a, b]).astype(np.float32)
    tables, scale = embeddings.layout(n, dim)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1200)), pa.array(list(v), pa.list_(pa.float32()))], names=["id", "v"])
    moved = embeddings.unpack(list(embeddings._place(1, dim, tables, embeddings.PROBES, scale)([batch])), {**embeddings.KINDS})
    left, right, _ = embeddings.near_in_cells(moved, dim, embeddings.COSINE)
    found = {(i, j) for i, j in zip(left.tolist(), right.tolist()) if j == i + 600}
    assert len(found) >= 0.9 * 600, (len(found), tables, scale)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-3, 3), max_size=20))
def test_best_region(xs):
    first, last, total = html.best_region(np.array(xs, float))
    best = max([0, *(sum(xs[i:j]) for i in range(len(xs)) for j in range(i + 1, len(xs) + 1))])
    assert total == best and sum(xs[first:last]) == best


def test_extraction(spark):
    sf = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html.fit(sf.where("page_id % 2 = 0"))
    hit = total = 0
    for r in sf.where("page_id % 2 = 1").collect():
        tokens = html.tokenize(r["html"])
        at = html._labelled(tokens)
        if at:
            first, last = html.extract(r["html"], weights)[:2]
            a, b = [{k for k in range(*x) if not tokens[k][1]} for x in (at, (first, last))]
            hit, total = hit + 2 * len(a & b), total + len(a) + len(b)
    assert total and hit / total > 0.9
    odd = spark.createDataFrame([(1, None, None, "z"), (None, "u", "", "z"), (2, "u", "<p>", "z"), (3, "u", "<script>x", "z"), (4, "u", "<p>a &amp; b", "z")], "page_id long, url string, html string, text string")
    got = html.extract_pages(odd, weights).orderBy("page_id").collect()
    assert len(got) == 5 and got[-1]["text"] == "a & b" and sum(r["n_words"] for r in got) == 3


def test_warc(spark):
    rows = [(1, "u", "<p>é</p>"), (2, "u", "<p>é</p>"), (3, None, ""), (4, "a\r\nb", "x" * 100_000), (5, "v", None), (None, "w", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = warc.write_pages(pages, file_bytes=200)
    assert index.count() == 5
    got = sorted(((r["page_id"], r["url"], r["html"]) for r in warc.read_records(index).collect()), key=str)
    assert got == sorted((r for r in rows if r[2] is not None), key=str)
    assert {r["page_id"] for r in warc.read_records(warc.first_captures(index)).collect()} == {1, 3, 4, None}
    assert warc.read_records(warc.write_pages(pages.limit(0))).count() == 0
    with pytest.raises(Exception, match="digest differs"):
        warc.read_records(index.selectExpr("page_id", "url", "'sha256:0' AS digest", "n_bytes", "file", "offset", "length")).collect()


def test_warc_of_others(spark, tmp_path):
    """Files that are there, compressed record by record or not at all."""
    import zlib

    def record(kind, uri, body):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    rows = [("warcinfo", "", b"about"), ("response", "http://a", b"HTTP/1.1 200 OK\r\n\r\n<p>" + b"x" * 3_000_000), ("resource", "http://b", b""), ("resource", "http://c", "é".encode() + b"\xff")]
    raw = [record(*r) for r in rows]
    (tmp_path / "a.warc").write_bytes(b"".join(raw))
    packed = []
    for r in raw:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed.append(z.compress(r) + z.flush())
    (tmp_path / "b.warc.gz").write_bytes(b"".join(packed))
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc",), (f"file://{tmp_path}/b.warc.gz",), (None,)], "file string")
    index = warc.index_files(files)
    got = sorted((r["url"], r["html"]) for r in warc.read_records(index).collect())
    assert got == sorted(2 * [(u, b.decode(errors="replace")) for k, u, b in rows[1:]]) and warc.index_files(files.limit(0)).count() == 0


def test_hot_passages(spark, monkeypatch):
    """A passage that most documents share waits where they are, and is told its origin."""
    rng = random.Random(12)
    passage = words(rng, 30)
    texts = [f"{words(rng, rng.randrange(9))} {passage if k % 5 else words(rng, 30)} {words(rng, rng.randrange(9))}" for k in range(300)] + [passage] * 40
    monkeypatch.setattr(substring, "KEPT", 1)
    monkeypatch.setattr(substring, "AT_ONCE", 500)
    got = {}
    for r in substring.repeats(table(spark, texts).repartition(5), 20).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        assert r["first_doc_id"] < r["doc_id"] or r["first_doc_id"] == r["doc_id"]
    assert got == brute_repeats(texts, 20)


def odd(spark):
    """Documents with nulls, rows that repeat, empty and long texts, and columns with the names that operators use."""
    texts = corpus()
    rows = [(k, t, k % 3, "s", "x", "y", "z", 1) for k, t in enumerate(texts)] + [(None, texts[4], 0, None, "x", "y", "z", 1), (4, texts[4], 1, None, "x", "y", "z", 1), (3, "one", 0, "s", "x", "y", "z", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, c0 long, source string, spans string, __salt string, __f_n_words string, copies long")


def test_columns_of_any_name(spark):
    df = odd(spark)
    cut = substring.cut_repeats(df)
    near = simhash.drop_near_duplicates(df)
    kept = rules.keep_good(df, [(rules.Condition("n_words", False, 1.0),)])
    mixed = mixing.mixed(df)
    for out in (cut, near, kept, mixed):
        assert out.columns == df.columns and all((r["spans"], r["__salt"], r["__f_n_words"], r["copies"]) == ("x", "y", "z", 1) for r in out.collect())
    assert near.where("doc_id is null").count() == 1 and near.where("doc_id = 4").count() == 2 and near.where("doc_id in (5, 6)").count() == 0
    assert kept.where("doc_id = 0").count() == 1 and kept.where("doc_id = 3").count() == 0
    assert mixed.where("doc_id is null").count() == 0
    assert all(op(df.limit(0)).count() == 0 for op in (substring.cut_repeats, simhash.drop_near_duplicates, mixing.mixed, lambda d: rules.keep_good(d, []), lambda d: licenses.scan(d), lambda d: rules.judge(d, [])))


def test_mixing_weights(spark):
    docs = spark.createDataFrame([(k, "a b c d", "s") for k in range(40)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([(k, (0.0, -1.0, float("nan"), None, 1e9)[k % 5]) for k in range(40)] + [(None, 1.0), (4, 0.5)], "doc_id long, weight double")
    got = {r["doc_id"] for r in mixing.mix_sources(docs, budget=4 * 24, quality=weights).collect()}
    assert {k for k in range(40) if k % 5 == 4} < got and not any(k % 5 < 2 for k in got) and len(got) == 24
    tied = mixing.mix_sources(docs, budget=40, quality=weights.selectExpr("doc_id", "0.0 AS weight"))
    assert sorted(r["doc_id"] for r in tied.collect()) == list(range(10))


def features(text):
    if text is None:
        return dict.fromkeys(rules.NAMES, float("nan"))
    ws = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    lines, n = text.split("\n"), len(text)
    share = lambda a, b: a / b if b else float("nan")
    return {
        "n_words": float(len(ws)), "word_length": share(n, len(ws)), "distinct_words": share(len(set(ws)), len(ws)), "distinct_lines": share(len(set(lines)), len(lines)),
        "symbols": share(sum(c in "#$%&*!|@^~<>{}=_\\" for c in text), n), "digits": share(sum(c in "0123456789" for c in text), n), "capitals": share(sum(unicodedata.category(c) == "Lu" for c in text), n),
    }


def plain_rule(text, learned):
    x = features(text)
    for k, rule in enumerate(learned, 1):
        if all(not math.isnan(x[c.name]) and (x[c.name] > c.threshold if c.above else x[c.name] <= c.threshold) for c in rule):
            return k
    return 0


def test_rules_are_judged_as_in_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = rules.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    learned += [(rules.Condition("capitals", True, 0.2),), (rules.Condition("digits", True, 0.1), rules.Condition("n_words", False, 30.0))]
    for df in (docs.select("doc_id", "text"), table(spark, corpus() + ["ÄÖ 12 $ \t x\nx\n", "A1 " * 9])):
        want = {r["doc_id"]: plain_rule(r["text"], learned) for r in df.collect()}
        assert {r["doc_id"]: r["rule"] for r in rules.judge(df, learned).collect()} == want
    assert len(learned) > 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.booleans()), min_size=2, max_size=25))
def test_the_best_condition_has_the_most_gain(rows):
    bad = np.array([r[2] for r in rows])
    if bad.all() or not bad.any():
        return
    x = {c: np.array([float(r[k % 2]) for r in rows]) for k, c in enumerate(rules.NAMES)}
    gains = []
    for c in rules.NAMES:
        for t in set(x[c]):
            for hit in (x[c] > t, x[c] <= t):
                p, n = (hit & bad).sum(), (hit & ~bad).sum()
                if p and hit.sum() < len(rows):
                    gains.append(p * (np.log2(p / (p + n)) - np.log2(bad.mean())))
    found = rules._best(x, bad, np.arange(len(rows)))
    top = max(gains, default=0)
    assert (found is None and top <= 1e-6) or abs(found[0] - top) < 1e-6


def patience(a, b):
    """Words of b aligned with a, by a direct reading: anchors that are unique in both, the longest run of them in order, and so on in the gaps; where there is none, the longest common subsequence."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + patience(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + patience(a[:-1], b[:-1])
    once = [(a.index(w), b.index(w)) for w in b if a.count(w) == 1 and b.count(w) == 1]
    once.sort()
    best = []
    for k, (i, j) in enumerate(once):
        before = [c for (x, y), c in zip(once[:k], best) if y < j]
        best.append(max(before, key=len, default=[]) + [(i, j)])
    chain = max(best, key=len, default=[])
    if not chain:
        row = [0] * (len(b) + 1)
        for w in a:
            new = [0]
            for k, v in enumerate(b):
                new.append(row[k] + 1 if v == w else max(row[k + 1], new[k]))
            row = new
        return row[-1]
    total, x, y = len(chain), 0, 0
    for i, j in [*chain, (len(a), len(b))]:
        total += patience(a[x:i], b[y:j])
        x, y = i + 1, j + 1
    return total


@pytest.mark.parametrize("inserted", [0.0, 0.3, 0.7, 1.5])
def test_licenses_as_by_alignment_of_the_whole_text(inserted):
    import sys

    sys.setrecursionlimit(20_000)
    rng = random.Random(7)
    for name in ("MIT", "ISC", "MPL-2.0-header", "BSD-3-Clause", "Apache-2.0-notice"):
        template = licenses.template_words(licenses.TEMPLATES[name])
        for _ in range(4):
            copy = []
            for w in template:
                copy += [w] * (rng.random() > 0.05) + [f"y{rng.randrange(99)}" for _ in range(int(inserted) + (rng.random() < inserted % 1))]
            text = words(rng, rng.randrange(60)).split() + copy + words(rng, 40).split()
            whole = patience(text, template) / len(template)
            found = licenses.best_match(text, template)
            if len(template) > licenses.SHORT:
                assert found and found[0] >= whole - 1e-9, (name, found, whole)
            else:
                assert (found[0] if found else 0) <= whole + 1e-9


def test_license_of_a_place(spark):
    mit = licenses.TEMPLATES["MIT"]
    texts = [
        "Licensed under CC BY-SA 4.0", "x Licensed under CC BY-NC 4.0 y", mit.replace("the Software)", "the \u201cSoftware\u201d)").replace("AS IS", "\u201cAS IS\u201d"), licenses.TEMPLATES["Apache-2.0-header"],
        "SPDX-License-Identifier: GPL-2.0-only", mit[:400] + " gap" * 300 + mit[400:], "all the other rights are long since reserved", licenses.TEMPLATES["BSD-2-Clause"], licenses.TEMPLATES["BSD-3-Clause"],
    ]
    df = table(spark, texts + [mit, mit], [*range(len(texts)), None, None])
    got = [(r["doc_id"], r["license"]) for r in licenses.scan(df).collect()]
    want = [(0, "CC-BY-SA-4.0-notice"), (1, "CC-BY-NC-4.0-notice"), (2, "MIT"), (3, "Apache-2.0-header"), (4, "GPL-2.0-only-tag"), (5, "MIT"), (7, "BSD-2-Clause"), (8, "BSD-3-Clause"), (None, "MIT"), (None, "MIT")]
    assert sorted(got, key=str) == sorted(want, key=str)


def plain_extract(page, weights):
    """Tokens by going through the page, the region by trying all."""
    tokens, at = [], 0
    while at < len(page):
        if page[at].isspace():
            at += 1
        elif page[at] == "<":
            low = page[at:].lower()
            name = next((t for t in ("script", "style") if re.match(rf"<{t}\b[^<>]*>", low)), "")
            if low.startswith("<!--"):
                end = page.find("-->", at)
                at = end + 3 if end >= 0 else len(page)
            elif name:
                m = re.search(rf"</{name}\s*>", low)
                at += m.end() if m else len(low)
            elif m := re.match(r"<[^<>]*>", page[at:]):
                k = re.match(r"<\s*(/?)\s*([A-Za-z][\w:-]*)", m[0])
                if k and k[2].lower() not in ("script", "style"):
                    tokens.append((m[0], k[1] + k[2].lower()))
                at += m.end()
            else:
                at += 1
        else:
            m = re.match(r"[^<\s]+", page[at:])
            tokens.append((m[0], ""))
            at += m.end()
    scores = [1.0 if not k else weights.get(k, weights[""]) for _, k in tokens]
    best = (0.0, 0, 0)
    for j in range(1, len(scores) + 1):
        total = 0.0
        for i in range(j - 1, -1, -1):
            total += scores[i]
            if total > best[0] + 1e-9 or abs(total - best[0]) <= 1e-9 and j == best[2] and total > 0:
                best = (total, i, j)
    text = ""
    for k in range(best[1], best[2]):
        if not tokens[k][1]:
            between = [t[1].strip("/") for t in tokens[best[1] : k]]
            last = max((i for i in range(best[1], k) if not tokens[i][1]), default=None)
            gap = between[last - best[1] + 1 :] if last is not None else []
            text += ("" if last is None else "\n" if set(gap) & html.BLOCKS else " ") + tokens[k][0]
    return best[1], best[2], entities.unescape(text)


def test_extraction_by_trying_all_regions(spark):
    rng = random.Random(2)
    own = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    weights = html.learn(own)
    parts = ["word", "a &amp; b", "<p>", "</p>", "<div class='x'>", "</div>", "<!-- no words -->", "<script>var x</script>", "<br>", "<a href=u>", "</a>", "<style>", "<", "\n"]
    pages = [" ".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(120)] + [p for p in own if len(p) < 4000][:10]
    df = spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)] + [(0, "u", pages[0])], "page_id long, url string, html string")
    found = html.extract_pages(df, weights).collect()
    assert len(found) == len(pages) + 1 and html.extract_pages(df.limit(0), weights).count() == 0 and html.fit(df.limit(0)) == html.learn([])
    for r in found:
        first, end, text = plain_extract(pages[r["page_id"]], weights)
        assert (r["first_token"], r["end_token"], r["text"]) == (first, end, text), pages[r["page_id"]]


def test_labels_of_pages_with_several_articles():
    at = lambda page: html._labelled(html.tokenize(page))
    assert at("<article>a b</article> <nav>n n n n</nav> <article>c d e</article>") == (11, 14)
    assert at("<article>a <article>b</article> c</article> d") == (1, 6) and at("x <article>a") == (2, 3)
    assert at("<article></article>") is None and at("no") is None


def test_reuse_of_chunks(spark):
    rng = random.Random(5)
    shared = words(rng, 3000)
    texts = [f"{words(rng, 300)} {shared} {words(rng, 300)}" for _ in range(8)] + [words(rng, 500)] * 6 + [words(rng, 500) for _ in range(5)] + ["", None]
    plain = bpe.encoding(bpe.VOCABULARY)
    for together in (1, 100):
        got = {r["doc_id"]: r["tokens"] for r in bpe.encode(table(spark, texts), together=together).collect()}
        assert got == {k: None if t is None else plain.encode_ordinary(t) for k, t in enumerate(texts)}
    n = bpe.reuse(table(spark, texts).coalesce(1), together=100).first()
    assert n["texts"] == len(texts) and n["reused"] > 50 and n["encoded"] < 60 and n["repaired"] > 0
    unlike = bpe.reuse(table(spark, texts[14:19])).first()
    assert (unlike["encoded"], unlike["reused"], unlike["repaired"]) == (5, 0, 0)


def test_embeddings_that_repeat(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 3.0]), (3, [1.0, None]), (4, [0.6, 0.8]), (5, [0.0, 1e-30])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, id string")
    assert {r["vec_id"]: r["group_id"] for r in embeddings.near_duplicates(df).collect()} == {1: 1, 2: 1, 5: 1}
