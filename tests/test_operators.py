"""Operators against plain Python, on literal rows."""

import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.config import ANNUAL, CURRENT
from tessera.operators import chunks, clusters, html, prices
from tessera.operators import sections as S
from tessera.sources import filings, market
from tessera.streaming import ingest


def fold(parts, limit):
    out, now = [], []
    for p in parts:
        if now and sum(len(x.split()) for x in now) + len(p.split()) > limit:
            out.append(" ".join(now))
            now = []
        now.append(p)
    return out + [" ".join(now)] if now else out


def test_sentences_and_fold(spark):
    rows = [None, "", "  \n", "One. Two three! (Four) five? 'Six'.", "word " * 400 + ". " + "Next one. " * 200]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").select("k", T.sentences(F.col("t")).alias("s"), chunks.paragraphs(F.col("t")).alias("p")).orderBy("k").collect()
    assert got[0]["s"] is None and got[1]["s"] == [] and got[2]["p"] == []
    assert got[3]["s"] == ["One.", "Two three!", "(Four) five?", "'Six'."]
    assert got[4]["p"] == fold(got[4]["s"], 150) and len(got[4]["p"][0].split()) > 150


@pytest.mark.parametrize("n,kept", [(7, False), (8, True), (120, True), (121, False)])
def test_financial_bounds(spark, n, kept):
    s = " ".join(["revenue"] * n)
    assert spark.range(1).select(T.is_financial(F.lit(s)).alias("x")).first()["x"] is kept


def test_noise(spark):
    for s in ("See exhibit 10.1 for revenue and income of the company today", "☑ revenue and income of the company rose in the quarter", "Form 10-K revenue and income of the company rose much"):
        assert spark.range(1).select(T.is_financial(F.lit(s)).alias("x")).first()["x"] is False


def series(spark, values, start="2024-01-01"):
    rows = [("A", i, v) for i, v in enumerate(values) if v is not ...]
    return spark.createDataFrame(rows, "ticker string, i int, close double").select("ticker", F.date_add(F.lit(start).cast("date"), F.col("i")).alias("date"), "close")


def test_fill_is_bounded(spark):
    p = series(spark, [1.0, ..., ..., ..., ..., ..., ..., 9.9, ..., ..., 2.0])  # from Monday the 1st; the 8th is a Monday
    p = p.where("date <> '2024-01-08'")
    out = [r["close"] for r in prices.clean_prices(p, "2024-01-01", "2024-01-11").orderBy("date").collect()]
    assert out == [1.0, 1.0, 1.0, 1.0, None, None, None, None, 2.0]
    r = [r["return_1d"] for r in prices.clean_prices(p, "2024-01-01", "2024-01-11").orderBy("date").collect()]
    assert r[4] == 0.0 and r[8] == 1.0
    r = [r["return_1d"] for r in prices.clean_prices(p, "2024-01-01", "2024-01-11", gaps="null").orderBy("date").collect()]
    assert r[4] is None and r[8] is None


def test_constant_price_and_duplicates(spark):
    p = series(spark, [5.0] * 12)
    assert not any(r["is_outlier"] for r in prices.clean_prices(p, "2024-01-01", "2024-01-12").collect())
    with pytest.raises(Exception, match="more than one row"):
        prices.clean_prices(p.unionAll(p), "2024-01-01", "2024-01-12").collect()
    assert prices.clean_prices(p.limit(0), "2024-01-01", "2024-01-12").count() == 0


HEAD = {"1": "Item 1. Business", "1A": "Item 1A. Risk Factors", "2": "Item 2. Properties", "3": "Item 3. Legal Proceedings", "7": "Item 7. Management's Discussion"}


def filing(spark, body):
    return spark.createDataFrame([(1, body)], "filing_id long, html string")


def split(spark, body):
    return {r["item"]: r for r in S.split_annual(filing(spark, body)).collect()}


def paras(n, word="word"):
    return "".join(f"<p>{word} {word} {word}</p>" for _ in range(n))


def test_split_headers(spark):
    got = split(spark, paras(20) + "<div><b>ITEM 1.</b><b>BUSINESS</b></div>" + paras(80) + f"<div>{HEAD['2']}</div>" + paras(9))
    assert set(got) == {"1", "2"} and got["1"]["text"].startswith("ITEM 1. BUSINESS") and got["2"]["order_correct"]


def test_linked_reference_is_not_chosen(spark):
    body = paras(20) + f'<p><a href="#x">{HEAD["7"]}</a></p>' + paras(5) + f"<div>{HEAD['7']}</div>" + paras(90)
    assert split(spark, body)["7"]["words"] == 3 * 90 + 4
    assert split(spark, paras(20) + f'<a href="#x">{HEAD["7"]}</a>' + paras(90))["7"]["words"] == 274


def test_header_with_much_inner_space(spark):
    f = filing(spark, paras(20) + "<div>Item 1A." + " \n" * 2000 + "Risk Factors</div>" + paras(90))
    assert [(r["item"], r["text"]) for r in S.candidates(S.split_filings(f)).collect()] == [("1A", "Item 1A. Risk Factors")]


def test_combined_header(spark):
    got = split(spark, paras(20) + "<div>Items 1 and 2. Business and Properties</div>" + paras(90))
    assert got["2"]["text"] == got["1"]["text"] and got["2"]["combined"] and got["2"]["place"] is None
    assert "2" not in split(spark, paras(20) + "<div>Item 1. Business and Properties</div>" + paras(90))


def test_page_reference_and_far(spark):
    f = filing(spark, paras(20) + "<div>Item 1 Business Pages 3-7</div>" + paras(5))
    assert S.candidates(S.split_filings(f)).count() == 0 and [r["hits"] for r in S.page_references(S.split_filings(f)).collect()] == [2]
    far = filing(spark, paras(90) + f"<div>{HEAD['1']}</div>" + paras(2))
    assert S.far_filings(S.split_filings(far)).count() == 1 and S.split_annual(far).count() == 0
    exactly = filing(spark, paras(80) + f"<div>{HEAD['1']}</div>" + paras(19))
    assert S.far_filings(S.split_filings(exactly)).count() == 0


def test_stub_is_retried(spark):
    body = paras(20) + f"<div>{HEAD['7']}</div><div>{HEAD['2']}</div>" + paras(9) + f"<div>{HEAD['7']}</div>" + paras(90)
    got = split(spark, body)
    assert got["7"]["words"] == 274 and got["2"]["words"] == 30 and got["7"]["order_correct"]


def test_repair():
    text = "Item 1B. Unresolved Staff " + "word " * 3100 + "Item 2. Properties " + "land " * 60
    out = S.repair({"1B": text}, False)
    assert out["2"].startswith("Item 2. Properties") and "land" not in out["1B"]
    assert "2" not in S.repair({"1B": text[:200]}, False)
    kept = S.repair({"1B": text, "2": "own " * 60}, False)
    assert kept["2"].startswith("own") and "land" not in kept["1B"]


def test_current_reports(spark):
    f = spark.createDataFrame([(1, "<div>Item 9.01 Financial Statements and Exhibits</div><p>x</p>"), (2, "<div>Item 3.03 Material Modification</div><p>x</p><div>Item 8.01 Other Events</div>"), (3, "<p>none</p>"), (4, None)], "filing_id long, html string")
    got = {r["filing_id"]: r for r in S.current_events(S.split_filings(f, CURRENT)).collect()}
    assert [got[k]["status"] for k in (1, 2, 3, 4)] == ["exhibits_only", "extracted", "failed", "failed"]
    assert got[2]["event_types"] == "Item 3.03; Other Events"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(list(HEAD.values()) + ["plain text"] * 5), max_size=30))
def test_settled_sections_come_from_the_nodes(texts):
    ranked = {}
    for k, t in enumerate(texts):
        for i in ANNUAL.order:
            if i in HEAD and t == HEAD[i]:
                ranked.setdefault(i, []).append({"item": i, "item_ord": ANNUAL.order.index(i), "node_idx": k, "is_combined": False})
    sections, found, combined = S.settle(texts, {i: ranked[i] for i in ANNUAL.order if i in ranked})
    assert not combined and {c["item"] for c in found} == set(ranked) and all(v in " ".join(texts) for v in sections.values())


def test_html(spark):
    assert html.extract_text("<div><p>x</p></div><article>lost</article>") == "x x"
    assert html.extract_text(None) == "" and html.repair_encoding("itâ€™s") == "it's"
    assert html.text_nodes(spark.createDataFrame([(1, None), (2, ""), (None, "<p>x</p>")], "page_id long, html string")).count() == 0


@pytest.mark.parametrize("n,rows", [(19, 0), (20, 1), (100, 1)])
def test_short_sections(spark, n, rows):
    s = spark.createDataFrame([("f", "t", "10-K", "2024-01-01", "1", "word " * n)], "filing_id string, ticker string, filing_type string, filing_date string, section_id string, text string")
    got = chunks.semantic_chunks(s).collect()
    assert len(got) == rows and all(r["topic_shift_score"] is None and r["chunk_id"] == "f_1_001" for r in got)


def test_chunks_keep_the_words(spark):
    text = " ".join(f"Alpha{k % 3} beta gamma delta {'x' * (k % 5 + 1)} word{k // 40} more of it here." for k in range(400)) + " Long " + "tail " * 900 + "."
    s = spark.createDataFrame([("f", "t", "10-K", "2024-01-01", "8", text)], "filing_id string, ticker string, filing_type string, filing_date string, section_id string, text string")
    got = sorted(chunks.semantic_chunks(s).collect(), key=lambda r: r["chunk_index"])
    assert " ".join(r["text"] for r in got).split() == text.split()
    assert all(r["word_count"] <= 800 or r["text"].count(". ") == 0 for r in got)
    assert got[1]["preceding_context"] == got[0]["text"][:200] + "..." and all(r["total_chunks"] == len(got) for r in got)


def test_density_clusters(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.05, (20, 2)) for c in ((0, 0), (5, 5), (0, 5))] + [np.array([[20.0, 20.0], [-20.0, 9.0]])])
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "id long, vec array<double>")
    for block in (100, 25):
        got = {r["id"]: r["cluster_id"] for r in clusters.density_clusters(df, block=block).collect()}
        assert len(got) == 62 and got[60] == got[61] == -1
        assert [len({got[k] for k in range(a, a + 20)} - {-1}) for a in (0, 20, 40)] == [1, 1, 1] and len(set(got.values()) - {-1}) == 3


def test_zero_vectors(spark):
    from tessera.functions.vectors import cosine

    z, v = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert spark.range(1).select(cosine(z, v).alias("a"), cosine(z, v, 0.0).alias("b")).first() == (1.0, 0.0)


def test_files_and_stream(spark, tmp_path):
    folder = tmp_path / "raw" / "AAA"
    folder.mkdir(parents=True)
    (folder / "10K_1.json").write_text(json.dumps({"raw_html": "<p>Revenue and income rose in the quarter and the year. Other text.</p>", "ticker": "AAA", "form_type": "10-K", "filing_date": "2024-02-01"}))
    (folder / "8K_1.json").write_text(json.dumps({"ticker": "AAA"}))
    assert filings.read_raw(spark, str(tmp_path / "raw"), "10K_").first()["filing_id"] == "AAA_10-K_2024-02-01"
    assert filings.read_raw(spark, str(tmp_path / "raw")).count() == 2
    query = ingest.clean_filings(spark, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_market_source(spark):
    payload = json.dumps({"chart": {"result": [{"timestamp": [1704205800, 1704292200], "indicators": {"quote": [{"open": [1, 2], "high": [1, 2], "low": [1, 2], "close": [1, None], "volume": [5, 6]}], "adjclose": [{"adjclose": [0.5, None]}]}}]}})

    def fetch(ticker, start, end):
        if ticker == "BAD":
            raise ValueError("no such ticker")
        return payload

    spark.dataSource.register(market.chart_source(fetch))
    pulled = spark.read.format("charts").option("tickers", "AAA,BAD").load()
    assert {r["status"]: r["n"] for r in market.manifest(pulled).collect()} == {"success": 1, "failure": 1}
    assert [(r["date"].isoformat(), r["close"], r["open"]) for r in market.flatten_payload(pulled).collect()] == [("2024-01-02", 0.5, 1.0)]


class Slow:
    """A model that is loaded where it is first called."""

    model = None

    def __call__(self, texts):
        if Slow.model is None:
            Slow.model = lambda ts: np.array([[len(t), t.count("a"), 1.0] for t in ts])
        return Slow.model(texts)


def test_own_embedding(spark):
    text = " ".join(f"Alpha{k % 3} beta gamma {'a' * (k // 50)} more of it here." for k in range(300))
    s = spark.createDataFrame([("f", "t", "10-K", "2024-01-01", "8", text), ("g", "t", "10-K", "2024-01-01", None, None)], "filing_id string, ticker string, filing_type string, filing_date string, section_id string, text string")
    got = chunks.semantic_chunks(s, Slow()).collect()
    assert got and all(len(r["embedding"]) == 3 for r in got) and [r["chunk_index"] for r in got] == list(range(1, len(got) + 1))
    again = sum(r["word_count"] > 0 and r["embedding"][2] == 1.0 for r in got)
    assert again == len(got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=30))
def test_merge_and_split_step_by_step(sizes):
    raw = [(" ".join(["w"] * n), n, [np.array([float(k)])]) for k, n in enumerate(sizes)]
    want, held = [], []
    for k, n in enumerate(sizes):
        if held and sum(sizes[i] for i in held) + n < 100:
            held.append(k)
        else:
            if held:
                want.append(held)
            held = [k]
    if held:
        want.append(held)
    got = chunks.merged_of(raw)
    assert [[int(v[0]) for v in x[2]] for x in got] == want and [x[1] for x in got] == [sum(sizes[i] for i in g) for g in want]


def plain_hdbscan(points, min_size, min_samples):
    """(mutual reachability, clusters): single linkage level by level, and the clusters of most stability as sets of points, from the definition."""
    n = len(points)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, min_samples - 1]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])

    def parts(rows, eps):
        left, out = set(rows), []
        while left:
            todo = [left.pop()]
            group = set(todo)
            while todo:
                x = todo.pop()
                near = {y for y in left if m[x, y] < eps}
                left -= near
                group |= near
                todo += near
            out.append(group)
        return out

    def grow(rows, born):
        """(stability, clusters chosen below or it) of the cluster of these rows."""
        levels = sorted({m[a, b] for a in rows for b in rows if a < b}, reverse=True)
        now, mass = set(rows), 0.0
        for eps in levels:
            lam = 1 / eps
            split = parts(now, eps)
            if len(split) == 1:
                continue
            large = [s for s in split if len(s) >= min_size]
            if len(large) > 1:
                mass += len(now) * (lam - born)
                below = [grow(s, lam) for s in large]
                under = sum(b[0] for b in below)
                return (mass, [set(rows)]) if mass >= under else (under, [c for b in below for c in b[1]])
            gone = now - (large[0] if large else set())
            mass += len(gone) * (lam - born)
            if not large:
                return mass, [set(rows)]
            now = large[0]
        return mass, [set(rows)]

    # the root is never a cluster: the first split into two large parts opens them
    now = set(range(n))
    for eps in sorted({m[a, b] for a in range(n) for b in range(a)}, reverse=True):
        large = [s for s in parts(now, eps) if len(s) >= min_size]
        if len(large) > 1:
            return m, [c for s in large for c in grow(s, 1 / eps)[1]]
        if not large:
            break
        now = large[0]
    return m, []


@pytest.mark.parametrize("seed", range(6))
def test_density_clusters_from_the_definition(spark, seed):
    rng = np.random.default_rng(seed)
    points = np.concatenate([rng.normal(rng.uniform(-4, 4, 2), rng.uniform(0.1, 0.9), (rng.integers(4, 14), 2)) for _ in range(5)] + [rng.uniform(-6, 6, (6, 2))])
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "id long, vec array<double>")
    got = {}
    for r in clusters.density_clusters(df, block=20).collect():
        if r["cluster_id"] >= 0:
            got.setdefault(r["cluster_id"], set()).add(r["id"])
    m, want = plain_hdbscan(points, clusters.MIN_SIZE, clusters.MIN_SAMPLES)
    assert len(got) == len(want)
    for c in want:
        own = next(g for g in got.values() if c <= g)
        # at equal distances a point may leave a cluster just when it begins, and then belongs to either
        rest = [k for k in range(len(points)) if k not in own]
        assert len(own - c) <= 2 and all(m[e, sorted(c)].min() >= m[np.ix_(rest, sorted(own))].min() for e in own - c)


def test_nearest_by_matrix_and_by_loop(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.standard_normal((50, 4)))] + [(50, [0.0] * 4), (51, None)], "id long, vec array<double>")
    centres = spark.createDataFrame([(7, [1.0, 0.0, 0.0, 0.0], 9), (3, [2.0, 0.0, 0.0, 0.0], 4), (5, [0.0, 1.0, 1.0, 0.0], 1)], "cluster_id int, centroid array<double>, first long")
    one = {r["id"]: (r["cluster_id"], round(r["similarity"], 9)) for r in clusters.nearest(rows, centres).collect()}
    monkeypatch.setattr(clusters, "MATRIX", 0)
    assert one == {r["id"]: (r["cluster_id"], round(r["similarity"], 9)) for r in clusters.nearest(rows, centres).collect()}
    assert len(one) == 51 and one[50] == (5, 0.0) and {c for c, _ in one.values()} == {3, 5}
    assert clusters.nearest(rows, centres.limit(0)).count() == 0


def test_reduced_dimensions(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 3)) @ rng.standard_normal((3, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(200, None)], "id long, vec array<double>")
    got = np.array([r["vec"] for r in clusters.reduce_dimensions(df, 3).orderBy("id").collect()])
    apart = lambda v: ((v[:, None] - v[None]) ** 2).sum(2)
    assert got.shape == (200, 3) and np.allclose(apart(got), apart(x)) and clusters.reduce_dimensions(df, 8).first()["vec"] == x[0].tolist()


def test_fetch_waits_and_gives_up(spark):
    import time

    calls = []

    def fetch(ticker, start, end):
        calls.append(ticker)
        if len(calls) < 3:
            raise ValueError("again")
        return "{}"

    reader = market._Reader({"tickers": "A", "pause": "0.2"}, fetch)
    began = time.time()
    assert list(reader.read(reader.partitions()[0])) == [("A", "{}", None)] and len(calls) == 3 and time.time() - began >= 0.4
    slow = market._Reader({"tickers": "A", "tries": "1", "timeout": "0.1"}, lambda *a: time.sleep(5))
    assert list(slow.read(slow.partitions()[0]))[0][2].startswith("TimeoutError")


def test_labels(spark):
    assert clusters.accepted(' "Cloud Growth." ') == "Cloud Growth" and clusters.accepted(None) == "" and clusters.accepted("x" * 80) == ""


def test_shared_folder_of_a_cluster():
    from tessera import storage

    class Session:
        def __init__(self, **conf):
            self.conf = conf

    assert storage.shared_dir(Session(**{"spark.checkpoint.dir": "file:///x/"})) == "file:///x"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session(**{"spark.master": "spark://host:7077"}))


def test_cosine_and_rounding_are_those_of_sql():
    """Cosines of hashed words, among them such at a threshold and at half a digit, to the last bit; and rounding of halves, shown and not."""
    import duckdb

    from tessera.functions.numbers import half_up
    from tessera.plans.text import _cos

    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(2, 9))) for _ in range(4000)] + ["w1 w4 w30 w22 w22 w31 w10", "w10 w2 w1 w23 w22 w6 w6 w6"]
    v = chunks.hashed_vectors(texts)
    v, b = v[::2], v[1::2]
    want = [r[0] for r in duckdb.sql(f"SELECT {_cos} FROM (SELECT unnest(?::DOUBLE[][]) AS v, unnest(?::DOUBLE[][]) AS b)", params=[v.tolist(), b.tolist()]).fetchall()]
    assert [chunks.cosine(x, y) for x, y in zip(v, b)] == want
    odd = [0.0078125, 0.0015625, 0.7578125, 0.75781249999999989, 81.25, -0.0625, 1.0000005, 2.5e-7]
    for digits in (1, 3, 6):
        assert [half_up(x, digits) for x in odd] == [r[0] for r in duckdb.sql(f"SELECT round(unnest(?::DOUBLE[]), {digits})", params=[odd]).fetchall()]


def test_rounded_column(spark):
    from tessera.functions.numbers import half_up, half_up_column

    odd = [0.0078125, 0.0015625, 0.7578125, 0.75781249999999989, 81.25, -0.0625, 1.0000005, 0.0, None]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(odd)], "k int, x double").select("k", half_up_column(F.col("x"), 6).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in got] == [None if x is None else half_up(x, 6) for x in odd]


@pytest.mark.parametrize("seed", range(4))
def test_density_clusters_do_not_depend_on_ties_and_blocks(spark, seed):
    """Points of a grid, many at equal distances and some equal: exactly the clusters of the definition, however the rows lie in blocks, tiles and lists."""
    rng = np.random.default_rng(seed)
    points = np.concatenate([rng.integers(0, 4, (rng.integers(6, 16), 2)) * rng.uniform(0.2, 0.7) + rng.integers(-5, 5, 2) for _ in range(5)] + [rng.uniform(-6, 6, (6, 2))])
    points += rng.normal(0, 1e-3, points.shape) * (rng.random((len(points), 1)) < 0.5)
    points = points[np.unique(points, axis=0, return_index=True)[1]]
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "id long, vec array<double>")
    want = sorted(map(sorted, plain_hdbscan(points, clusters.MIN_SIZE, clusters.MIN_SAMPLES)[1]))
    for block in (7, 4096):
        got = {}
        for r in clusters.density_clusters(df, block=block).collect():
            got.setdefault(r["cluster_id"], []).append(r["id"])
        got.pop(-1, None)
        assert sorted(map(sorted, got.values())) == want


@pytest.mark.parametrize("listed", [2, 5])
def test_spanning_tree_of_groups_without_known_edges_between_them(spark, monkeypatch, tmp_path, listed):
    """Tight groups, and equal rows, of more rows than a list of neighbours has: the parts ask for their edges, and the tree has the least sum."""
    rng = np.random.default_rng(listed)
    points = np.concatenate([c + rng.normal(0, 0.01, (20, 3)) for c in rng.uniform(-3, 3, (9, 3))] + [np.ones((15, 3))])
    vectors = pa.table({"id": pa.array(range(len(points)), pa.int64()), "vec": pa.array(points.tolist(), pa.list_(pa.float64()))})
    pq.write_table(vectors, tmp_path / "part-0.parquet")
    monkeypatch.setattr(clusters, "TILE", 16)
    path, turns = tmp_path.as_uri(), 0
    (tmp_path / "near").mkdir()
    near = list(clusters._neighbours(path, listed, 3, 50)(iter(vectors.to_batches())))
    pq.write_table(pa.Table.from_batches(near), tmp_path / "near" / "part-0.parquet")
    s = clusters._first_state((tmp_path / "near").as_uri())
    while clusters._grow(s) > 1:
        clusters._save(f"{path}/state", s)
        (tmp_path / f"asked-{turns}").mkdir()
        pq.write_table(pa.Table.from_batches(list(clusters._asked(path, f"{path}/state", 50)(iter(vectors.to_batches())))), tmp_path / f"asked-{turns}" / "part-0.parquet")
        clusters._answered(s, f"{path}/asked-{turns}")
        turns += 1
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 2]
    m, inside, total = np.maximum(np.maximum(d, core[:, None]), core[None]), [0], 0.0
    while len(inside) < len(points):
        rest = [k for k in range(len(points)) if k not in inside]
        near = m[np.ix_(inside, rest)].min(axis=0)
        inside.append(rest[int(near.argmin())])
        total += near.min()
    assert turns > 0 and len(s["d"]) == len(points) - 1 and np.isclose(s["d"].sum(), total) and np.allclose(s["core"], core)


@pytest.mark.parametrize("n", [1, 7, 8, 61])
def test_pairs_are_found_a_strip_at_a_time(monkeypatch, n):
    """All pairs within reach, for tables of any width; where all are within reach, no more than a strip of them is held before `maybe` has chosen."""
    monkeypatch.setattr(clusters, "STRIP", 16)
    rng = np.random.default_rng(n)
    a, b, seen = rng.standard_normal((50, 5)), rng.standard_normal((n, 5)), []
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    for reach in (rng.uniform(0, 3, 50), np.full(50, np.inf), np.zeros(50)):
        r, c, x = clusters._pairs(a, b, reach, lambda r, c: [seen.append(len(r)), (r + c) % 3 != 0][1])
        want = np.argwhere((d < reach[:, None]) & (np.add.outer(np.arange(50), np.arange(n)) % 3 != 0))
        assert np.column_stack([r, c]).tolist() == want.tolist() and np.allclose(x, d[r, c])
    assert max(seen) <= 16 * n


def test_only_rows_that_ask_are_dealt(tmp_path):
    state = (tmp_path / "state").as_uri()
    clusters._save(state, {"ids": np.arange(3, 9), "ask": np.array([False, True, False, False, True, False]), "u": np.zeros(4)})
    batch = pa.RecordBatch.from_pydict({"id": pa.array([8, 7, 3, 4], pa.int64()), "vec": pa.array([[k] for k in range(4)], pa.list_(pa.float64()))})
    assert [b.to_pydict() for b in clusters._asking(state)(iter([batch]))] == [{"id": [7, 4], "vec": [[1.0], [3.0]]}]
    assert list(clusters._load(state, "ids")) == ["ids"] and sorted(clusters._load(state)) == ["ask", "ids", "u"]


def test_json_files_are_read_as_by_spark_in_few_tasks(spark, tmp_path):
    """Lists, broken and empty files, other encodings, hidden names and deeper folders; and tasks by cores, not by files."""
    here = tmp_path / "raw"
    (here / "A B" / "deep").mkdir(parents=True)
    (here / ".hidden").mkdir()
    row = {"raw_html": "<p>\u00e9</p>", "ticker": "AAA", "form_type": "10-K", "filing_date": "2024-02-01", "accession_number": "1"}
    for name, body in {
        "A B/10K_1.json": json.dumps(row), "A B/deep/10K_2.json": json.dumps([row, row | {"ticker": None}]), "A B/10K_3.json": "{broken", "A B/10K_4.json": " \n", "10K_5.json": json.dumps(row | {"raw_html": {"a": 1}, "form_type": 7}, separators=(",", ":")),
        "A B/10K_6.json": "[]", "A B/.10K_7.json": json.dumps(row), "A B/_10K_8.json": json.dumps(row), ".hidden/10K_9.json": json.dumps(row), "A B/10K_10.json.bak": json.dumps(row),
    }.items():
        (here / name).write_text(body)
    (here / "A B" / "10K_11.json").write_bytes(json.dumps(row, ensure_ascii=False).encode("utf-16-le"))
    for k in range(300):
        (here / "A B" / f"10K_9{k:03}.json").write_text(json.dumps(row | {"accession_number": str(k)}))
    plain = spark.read.schema(filings.RAW).option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(str(here))
    cols = ["ticker", "form_type", "filing_date", "accession_number", "raw_html"]
    key = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    got = filings._read_json(spark, str(here), "*.json", filings.RAW)
    assert key(got.select(*cols).collect()) == key(plain.select(*cols).collect())
    assert {r["file"] for r in got.where("ticker = 'AAA'").select("file").collect()} >= {"10K_1.json", "10K_2.json", "10K_5.json", "10K_11.json"}
    for k in range(300, 1200):
        (here / "A B" / f"10K_9{k:04}.json").write_text("{}")
    assert filings._read_json(spark, str(here), "*.json", filings.RAW).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_places_of_words_are_bounded():
    """A worker that has met any number of words keeps at most PLACES of them, and the vectors are those without any kept."""
    texts = [" ".join(f"x{k}y{j}" for j in range(1000)) for k in range(70)]
    got = chunks.hashed_vectors(texts)
    assert len(chunks._places) <= chunks.PLACES <= 50_000
    chunks._places.clear()
    assert (chunks.hashed_vectors(texts[-3:]) == got[-3:]).all()
