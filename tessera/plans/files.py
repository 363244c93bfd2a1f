"""Queries through files: raw and processed filings, prices, macro series and reports are written to the shared folder and read again; and the chains from files to results."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera import entries
from tessera.functions import text as T
from tessera.functions.text import collapse_sql, q, word_count_sql
from tessera.operators import clusters as K
from tessera.operators import quality
from tessera.plans import clusters, filings, prices
from tessera.plans.text import SECTION
from tessera.sources import filings as files
from tessera.sources import market
from tessera.storage import new_path, spread, stored

DAY = "2024-01-01"
SERIES = ["cpi", "gdp", "rates", "broken"]


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _about():
    kind = F.when(F.col("doc_id") % 4 == 3, "8-K").otherwise("10-K")
    day = F.date_add(F.lit(DAY).cast("date"), (F.col("doc_id") % 300).cast("int")).cast("string")
    name = F.concat(F.regexp_replace(kind, "-", ""), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".json"))
    return F.col("source").alias("ticker"), name.alias("file"), kind.alias("form_type"), day.alias("filing_date")


def raw_folder(spark, sf_dir) -> str:
    """Each document as a raw filing of one paragraph; every ninth has no accession number, every eleventh no HTML."""
    root = new_path(spark, "raw")
    body = F.concat(F.lit("<p>"), filings.escaped(F.col("text"), False), F.lit("</p>"))
    rows = _docs(spark, sf_dir).select(*_about(), F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("acc-"), F.col("doc_id").cast("string"))).alias("accession_number"), F.when(F.col("doc_id") % 11 != 0, body).alias("raw_html"))
    packed = F.to_json(F.struct("raw_html", "ticker", "form_type", "filing_date", "accession_number"))
    files.write_files(spread(rows.select("ticker", "file", packed.alias("body"))), root)
    return root


def scan_raw_filings(spark, sf_dir):
    """Annual reports by their prefix."""
    rows = files.read_raw(spark, raw_folder(spark, sf_dir), "10K_")
    return rows.select("filing_id", "ticker", "form_type", "filing_date", "file", F.md5("raw_html").alias("html_md5"))


def scan_processed(spark, sf_dir):
    """Sections of processed filings, a document each and every fifth without any."""
    known = F.create_map(*(F.lit(x) for kv in SECTION.items() for x in kv))
    rows = _docs(spark, sf_dir).select("doc_id", *_about(), F.coalesce(known[F.col("lang")], "lang").alias("section"), "text")
    body = F.to_json(F.struct("ticker", F.col("doc_id").cast("string").alias("filing_id"), F.col("form_type").alias("filing_type"), "filing_date", F.when(F.col("doc_id") % 5 != 0, F.create_map("section", "text")).alias("sections")))
    root = new_path(spark, "processed")
    files.write_files(spread(rows.select("ticker", "file", body.alias("body"))), root)
    return files.read_processed(spark, root).withColumn("text", F.md5("text"))


def clean_filing_stats(spark, sf_dir):
    """Raw filings to statistics."""
    return entries.clean_filings(files.read_raw(spark, raw_folder(spark, sf_dir))).stats


def stats_csv(spark, sf_dir):
    """K2: statistics of prices as one CSV file."""
    path = new_path(spark, "stats")
    files.write_csv(prices.price_stats(spark, sf_dir), path)
    return spark.read.schema("ticker string, original_rows long, missing_days_count long, missing_days_pct double, outlier_count long, outlier_dates string").csv(path, header=True).fillna("", ["outlier_dates"])


def price_files(spark, sf_dir):
    """Bars as CSV files of each ticker, read again."""
    bars = prices.bars_of_events(spark, sf_dir).select("date", "open", "high", "low", "close", "volume", "ticker", F.lit("2024-02-01").alias("pulled_at"))
    path = new_path(spark, "prices")
    market.write_csv_by(bars, "ticker", path)
    return market.load_prices(spark, path).withColumn("date", F.col("date").cast("string"))


def _observations(series: str, start: str, end: str) -> str:
    if series == "broken":
        raise ConnectionError(series)
    return json.dumps({"observations": [{"date": f"{y}-{m:02}-01", "value": "." if m == 12 else str(len(series) + y / 4 + m)} for y in (2023, 2024) for m in range(1, 13)]})


def _pulled(spark):
    spark.dataSource.register(market.chart_source(_observations, "observations"))
    return spark.read.format("observations").option("tickers", ",".join(SERIES)).option("pause", "0.01").load()


def macro_files(spark, sf_dir):
    """Series from a source, one of which fails, as CSV files and read again."""
    rows = market.macro_or_synthetic(spark, _pulled(spark), SERIES, "2023-01-01", "2024-12-31")
    path = new_path(spark, "macro")
    market.write_csv_by(rows, "series", path)
    return market.load_macro(spark, path).withColumn("date", F.col("date").cast("string"))


def pull_manifest(spark, sf_dir):
    """K6: the pull's successes and failures as JSON."""
    path = new_path(spark, "manifest")
    files.write_json(market.manifest(_pulled(spark)), path)
    return spark.read.schema("status string, n long").json(path)


def company_status(spark, sf_dir):
    """Q2 with companies that have no file, or no annual report: the status of each by its first annual report."""
    status = filings.filing_status(spark, sf_dir).select("filing_id", "status")
    f = F.col("filing_id")
    about = status.select("filing_id", F.concat(F.lit("C"), (f % 17).cast("string")).alias("ticker"), F.when((f % 17 == 3) | (f % 5 == 1), "8-K").otherwise("10-K").alias("form_type"), F.lpad((999_999_999 - f).cast("string"), 9, "0").alias("file"))
    companies = spark.range(20).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("ticker"))
    return quality.company_status(companies, about, status)


def _described(spark, sf_dir):
    day = F.date_add(F.lit(DAY).cast("date"), (F.col("doc_id") % 300).cast("int")).cast("string")
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("ticker"), F.when(F.col("doc_id") % 9 != 0, day).alias("filing_date"), F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("section"), "text")


def _joined(spark, sf_dir):
    return clusters.members(spark, sf_dir).join(_docs(spark, sf_dir).select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")


def cluster_summaries(spark, sf_dir):
    """G14."""
    return K.summaries(_joined(spark, sf_dir), _described(spark, sf_dir))


def cluster_summaries_labelled(spark, sf_dir):
    """G13 with a labeler, which fails on some clusters and says too much of others."""

    def labeler(texts, companies, keywords):
        if len(companies) % 3 == 0:
            raise TimeoutError
        return "x" * 80 if len(companies) % 3 == 1 else f'"{len(texts)} {max(map(len, texts))} {len(companies)}."'

    return K.summaries(_joined(spark, sf_dir), _described(spark, sf_dir), labeler).select("cluster_id", "label")


def labelled_chunks(spark, sf_dir):
    """K7: cluster and head of each chunk; every tenth chunk is in no cluster yet."""
    m = clusters.members(spark, sf_dir).withColumn("chunk_id", F.concat(F.lit("c"), F.col("id").cast("string")))
    heads = K.heads(m).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"))
    return files.label_chunks(m.select("chunk_id"), m.where("id % 10 <> 0").select("chunk_id", "cluster_id"), heads)


def upserted_heads(spark, sf_dir):
    """K8: heads written a second time, after the noise was moved."""
    m = clusters.members(spark, sf_dir)
    old, new = (stored(K.heads(x).withColumn("similarity", F.round("similarity", 6)), "heads") for x in (m, K.reassign_noise(m.where("cluster_id < 5"), clusters.DISTANCE)))
    return files.upsert(old, new, "cluster_id")


def clusters_json(spark, sf_dir):
    """K9."""
    path = new_path(spark, "clusters")
    files.write_json(K.totals(clusters.members(spark, sf_dir)), path)
    return spark.read.schema("clusters long, clustered long, noise long").json(path)


def reduced_vectors(spark, sf_dir):
    """G1 without a number of components: the vectors as they are, as where the reducer isn't there."""
    rows = K.reduce_dimensions(clusters.members(spark, sf_dir))
    return rows.select("id", F.posexplode("vec").alias("k", "x")).select("id", "k", F.round("x", 6).alias("x"))


def filings_to_clusters(spark, sf_dir):
    """Annual reports as raw filings, to sections, to chunks, to clusters and their summaries."""
    html = filings.annual_filings(spark, sf_dir)
    raw = html.select(F.col("filing_id").cast("string").alias("filing_id"), F.concat(F.lit("C"), (F.col("filing_id") % 17).cast("string")).alias("ticker"), F.lit("10-K").alias("form_type"), F.lit(DAY).alias("filing_date"), F.col("html").alias("raw_html"))
    return entries.cluster_chunks(stored(entries.chunk_filings(raw), "chunks")).summaries


_kind = "CASE WHEN doc_id % 4 = 3 THEN '8-K' ELSE '10-K' END"
_file = f"replace({_kind}, '-', '') || '_' || doc_id || '.json'"
_day = f"(DATE '{DAY}' + (doc_id % 300)::INT)::VARCHAR"
_id = f"CASE WHEN doc_id % 9 <> 0 THEN 'acc-' || doc_id ELSE concat_ws('_', source, {_kind}, {_day}) END"
_esc = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
#: What the cleaner makes of a paragraph: collapsed, with plain quotes.
_read = collapse_sql(f"translate(CASE WHEN doc_id % 11 <> 0 THEN text ELSE '' END, {q(chr(0x2018) + chr(0x2019) + chr(0x201C) + chr(0x201D) + chr(0xA0))}, {q(chr(39) * 2 + chr(34) * 2 + ' ')})")
_section = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SECTION.items()) + " ELSE lang END"
_summaries = f"""{clusters.MEMBERS}, d AS MATERIALIZED (
  SELECT doc_id AS id, source AS ticker, CASE WHEN doc_id % 9 <> 0 THEN {_day} END AS day, CASE WHEN doc_id % 11 <> 0 THEN lang ELSE 'unknown' END AS section, text FROM documents
), own AS MATERIALIZED (SELECT * FROM m JOIN d USING (id) WHERE cluster_id <> -1),
{clusters.centre_sql("h", "own")}, heads AS (SELECT own.cluster_id, id, substr(text, 1, 200) AS preview, text FROM own JOIN h ON h.cluster_id = own.cluster_id QUALIFY row_number() OVER (PARTITION BY own.cluster_id ORDER BY round({clusters.COS}, 9) DESC, id) = 1),
{clusters.keywords_sql("own", "cluster_id", "id")},
s AS (SELECT cluster_id, section, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(id)) AS k FROM own GROUP BY cluster_id, section QUALIFY k <= 3),
p AS (SELECT cluster_id, count(*) AS size, string_agg(DISTINCT ticker, ', ' ORDER BY ticker) AS companies, count(DISTINCT ticker) AS n_companies, coalesce(min(day), '') AS date_from, coalesce(max(day), '') AS date_to FROM own GROUP BY 1),
t AS (SELECT cluster_id, string_agg(section, ', ' ORDER BY k) AS dominant_sections FROM s GROUP BY 1),
firsts AS (SELECT cluster_id, max(length(substr(text, 1, 300))) AS longest, count(*) AS n FROM (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY id) <= 4) GROUP BY 1)"""
_plain = "CASE WHEN four = '' THEN 'Unlabeled Cluster' ELSE four END"
_all = (
    scan_raw_filings, scan_processed, clean_filing_stats, stats_csv, price_files, macro_files, pull_manifest, company_status, cluster_summaries, cluster_summaries_labelled, labelled_chunks, upserted_heads,
    clusters_json, reduced_vectors, filings_to_clusters,
)
QUERIES = {f.__name__: f for f in _all}
SQL = {
    "scan_raw_filings": f"SELECT {_id} AS filing_id, source AS ticker, {_kind} AS form_type, {_day} AS filing_date, {_file} AS file, md5(CASE WHEN doc_id % 11 <> 0 THEN '<p>' || {_esc} || '</p>' ELSE '' END) AS html_md5 FROM documents WHERE doc_id % 4 <> 3",
    "scan_processed": f"SELECT doc_id::VARCHAR AS filing_id, source AS ticker, {_kind} AS filing_type, {_day} AS filing_date, CASE WHEN doc_id % 5 <> 0 THEN {_section} END AS section_id, CASE WHEN doc_id % 5 <> 0 THEN md5(text) END AS text FROM documents",
    "clean_filing_stats": f"""SELECT filing_id, ticker, form_type, filing_date, raw AS token_count_raw, clean AS token_count_clean, n AS n_sentences, round((1 - clean / greatest(raw, 1)) * 100, 1) AS boilerplate_removed_pct FROM (
      SELECT filing_id, ticker, form_type, filing_date, sum({word_count_sql("t")})::BIGINT AS raw, sum({word_count_sql("array_to_string(x, ' ')")})::BIGINT AS clean, sum(len(x))::BIGINT AS n FROM (
        SELECT *, list_filter({T.strict_sentences_sql("t")}, lambda z: {T.is_financial_sql("z")}) AS x FROM (SELECT {_id} AS filing_id, source AS ticker, {_kind} AS form_type, {_day} AS filing_date, {_read} AS t FROM documents)
      ) GROUP BY ALL)""",
    "stats_csv": prices.SQL["price_stats"],
    "price_files": prices.SQL["ohlcv_bars"],
    "macro_files": "SELECT s AS series, make_date(y, m, 1)::VARCHAR AS date, CASE WHEN m <> 12 THEN (length(s) + y / 4 + m)::DOUBLE END AS value FROM (VALUES ('cpi'), ('gdp'), ('rates')) v(s), (VALUES (2023), (2024)) w(y), range(1, 13) t(m)",
    "pull_manifest": "SELECT * FROM (VALUES ('success', 3::BIGINT), ('failure', 1::BIGINT)) v(status, n)",
    "company_status": f"""WITH c AS (SELECT 'C' || i AS ticker FROM range(20) t(i)), st AS (SELECT filing_id, status FROM ({filings.SQL["filing_status"]})),
      f AS (SELECT filing_id, 'C' || (filing_id % 17) AS ticker, filing_id % 17 = 3 OR filing_id % 5 = 1 AS other FROM st),
      one AS (SELECT ticker, max(filing_id) FILTER (NOT other) AS filing_id, count(*) AS n FROM f GROUP BY 1)
      SELECT c.ticker, one.filing_id, CASE WHEN n IS NULL THEN 'no_files' WHEN one.filing_id IS NULL THEN 'no_10k' ELSE status END AS status FROM c LEFT JOIN one USING (ticker) LEFT JOIN st ON st.filing_id = one.filing_id""",
    "cluster_summaries": f"WITH {_summaries} SELECT p.cluster_id, {_plain} AS label, size, heads.id AS head_id, preview AS head_preview, dominant_sections, companies, date_from, date_to FROM p JOIN t USING (cluster_id) JOIN keys USING (cluster_id) JOIN heads USING (cluster_id)",
    "cluster_summaries_labelled": f"WITH {_summaries} SELECT p.cluster_id, CASE WHEN least(n_companies, 8) % 3 = 2 THEN 1 + n || ' ' || greatest(longest, length(substr(heads.text, 1, 300))) || ' ' || least(n_companies, 8) ELSE {_plain} END AS label FROM p JOIN keys USING (cluster_id) JOIN heads USING (cluster_id) JOIN firsts USING (cluster_id)",
    "labelled_chunks": f"WITH {clusters.MEMBERS}, {clusters.centre_sql('h', 'm')}, heads AS (SELECT id FROM m JOIN h ON h.cluster_id = m.cluster_id QUALIFY row_number() OVER (PARTITION BY h.cluster_id ORDER BY round({clusters.COS}, 9) DESC, id) = 1) SELECT 'c' || id AS chunk_id, CASE WHEN id % 10 <> 0 THEN cluster_id END AS cluster_id, id IN (FROM heads) AS is_cluster_head FROM m",
    "upserted_heads": f"""WITH old AS ({clusters.heads_sql("all_m", "SELECT * FROM m")}), new AS ({clusters.heads_sql("moved", "", "< 5")})
      SELECT * FROM new UNION ALL SELECT * FROM old WHERE cluster_id NOT IN (SELECT cluster_id FROM new)""",
    "clusters_json": clusters.SQL["cluster_totals"],
    "reduced_vectors": "SELECT vec_id AS id, (generate_subscripts(embedding, 1) - 1)::INT AS k, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings",
}
