"""Queries over documents as sections: cleaning and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.numbers import half_up_column
from tessera.functions.text import q
from tessera.functions.vectors import hashed_embedding, hashed_embedding_sql
from tessera.operators import chunks as C
from tessera.operators import cleaning
from tessera.storage import spread

SECTION = {"en": "1", "fr": "1A", "de": "7", "es": "8"}
INJECTED = "Table of contents. Call (555) 123-4567 now. The form 10-K is incorporated herein by reference."


def _docs(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sections(spark, sf_dir):
    known = F.create_map(*(F.lit(x) for kv in SECTION.items() for x in kv))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).cast("string")
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("filing_id"), F.col("source").alias("ticker"), F.lit("10-K").alias("filing_type"), day.alias("filing_date"), F.coalesce(known[F.col("lang")], "lang").alias("section_id"), "text")


def _each(df, split):
    return df.select("doc_id", F.posexplode(split(F.col("text"))).alias("ord", "sentence")).select("doc_id", "ord", F.md5("sentence").alias("sentence_md5"))


def sentence_split(spark, sf_dir):
    return _each(_docs(spark, sf_dir), T.sentences)


def sentence_split_strict(spark, sf_dir):
    return _each(_docs(spark, sf_dir), T.strict_sentences)


def financial_sentences(spark, sf_dir):
    return cleaning.financial_rows(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "sentence")


def cleaning_stats(spark, sf_dir):
    """C6; the text's own words stand for those of the page."""
    return cleaning.cleaning_stats(_docs(spark, sf_dir), ["doc_id"])


def noise_reasons(spark, sf_dir):
    """Documents with and without injected boilerplate, by the kinds of noise."""
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" " + INJECTED))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", text.alias("t")).select("doc_id", *(F.col("t").rlike(f"(?iu){p}").alias(k) for k, p in T.NOISE.items()))


def paragraphs(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(C.paragraphs(F.col("text"))).alias("ord", "p")).select("doc_id", "ord", T.word_count(F.col("p")).alias("words"), F.md5("p").alias("text_md5"))


def hashed_embeddings(spark, sf_dir):
    v = hashed_embedding(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(v).alias("k", "x")).where("x > 0").select("doc_id", "k", half_up_column(F.col("x"), 6).alias("x"))


def topic_boundaries(spark, sf_dir):
    return C.topics(sections(spark, sf_dir)).select("filing_id", "ord", half_up_column(F.col("sim"), 6).alias("sim"), "grp")


def chunks_raw(spark, sf_dir):
    return C.raw_chunks(sections(spark, sf_dir)).select("filing_id", "grp", "words", "paragraphs", *(half_up_column(F.element_at("centroid", k), 6).alias(f"component_{k}") for k in (1, 20, 64)))


def chunks(spark, sf_dir):
    """A vector is told by the sum of its components and of their squares."""
    rows = C.semantic_chunks(sections(spark, sf_dir))
    total = lambda f: half_up_column(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + f(x.cast("double"))), 5)
    return rows.withColumn("embedding_sum", total(lambda x: x)).withColumn("embedding_squares", total(lambda x: x * x)).drop("embedding")


def chunk_status(spark, sf_dir):
    s = sections(spark, sf_dir)
    return C.filing_status(s, C.semantic_chunks(s)).select("filing_id", "status")



_sentence = f"s AS MATERIALIZED (SELECT doc_id, lang, unnest(x) AS s, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, lang, {T.sentences_sql('text')} AS x FROM documents))"
#: The fold, sentence by sentence.
_paragraph = f"""
{_sentence}, sw AS MATERIALIZED (SELECT *, {T.word_count_sql("s")} AS w FROM s),
fold AS (
  SELECT doc_id, k, w AS n, 0 AS p FROM sw WHERE k = 1
  UNION ALL
  SELECT f.doc_id, sw.k, CASE WHEN f.n > 0 AND f.n + w > 150 THEN w ELSE f.n + w END, CASE WHEN f.n > 0 AND f.n + w > 150 THEN p + 1 ELSE p END FROM fold f JOIN sw ON sw.doc_id = f.doc_id AND sw.k = f.k + 1
), paras AS MATERIALIZED (SELECT doc_id, any_value(lang) AS lang, p::INT AS ord, string_agg(s, ' ' ORDER BY k) AS t, sum(w)::INT AS words FROM fold JOIN sw USING (doc_id, k) GROUP BY doc_id, p)"""
#: Fold of `w` words of rows k, k + 1, ... of each id in `source` (k from 1): a row joins the group while both have at most / fewer than `limit` words.
_fold = lambda name, source, limit, under: f"""{name} AS (
  SELECT id, k, w AS n, 0 AS g FROM {source} WHERE k = 1
  UNION ALL
  SELECT f.id, x.k, CASE WHEN f.n + x.w {under} {limit} THEN f.n + x.w ELSE x.w END, CASE WHEN f.n + x.w {under} {limit} THEN g ELSE g + 1 END FROM {name} f JOIN {source} x ON x.id = f.id AND x.k = f.k + 1
)"""  # noqa: E731
_threshold = "CASE lang " + " ".join(f"WHEN '{k}' THEN {C.THRESHOLDS[v]}" for k, v in SECTION.items()) + " ELSE 0.5 END"
_cos = "list_dot_product(v, b) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(b, b)), 0)"
_topics = f"""{_paragraph}, e AS MATERIALIZED (SELECT *, {hashed_embedding_sql("t")} AS v FROM paras),
l AS (SELECT *, lag(v) OVER (PARTITION BY doc_id ORDER BY ord) AS b FROM e),
c AS (SELECT *, CASE WHEN b IS NOT NULL THEN coalesce({_cos}, 1.0) END AS sim FROM l),
topics AS MATERIALIZED (SELECT doc_id AS filing_id, ord, t, words, v, sim, sum(coalesce((sim < {_threshold})::INT, 0)) OVER (PARTITION BY doc_id ORDER BY ord)::INT AS grp FROM c)"""


_mean = "list(x ORDER BY j)"
#: Raw chunks merged, the large ones cut and embedded anew, the short sections besides; then each with its neighbours.
_chunks = f"""{_topics},
raw AS MATERIALIZED (SELECT filing_id AS id, grp + 1 AS k, string_agg(t, ' ' ORDER BY ord) AS t, sum(words)::INT AS w FROM topics GROUP BY filing_id, grp),
{_fold("merge", "raw", C.SMALL, "<")},
merged AS MATERIALIZED (SELECT id, g, string_agg(t, ' ' ORDER BY k) AS t, sum(w)::INT AS w FROM merge JOIN raw USING (id, k) GROUP BY id, g),
means AS MATERIALIZED (
  SELECT id, g, {_mean} AS v FROM (
    SELECT id, g, j, avg(x) AS x FROM (SELECT m.id, m.g, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM merge m JOIN topics t ON t.filing_id = m.id AND t.grp = m.k - 1) GROUP BY ALL
  ) GROUP BY id, g
),
parts AS MATERIALIZED (SELECT id || '/' || g AS id, unnest(x) AS t, generate_subscripts(x, 1) AS k FROM (SELECT id, g, {T.sentences_sql("t")} AS x FROM merged WHERE w > {C.LARGE})),
sized AS MATERIALIZED (SELECT *, {T.word_count_sql("t")}::INT AS w FROM parts),
{_fold("cut", "sized", C.LARGE, "<=")},
pieces AS (SELECT split_part(id, '/', 1)::BIGINT AS id, split_part(id, '/', 2)::INT AS g, c.g AS p, string_agg(t, ' ' ORDER BY k) AS t, sum(w)::INT AS w FROM cut c JOIN sized USING (id, k) GROUP BY id, c.g),
docs AS MATERIALIZED (SELECT doc_id AS id, text, {T.strip_sql("text")} AS t, {T.word_count_sql("text")}::INT AS w FROM documents),
every AS MATERIALIZED (
  SELECT d.id, 0 AS g, 0 AS p, t, w, {hashed_embedding_sql("t")} AS v FROM docs d WHERE w BETWEEN {C.TINY} AND {C.SMALL}
  UNION ALL SELECT m.id, m.g, 0, m.t, m.w, v FROM merged m JOIN means USING (id, g) JOIN docs d ON d.id = m.id AND d.w > {C.SMALL} WHERE m.w <= {C.LARGE}
  UNION ALL SELECT id, g, p, t, w, {hashed_embedding_sql("t")} FROM pieces
), around AS (
  SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY id) AS total, lag(t) OVER o AS bt, lead(t) OVER o AS nt, lag(v) OVER o AS b FROM every WINDOW o AS (PARTITION BY id ORDER BY g, p)
)"""
_day = "(DATE '2024-01-01' + (doc_id % 300)::INT)::VARCHAR"
_section = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SECTION.items()) + " ELSE lang END"
_name = "CASE lang " + " ".join(f"WHEN '{k}' THEN {q(C.SECTION_NAMES[v])}" for k, v in SECTION.items()) + " ELSE lang END"
_chunk_rows = f"""WITH RECURSIVE {_chunks} SELECT source AS ticker, id AS filing_id, '10-K' AS filing_type, {_day} AS filing_date, {_section} AS section_id, {_name} AS section_name,
  id || '_' || {_section} || printf('_%03d', i) AS chunk_id, i::INT AS chunk_index, total::INT AS total_chunks, t AS text,
  coalesce(array_to_string(list_slice({T.sentences_sql("bt")}, -2, -1), ' '), '') AS overlap_previous, coalesce(array_to_string(list_slice({T.sentences_sql("nt")}, 1, 2), ' '), '') AS overlap_next,
  coalesce(substr(bt, 1, {C.CONTEXT}) || '...', '') AS preceding_context, w AS word_count, CASE WHEN b IS NOT NULL THEN round(1 - coalesce({_cos}, 1.0), 3) END AS topic_shift_score,
  round(list_sum(list_transform(v, lambda x: x::FLOAT::DOUBLE)), 5) AS embedding_sum, round(list_sum(list_transform(v, lambda x: x::FLOAT::DOUBLE * x::FLOAT::DOUBLE)), 5) AS embedding_squares
FROM around JOIN documents ON doc_id = id"""


def _each_sql(split: str) -> str:
    return f"SELECT doc_id, (generate_subscripts(x, 1) - 1)::INT AS ord, md5(unnest(x)) AS sentence_md5 FROM (SELECT doc_id, {split} AS x FROM documents)"


_kept = f"list_filter({T.strict_sentences_sql('text')}, lambda z: {T.is_financial_sql('z')})"
_stats = f"SELECT doc_id, {T.word_count_sql('text')}::INT AS raw, {T.word_count_sql('''array_to_string(x, ' ')''')}::INT AS clean, len(x)::INT AS n FROM (SELECT doc_id, text, {_kept} AS x FROM documents)"
_injected = f"CASE WHEN doc_id % 5 = 0 THEN text || ' ' || {q(INJECTED)} ELSE text END"
_all = (
    sentence_split, sentence_split_strict, financial_sentences, cleaning_stats, noise_reasons, paragraphs, hashed_embeddings, topic_boundaries, chunks_raw, chunks, chunk_status,
)
QUERIES = {f.__name__: f for f in _all}
SQL = {
    "sentence_split": _each_sql(T.sentences_sql("text")),
    "sentence_split_strict": _each_sql(T.strict_sentences_sql("text")),
    "financial_sentences": f"SELECT doc_id, unnest({_kept}) AS sentence FROM documents",
    "cleaning_stats": f"SELECT doc_id, raw AS token_count_raw, clean AS token_count_clean, n AS n_sentences, round((1 - clean / greatest(raw, 1)) * 100, 1) AS boilerplate_removed_pct FROM ({_stats})",
    "noise_reasons": "SELECT doc_id, " + ", ".join(f"regexp_matches(t, {q('(?i)' + p)}) AS {k}" for k, p in T.NOISE.items()) + f" FROM (SELECT doc_id, {_injected} AS t FROM documents)",
    "paragraphs": f"WITH RECURSIVE {_paragraph} SELECT doc_id, ord, words, md5(t) AS text_md5 FROM paras",
    "hashed_embeddings": f"SELECT doc_id, k::INT AS k, round(x, 6) AS x FROM (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS k FROM (SELECT doc_id, {hashed_embedding_sql('text')} AS v FROM documents)) WHERE x > 0",
    "topic_boundaries": f"WITH RECURSIVE {_topics} SELECT filing_id, ord, round(sim, 6) AS sim, grp FROM topics",
    "chunks_raw": f"WITH RECURSIVE {_topics} SELECT filing_id, grp, sum(words)::INT AS words, count(*) AS paragraphs, "
    + ", ".join(f"round(sum(v[{k}]) / count(*), 6) AS component_{k}" for k in (1, 20, 64))
    + " FROM topics GROUP BY filing_id, grp",
    "chunks": _chunk_rows,
    "chunk_status": f"SELECT doc_id AS filing_id, CASE WHEN {T.word_count_sql('text')} = 0 THEN 'empty' WHEN {T.word_count_sql('text')} < 20 THEN 'no_chunks' ELSE 'ok' END AS status FROM documents",
}
