"""Queries over embeddings, whose labels are clusters and every seventh of which is noise, with documents of the same id."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.config import STOPWORDS
from tessera.functions.text import q
from tessera.functions.vectors import doubles
from tessera.operators import clusters as K

#: At the usual 0.35 none of these vectors is near a centroid.
DISTANCE = 0.80


def members(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("vec"), label.alias("cluster_id"))


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def centroids(spark, sf_dir):
    return K.centroids(members(spark, sf_dir)).select("cluster_id", F.posexplode("centroid").alias("k", "x")).select("cluster_id", "k", F.round("x", 6).alias("x"))


def noise_reassign(spark, sf_dir):
    return K.reassign_noise(members(spark, sf_dir), DISTANCE).select("id", "cluster_id")


def noise_reassign_strict(spark, sf_dir):
    return K.reassign_noise(members(spark, sf_dir)).select("id", "cluster_id")


def cluster_heads(spark, sf_dir):
    return K.heads(K.reassign_noise(members(spark, sf_dir), DISTANCE)).withColumn("similarity", F.round("similarity", 6))


def cluster_profile(spark, sf_dir):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).cast("string")
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("ticker"), F.when(F.col("doc_id") % 9 != 0, day).alias("filing_date"), F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("section"))
    return K.profile(members(spark, sf_dir).select("id", "cluster_id").join(docs, "id"))


def cluster_keywords(spark, sf_dir):
    return K.keywords(_docs(spark, sf_dir).select(F.col("source").alias("cluster_id"), F.col("doc_id").alias("id"), "text"))


def cluster_labels(spark, sf_dir):
    return cluster_keywords(spark, sf_dir).select("cluster_id", K.label(F.col("keywords")).alias("label"))


def top_clusters(spark, sf_dir):
    return K.top_clusters(members(spark, sf_dir))


def cluster_totals(spark, sf_dir):
    return K.totals(members(spark, sf_dir))


def density_clusters(spark, sf_dir):
    return K.density_clusters(members(spark, sf_dir).select("id", "vec"))


def incremental_assign(spark, sf_dir):
    """New vectors, every third, by the centroids of the others."""
    m = members(spark, sf_dir)
    return K.assign_new(m.where("id % 3 = 0").select("id", "vec"), K.centroids(m.where("id % 3 <> 0")), DISTANCE)


MEMBERS = "m AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS cluster_id FROM embeddings)"


def centre_sql(name: str, source: str) -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT cluster_id, list(x ORDER BY k) AS centroid, min(first) AS first FROM (SELECT cluster_id, k, avg(x) AS x, min(id) AS first FROM (SELECT cluster_id, id, unnest(vec) AS x, generate_subscripts(vec, 1) AS k FROM {source} "
        f"WHERE cluster_id <> -1) GROUP BY ALL) GROUP BY 1)"
    )


COS = "list_dot_product(vec, centroid) / greatest(sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(centroid, centroid)), 1e-300)"


def _nearest(rows: str) -> str:
    return f"SELECT id, c.cluster_id AS to_id, {COS} AS sim FROM {rows}, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, c.first) = 1"


def _reassigned(distance: float) -> str:
    return f"""{MEMBERS}, {centre_sql("c", "m")}, near AS ({_nearest("(SELECT id, vec FROM m WHERE cluster_id = -1)")}),
moved AS MATERIALIZED (SELECT m.id, vec, coalesce(CASE WHEN 1 - sim <= {distance} THEN to_id END, cluster_id) AS cluster_id FROM m LEFT JOIN near ON near.id = m.id)"""


_stop = "(" + ", ".join(q(w) for w in STOPWORDS) + ")"


def keywords_sql(table: str, key: str, number: str) -> str:
    """CTEs up to keys (cluster_id, keywords, four)."""
    return f"""
kf AS (SELECT {key} AS c, text, row_number() OVER (PARTITION BY {key} ORDER BY {number}) AS d FROM {table} QUALIFY d <= 50),
kw AS (SELECT c, d, unnest(x) AS word, generate_subscripts(x, 1) AS p FROM (SELECT c, d, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS x FROM kf)),
kn AS (SELECT c, word, count(*) AS n, min((d, p)) AS first FROM kw WHERE regexp_matches(word, '^[a-z]{{4,}}$') AND word NOT IN {_stop} GROUP BY ALL),
kt AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, first) AS k FROM kn QUALIFY k <= 5),
keys AS (SELECT s.c AS cluster_id, coalesce(string_agg(word, ',' ORDER BY k), '') AS keywords, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (k <= 4), '') AS four FROM (SELECT DISTINCT {key} AS c FROM {table}) s LEFT JOIN kt ON kt.c = s.c GROUP BY 1)"""


def heads_sql(table: str, source: str, moved: str = "") -> str:
    """Heads of the members, or with `moved`, such as "< 5", of those whose cluster_id is so, once noise is moved."""
    rows = f"{MEMBERS}, {table} AS ({source})"
    if moved:
        rows = _reassigned(DISTANCE).replace("FROM embeddings)", f"FROM embeddings WHERE (CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END) {moved})")
    return f"WITH {rows}, {centre_sql('h', table)} SELECT h.cluster_id, id, round({COS}, 6) AS similarity FROM {table} t JOIN h ON h.cluster_id = t.cluster_id QUALIFY row_number() OVER (PARTITION BY h.cluster_id ORDER BY round({COS}, 9) DESC, id) = 1"


_keywords = keywords_sql("documents", "source", "doc_id")
_all = (centroids, noise_reassign, noise_reassign_strict, cluster_heads, cluster_profile, cluster_keywords, cluster_labels, top_clusters, cluster_totals, density_clusters, incremental_assign)
QUERIES = {f.__name__: f for f in _all}
SQL = {
    "centroids": f"WITH {MEMBERS}, {centre_sql('c', 'm')} SELECT cluster_id, (generate_subscripts(centroid, 1) - 1)::INT AS k, round(unnest(centroid), 6) AS x FROM c",
    "noise_reassign": f"WITH {_reassigned(DISTANCE)} SELECT id, cluster_id FROM moved",
    "noise_reassign_strict": f"WITH {_reassigned(K.NOISE_DISTANCE)} SELECT id, cluster_id FROM moved",
    "cluster_heads": f"WITH {_reassigned(DISTANCE)}, {centre_sql('h', 'moved')} SELECT h.cluster_id, id, round({COS}, 6) AS similarity FROM moved JOIN h ON h.cluster_id = moved.cluster_id QUALIFY row_number() OVER (PARTITION BY h.cluster_id ORDER BY round({COS}, 9) DESC, id) = 1",
    "cluster_profile": f"""WITH {MEMBERS}, r AS MATERIALIZED (
      SELECT cluster_id, id, source AS ticker, CASE WHEN doc_id % 9 <> 0 THEN (DATE '2024-01-01' + (doc_id % 300)::INT)::VARCHAR END AS day, CASE WHEN doc_id % 11 <> 0 THEN lang ELSE 'unknown' END AS section FROM m JOIN documents ON doc_id = id WHERE cluster_id <> -1
    ), s AS (SELECT cluster_id, section, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(id)) AS k FROM r GROUP BY cluster_id, section QUALIFY k <= 3)
    SELECT * FROM (SELECT cluster_id, count(*) AS size, string_agg(DISTINCT ticker, ', ' ORDER BY ticker) AS companies, coalesce(min(day), '') AS date_from, coalesce(max(day), '') AS date_to FROM r GROUP BY 1)
    JOIN (SELECT cluster_id, string_agg(section, ', ' ORDER BY k) AS dominant_sections FROM s GROUP BY 1) USING (cluster_id)""",
    "cluster_keywords": f"WITH {_keywords} SELECT cluster_id, keywords FROM keys",
    "cluster_labels": f"WITH {_keywords} SELECT cluster_id, CASE WHEN four = '' THEN 'Unlabeled Cluster' ELSE four END AS label FROM keys",
    "top_clusters": f"WITH {MEMBERS} SELECT cluster_id, count(*) AS size FROM m WHERE cluster_id <> -1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "cluster_totals": f"WITH {MEMBERS} SELECT count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS clusters, count(*) FILTER (cluster_id <> -1) AS clustered, count(*) FILTER (cluster_id = -1) AS noise FROM m",
    "incremental_assign": f"WITH {MEMBERS}, old AS (SELECT * FROM m WHERE id % 3 <> 0), {centre_sql('c', 'old')}, near AS ({_nearest('(SELECT id, vec FROM m WHERE id % 3 = 0)')}) SELECT id, CASE WHEN 1 - sim <= {DISTANCE} THEN to_id ELSE -1 END AS cluster_id FROM near",
}
