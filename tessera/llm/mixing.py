"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a budget of tokens (words): its share of the weights times the whole budget. Complete epochs come first: a document
has floor(budget / tokens of its source) copies. What is left is sampled without replacement: a document's key is
-ln(u) / quality weight with u from the hash of its id, and documents are taken in the order of their keys while the running sum of
their tokens is within the rest.

The running sum over a source isn't one sort: keys are cut into ranges whose sums say which are taken whole; only the range
where the budget ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import stored

TEMPERATURE = 0.7
RANGES = 1024
WORD = r"[^ \t\n\x0B\f\r]+"
#: Weight of documents labelled good and bad, and of those without a label.
GOOD, BAD, UNKNOWN = 1.0, 0.25, 0.5


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    budget: int | None = None,
    quality: DataFrame | None = None,
    temperature: float = TEMPERATURE,
    seed: int = 0,
    unknown: float = 1.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents that are taken once or more.

    weights: of the sources, in any unit; a source without one gets nothing. None: in proportion to tokens ** temperature.
    budget: tokens in all; None: as many as docs have. quality: (doc_id, weight); where there is none, or one that is null or no number, the weight is `unknown`; where it is 0
    or less, the document comes last; of several, the largest counts. Rows that repeat an id are one document with the tokens of all of them, of the
    least source. A null source counts as ''; rows with a null id aren't taken; a null text has 0 tokens. Keys that tie go by id.
    A source without tokens gets no complete epochs, and all its documents fit in the rest. An empty table gives no row; other columns aren't looked at.
    """
    spark = docs.sparkSession
    units = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), tokens(F.col(text_col)).alias("n_tokens")).where("doc_id is not null")
    units = units.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("n_tokens").alias("n_tokens"))
    if quality is not None:
        known = quality.toDF("doc_id", "weight").where("doc_id is not null and weight is not null and not isnan(weight)")
        units = units.join(known.groupBy("doc_id").agg(F.max("weight").alias("weight")), "doc_id", "left")
    else:
        units = units.withColumn("weight", F.lit(None).cast("double"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(float(unknown)))
    units = units.select("doc_id", "source", "n_tokens", F.when(weight > 0, -F.ln(u) / weight).otherwise(F.lit(float("inf"))).alias("k"))
    units = stored(units.withColumn("r", F.floor((1 - F.exp(-F.col("k"))) * RANGES).cast("int")), "units")

    ranges = stored(units.groupBy("source", "r").agg(F.sum("n_tokens").alias("t")), "ranges")
    totals = ranges.groupBy("source").agg(F.sum("t").alias("total"))
    if weights is None:
        share = F.when(F.col("total") > 0, F.pow(F.col("total").cast("double"), F.lit(temperature))).otherwise(0.0)
        totals = totals.withColumn("w", share)
    else:
        given = spark.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "source string, w double")
        totals = totals.join(given, "source").where("w > 0")
    whole = totals.agg(F.sum("w").alias("all_w"), F.sum("total").alias("all_t"))
    every = F.lit(budget).cast("long") if budget is not None else F.col("every")
    spend = ranges.agg(F.sum("t").alias("every"))
    plan = totals.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(spend))
    plan = plan.select("source", "total", F.floor(every * F.try_divide(F.col("w"), F.col("all_w"))).alias("target"))
    epochs = F.when(F.col("total") > 0, F.expr("target div total")).otherwise(0)
    plan = plan.select("source", epochs.alias("epochs"), (F.coalesce("target", F.lit(0)) - epochs * F.col("total")).alias("rest"))

    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = ranges.withColumn("before", before).join(plan, "source")
    cut = cut.select("source", "r", "epochs", "rest", "before", F.when(F.col("before") + F.col("t") <= F.col("rest"), "all").when(F.col("before") <= F.col("rest"), "some").otherwise("none").alias("take"))
    rows = units.join(stored(cut, "cuts"), ["source", "r"])
    whole_rows = rows.where("take <> 'some'").select("doc_id", "source", "n_tokens", (F.col("epochs") + (F.col("take") == "all").cast("long")).alias("copies"))
    running = F.sum("n_tokens").over(Window.partitionBy("source", "r").orderBy("k", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    some = rows.where("take = 'some'").withColumn("upto", F.col("before") + running)
    some_rows = some.select("doc_id", "source", "n_tokens", (F.col("epochs") + (F.col("upto") <= F.col("rest")).cast("long")).alias("copies"))
    return whole_rows.unionAll(some_rows).where("copies > 0")


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from (doc_id, quality): GOOD or BAD. A null id or quality is no label; of several the largest counts."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return known.select("doc_id", F.when(F.col("q") > 0, GOOD).otherwise(BAD).alias("weight"))


def mixed(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, each as often as `mix_sources` takes it, with all their columns; rows with a null id go, and rows that repeat an id are taken as one document, each as often."""
    taken = mix_sources(docs, id_col=id_col, **how).select("doc_id", F.col("copies").cast("int").alias("copies"))
    # the columns have other names meanwhile, as theirs may be any
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    found = rows.join(taken, F.col(f"c{docs.columns.index(id_col)}") == F.col("doc_id"))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*rows.columns).toDF(*docs.columns)


SQL = f"""
WITH q AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
u AS (
  SELECT doc_id, min(coalesce(source, '')) AS source, sum(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0))::BIGINT AS n_tokens
  FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id
), k AS (
  SELECT doc_id, source, n_tokens,
    -ln((('0x' || substr(md5('0:' || doc_id), 1, 13))::BIGINT + 0.5) / {1 << 52}) / CASE WHEN q > 0 THEN {GOOD} WHEN q IS NOT NULL THEN {BAD} ELSE {UNKNOWN} END AS k
  FROM u LEFT JOIN q USING (doc_id)
), t AS (SELECT source, sum(n_tokens) AS total FROM k GROUP BY source),
w AS (SELECT source, total, floor((sum(total) OVER ()) * (CASE WHEN total > 0 THEN pow(total, {TEMPERATURE}) ELSE 0 END) / sum(CASE WHEN total > 0 THEN pow(total, {TEMPERATURE}) ELSE 0 END) OVER ())::BIGINT AS target FROM t),
p AS (SELECT source, CASE WHEN total > 0 THEN (target // total)::BIGINT ELSE 0 END AS epochs, total, target FROM w),
s AS (
  SELECT doc_id, k.source, n_tokens, epochs, target - epochs * total AS rest,
    sum(n_tokens) OVER (PARTITION BY k.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN p USING (source)
)
SELECT doc_id, source, n_tokens, (epochs + (upto <= rest)::BIGINT)::BIGINT AS copies FROM s WHERE epochs + (upto <= rest)::BIGINT > 0
"""
