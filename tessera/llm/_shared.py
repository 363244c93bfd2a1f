"""Places on the cluster's shared storage, and tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import delete, new_path, shared_dir, spread, stored

__all__ = ["HOT", "buckets", "connected", "delete", "joined", "letters", "new_path", "shared_dir", "spread", "stored"]
#: Rows of one key beyond which a join splits them; of N rows at most N / HOT keys are that hot, which is what is broadcast.
HOT = 1_000_000


def letters(text: Column) -> Column:
    """The text in lower case, with a space for what isn't ASCII and neither a letter, a digit nor a mark, as curly quotes and dashes."""
    return F.regexp_replace(F.lower(text), r"[^\x00-\x7F\p{L}\p{N}\p{M}]+", " ")


def joined(rows: DataFrame, unique: DataFrame, keys: list[str], count: str, by: str, how: str = "inner", hot: int = HOT) -> DataFrame:
    """rows joined with `unique`, which has each of the keys once and in its column `count` how many rows have them; that column goes.

    Keys of more than `hot` rows are split into parts by the hash of the rows' column `by`, and their row of `unique` is repeated for each part, so that no task gets all rows of one key.
    """
    parts = F.ceil(F.col(count) / hot).cast("int")
    many = unique.where(F.col(count) > hot).select(*keys, parts.alias("__parts"))
    salted = rows.join(F.broadcast(many), keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    repeated = unique.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(count)
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")


def buckets(spark: SparkSession) -> int:
    """As many buckets as the session's shuffles have partitions: the one setting that a job sizes to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of the edges (a, b), root the least id of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014); each pair of steps is stored. Null ends and loops are dropped.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v and a is not null and b is not null").distinct()
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    now, path = kept(now)
    before = None
    while True:
        # a node of many neighbours is the center of a star: its edges are split over tasks
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = joined(both, least, ["u"], "n", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        (now, path), old = kept(small.where("u <> v").distinct()), path
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        delete(spark, old)
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = state
