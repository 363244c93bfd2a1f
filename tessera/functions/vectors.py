"""Vectors as arrays of doubles, in expressions of Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 64


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, of_zero: float = 1.0) -> Column:
    """Chunks hold a zero vector for equal to any (1.0), clusters for unlike any (0.0)."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.try_divide(dot(a, b), n)).otherwise(F.lit(of_zero))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def hashed_embedding(text: Column, dim: int = DIM) -> Column:
    """T5's default: counts of the lower-case words by the md5 of each, at unit length; zeros for a text without words."""
    words = F.filter(F.split(F.lower(text), r"[\s\x{0B}\x{85}\x{1C}-\x{1F}\p{Z}]+"), lambda w: w != "")
    at = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long") % dim).cast("int"))
    each = F.array(*(F.lit(i) for i in range(dim)))
    # bound as a variable, else the words are hashed anew for each component; array_remove counts without a lambda
    counts = F.element_at(F.transform(F.array(at), lambda a: F.transform(each, lambda i: (F.size(a) - F.size(F.array_remove(a, i))).cast("double"))), 1)
    return unit(counts)


def unit(v: Column) -> Column:
    # vector and norm are variables, each computed once
    scaled = lambda v, n: F.transform(v, lambda x: F.when(n > 0, F.try_divide(x, n)).otherwise(x))
    return F.element_at(F.transform(F.array(v), lambda v: F.element_at(F.transform(F.array(norm(v)), lambda n: scaled(v, n)), 1)), 1)


def hashed_embedding_sql(t: str, dim: int = DIM) -> str:
    """A LIST of doubles in DuckDB."""
    words = f"regexp_extract_all(lower({t}), '[^\\s\\x{{0B}}\\x{{85}}\\x{{1C}}-\\x{{1F}}\\p{{Z}}]+')"
    at = f"list_transform({words}, lambda w: (concat('0x', substr(md5(w), 1, 6))::INT) % {dim})"
    counts = f"list_transform([{at}], lambda a: list_transform(range({dim}), lambda i: len(list_filter(a, lambda x: x = i))::DOUBLE))[1]"
    n = "sqrt(list_sum(list_transform(c, lambda y: y * y)))"
    return f"list_transform([{counts}], lambda c: list_transform(c, lambda x: CASE WHEN {n} > 0 THEN x / {n} ELSE x END))[1]"
