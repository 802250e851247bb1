"""Hybrid search around the semantic functions: similarity, ranks, normalised scores, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of equal length; null if either is null or zero."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    return F.try_divide(dot, norm(a) * norm(b))


def min_max(df: DataFrame, *columns: str, suffix: str = "_norm", scope: list[str] | None = None) -> DataFrame:
    """df with each column scaled to 0..1 over all rows, or over those that agree in scope. The bounds come from
    one combined aggregation; a column without spread scales to null."""
    bounds = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    summary = df.groupBy(*scope).agg(*bounds) if scope else df.agg(*bounds)
    out = df.join(summary, scope) if scope else df.join(F.broadcast(summary))
    for c in columns:
        lo, hi = F.col(f"_lo_{c}").cast("double"), F.col(f"_hi_{c}").cast("double")
        out = out.withColumn(c + suffix, F.try_divide(F.col(c).cast("double") - lo, hi - lo)).drop(f"_lo_{c}", f"_hi_{c}")
    return out


def ranked(df: DataFrame, score: str, name: str, scope: list[str] | None = None) -> DataFrame:
    """df with the dense rank of a score, the highest first.

    Ranks over all rows come from the distinct scores, which are numbered within range partitions and
    offset by the partitions' counts, so no task sees all rows.
    """
    if scope:
        return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*scope).orderBy(F.desc_nulls_last(score))))
    distinct = df.select(F.col(score).alias("_s")).distinct().repartitionByRange(F.desc_nulls_last("_s")).withColumn("_p", F.spark_partition_id())
    distinct = distinct.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(F.desc_nulls_last("_s"))))
    sizes = distinct.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranks = distinct.join(F.broadcast(before), "_p").select("_s", (F.col("_r") + F.col("_before")).cast("int").alias(name))
    return df.join(ranks, df[score].eqNullSafe(ranks["_s"])).drop("_s")


def top_k(df: DataFrame, k: int, score: str, *ties: str) -> DataFrame:
    """The k rows with the highest scores, ties by further columns: one bounded selection a partition."""
    return df.orderBy(F.desc_nulls_last(score), *ties).limit(k)


def similar_pairs(df: DataFrame, id_col: str, vector_col: str, least: float) -> DataFrame:
    """(left, right, similarity) of the rows whose similarity reaches least, left < right. Compares all pairs: for the
    bounded tables of a query; the training-data operators have an index for whole corpora."""
    a = df.select(F.col(id_col).alias("left"), F.col(vector_col).alias("_a"))
    b = df.select(F.col(id_col).alias("right"), F.col(vector_col).alias("_b"))
    pairs = a.join(b, F.col("left") < F.col("right")).withColumn("similarity", cosine_similarity("_a", "_b"))
    return pairs.where(F.col("similarity") >= least).select("left", "right", "similarity")
