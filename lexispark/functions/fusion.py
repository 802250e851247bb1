"""Rank and score fusion for hybrid search, as plain Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The constant of reciprocal rank fusion.
RRF_K = 60


def _columns(columns: tuple) -> list[Column]:
    if not columns:
        raise ValueError("a fusion needs at least one column")
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def _score(c: Column) -> Column:
    """A score as a double; null and NaN count as 0."""
    return F.nanvl(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def fusion_rrf(*ranks: Column | str, scope: list[Column | str] | None = None) -> Column:
    """The sum of 1 / (60 + rank) over the rank columns; a null rank counts as 0.

    A column that ranks nothing within the scope (no rank above 1) is left out, unless the scope is a single
    row ranked 1. The scope is all rows, or those that agree in the scope columns (one query's, say), which
    also lets the maxima be computed in parallel.
    """
    window = Window.partitionBy(*(scope or [F.lit(0)]))
    alone = F.count(F.lit(1)).over(window) == 1
    terms = []
    for c in _columns(ranks):
        rank = F.coalesce(c.cast("int"), F.lit(0))
        counts = (F.max(rank).over(window) > 1) | (alone & (rank == 1))
        terms.append(F.when(counts, 1.0 / (RRF_K + rank)).otherwise(0.0))
    return _sum(terms)


def fuse_ranks(df: DataFrame, *ranks: str, name: str = "score") -> DataFrame:
    """df with fusion_rrf over the whole of it: the columns' maxima come from one combined aggregation of a
    single row, which is broadcast, so nothing is gathered in one place."""
    own = [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ranks]
    summary = df.agg(F.count("*").alias("_rows"), *[F.max(r).alias(f"_most{i}") for i, r in enumerate(own)])
    terms = [F.when((F.col(f"_most{i}") > 1) | ((F.col("_rows") == 1) & (r == 1)), 1.0 / (RRF_K + r)).otherwise(0.0) for i, r in enumerate(own)]
    return df.join(F.broadcast(summary)).withColumn(name, _sum(terms)).drop("_rows", *[f"_most{i}" for i in range(len(own))])


def fusion_combsum(*scores: Column | str) -> Column:
    """The sum of the scores."""
    return _sum([_score(c) for c in _columns(scores)])


def fusion_combmnz(*scores: Column | str) -> Column:
    """The sum times the number of scores that are not 0."""
    own = [_score(c) for c in _columns(scores)]
    return _sum(own) * _sum([F.when(s != 0, 1.0).otherwise(0.0) for s in own])


def fusion_combmed(*scores: Column | str) -> Column:
    """The median of all scores, zeros included."""
    own = [_score(c) for c in _columns(scores)]
    n, ordered = len(own), F.array_sort(F.array(*own))
    if n % 2:
        return ordered[n // 2]
    return (ordered[n // 2 - 1] + ordered[n // 2]) / 2.0


def fusion_combanz(*scores: Column | str) -> Column:
    """The mean of all scores, zeros included."""
    return fusion_combsum(*scores) / float(len(scores))
