"""Group-wise semantic functions: rows are gathered by collect_list in a given order, then asked about in windows.

They mix with other aggregates, partial and final aggregation is Spark's, and an empty group gives a null. As they hold a
group as a whole, reductions of large groups are streamed(), a frame of its own, instead.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexispark.operators import batching
from lexispark.operators.client import ModelClient
from lexispark.operators.semantic import dumped, packed
from lexispark.operators.service import Handle
from lexispark.plans.spec import CallSpec


def column_json(client: ModelClient, rows: list[tuple]) -> str:
    """Rows as compact column JSON, keys in alphabetical order."""
    columns = [c.over(list(data)) for c, data in zip(client.spec.columns, zip(*rows, strict=True), strict=True)]
    return json.dumps(columns, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def reduced(client: ModelClient, rows: Iterable[tuple]) -> str:
    """A left fold over batches, asked for even about a single row."""

    def ask(batch: list[tuple], summary: str | None) -> str | None:
        answers = client.ask(batch, n=1, previous=summary)
        return None if not answers or answers[0] is None else dumped(answers[0])

    return dumped(batching.fold(rows, client.spec.model.batch, ask))


def chosen(client: ModelClient, rows: list[tuple]) -> str:
    """The row that wins the tournament; a single row wins unasked."""

    def ask(window: list[int]) -> Any:
        answers = client.ask([rows[i] for i in window], n=1, ids=window)
        return answers[0] if answers else None

    return column_json(client, [rows[batching.tournament(len(rows), client.spec.model.batch, ask)]])


def reranked(client: ModelClient, rows: list[tuple]) -> str:
    """All rows, in the order of relevance; a single row is given back unasked."""
    ask = lambda window: client.ask([rows[i] for i in window], ids=window)
    options = client.spec.options
    order = batching.rerank(len(rows), client.spec.model.batch, ask, options.get("order", "relevance"), options.get("passes", 1))
    return column_json(client, [rows[i] for i in order])


def function_of(spec: CallSpec, handle: Handle, work: Callable[[ModelClient, list[tuple]], str], width: int):
    """The Arrow function of a group-wise call, over the sorted array of a group's rows (structs of width texts)."""
    names = [f"c{i}" for i in range(width)]
    most = spec.options.get("max_rows_per_group")

    def run(groups: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with ModelClient(spec, handle) as client:
            for series in groups:
                out = []
                for rows in series:
                    if rows is None or not len(rows):
                        out.append(None)
                        continue
                    if most and len(rows) > most:
                        raise ValueError(f"a group has {len(rows)} rows, more than max_rows_per_group={most}")
                    out.append(work(client, [tuple(r["row"][n] for n in names) for r in rows]))
                yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, T.StringType()).asNondeterministic()


def gathered(spec: CallSpec, handle: Handle, work: Callable[[ModelClient, list[tuple]], str], columns: list[Column], order_by: list[Column]) -> Column:
    """work over a group's rows, ordered by order_by and then by the columns themselves."""
    row = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order_by)], packed(columns).alias("row"))
    return function_of(spec, handle, work, len(columns))(F.array_sort(F.collect_list(row))).alias(spec.function_name)


def rows_of(batches: Iterable[pa.RecordBatch], names: list[str], size: int) -> Iterator[tuple]:
    """The rows of some columns, so many made at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield from zip(*[part.column(n).to_pylist() for n in names], strict=True)


def streamed(df: DataFrame, keys: list[str], spec: CallSpec, handle: Handle, columns: list[Column], order_by: list[Column], name: str) -> DataFrame:
    """The keys and each group's reduction, over its rows in the order of gathered(). A group is one task's work, as its
    requests are one chain, but its rows are sorted by Spark, which spills, and pass the task in Arrow batches. Groups are
    dealt to a fixed number of partitions, as Spark would put small ones into one task, where their requests wait."""
    groups, own = [f"g{i}" for i in range(len(keys))], [f"c{i}" for i in range(len(columns))]
    order = [f"k{i}" for i in range(len(order_by))]
    fields = df.select(*[F.col(k) for k in keys]).schema.fields
    kinds = [to_arrow_type(f.dataType) for f in fields]  # not the kinds that come, which have the session's time zone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)
        key = first.slice(0, 1)
        with ModelClient(spec, handle) as client:
            answer = reduced(client, rows_of(chain([first], batches), own, spec.model.batch))
        yield pa.RecordBatch.from_arrays([*[key.column(g).cast(t) for g, t in zip(groups, kinds, strict=True)], pa.array([answer], pa.string())], names=[*groups, "answer"])

    rows = df.select(*[F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)], *[c.alias(k) for c, k in zip(order_by, order, strict=True)], *[c.alias(n) for c, n in zip(columns, own, strict=True)])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.repartition(n, *groups) if groups else rows.repartition(1)).sortWithinPartitions(*groups, *order, *own)
    kind = T.StructType([*[T.StructField(g, f.dataType) for g, f in zip(groups, fields, strict=True)], T.StructField("answer", T.StringType())])
    out = dealt.groupBy(*groups).applyInArrow(run, kind)
    if not groups:  # no rows are one group too
        out = out.agg(F.max("answer").alias("answer"))
    return out.select(*[F.col(g).alias(f.name) for g, f in zip(groups, fields, strict=True)], F.col("answer").alias(name))


def joined(keys: list[str], *frames: DataFrame) -> DataFrame:
    """Frames that have one row a group, side by side; a null key is a group like any other. They are not joined, as a
    broadcast would not wait for a model's answers."""
    own = {c.lower() for c in frames[0].select(*keys).columns}
    values = [c for frame in frames for c in frame.columns if c.lower() not in own]
    if len({c.lower() for c in values}) < len(values):
        raise ValueError(f"the names of what stands side by side must differ: {', '.join(values)}")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.groupBy(*keys).agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in values])


WORK = {"reduce": reduced, "first": chosen, "last": chosen, "rerank": reranked}
