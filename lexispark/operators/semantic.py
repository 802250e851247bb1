"""Row-wise semantic functions and their Arrow functions.

A function's Column is nondeterministic for the optimizer, so that two uses of it are one evaluation; cheap
predicates and top-k selection belong in steps before it (see Session.semantic_filter).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.operators import batching
from lexispark.operators.client import ModelClient
from lexispark.operators.service import Handle
from lexispark.plans.spec import CallSpec

#: Batches that a task gathers before it sends them together.
ROUND = 64
NULL_TEXT = "NULL"


def text_of(c: Column | str) -> Column:
    """A value as the text that a model reads; null is the text NULL, nested values are JSON. The kind is known once the
    plan is analysed, and only one of the two ways is left in it."""
    own = F.col(c) if isinstance(c, str) else c
    listed = F.to_json(F.array(own))
    inner = F.when(own.isNotNull(), F.substr(listed, F.lit(2), F.length(listed) - 2))
    return F.coalesce(F.when(F.typeof(own).rlike("^(array|map|struct)<"), inner).otherwise(own.cast("string")), F.lit(NULL_TEXT))


def text_sql(expression: str) -> str:
    """text_of() of an SQL expression."""
    listed = f"to_json(array({expression}))"
    inner = f"case when ({expression}) is not null then substr({listed}, 2, length({listed}) - 2) end"
    return f"coalesce(case when rlike(typeof({expression}), '^(array|map|struct)<') then {inner} else cast(({expression}) as string) end, '{NULL_TEXT}')"


def packed(columns: list[Column]) -> Column:
    return F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])


def dumped(answer: Any) -> str:
    """A string as it is, anything else as compact JSON; a null is the text null."""
    return answer if isinstance(answer, str) else json.dumps(answer, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def truth(answer: Any) -> bool:
    """A filter's answer; a missing one lets the row pass."""
    if answer is None:
        return True
    if isinstance(answer, str):
        return answer.strip().lower() != "false"
    return bool(answer)


def answered(client: ModelClient, rows: list[tuple]) -> list[Any]:
    """One answer a row, in batches, one after the other or in rounds."""
    spec = client.spec
    if spec.model.is_async:
        # In a round the limit is asked for once, before it: what is in flight returns.
        return batching.in_rounds(len(rows), spec.model.batch, lambda a, b: client.ask(rows[a:b], checked=False), client.exceeded)
    return batching.in_turn(len(rows), spec.model.batch, lambda a, b: client.ask(rows[a:b]))


def embedded(client: ModelClient, rows: list[tuple]) -> list[Any]:
    """Each row's values, every one followed by a space, as an embedding; overflowing batches are halved."""
    columns = client.columns(rows)  # audio is transcribed
    texts = ["".join(f"{v} " for v in row) for row in zip(*(c["data"] for c in columns), strict=True)]
    return batching.in_turn(len(rows), client.spec.model.batch, lambda a, b: client.embed(texts[a:b]))


def mapped(spec: CallSpec, handle: Handle, work: Callable[[ModelClient, list[tuple]], list[Any]], finish: Callable[[Any], Any], kind: T.DataType):
    """An iterator function over structs: rows are gathered across Arrow batches, so that only a partition's
    last model batch is short."""
    size = spec.model.batch * ROUND

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        with ModelClient(spec, handle) as client:
            waiting: list[tuple] = []
            for frame in frames:
                waiting += list(frame.itertuples(index=False, name=None))
                whole = len(waiting) // size * size
                if whole:
                    for i in range(0, whole, size):
                        yield pd.Series([finish(a) for a in work(client, waiting[i : i + size])], dtype=object)
                    waiting = waiting[whole:]
            if waiting:
                yield pd.Series([finish(a) for a in work(client, waiting)], dtype=object)

    return F.pandas_udf(run, kind).asNondeterministic()


def function_of(spec: CallSpec, handle: Handle):
    """The Arrow function of a row-wise call, over one struct of texts."""
    if spec.function == "embedding":
        return mapped(spec, handle, embedded, lambda a: a, T.ArrayType(T.DoubleType()))
    if spec.function == "filter":
        return mapped(spec, handle, answered, truth, T.BooleanType())
    return mapped(spec, handle, answered, dumped, T.StringType())


def bare(spec: CallSpec, handle: Handle) -> Any:
    """One answer to the prompt alone, asked for on the driver."""
    with ModelClient(spec, handle) as client:
        return client.ask_bare()
