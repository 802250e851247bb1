"""The entry point: semantic functions, statements, limits and metrics over one SparkSession."""

from __future__ import annotations

import itertools
import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.fusion import RRF_K
from lexispark.operators import aggregates, semantic
from lexispark.operators.service import WINDOW, Service
from lexispark.plans import rewrite, statements
from lexispark.plans.catalog import Catalog
from lexispark.plans.spec import CallSpec, SpecError, resolve_columns, resolve_model, resolve_prompt
from lexispark.sources.providers import default_secret, provider_key

Struct = dict[str, Any]
#: Model parameters, given or stored, that hold a schema for the answers.
SCHEMAS = ("response_format", "format", "output_format")
SECRET_TYPES = {"openai": "openai", "azure_llm": "azure", "azure": "azure", "ollama": "ollama", "anthropic": "anthropic"}


class Secrets:
    """Named settings of providers, on the driver alone."""

    def __init__(self, service: Service):
        self.held = service.secrets

    def create(self, kind: str, settings: dict[str, str], name: str | None = None) -> None:
        if kind not in SECRET_TYPES:
            raise ValueError(f"secret type {kind!r} is none of {', '.join(SECRET_TYPES)}")
        self.held[name or default_secret(SECRET_TYPES[kind])] = dict(settings)

    def drop(self, name: str) -> None:
        self.held.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self.held)


class Session:
    def __init__(self, spark: SparkSession, storage: str | Path | None = None, rate_window: float = WINDOW):
        """storage: the folder of the global catalog (None: it lives with the session)."""
        self.spark = spark
        self.service = Service(spark.conf.get("spark.driver.host", "127.0.0.1"), rate_window, spark.conf.get("spark.driver.bindAddress", None))
        self.catalog, self.secrets = Catalog(storage), Secrets(self.service)
        self.calls = itertools.count(1)

    def close(self) -> None:
        self.service.close()

    # statements

    def sql(self, text: str) -> DataFrame:
        """A MODEL, PROMPT or SECRET statement, or anything else as Spark SQL, in which the semantic functions, the fusions
        and the metrics may be called with struct literals: llm_filter({'model_name': 'm'}, {'prompt': 'Is it so?',
        'context_columns': [{'data': title}]}). llm_reduce, llm_first, llm_last and llm_rerank take a third struct of options,
        {'order_by': ts, 'passes': 0}; fusion_rrf, as Columns do, looks at all rows of its SELECT."""
        if statements.is_own(text):
            return statements.execute(statements.parse(text), self.catalog, self.spark, self.secrets)
        return self.spark.sql(rewrite.rewrite(text, self._in_sql))

    def _in_sql(self, name: str, values: list[Any], texts: list[str]) -> str:
        """The SQL that takes the place of a call."""
        if name in rewrite.METRICS:
            return rewrite.literal(getattr(self, name)())
        if name.startswith("fusion_"):
            return _fusion_sql(name.removeprefix("fusion_"), texts)
        if len(values) not in ((2, 3) if name.removeprefix("llm_") in rewrite.AGGREGATES else (2,)) or not all(isinstance(v, dict) for v in values):
            raise SpecError(f"{name} takes a model struct and a prompt struct")
        model, prompt, options = values[0], dict(values[1]), dict(values[2]) if len(values) == 3 else {}
        function = name.removeprefix("llm_")
        if function == "embedding" and set(prompt) != {"context_columns"}:
            raise SpecError("llm_embedding takes `context_columns` and nothing else")
        expressions = []
        for c in prompt.get("context_columns") or []:
            data = c.get("data") if isinstance(c, dict) else None
            expressions.append(data if isinstance(data, rewrite.Expression) else "NULL" if data is None else rewrite.literal(data) if isinstance(data, str) else str(data))
        if function in rewrite.SCALARS and prompt.get("context_columns") is None:
            spec, _ = self._spec(function, "boolean" if function == "filter" else "string", model, prompt, function == "embedding" or None)
            answer = semantic.bare(spec, self.service.handle)
            return str(semantic.truth(answer)).lower() if function == "filter" else rewrite.literal(semantic.dumped(answer))
        prompt["context_columns"] = [c | {"data": F.lit("")} if isinstance(c, dict) else c for c in prompt["context_columns"]]
        order_by = options.pop("order_by", None)
        output = {"filter": "boolean", "first": "integer", "last": "integer", "rerank": "integer"}.get(function, "string")
        spec, _ = self._spec(function, output, model, prompt, True, **options)
        if function == "embedding" and any((c.type or "").split("/")[0] == "image" for c in spec.columns):
            raise SpecError("llm_embedding takes no images")
        own = f"lexispark_call_{spec.call.rsplit('#', 1)[-1]}_{id(self)}"
        fields = ", ".join(f"'c{i}', {semantic.text_sql(e)}" for i, e in enumerate(expressions))
        if function in rewrite.SCALARS:
            self.spark.udf.register(own, semantic.function_of(spec, self.service.handle))
            return f"{own}(named_struct({fields}))"
        self.spark.udf.register(own, aggregates.function_of(spec, self.service.handle, aggregates.WORK[function], len(expressions)))
        keys = [order_by] if order_by is not None and not isinstance(order_by, list) else order_by or []
        keyed = "".join(f"'k{i}', {k}, " for i, k in enumerate(keys))
        return f"{own}(array_sort(collect_list(named_struct({keyed}'row', named_struct({fields})))))"

    # calls

    def _spec(self, function: str, output: str, model: Struct, prompt: Struct | None, context: bool | None, **options: Any) -> tuple[CallSpec, list[Column]]:
        """context: whether context columns are required (True), or may be missing (None)."""
        prompt = dict(prompt or {})
        given = prompt.get("context_columns")
        if context and given is None:
            raise SpecError(f"llm_{function} needs `context_columns`")
        columns = () if given is None else resolve_columns(given, self.catalog)
        if given is not None and not columns:
            raise SpecError("`context_columns` must not be empty")
        task = "" if function == "embedding" else resolve_prompt(prompt, self.catalog)
        own = resolve_model(model, self.catalog)
        if function == "complete" and any(k in own.settings for k in SCHEMAS):
            output = "object"
        options = {k: v for k, v in options.items() if v is not None}
        call = f"llm_{function}#{next(self.calls)}"
        return CallSpec(function, output, own, task, columns, call, options), [semantic.text_of(c["data"]) for c in given or []]

    def llm_complete(self, model: Struct, prompt: Struct) -> Column:
        """An answer a row as text; without context columns, one answer for all rows, asked for now."""
        spec, columns = self._spec("complete", "string", model, prompt, None)
        if not columns:
            return F.lit(semantic.dumped(semantic.bare(spec, self.service.handle)))
        return semantic.function_of(spec, self.service.handle)(semantic.packed(columns))

    def llm_filter(self, model: Struct, prompt: Struct) -> Column:
        """Whether each row fits the prompt; a missing answer lets a row pass."""
        spec, columns = self._spec("filter", "boolean", model, prompt, None)
        if not columns:
            return F.lit(semantic.truth(semantic.bare(spec, self.service.handle)))
        return semantic.function_of(spec, self.service.handle)(semantic.packed(columns))

    def llm_embedding(self, model: Struct, columns: Struct) -> Column:
        """An array of doubles a row; the only key of columns is context_columns."""
        if set(columns) != {"context_columns"}:
            raise SpecError("llm_embedding takes `context_columns` and nothing else")
        spec, own = self._spec("embedding", "string", model, columns, True)
        if any((c.type or "").split("/")[0] == "image" for c in spec.columns):
            raise SpecError("llm_embedding takes no images")
        return semantic.function_of(spec, self.service.handle)(semantic.packed(own))

    def _aggregate(self, function: str, output: str, model: Struct, prompt: Struct, order_by: Any, **options: Any) -> Column:
        spec, columns = self._spec(function, output, model, prompt, True, **options)
        return aggregates.gathered(spec, self.service.handle, aggregates.WORK[function], columns, _listed(order_by))

    def llm_reduce(self, model: Struct, prompt: Struct, order_by: Any = None, max_rows_per_group: int | None = None) -> Column:
        """An aggregate: one answer over all rows of a group, folded batch by batch in the given order."""
        return self._aggregate("reduce", "string", model, prompt, order_by, max_rows_per_group=max_rows_per_group)

    def llm_first(self, model: Struct, prompt: Struct, order_by: Any = None, max_rows_per_group: int | None = None) -> Column:
        """An aggregate: the most relevant row of a group, as column JSON."""
        return self._aggregate("first", "integer", model, prompt, order_by, max_rows_per_group=max_rows_per_group)

    def llm_last(self, model: Struct, prompt: Struct, order_by: Any = None, max_rows_per_group: int | None = None) -> Column:
        """An aggregate: the least relevant row of a group, as column JSON."""
        return self._aggregate("last", "integer", model, prompt, order_by, max_rows_per_group=max_rows_per_group)

    def llm_rerank(self, model: Struct, prompt: Struct, order_by: Any = None, order: str = "relevance", max_rows_per_group: int | None = None, passes: int = 1) -> Column:
        """An aggregate: all rows of a group as column JSON, the most relevant first (order="window": in the
        order in which sliding windows settle them). Groups beyond one window: one pass puts the best half window first;
        passes=0 repeats it until nothing moves."""
        if order not in ("relevance", "window"):
            raise SpecError("order is relevance or window")
        return self._aggregate("rerank", "integer", model, prompt, order_by, order=order, max_rows_per_group=max_rows_per_group, passes=passes)

    def semantic_filter(self, df: DataFrame, model: Struct, prompt: Struct, cheap: Column | str | None = None) -> DataFrame:
        """df where cheap holds and the prompt fits: only rows that pass cheap are asked about."""
        if cheap is not None:
            df = df.where(cheap)
        return df.where(self.llm_filter(model, prompt))

    def reduce_groups(self, df: DataFrame, keys: list[str], model: Struct, prompt: Struct, name: str = "summary", spread: int = 1, order_by: Any = None) -> DataFrame:
        """llm_reduce by keys, for groups of any size: a group's rows pass its task in the given order and are never held
        as a whole. spread > 1 first reduces that many parts of each group side by side and then their summaries, for
        tasks where parts may be merged in any grouping: large groups spread over the cluster."""
        if spread == 1:
            spec, columns = self._spec("reduce", "string", model, prompt, True)
            return aggregates.streamed(df, keys, spec, self.service.handle, columns, _listed(order_by), name)
        columns = [c["data"] if isinstance(c["data"], Column) else F.col(c["data"]) for c in prompt["context_columns"]]
        dealt = df.withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(spread)))
        parts = self.reduce_groups(dealt, [*keys, "_part"], model, prompt, name, order_by=order_by)
        again = {k: v for k, v in prompt.items() if k != "context_columns"} | {"context_columns": [{"data": name}]}
        return self.reduce_groups(parts, keys, model, again, name)

    @staticmethod
    def join_groups(keys: list[str], *frames: DataFrame) -> DataFrame:
        """Side by side: results of reduce_groups, and of groupBy(*keys).agg(...), over the same rows."""
        return aggregates.joined(keys, *frames)

    # SQL access

    def register(self, name: str, function: str, model: Struct, prompt: Struct) -> None:
        """Makes complete, filter or embedding, with its model and prompt fixed, a function of Spark SQL over one struct
        of as many text fields as context_columns lists (their data is ignored)."""
        output = {"complete": "string", "filter": "boolean", "embedding": "string"}[function]
        spec, _ = self._spec(function, output, model, {k: v for k, v in prompt.items()}, True)
        self.spark.udf.register(name, semantic.function_of(spec, self.service.handle))

    # metrics

    def llm_get_metrics(self) -> str:
        return json.dumps(self.metrics(), sort_keys=True)

    def llm_get_debug_metrics(self) -> str:
        with self.service.lock:
            return json.dumps(self.service.metrics.nested(), sort_keys=True)

    def llm_reset_metrics(self) -> str:
        with self.service.lock:
            return self.service.metrics.reset()

    def metrics(self) -> dict[str, Any]:
        with self.service.lock:
            return self.service.metrics.flat()

    def metrics_df(self) -> DataFrame:
        schema = "call string, input_tokens long, output_tokens long, total_tokens long, api_calls long, api_duration_ms double, execution_time_ms double, model_name string, provider string"
        return self.spark.createDataFrame([(k, *v.values()) for k, v in self.metrics().items()], schema)


def _listed(order_by: Any) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in ([] if order_by is None else order_by if isinstance(order_by, (list, tuple)) else [order_by])]


def _fusion_sql(name: str, own: list[str]) -> str:
    """A fusion of SQL expressions, as functions/fusion.py defines it."""
    if not own:
        raise SpecError("a fusion needs at least one column")
    if name == "rrf":
        rank = lambda x: f"coalesce(cast({x} as int), 0)"
        counts = lambda x: f"max({rank(x)}) over () > 1 or (count(1) over () = 1 and {rank(x)} = 1)"
        return "(" + " + ".join(f"case when {counts(x)} then 1d / ({RRF_K} + {rank(x)}) else 0d end" for x in own) + ")"
    scores = [f"nanvl(coalesce(cast({x} as double), 0d), 0d)" for x in own]
    total, n = "(" + " + ".join(scores) + ")", len(own)
    if name == "combsum":
        return total
    if name == "combanz":
        return f"({total} / {n}d)"
    if name == "combmnz":
        return f"({total} * (" + " + ".join(f"if({s} <> 0, 1d, 0d)" for s in scores) + "))"
    ordered = "array_sort(array(" + ", ".join(scores) + "))"
    return f"({ordered}[{n // 2}])" if n % 2 else f"(({ordered}[{n // 2 - 1}] + {ordered}[{n // 2}]) / 2d)"


__all__ = ["Session", "Secrets", "default_secret", "provider_key"]
