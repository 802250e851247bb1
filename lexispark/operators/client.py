"""One task's access to a model: limits, the request, and its metrics."""

from __future__ import annotations

import time
from typing import Any

from lexispark.functions import render
from lexispark.operators.service import Handle
from lexispark.plans.spec import CallSpec, ModelSpec
from lexispark.sources.providers import Request, make_provider


class ModelClient:
    def __init__(self, spec: CallSpec, handle: Handle):
        from pyspark import TaskContext

        self.spec, self.service = spec, handle.connect()
        task = TaskContext.get()
        self.task = f"stage {task.stageId()} partition {task.partitionId()} attempt {task.attemptNumber()}" if task else "driver"
        self.providers: dict[ModelSpec, Any] = {}

    def __enter__(self) -> ModelClient:
        self.began = time.monotonic()
        return self

    def __exit__(self, *_: Any) -> None:
        self._record(0, 0, execution_time_ms=(time.monotonic() - self.began) * 1000)
        self.service.close()

    def provider(self, model: ModelSpec) -> Any:
        if model not in self.providers:
            secret = self.service.ask("secret", model.secret)
            self.providers[model] = make_provider(model.provider, model.model, model.settings, secret)
        return self.providers[model]

    def _record(self, prompt: int, completion: int, **counts: float) -> None:
        model = self.spec.model
        record = {"call": self.spec.call, "task": self.task, "function": self.spec.function_name, "model": model.name, "provider": model.provider, "input_tokens": prompt, "output_tokens": completion, **counts}
        self.service.ask("used", model.name, prompt, completion, record)

    def exceeded(self) -> bool:
        limits = dict(self.spec.model.usage_limit)
        return bool(limits) and self.service.ask("exceeded", self.spec.model.name, limits) is not None

    def _sent(self, send, checked: bool = True) -> Any:
        model = self.spec.model
        self.service.start(model.name, model.rate_limit, dict(model.usage_limit) if checked else {})
        began = time.monotonic()
        answer, usage = send()
        seconds = usage.seconds or time.monotonic() - began
        self._record(usage.prompt_tokens, usage.completion_tokens, api_calls=1, api_duration_ms=seconds * 1000)
        return answer

    def columns(self, rows: list[tuple]) -> list[dict[str, Any]]:
        """The context columns over some rows, audio transcribed into tabular columns after the others."""
        cells = list(zip(*rows, strict=True)) if rows else [()] * len(self.spec.columns)
        columns = [c.over(list(data)) for c, data in zip(self.spec.columns, cells, strict=True)]
        tabular, images, audio = render.split_media(columns)
        for c, own in zip(self.spec.columns, columns, strict=True):
            if own in audio:
                texts = self.provider(c.transcriber).transcribe([None if x in (None, "NULL") else x for x in own["data"]])
                tabular.append({"name": render.transcription_name(c.name), "data": texts})
        return tabular + images

    def ask(self, rows: list[tuple], n: int | None = None, ids: list[int] | None = None, previous: str | None = None, checked: bool = True) -> list[Any]:
        """The model's answers about rows; ids: shown as the column row_id; n: answers asked for (default: one a row)."""
        spec = self.spec
        tabular, images, _ = render.split_media(self.columns(rows))
        if ids is not None:
            tabular = [*tabular, {"name": "row_id", "data": [str(i) for i in ids]}]
        n = len(rows) if n is None else n
        prompt = render.render(spec.task, tabular, spec.model.format, spec.function, spec.output, n)
        if spec.function == "reduce":
            prompt = render.with_summary(prompt, previous)
        for c in images:
            c["data"] = [None if x == "NULL" else x for x in c["data"]]
        request = Request(prompt, spec.output, n, spec.function, tabular, images, previous)
        return self._sent(lambda: self.provider(spec.model).complete(request), checked)

    def ask_bare(self) -> Any:
        """One answer to the prompt alone."""
        request = Request(self.spec.task, self.spec.output, 1, self.spec.function)
        answers = self._sent(lambda: self.provider(self.spec.model).complete(request))
        return answers[0] if answers else None

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._sent(lambda: self.provider(self.spec.model).embed(texts))
