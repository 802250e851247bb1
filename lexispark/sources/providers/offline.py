"""A provider without a model: answers are fixed functions of a row's text, which SQL can compute too.

A row's text is its values joined by |; an image's value is the word image and its source. The rule comes from the model parameters: {"rule": ...}. Faults and
usage are injected the same way: overflow_above (rows a request), short_by (answers left out), fail (a message
that is raised), tokens ([prompt, completion] a request).
"""

from __future__ import annotations

import hashlib
from typing import Any

from lexispark.sources.providers.base import Provider, Request, Usage, raise_if_overflow

DIMENSIONS = 8


def row_texts(columns: list[dict[str, Any]], images: list[dict[str, Any]] = ()) -> list[str]:
    own = [c["data"] for c in columns if c.get("name") != "row_id"]
    own += [["" if v is None else f"image {v}" for v in c["data"]] for c in images]
    return ["|".join("" if v is None else str(v) for v in row) for row in zip(*own, strict=True)]


def md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def embedding(text: str) -> list[float]:
    return [b / 255.0 for b in hashlib.md5(text.encode()).digest()[:DIMENSIONS]]


class Offline(Provider):
    name = "offline"

    def complete(self, request: Request) -> tuple[list[Any], Usage]:
        p = self.parameters
        texts = row_texts(request.columns, request.images) if request.columns or request.images else []
        if "fail" in p:
            raise_if_overflow(str(p["fail"]))
            raise RuntimeError(str(p["fail"]))
        if len(texts) > int(p.get("overflow_above", 1 << 60)):
            raise_if_overflow("the prompt is longer than the context window")
        tokens = p.get("tokens") or [len(request.prompt.split()), request.n]
        answers = self._answers(request, texts)
        keep = len(answers) - int(p.get("short_by", 0))
        return answers[: max(0, keep)], Usage(int(tokens[0]), int(tokens[1]))

    def _answers(self, request: Request, texts: list[str]) -> list[Any]:
        rule = str(self.parameters.get("rule", "md5"))
        if rule == "bad id" and request.function != "reduce":
            return [99] * request.n
        if request.function == "reduce":
            return [self._reduced(rule, texts, request.previous)]
        if request.function in ("first", "last", "rerank"):
            ids = next(c["data"] for c in request.columns if c.get("name") == "row_id")
            ranked = [i for _, i in sorted((md5(t), int(i)) for t, i in zip(texts, ids, strict=True))]
            return ranked if request.function == "rerank" else [ranked[0 if request.function == "first" else -1]]
        if not (request.columns or request.images):
            texts = [request.prompt] * request.n
        if rule == "prompt":  # what a model would read
            return [request.prompt] * request.n
        return [self._one(rule, request, t) for t in texts]

    def _one(self, rule: str, request: Request, text: str) -> Any:
        if request.function == "filter" or request.output == "boolean":
            if rule.startswith("contains:"):
                return rule.removeprefix("contains:") in text
            return None if rule == "null" else md5(text)[0] < "8"
        first = text.split("|")[0] if request.columns else text
        if request.output == "object" or rule == "object":
            return {"digest": md5(text), "length": len(first)}
        return {"echo": first, "upper": first.upper(), "len": len(first), "null": None}.get(rule, md5(text))

    @staticmethod
    def _reduced(rule: str, texts: list[str], previous: str | None) -> str:
        if rule == "count":
            return str(len(texts) + int(previous or 0))
        if rule == "max":
            return max([*texts, *([previous] if previous is not None else [])])
        if rule == "concat":
            return ",".join([*([previous] if previous is not None else []), *texts])
        if rule == "sorted_concat":
            return ",".join(sorted([*texts, *(previous.split(",") if previous else [])]))
        return min([*map(md5, texts), *([previous] if previous is not None else [])])

    def embed(self, texts: list[str]) -> tuple[list[list[float]], Usage]:
        return [embedding(t) for t in texts], Usage(sum(len(t.split()) for t in texts), 0)

    def transcribe(self, sources: list[str | None]) -> list[str | None]:
        return [None if s is None else f"transcript of {s}" for s in sources]
