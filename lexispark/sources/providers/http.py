"""Providers behind HTTP interfaces. Requests have timeouts and are repeated, with growing pauses, when the
service is busy or out of reach; certificates are checked."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
import uuid
from typing import Any

from lexispark.operators.batching import TokenOverflow
from lexispark.sources import media
from lexispark.sources.providers.base import Provider, Request, Usage, raise_if_overflow

TIMEOUT, TRIES, PAUSE = 120, 4, 0.5
BUSY = (408, 409, 429, 500, 502, 503, 504, 529)


def post(url: str, payload: dict[str, Any] | bytes, headers: dict[str, str]) -> tuple[dict[str, Any], float]:
    """(answer, seconds). An error that names the length of a prompt or answer is a TokenOverflow."""
    data = payload if isinstance(payload, bytes) else json.dumps(payload).encode()
    headers = {"Content-Type": "application/json"} | headers
    for attempt in range(TRIES):
        began = time.monotonic()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=TIMEOUT) as response:
                return json.loads(response.read()), time.monotonic() - began
        except urllib.error.HTTPError as e:
            text = e.read().decode("utf-8", "replace")
            raise_if_overflow(text)
            if e.code not in BUSY or attempt == TRIES - 1:
                raise RuntimeError(f"{url} answered {e.code}: {text[:500]}") from None
        except (urllib.error.URLError, TimeoutError) as e:
            if attempt == TRIES - 1:
                raise RuntimeError(f"{url} can't be reached: {e}") from None
        time.sleep(PAUSE * 2**attempt * (1 + random.random()))
    raise AssertionError


def items(answer: Any) -> list[Any]:
    """The list of answers in a structured completion."""
    if isinstance(answer, str):
        answer = json.loads(answer)
    found = answer.get("items") if isinstance(answer, dict) else answer
    if not isinstance(found, list):
        raise RuntimeError("the completion holds no list of items")
    return found


def item_list(item: dict[str, Any], n: int | None = None) -> dict[str, Any]:
    """The schema of an object whose items are n answers."""
    bounds = {} if n is None else {"minItems": n, "maxItems": n}
    return {"type": "object", "properties": {"items": {"type": "array", **bounds, "items": item}}, "required": ["items"], "additionalProperties": False}


def labelled(column: dict[str, Any]) -> list[tuple[str, str]]:
    """(label, image) of a column's images; a label names the row by its place among all rows of the request."""
    name = column.get("name") or "image"
    return [(f"{name} of row {i}", image) for i, image in enumerate(column["data"], 1) if image is not None]


class OpenAI(Provider):
    name = "openai"

    def url(self, what: str) -> str:
        return self.secret.get("base_url", "https://api.openai.com/v1").rstrip("/") + "/" + what

    def headers(self) -> dict[str, str]:
        return {"Authorization": f"Bearer {self.secret.get('api_key', '')}"}

    def parts(self, request: Request) -> list[dict[str, Any]]:
        out: list[dict[str, Any]] = [{"type": "text", "text": request.prompt}]
        for column in request.images:
            for label, image in labelled(column):
                url = image if media.is_url(image) else f"data:{media.mime(column.get('type'))};base64,{media.as_base64(image)}"
                out.append({"type": "text", "text": label})
                out.append({"type": "image_url", "image_url": {"url": url, "detail": column.get("detail") or "low"}})
        return out

    def payload(self, request: Request) -> dict[str, Any]:
        given = self.parameters.get("response_format")
        if given:
            schema = given.get("json_schema", given)
            item, strict = schema.get("schema", {"type": request.output}), bool(given.get("strict", schema.get("strict", False)))
        else:
            item, strict = {"type": request.output}, False
        form = {"type": "json_schema", "json_schema": {"name": "answers", "strict": strict, "schema": item_list(item, request.n)}}
        return {"model": self.model, "messages": [{"role": "user", "content": self.parts(request)}]} | self.parameters | {"response_format": form}

    def complete(self, request: Request) -> tuple[list[Any], Usage]:
        answer, seconds = post(self.url("chat/completions"), self.payload(request), self.headers())
        usage = answer.get("usage") or {}
        choice = (answer.get("choices") or [{}])[0]
        if choice.get("finish_reason") == "length":
            raise TokenOverflow("the answer was cut off")
        if choice.get("finish_reason") not in (None, "stop"):
            raise RuntimeError(f"the completion ended with {choice['finish_reason']!r}")
        message = choice.get("message") or {}
        if message.get("refusal"):
            raise RuntimeError(f"the model refused: {message['refusal']}")
        return items(message.get("content")), Usage(usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0), seconds)

    def embed(self, texts: list[str]) -> tuple[list[list[float]], Usage]:
        answer, seconds = post(self.url("embeddings"), {"model": self.model, "input": texts}, self.headers())
        data = sorted(answer.get("data") or [], key=lambda d: d.get("index", 0))
        if len(data) != len(texts):
            raise RuntimeError(f"{len(data)} embeddings for {len(texts)} texts")
        return [d["embedding"] for d in data], Usage((answer.get("usage") or {}).get("prompt_tokens", 0), 0, seconds)

    def transcribe(self, sources: list[str | None]) -> list[str | None]:
        return [None if s is None else self._transcript(s) for s in sources]

    def _transcript(self, source: str) -> str:
        mark, name = uuid.uuid4().hex, source.rsplit("/", 1)[-1].split("?")[0] or "audio"
        fields = f'--{mark}\r\nContent-Disposition: form-data; name="model"\r\n\r\n{self.model}\r\n'
        head = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{name}"\r\nContent-Type: application/octet-stream\r\n\r\n'
        data = fields.encode() + head.encode() + media.content(source) + f"\r\n--{mark}--\r\n".encode()
        answer, _ = post(self.url("audio/transcriptions"), data, self.headers() | {"Content-Type": f"multipart/form-data; boundary={mark}"})
        return answer.get("text", "")


class Azure(OpenAI):
    name = "azure"

    def url(self, what: str) -> str:
        base = self.secret.get("base_url") or f"https://{self.secret.get('resource_name', '')}.openai.azure.com"
        return f"{base.rstrip('/')}/openai/deployments/{self.model}/{what}?api-version={self.secret.get('api_version', '')}"

    def headers(self) -> dict[str, str]:
        return {"api-key": self.secret.get("api_key", "")}

    def embed(self, texts: list[str]) -> tuple[list[list[float]], Usage]:
        """One request a text."""
        out, total = [], Usage()
        for text in texts:
            found, usage = super().embed([text])
            out += found
            total = Usage(total.prompt_tokens + usage.prompt_tokens, 0, total.seconds + usage.seconds)
        return out, total


class Ollama(Provider):
    name = "ollama"

    def url(self, what: str) -> str:
        return self.secret.get("api_url", self.secret.get("base_url", "http://127.0.0.1:11434")).rstrip("/") + "/api/" + what

    def payload(self, request: Request) -> dict[str, Any]:
        message: dict[str, Any] = {"role": "user", "content": request.prompt}
        images = [pair for c in request.images for pair in labelled(c)]
        if images:
            message["images"] = [media.as_base64(x) for _, x in images]
            message["content"] += "\n\nAttached, in this order: " + "; ".join(label for label, _ in images)
        item = self.parameters.get("format") or {"type": request.output}
        return {"model": self.model, "messages": [message], "stream": False} | self.parameters | {"format": item_list(item, request.n)}

    def complete(self, request: Request) -> tuple[list[Any], Usage]:
        answer, seconds = post(self.url("chat"), self.payload(request), {})
        if answer.get("done_reason", "stop") != "stop" or answer.get("done") is False:
            raise RuntimeError(f"the completion did not finish: {answer.get('done_reason')}")
        content = (answer.get("message") or {}).get("content")
        if content is None:
            raise RuntimeError("the completion has no content")
        return items(content), Usage(answer.get("prompt_eval_count", 0), answer.get("eval_count", 0), seconds)

    def embed(self, texts: list[str]) -> tuple[list[list[float]], Usage]:
        """One request a text."""
        out, total = [], Usage()
        for text in texts:
            answer, seconds = post(self.url("embed"), {"model": self.model, "input": text}, {})
            if not answer.get("embeddings"):
                raise RuntimeError("the answer holds no embedding")
            out.append(answer["embeddings"][0])
            total = Usage(total.prompt_tokens + answer.get("prompt_eval_count", 0), 0, total.seconds + seconds)
        return out, total


class Anthropic(Provider):
    name = "anthropic"
    #: Asked for where the parameters don't say.
    MAX_TOKENS = 4096
    VERSION, BETA = "2023-06-01", "structured-outputs-2025-11-13"

    def url(self) -> str:
        return self.secret.get("base_url", "https://api.anthropic.com/v1").rstrip("/") + "/messages"

    def headers(self) -> dict[str, str]:
        return {"x-api-key": self.secret.get("api_key", ""), "anthropic-version": self.secret.get("api_version", self.VERSION), "anthropic-beta": self.BETA}

    def payload(self, request: Request) -> dict[str, Any]:
        parts: list[dict[str, Any]] = [{"type": "text", "text": request.prompt}]
        for column in request.images:
            for label, image in labelled(column):
                parts.append({"type": "text", "text": label})
                parts.append({"type": "image", "source": {"type": "base64", "media_type": media.mime(column.get("type")), "data": media.as_base64(image)}})
        out = {"model": self.model, "messages": [{"role": "user", "content": parts}], "max_tokens": self.MAX_TOKENS} | self.parameters
        schema = item_list((self.parameters.get("output_format") or {}).get("schema") or {"type": request.output})
        if "claude-3" in self.model:  # has no structured output: the answer is the input of a tool it must use
            out.pop("output_format", None)
            tool = {"name": "answers", "description": "Takes the answers", "input_schema": schema}
            return out | {"tools": [tool], "tool_choice": {"type": "tool", "name": "answers"}}
        return out | {"output_format": {"type": "json_schema", "schema": schema}}

    def complete(self, request: Request) -> tuple[list[Any], Usage]:
        answer, seconds = post(self.url(), self.payload(request), self.headers())
        if answer.get("type") == "error":
            message = (answer.get("error") or {}).get("message", "")
            raise_if_overflow(message)
            raise RuntimeError(f"the service answered: {message}")
        if answer.get("stop_reason") == "max_tokens":
            raise TokenOverflow("the answer was cut off")
        if answer.get("stop_reason") not in (None, "end_turn", "stop_sequence", "tool_use"):
            raise RuntimeError(f"the completion ended with {answer['stop_reason']!r}")
        usage = answer.get("usage") or {}
        used = Usage(usage.get("input_tokens", 0), usage.get("output_tokens", 0), seconds)
        for part in answer.get("content") or []:
            if part.get("type") == "tool_use":
                return items(part.get("input")), used
            if part.get("type") == "text":
                return items(part.get("text")), used
        raise RuntimeError("the completion has no content")
