"""The interface of a provider."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from lexispark.operators.batching import TokenOverflow

#: Lower-case fragments of providers' messages about prompts or answers that are too long.
OVERFLOW_MESSAGES = (
    "context length",
    "context window",
    "maximum context",
    "max context",
    "token limit",
    "tokens exceed",
    "exceeds token",
    "too many tokens",
    "too long",
    "prompt is too long",
    "input is too long",
    "request too large",
    "max_tokens",
    "maximum tokens",
)


def raise_if_overflow(message: str) -> None:
    low = message.lower()
    if any(part in low for part in OVERFLOW_MESSAGES):
        raise TokenOverflow(message)


@dataclass
class Request:
    """One completion request: prompt is what a model reads; the rest is what it was made from."""

    prompt: str
    output: str  # string, object, boolean or integer
    n: int  # answers asked for
    function: str = "complete"
    columns: list[dict[str, Any]] = field(default_factory=list)  # tabular, with row_id where rows are chosen
    images: list[dict[str, Any]] = field(default_factory=list)
    previous: str | None = None  # the summary so far, of a reduction


@dataclass
class Usage:
    prompt_tokens: int = 0
    completion_tokens: int = 0
    seconds: float = 0.0


class Provider:
    name = ""

    def __init__(self, model: str, parameters: dict[str, Any], secret: dict[str, str]):
        self.model, self.parameters, self.secret = model, parameters, secret

    def complete(self, request: Request) -> tuple[list[Any], Usage]:
        """The answers, as many as the model gave."""
        raise NotImplementedError

    def embed(self, texts: list[str]) -> tuple[list[list[float]], Usage]:
        raise NotImplementedError(f"{self.name} has no embeddings")

    def transcribe(self, sources: list[str | None]) -> list[str | None]:
        raise NotImplementedError(f"{self.name} has no audio transcription")
