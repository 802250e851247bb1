"""Model providers: what turns a request into answers."""

from __future__ import annotations

from lexispark.sources.providers.base import Provider, Request
from lexispark.sources.providers.http import Anthropic, Azure, Ollama, OpenAI
from lexispark.sources.providers.offline import Offline

PROVIDERS: dict[str, type[Provider]] = {"openai": OpenAI, "default": OpenAI, "": OpenAI, "azure": Azure, "ollama": Ollama, "anthropic": Anthropic, "offline": Offline}
#: Secrets are looked up under these names unless a model names another.
SECRET_SUFFIX = {"azure": "azure_llm"}


def provider_key(name: str | None) -> str:
    key = (name or "").strip().lower()
    if key not in PROVIDERS:
        raise ValueError(f"provider {name!r} is not supported: choose openai, azure, ollama, anthropic or offline")
    return "openai" if key in ("", "default") else key


def default_secret(key: str) -> str:
    return f"__default_{SECRET_SUFFIX.get(key, key)}"


def make_provider(key: str, model: str, parameters: dict, secret: dict) -> Provider:
    return PROVIDERS[key](model, parameters, secret)


__all__ = ["PROVIDERS", "Provider", "Request", "default_secret", "make_provider", "provider_key"]
