"""Named models and versioned prompts, in two scopes.

LOCAL lives with the session. GLOBAL is a JSON file that sessions share: it is read for every use and replaced
as a whole by an atomic rename, under a lock file, so readers never see half a change.
"""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lexispark.functions.render import TupleFormat

GLOBAL, LOCAL = "global", "local"
MODEL_SCHEMA = "scope string, model_name string, model string, provider_name string, model_args string"
PROMPT_SCHEMA = "scope string, prompt_name string, prompt string, updated_at string, version string"
#: Models that every session knows (name = model, provider), the default one, and the first prompt.
DEFAULT_MODELS = {
    "default": ("gpt-4o-mini", "openai"),
    "gpt-4o-mini": ("gpt-4o-mini", "openai"),
    "gpt-4o": ("gpt-4o", "openai"),
    "gpt-4o-transcribe": ("gpt-4o-transcribe", "openai"),
    "gpt-4o-mini-transcribe": ("gpt-4o-mini-transcribe", "openai"),
    "text-embedding-3-large": ("text-embedding-3-large", "openai"),
    "text-embedding-3-small": ("text-embedding-3-small", "openai"),
}
FIRST_PROMPT = ("hello-world", "Tell me hello world")
USAGE_KEYS = ("prompt_tokens_limit", "completion_tokens_limit", "total_tokens_limit")
MODEL_ARGS = ("tuple_format", "batch_size", "max_batch_size", "model_parameters", "is_async", "rate_limit", "usage_limit")
ATTACH_TRIES, ATTACH_PAUSE = 10, 1.0


class CatalogError(ValueError):
    pass


def _positive(name: str, value: Any) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise CatalogError(f"Expected '{name}' to be an unsigned number.")
    if value == 0:
        raise CatalogError(f"'{name}' must be larger than 0")
    return value


def checked_args(args: dict[str, Any]) -> dict[str, Any]:
    """model_args whose keys and kinds of values are allowed."""
    out: dict[str, Any] = {}
    for key, value in args.items():
        if key not in MODEL_ARGS:
            raise CatalogError(f"Unknown model_args parameter: '{key}'. Only {', '.join(MODEL_ARGS)} are allowed.")
        if key in ("batch_size", "max_batch_size", "rate_limit"):
            out[key] = _positive(key, value)
        elif key == "tuple_format":
            if not isinstance(value, str):
                raise CatalogError("Expected 'tuple_format' to be a string.")
            out[key] = TupleFormat.of(value).name
        elif key == "model_parameters":
            if not isinstance(value, dict):
                raise CatalogError("Expected 'model_parameters' to be a JSON object.")
            out[key] = value
        elif key == "is_async":
            if not isinstance(value, bool):
                raise CatalogError("Expected 'is_async' to be a boolean.")
            out[key] = value
        else:
            if not isinstance(value, dict) or not value or set(value) - set(USAGE_KEYS):
                raise CatalogError(f"Expected 'usage_limit' to be a JSON object of {', '.join(USAGE_KEYS)}.")
            out[key] = {k: _positive(k, v) for k, v in value.items()}
    return out


@dataclass
class Model:
    name: str
    model: str
    provider: str
    args: dict[str, Any] = field(default_factory=dict)


@dataclass
class Prompt:
    name: str
    prompt: str
    updated_at: str
    version: int = 1


def _now() -> str:
    return datetime.now(UTC).replace(tzinfo=None).isoformat(sep=" ")


class Scope:
    """Models by name and prompts by name and version."""

    def __init__(self):
        self.models: dict[str, Model] = {}
        self.prompts: dict[str, list[Prompt]] = {}

    @contextlib.contextmanager
    def changing(self) -> Iterator[Scope]:
        yield self

    def reading(self) -> Scope:
        return self


class FileScope(Scope):
    """A scope kept in a file."""

    def __init__(self, path: str | Path):
        super().__init__()
        self.path = Path(path)

    def reading(self) -> Scope:
        out = Scope()
        try:
            data = json.loads(self.path.read_text())
        except FileNotFoundError:
            name, text = FIRST_PROMPT
            out.prompts[name] = [Prompt(name, text, _now())]
            return out
        out.models = {m["name"]: Model(**m) for m in data["models"]}
        for p in data["prompts"]:
            out.prompts.setdefault(p["name"], []).append(Prompt(**p))
        return out

    @contextlib.contextmanager
    def changing(self) -> Iterator[Scope]:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        lock = self.path.with_suffix(".lock")
        for attempt in range(ATTACH_TRIES):
            try:
                os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                if attempt == ATTACH_TRIES - 1:
                    raise CatalogError(f"the catalog {self.path} is locked: if no session is changing it, delete {lock}") from None
                time.sleep(ATTACH_PAUSE)
        try:
            now = self.reading()
            yield now
            data = {"models": [vars(m) for m in now.models.values()], "prompts": [vars(p) for ps in now.prompts.values() for p in ps]}
            with tempfile.NamedTemporaryFile("w", dir=self.path.parent, delete=False) as f:
                json.dump(data, f)
            os.replace(f.name, self.path)
        finally:
            lock.unlink(missing_ok=True)


class Catalog:
    def __init__(self, storage: str | Path | None = None):
        """storage: the folder of the global scope; None keeps it in memory too."""
        self.local = Scope()
        self.shared: Scope = FileScope(Path(storage) / "catalog.json") if storage else Scope()
        if not storage:
            name, text = FIRST_PROMPT
            self.shared.prompts[name] = [Prompt(name, text, _now())]

    def scope(self, name: str) -> Scope:
        return self.shared if name == GLOBAL else self.local

    # models

    def create_model(self, name: str, model: str, provider: str, args: dict[str, Any] | None = None, scope: str = LOCAL) -> None:
        args = checked_args(args or {})
        if name in DEFAULT_MODELS or any(name in s.reading().models for s in (self.shared, self.local)):
            raise CatalogError(f"Model '{name}' already exist.")
        with self.scope(scope).changing() as s:
            s.models[name] = Model(name, model, provider, args)

    def delete_model(self, name: str) -> None:
        for s in (self.shared, self.local):
            if name in s.reading().models:
                with s.changing() as now:
                    now.models.pop(name, None)

    def update_model(self, name: str, model: str, provider: str, args: dict[str, Any] | None = None) -> None:
        """Replaces a model, its arguments as a whole; a global one before a local one."""
        args = checked_args(args or {})
        for s in (self.shared, self.local):
            if name in s.reading().models:
                with s.changing() as now:
                    now.models[name] = Model(name, model, provider, args)
                return
        raise CatalogError(f"Model '{name}' doesn't exist.")

    def move_model(self, name: str, to: str) -> None:
        source, target = (self.local, self.shared) if to == GLOBAL else (self.shared, self.local)
        if name in target.reading().models:
            raise CatalogError(f"Model '{name}' already exist in {to} storage.")
        if name not in source.reading().models:
            return
        with source.changing() as a, target.changing() as b:
            b.models[name] = a.models.pop(name)

    def model(self, name: str) -> Model:
        for s in (self.shared, self.local):
            found = s.reading().models.get(name)
            if found:
                return found
        if name in DEFAULT_MODELS:
            return Model(name, *DEFAULT_MODELS[name])
        raise CatalogError(f"Model not found: '{name}'")

    def models(self, spark: SparkSession, name: str | None = None) -> DataFrame:
        """(scope, model_name, model, provider_name, model_args); default models count as global."""
        rows = [(GLOBAL, n, m, p, "{}") for n, (m, p) in DEFAULT_MODELS.items()]
        for scope in (GLOBAL, LOCAL):
            rows += [(scope, m.name, m.model, m.provider, json.dumps(m.args, sort_keys=True)) for m in self.scope(scope).reading().models.values()]
        return spark.createDataFrame([r for r in rows if name in (None, r[1])], MODEL_SCHEMA)

    # prompts

    def create_prompt(self, name: str, text: str, scope: str = LOCAL) -> None:
        if any(name in s.reading().prompts for s in (self.shared, self.local)):
            raise CatalogError(f"Prompt '{name}' already exist.")
        with self.scope(scope).changing() as s:
            s.prompts[name] = [Prompt(name, text, _now())]

    def delete_prompt(self, name: str) -> None:
        for s in (self.shared, self.local):
            if name in s.reading().prompts:
                with s.changing() as now:
                    now.prompts.pop(name, None)

    def update_prompt(self, name: str, text: str) -> None:
        """Adds a version after the latest, in the scope that holds that one."""
        held = [(max(p.version for p in ps), s) for s in (self.shared, self.local) if (ps := s.reading().prompts.get(name))]
        if not held:
            raise CatalogError(f"Prompt '{name}' doesn't exist.")
        version, s = max(held, key=lambda x: x[0])
        with s.changing() as now:
            now.prompts[name].append(Prompt(name, text, _now(), version + 1))

    def move_prompt(self, name: str, to: str) -> None:
        """Moves all versions."""
        source, target = (self.local, self.shared) if to == GLOBAL else (self.shared, self.local)
        if name in target.reading().prompts:
            raise CatalogError(f"Prompt '{name}' already exist in {to} storage.")
        if name not in source.reading().prompts:
            return
        with source.changing() as a, target.changing() as b:
            b.prompts[name] = a.prompts.pop(name)

    def prompt(self, name: str, version: int | None = None) -> str:
        found = [p for s in (self.shared, self.local) for p in s.reading().prompts.get(name, []) if version in (None, p.version)]
        if not found:
            raise CatalogError(f"Prompt not found: '{name}'" + ("" if version is None else f", version {version}"))
        return max(found, key=lambda p: p.version).prompt

    def prompts(self, spark: SparkSession, name: str | None = None) -> DataFrame:
        """(scope, prompt_name, prompt, updated_at, version): all versions of one prompt, the latest first, or the
        latest version of each in each scope."""
        rows = [(scope, p) for scope in (GLOBAL, LOCAL) for ps in self.scope(scope).reading().prompts.values() for p in (ps if name else [max(ps, key=lambda p: p.version)])]
        rows = sorted((r for r in rows if name in (None, r[1].name)), key=lambda r: -r[1].version if name else 0)
        return spark.createDataFrame([(s, p.name, p.prompt, p.updated_at, str(p.version)) for s, p in rows], PROMPT_SCHEMA)
