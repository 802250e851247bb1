"""Arguments of a semantic function, resolved on the driver into what tasks need."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field
from typing import Any

from lexispark.functions.render import TupleFormat
from lexispark.plans.catalog import USAGE_KEYS, Catalog, checked_args
from lexispark.sources.providers import default_secret, provider_key

BATCH = 16
MODEL_KEYS = ("model_name", "secret_name", "max_batch_size", "batch_size", "is_async", "tuple_format", "model_parameters", "rate_limit", "usage_limit", "model", "provider")
CONTEXT_KEYS = ("name", "data", "type", "detail", "transcription_model")


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class ModelSpec:
    name: str
    model: str
    provider: str
    secret: str  # a secret's name: values never enter a plan
    format: TupleFormat = TupleFormat.XML
    batch: int = BATCH
    is_async: bool = True
    parameters: str = "{}"
    rate_limit: int | None = None
    usage_limit: tuple[tuple[str, int], ...] = ()

    @property
    def settings(self) -> dict[str, Any]:
        return json.loads(self.parameters)


@dataclass(frozen=True)
class ColumnSpec:
    """What is fixed of a context column; its data comes with the rows."""

    name: str | None = None
    type: str | None = None
    detail: str | None = None
    transcriber: ModelSpec | None = None

    def over(self, data: list) -> dict[str, Any]:
        return {k: v for k, v in (("name", self.name), ("type", self.type), ("detail", self.detail)) if v is not None} | {"data": data}


@dataclass(frozen=True)
class CallSpec:
    """One use of a function: frozen and picklable."""

    function: str
    output: str
    model: ModelSpec
    task: str = ""
    columns: tuple[ColumnSpec, ...] = ()
    call: str = ""  # names the use in the metrics
    options: dict[str, Any] = field(default_factory=dict, hash=False)

    @property
    def function_name(self) -> str:
        return f"llm_{self.function}"


def resolve_model(model: dict[str, Any], catalog: Catalog) -> ModelSpec:
    """Values given here come first, then the stored model's, then defaults."""
    if not isinstance(model, dict):
        raise SpecError("the model must be a struct")
    unknown = set(model) - set(MODEL_KEYS)
    if unknown:
        raise SpecError(f"unknown model settings: {', '.join(sorted(unknown))}")
    name = model.get("model_name")
    if not name:
        raise SpecError("`model_name` is required in the model settings")
    given = {k: v for k, v in model.items() if v is not None and k not in ("model_name", "secret_name", "model", "provider")}
    if isinstance(given.get("model_parameters"), str):
        given["model_parameters"] = json.loads(given["model_parameters"])
    stored = catalog.model(name)
    own, given = dict(stored.args), checked_args(given)
    for source in (own, given):
        if "max_batch_size" in source:
            source.pop("batch_size", None)
        elif "batch_size" in source:
            warnings.warn("batch_size is deprecated: use max_batch_size", DeprecationWarning, stacklevel=3)
            source["max_batch_size"] = source.pop("batch_size")
    args = own | given
    provider = provider_key(model.get("provider") or stored.provider)
    limits = args.get("usage_limit") or {}
    return ModelSpec(
        name=name,
        model=model.get("model") or stored.model,
        provider=provider,
        secret=model.get("secret_name") or default_secret(provider),
        format=TupleFormat.of(args.get("tuple_format", "XML")),
        batch=args.get("max_batch_size", BATCH),
        is_async=args.get("is_async", True),
        parameters=json.dumps(args.get("model_parameters") or {}, sort_keys=True),
        rate_limit=args.get("rate_limit"),
        usage_limit=tuple((k, limits[k]) for k in USAGE_KEYS if k in limits),
    )


def resolve_prompt(prompt: dict[str, Any], catalog: Catalog) -> str:
    """The text of {prompt} or {prompt_name[, version]}."""
    keys = set(prompt) - {"context_columns"}
    if keys == {"prompt"}:
        text = prompt["prompt"]
    elif keys in ({"prompt_name"}, {"prompt_name", "version"}):
        version = prompt.get("version")
        text = catalog.prompt(prompt["prompt_name"], None if version is None else int(version))
    else:
        raise SpecError("the prompt must have either `prompt`, or `prompt_name` and maybe `version`")
    if not text or not str(text).strip():
        raise SpecError("The prompt cannot be empty")
    return str(text)


def resolve_columns(columns: Any, catalog: Catalog) -> tuple[ColumnSpec, ...]:
    if not isinstance(columns, (list, tuple)):
        raise SpecError("`context_columns` must be a list of structs")
    out = []
    for c in columns:
        if not isinstance(c, dict) or set(c) - set(CONTEXT_KEYS):
            raise SpecError(f"a context column has the keys {', '.join(CONTEXT_KEYS)} and no others")
        if c.get("data") is None:
            raise SpecError("a context column needs `data`")
        audio = (c.get("type") or "").split("/")[0] == "audio"
        if audio != (c.get("transcription_model") is not None):
            raise SpecError("`transcription_model` is required for audio" if audio else "`transcription_model` is for audio columns only")
        transcriber = resolve_model({"model_name": c["transcription_model"]}, catalog) if audio else None
        out.append(ColumnSpec(c.get("name"), c.get("type"), c.get("detail"), transcriber))
    return tuple(out)
