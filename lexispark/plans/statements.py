"""The MODEL, PROMPT and SECRET statements: text to a statement, and a statement to its effect. Parsing has none."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lexispark.plans.catalog import GLOBAL, LOCAL, Catalog


class StatementError(ValueError):
    pass


@dataclass(frozen=True)
class Statement:
    """verb: create, update, move, delete or get; kind: model, prompt or secret."""

    verb: str
    kind: str
    name: str | None = None
    values: tuple[str, ...] = ()
    args: dict[str, Any] = field(default_factory=dict)
    scope: str = LOCAL


#: A string ends at the next quote: there is no way to write a quote inside one.
TOKEN = re.compile(r"(?P<skip>\s+|--[^\n]*)|'(?P<string>[^']*)'|(?P<word>[A-Za-z_]+)|(?P<number>\d+)|(?P<mark>[(),;=:\[\]])")
OWN = re.compile(r"\s*(?:--[^\n]*\n\s*)*(create\s+(?:or\s+replace\s+)?(?:(?:global|local|persistent|temporary)\s+)?(?:model|prompt|secret)|(?:update|delete)\s+(?:model|prompt)|drop\s+secret|get\s+(?:model|models|prompt|prompts))\b", re.I)


def is_own(text: str) -> bool:
    """Whether a text is one of these statements (anything else is for Spark)."""
    return bool(OWN.match(text))


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> tuple[str, str]:
        while self.at < len(self.text):
            if self.text[self.at] == "{":
                return "json", "{"
            found = TOKEN.match(self.text, self.at)
            if not found:
                raise StatementError(f"unexpected {self.text[self.at]!r}")
            if found.lastgroup != "skip":
                return str(found.lastgroup), found.group(found.lastgroup)
            self.at = found.end()
        return "end", ""

    def next(self) -> tuple[str, str]:
        kind, value = self.peek()
        if kind == "json":
            try:
                parsed, end = json.JSONDecoder().raw_decode(self.text, self.at)
            except json.JSONDecodeError as e:
                raise StatementError(f"malformed JSON: {e}") from None
            self.at = end
            return kind, parsed
        if kind != "end":
            self.at = TOKEN.match(self.text, self.at).end()  # type: ignore[union-attr]
        return kind, value

    def word(self, *allowed: str) -> str:
        kind, value = self.next()
        if kind != "word" or value.lower() not in allowed:
            raise StatementError(f"expected {' or '.join(a.upper() for a in allowed)}, found {value!r}")
        return value.lower()

    def mark(self, expected: str) -> None:
        if (found := self.next()) != ("mark", expected):
            raise StatementError(f"expected {expected!r}, found {found[1]!r}")

    def string(self, what: str) -> str:
        kind, value = self.next()
        if kind != "string" or not value:
            raise StatementError(f"expected {what} as a string that is not empty")
        return value

    def maybe_mark(self, value: str) -> bool:
        if self.peek() == ("mark", value):
            self.next()
            return True
        return False

    def end(self) -> None:
        self.maybe_mark(";")
        kind, value = self.next()
        if kind != "end":
            raise StatementError(f"unexpected {value!r} after the statement")


def parse(text: str) -> Statement:
    r = _Reader(text)
    verb = r.word("create", "update", "delete", "get", "drop")
    out = _PARSERS[verb](r)
    r.end()
    return out


def _values(r: _Reader, kind: str) -> tuple[str, tuple[str, ...], dict[str, Any]]:
    r.mark("(")
    name, rest, args = r.string(f"the {kind}'s name"), [], {}
    for what in ("the model", "the provider") if kind == "model" else ("the prompt",):
        r.mark(",")
        rest.append(r.string(what))
    if kind == "model" and r.maybe_mark(","):
        found, args = r.next()
        if found != "json":
            raise StatementError("expected the model's arguments as a JSON object")
    r.mark(")")
    return name, tuple(rest), args


def _create(r: _Reader) -> Statement:
    word, scope = r.word("global", "local", "model", "prompt", "secret", "or", "persistent", "temporary"), LOCAL
    if word == "or":
        r.word("replace")
        word = r.word("secret", "persistent", "temporary")
    if word in (GLOBAL, LOCAL):
        scope, word = word, r.word("model", "prompt")
    if word in ("persistent", "temporary"):
        word = r.word("secret")
    if word == "secret":
        return _secret(r)
    name, values, args = _values(r, word)
    return Statement("create", word, name, values, args, scope)


def _secret(r: _Reader) -> Statement:
    name = r.next()[1] if r.peek()[0] in ("word", "string") else None
    r.mark("(")
    settings: dict[str, str] = {}
    while True:
        key = r.next()
        if key[0] != "word":
            raise StatementError(f"expected a setting's name, found {key[1]!r}")
        r.maybe_mark("=")
        kind, value = r.next()
        if kind not in ("word", "string", "number"):
            raise StatementError(f"expected the value of {key[1]}")
        settings[key[1].lower()] = value
        if not r.maybe_mark(","):
            break
    r.mark(")")
    if "type" not in settings:
        raise StatementError("a secret needs a TYPE")
    return Statement("create", "secret", name, (settings.pop("type").lower(),), settings)


def _update(r: _Reader) -> Statement:
    kind = r.word("model", "prompt")
    if r.peek()[0] == "string":
        name = r.string(f"the {kind}'s name")
        r.word("to")
        return Statement("move", kind, name, scope=r.word(GLOBAL, LOCAL))
    name, values, args = _values(r, kind)
    return Statement("update", kind, name, values, args)


def _delete(r: _Reader) -> Statement:
    kind = r.word("model", "prompt")
    return Statement("delete", kind, r.string(f"the {kind}'s name"))


def _drop(r: _Reader) -> Statement:
    r.word("secret")
    return Statement("delete", "secret", r.next()[1])


def _get(r: _Reader) -> Statement:
    kind = r.word("model", "models", "prompt", "prompts")
    if r.peek()[0] == "string":
        return Statement("get", kind.rstrip("s"), r.string("a name"))
    if not kind.endswith("s"):
        raise StatementError(f"GET {kind.upper()} needs a name")
    return Statement("get", kind.rstrip("s"))


_PARSERS = {"create": _create, "update": _update, "delete": _delete, "drop": _drop, "get": _get}


def execute(statement: Statement, catalog: Catalog, spark: SparkSession, secrets) -> DataFrame:
    """The statement's effect; its status, or the rows that it asks for."""
    s = statement
    if s.verb == "get":
        return catalog.models(spark, s.name) if s.kind == "model" else catalog.prompts(spark, s.name)
    if s.kind == "secret":
        if s.verb == "create":
            secrets.create(s.values[0], s.args, s.name)
        else:
            secrets.drop(s.name)
    elif s.verb == "create":
        (catalog.create_model(s.name, *s.values, s.args, s.scope) if s.kind == "model" else catalog.create_prompt(s.name, *s.values, s.scope))
    elif s.verb == "update":
        (catalog.update_model(s.name, *s.values, s.args) if s.kind == "model" else catalog.update_prompt(s.name, *s.values))
    elif s.verb == "move":
        (catalog.move_model if s.kind == "model" else catalog.move_prompt)(s.name, s.scope)
    else:
        (catalog.delete_model if s.kind == "model" else catalog.delete_prompt)(s.name)
    done = {"create": "created", "update": "updated", "move": "scope updated", "delete": "deleted"}[s.verb]
    return spark.createDataFrame([(f"{s.kind.capitalize()} {done} successfully",)], "status string")
