"""Prompt texts: how rows become part of a request."""

from __future__ import annotations

import json
from enum import Enum
from typing import Any

#: A column is {"name": ..., "type": ..., "data": [one text a row]}; name and type may be absent.
Columns = list[dict[str, Any]]


class TupleFormat(Enum):
    XML = "xml"
    JSON = "json"
    MARKDOWN = "markdown"

    @classmethod
    def of(cls, name: str) -> TupleFormat:
        try:
            return cls(name.lower())
        except ValueError:
            raise ValueError(f"tuple_format {name!r} is none of XML, JSON and Markdown") from None


#: Slots: the user's prompt, the rows, the shape of the answer, and instructions for the function.
TEMPLATE = """You process table rows for a data pipeline. Answer for the rows below, following the task.

Task:
{task}

{rows}
Answer format:
{format}

Rules:
{rules}"""

FORMATS = {
    "string": "Return exactly {n} strings, one for each row, in the rows' order.",
    "object": "Return exactly {n} objects, one for each row, in the rows' order.",
    "boolean": "Return exactly {n} values true or false, one for each row, in the rows' order.",
    "integer": "Return {n} integers.",
}
RULES = {
    "complete": "Treat each row on its own. Never skip, merge or repeat a row.",
    "filter": "Judge each row on its own by the task: true if it fits, false if not.",
    "reduce": "Merge all rows, and the previous summary if there is one, into one answer.",
    "first": "Return the row_id of the row that is most relevant to the task.",
    "last": "Return the row_id of the row that is least relevant to the task.",
    "rerank": "Return every row_id once, from the most to the least relevant to the task.",
}


def column_names(columns: Columns, prefix: str = "") -> list[str]:
    """Given names, and COLUMN i for the i-th column without one."""
    out, unnamed = [], 0
    for c in columns:
        if isinstance(c.get("name"), str):
            out.append(prefix + c["name"])
        else:
            unnamed += 1
            out.append(f"COLUMN {unnamed}")
    return out


def row_count(columns: Columns) -> int:
    return len(columns[0].get("data") or []) if columns else 0


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def header(columns: Columns, form: TupleFormat) -> str:
    if form is TupleFormat.XML:
        return "<header>" + "".join(f"<column>{n}</column>" for n in column_names(columns)) + "</header>\n"
    if form is TupleFormat.MARKDOWN:
        if not columns:
            return " | Empty | \n | ----- | \n"
        cells, rules = column_names(columns, "COLUMN_"), ["-" * len(n) for n in column_names(columns)]
        return " | " + "".join(f"{c} | " for c in cells) + "\n | " + "".join(f"{r} | " for r in rules) + "\n"
    return ""


def body(columns: Columns, form: TupleFormat) -> str:
    n = row_count(columns)
    if form is TupleFormat.JSON:
        data = {name: c.get("data") or [] for name, c in zip(column_names(columns), columns, strict=True)}
        return json.dumps(data, indent=4, ensure_ascii=False, sort_keys=True) + "\n"
    rows = [[c["data"][i] for c in columns] for i in range(n)]
    if form is TupleFormat.XML:
        return "".join("<row>" + "".join(f"<column>{_text(v)}</column>" for v in r) + "</row>\n" for r in rows) or "<row></row>\n"
    return "".join(" | " + "".join(f"{json.dumps(v, ensure_ascii=False)} | " for v in r) + "\n" for r in rows)


def tuples(columns: Columns, form: TupleFormat) -> str:
    """The rows of a request: their number, a header, and the rows in the format."""
    return f"Rows below: {row_count(columns)}\n\n" + header(columns, form) + body(columns, form)


def transcription_name(name: str | None) -> str:
    return f"transcription_of_{name}" if name else "transcription"


def split_media(columns: Columns) -> tuple[Columns, Columns, Columns]:
    """(tabular, image, audio) columns; a type like image/png is an image."""
    kind = lambda c: (c.get("type") or "tabular").split("/")[0]
    return [c for c in columns if kind(c) not in ("image", "audio")], [c for c in columns if kind(c) == "image"], [c for c in columns if kind(c) == "audio"]


def render(task: str, columns: Columns, form: TupleFormat, function: str, output: str, n: int) -> str:
    """The whole prompt of a request over some rows' tabular columns."""
    return TEMPLATE.format(task=task, rows=tuples(columns, form), format=FORMATS[output].format(n=n), rules=RULES[function])


def with_summary(prompt: str, previous: str | None) -> str:
    """prompt, and the summary of the batches before this one."""
    return prompt + "\n\n" + json.dumps({"Previous Batch Summary": previous}, indent=4, ensure_ascii=False)
