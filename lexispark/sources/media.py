"""Images and audio named by URL, path or base64 text."""

from __future__ import annotations

import base64
import binascii
import urllib.request
from pathlib import Path

TIMEOUT = 60


def is_url(source: str) -> bool:
    return source.lower().startswith(("http://", "https://"))


def is_stored(source: str) -> bool:
    """Whether a source is the address of an object in a store, not a URL or a path."""
    scheme, mark, _ = source.partition("://")
    return bool(mark) and scheme.isalnum() and scheme.lower() not in ("http", "https", "file")


def is_base64(source: str) -> bool:
    try:
        return len(source) >= 16 and len(base64.b64decode(source, validate=True)) > 0
    except (binascii.Error, ValueError):
        return False


def content(source: str) -> bytes:
    """What a URL, an address in a store (s3, gs, hdfs, abfs) or a path holds; empty content is an error. Paths must exist
    where the task runs; stores are reached with the credentials that the task finds there."""
    if is_url(source):
        with urllib.request.urlopen(source, timeout=TIMEOUT) as response:
            data = response.read()
    elif is_stored(source):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(source)
        with store.open_input_stream(path) as stream:
            data = stream.read()
    else:
        data = Path(source.removeprefix("file://")).read_bytes()
    if not data:
        raise ValueError(f"{source} is empty")
    return data


def as_base64(source: str) -> str:
    """base64 text of a source, which may be base64 already."""
    if not is_url(source) and is_base64(source):
        return source
    return base64.b64encode(content(source)).decode()


def mime(kind: str | None, fallback: str = "image/png") -> str:
    """The media type of a column's type: image/jpeg as it is, image as the fallback."""
    return kind if kind and "/" in kind else fallback
