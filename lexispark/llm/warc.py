"""WARC records, and the derivatives of responses: linked metadata and plain-text conversion records.

A derivative names the response that it comes from (WARC-Refers-To), repeats its target URI and date and
the digest of its payload, and carries a digest of its own block; the metadata record holds the source's
header fields. Record identifiers are name-based UUIDs of what they identify, so reruns agree.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import itertools
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.llm.common import pieces, table

VERSION = "WARC/1.1"
#: The date of records made from tables that hold none.
DATE = "1970-01-01T00:00:00Z"
FIELDS = "page_id bigint, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, content_length bigint, block string"
#: Elements whose text is no prose, and elements that end a line.
SILENT = frozenset("script style noscript template".split())
BREAKS = frozenset("p div br hr li ul ol tr table h1 h2 h3 h4 h5 h6 title head body header footer nav section article main aside blockquote pre form option dd dt dl".split())
TAG = re.compile(r"<(?:/?([a-zA-Z][a-zA-Z0-9]*)|[!/?])")
CLOSING = {name: re.compile(rf"</{name}[ \t\r\n\f]*>", re.I) for name in SILENT}
GAPS = re.compile(r"[ \t\r\f\v]+")
#: Numbers of characters that no text can mean.
BEYOND = re.compile(r"&#(?:[xX]0*[1-9a-fA-F][0-9a-fA-F]{8,}|0*[1-9][0-9]{10,});?|&#0{20,}[0-9]*;?")
CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
#: Where a page's own charset is looked for, as browsers do.
META_BYTES = 1024


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def plain_text(page: str) -> str:
    """A page's text: elements that are not prose and comments dropped (to the page's end where they are not closed), block
    elements on lines of their own, entities decoded, runs of blanks and empty lines removed. One scan, in linear time."""
    out, at = [], 0
    while (lt := page.find("<", at)) >= 0:
        out.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            out.append(" ")
            at = end + 3 if end >= 0 else len(page)
            continue
        tag = TAG.match(page, lt)
        if not tag:
            out.append("<")
            at = lt + 1
            continue
        end = page.find(">", tag.end())
        if end < 0:  # no tag is closed from here on
            at = lt
            break
        name, at = (tag.group(1) or "").lower(), end + 1
        if name in SILENT and page[lt + 1] != "/":
            closed = CLOSING[name].search(page, at)
            out.append(" ")
            at = closed.end() if closed else len(page)
        elif name in BREAKS:
            out.append("\n")
    text = html.unescape(BEYOND.sub("\ufffd", "".join([*out, page[at:]])))
    lines = (GAPS.sub(" ", line).strip() for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def http_response(body: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body


def record(kind: str, own_id: str, uri: str, date: str, content_type: str, block: bytes, refers_to: str | None = None, payload: str | None = None) -> bytes:
    """One record in the file format."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    fields += [("WARC-Refers-To", refers_to)] * bool(refers_to) + [("WARC-Payload-Digest", payload)] * bool(payload)
    fields += [("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    head = "\r\n".join([VERSION, *(f"{k}: {clean(v)}" for k, v in fields)])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def clean(value: str) -> str:
    """A value fit for a header line."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value)


def fields_of(head: str) -> list[tuple[str, str]]:
    """The header fields of the lines after the first, in their order; a line that starts with a blank goes on with the last."""
    out: list[tuple[str, str]] = []
    for line in head.split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif colon:
            out.append((name.strip(), value.strip()))
    return out


def named(fields: list[tuple[str, str]], name: str) -> str | None:
    """The first field of a name, in any case of letters."""
    return next((v for k, v in fields if k.lower() == name), None)


#: What parts the records of a file; it may stand in blocks too, whose length then tells.
MARK = "WARC/1."


def assembled(parts: Iterable[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes, str | None]]:
    """(header fields, block, fault) of records, from the parts of a file between marks. A part that is shorter than its
    record's length goes on in the next one. Faults: a head that does not end, no length or one that is no number, and a
    block that ends before its length; what there is of such a record is given."""
    held: list[bytes] = []

    def one(last: bool):
        """The record of what is held, if it is whole or the last."""
        data = MARK.encode().join(held)
        head, end, block = data.partition(b"\r\n\r\n")
        if not end:
            return ([], data, "no end of the head") if last and data.strip() else None
        fields = fields_of(head.decode("utf-8", "replace"))
        length = named(fields, "content-length") or ""
        if not re.fullmatch(r"[0-9]{1,18}", length):
            return fields, block, "no length"
        if len(block) < int(length):
            return (fields, block, "cut off") if last else None
        return fields, block[: int(length)], None

    size = need = 0
    for part in parts:
        starts = bool(re.match(rb"[0-9]\r\n", part))
        if held and size < need:  # inside a block, whatever the part looks like
            held.append(part)
            size += len(part) + len(MARK)
            if size < need:
                continue
        elif starts:
            if held and (found := one(True)):
                yield found
            held, size = [part], len(part)
        elif held:
            held.append(part)
            size += len(part) + len(MARK)
        else:
            continue  # before the first record
        data = held[0] if len(held) == 1 else MARK.encode().join(held)
        head, end, _ = data.partition(b"\r\n\r\n")
        length = named(fields_of(head.decode("utf-8", "replace")), "content-length") or "" if end else ""
        need = len(head) + 4 + int(length) if re.fullmatch(r"[0-9]{1,18}", length) else 0
        if need and size >= need:
            yield one(True)
            held, size, need = [], 0, 0
        elif len(held) > 1:
            held = [data]
    if held and (found := one(True)):
        yield found


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes, str | None]]:
    """The records of a file's bytes, plain or of gzip members, as assembled() gives them."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    return assembled(data.split(MARK.encode()))


def payload_of(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(header fields in their order, body) of an HTTP response; a chunked body is put together."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = fields_of(head.decode("latin-1"))
    if "chunked" in (named(fields, "transfer-encoding") or "").lower():
        body = unchunked(body)
    return fields, body


def unchunked(body: bytes) -> bytes:
    """The chunks of a body; from a malformed one on, and in a body that is not chunked at all, the bytes as they are."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at, at + 64)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,8}", size):
            return b"".join([*out, body[at:]])
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def page_of(fields: list[tuple[str, str]], body: bytes) -> str:
    """A body as text: its content coding undone, decoded by the charset of the header or of the page, or as UTF-8; what
    cannot be undone or decoded stands as replacement characters."""
    for coding in reversed([c.strip().lower() for c in (named(fields, "content-encoding") or "").split(",")]):
        bits = {"gzip": 31, "x-gzip": 31, "deflate": 15}.get(coding)
        if bits:
            for window in (bits, -15):
                try:
                    body = zlib.decompressobj(window).decompress(body)
                    break
                except zlib.error:
                    continue
    own = CHARSET.search(named(fields, "content-type") or "") or CHARSET.search(body[:META_BYTES].decode("latin-1"))
    try:
        return body.decode(own.group(1) if own else "utf-8", "replace")
    except (LookupError, UnicodeError, ValueError):  # no such charset, or none of texts
        return body.decode("utf-8", "replace")


def derive(own_id: str, uri: str, date: str, block: bytes, source: list[tuple[str, str]] = ()) -> list[tuple]:
    """The metadata and conversion records of a response: (type, id, refers to, content type, payload digest, block). source:
    the response's own header fields; they are all kept, and so is the payload digest that they give."""
    headers, body = payload_of(block)
    text = plain_text(page_of(headers, body)).encode("utf-8", "replace")
    payload = named(list(source), "warc-payload-digest") or digest(body)
    converted = record_id(own_id, "conversion")
    told = [("source-content-length", str(len(body))), ("source-payload-digest", payload), ("text-digest", digest(text)), ("text-record-id", converted)]
    told += [(f"source-warc-{k.lower()}", clean(v)) for k, v in source]
    told += [(f"source-http-{clean(k).lower()}", clean(v)) for k, v in headers]
    meta = "".join(f"{k}: {v}\r\n" for k, v in told).encode("utf-8", "replace")
    return [
        ("metadata", record_id(own_id, "metadata"), own_id, "application/warc-fields", payload, meta),
        ("conversion", converted, own_id, "text/plain; charset=utf-8", payload, text),
    ]


def derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Three records of every page: its response and, in the columns of FIELDS, what derives from it.

    A null page is an empty one, a null URL an empty URI; a null id and equal ids stay as they are, and
    equal rows give equal records. The response's block is left out (null), as the page itself holds it. Very long pages are
    read whole, in time linear in their length. Other columns of pages are ignored; an empty table gives an empty one.
    """
    import pyarrow as pa

    names = [f.split()[0] for f in FIELDS.split(", ")]
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, part in pieces(batch, 2):
                ids = batch.column(0).slice(first, len(part)).to_pylist()
                rows = []
                for page, url, body in zip(ids, batch.column(1).slice(first, len(part)).to_pylist(), part, strict=True):
                    uri, body = url or "", body or b""
                    response = http_response(body)
                    own = record_id(uri, str(page), digest(body))
                    rows.append((page, "response", own, None, uri, DATE, "application/http; msgtype=response", digest(body), digest(response), len(response), None))
                    for what, name, refers, content, payload, block in derive(own, uri, DATE, response):
                        rows.append((page, what, name, refers, uri, DATE, content, payload, digest(block), len(block), block.decode()))
                kinds = [batch.column(0).type, *[pa.string()] * 8, pa.int64(), pa.string()]
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = FIELDS.replace("page_id bigint", f"page_id {kind}")
    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("binary").alias("h"))
    return rows.mapInArrow(run, schema)


#: Columns of records: some fields by name, all fields in their order, the block, and what is wrong with the record.
RECORD = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, headers array<struct<name: string, value: string>>, block binary, fault string"
RECORD_NAMES = ["record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "payload_digest", "headers", "block", "fault"]
KEYS = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-payload-digest")


def _batches(rows: Iterable[tuple], kinds, names: list[str], most: int = 8_000_000):
    """Rows as record batches of about so many bytes of blocks; a row's last but one value is its block."""
    import pyarrow as pa

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-2] or b"")
        if size > most or len(held) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _kinds():
    import pyarrow as pa

    return [*[pa.string()] * 7, pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary(), pa.string()]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records (RECORD) of the WARC files under a path of any store that Spark reads, compressed ones (.gz) or not.

    Spark's reader streams a file's parts between marks, so a worker holds a record, not a file. A record that is cut off
    or malformed comes with its fault and what there is of it; those after it are read. A large plain file is read in
    splits; only where a split ends inside a block at a mark is that block cut off, and told so.
    """

    def run(batches):
        def parts():
            for batch in batches:
                for part, split in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    yield split, part.as_py() or b""

        def rows():
            for _, own in itertools.groupby(parts(), lambda x: x[0]):
                yield from records_of(part for _, part in own)

        def records_of(own):
            for fields, block, fault in assembled(own):
                yield (*(named(fields, k) for k in KEYS), [{"name": k, "value": v} for k, v in fields], block, fault)

        yield from _batches(rows(), _kinds(), RECORD_NAMES)

    lines = spark.read.option("lineSep", MARK).text(path)
    lines = lines.select(F.col("value").cast("binary").alias("part"), F.concat_ws(" ", "_metadata.file_block_start", "_metadata.file_path").alias("split"))
    return lines.mapInArrow(run, RECORD)


def derive_records(records: DataFrame) -> DataFrame:
    """The metadata and conversion records (RECORD) of the responses without fault among records of read(). A null id, URI,
    date or block counts as an empty one (the date: DATE)."""

    def run(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    own, uri, date, headers, block = (c[i].as_py() for c in batch.columns)
                    fields = [(x["name"] or "", x["value"] or "") for x in headers or []]
                    for what, name, refers, content, payload, out in derive(own or "", uri or "", date or DATE, block or b"", fields):
                        yield (what, name, refers, uri or "", date or DATE, content, payload, [], out, None)

        yield from _batches(rows(), _kinds(), RECORD_NAMES)

    own = records.where("record_type = 'response' and fault is null").select("record_id", "target_uri", "warc_date", "headers", "block")
    return own.mapInArrow(run, RECORD)


def write(records: DataFrame, path: str) -> None:
    """Writes records as one WARC file a partition, part-*.gz, through Spark's own writer, so to any store that Spark writes."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                kind, own, refers, uri, date, content, payload, block = (c[i].as_py() for c in batch.columns)
                raw = record(kind or "resource", own or "", uri or "", date or DATE, content or "", block or b"", refers, payload)
                out.append(raw.removesuffix(b"\r\n"))  # the writer ends the line
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["raw"])

    rows = records.select("record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "payload_digest", F.col("block").cast("binary").alias("block"))
    rows.mapInArrow(run, "raw binary").select(F.col("raw").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, empty and repeated pages as in derivatives()."""
    return derivatives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
