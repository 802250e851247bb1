"""Removal of repeated passages: seed on winnowed anchors, extend both ways, keep what is maximal.

A window is ``width`` consecutive words. Its anchor is the smallest hash of its ``SEED_WORDS``-word
grams, so equal windows have equal anchors wherever they stand: documents meet on anchors (the seeds), and
only windows around an anchor that two documents share are looked at again. The windows around one
occurrence travel as one row. A row is extended from its anchor over the windows to both sides, as far as
they follow each other in an earlier document too: a stretch, with its place here and there. Stretches of a
pair of documents that go on from anchor to anchor, on one diagonal, are joined to maximal repeats, rows
with both places; those are cut out.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.llm.common import Named, cut, drop_cut, pieces, table

WIDTH, SEED_WORDS = 13, 4
#: An anchor of more documents is dealt out to salts of about so many: each salt marks what repeats within it,
#: and only what is first in its salt is held against the other salts, window by window.
HOT = 300
#: Windows in a row that share an anchor; a longer run is several rows.
RUN = 24


def _odd(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers from a fixed rule (splitmix64)."""
    mask, out = (1 << 64) - 1, []
    for k in range(1, n + 1):
        z = (seed + k * 0x9E3779B97F4A7C15) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, np.uint64)


def _grams(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A well-mixed 64-bit hash of every width consecutive word hashes."""
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(_odd(width, seed)):
        out += h[j : j + n] * c
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width consecutive values."""
    n, have = len(x) - width + 1, 1
    while have < width:
        step = min(have, width - have)
        x, have = np.minimum(x[:-step], x[step:]), have + step
    return x[:n]


def windows(text: bytes | None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, window hash) of every window of a text; together they identify a window in 128 bits."""
    from xxhash import xxh3_128_digest

    words = (text or b"").split()
    if len(words) < width:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys = np.frombuffer(b"".join(map(xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)
    k = min(SEED_WORDS, width)
    anchors = _least(_grams(keys[:, 0], k, 1), width - k + 1)
    return anchors.view(np.int64), _grams(keys[:, 1], width, 2).view(np.int64)


def _anchor_rows(width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start, part in pieces(batch, 1):
                found = [np.unique(windows(x, width)[0]) for x in part]
                ends = np.cumsum([0, *map(len, found)])
                values = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), lists], names=["id", "anchors"])

    return run


def _window_rows(width: int):
    """Rows (id, th, starts, anchor, salt, salted, windows): the windows in a row of one anchor, and all
    word starts where they stand in the text."""

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        names = ["id", "th", "starts", "anchor", "salt", "salted", "windows"]
        for batch in batches:
            for first, part in pieces(batch, 2):
                out: list[list] = [[] for _ in names]
                ids, ths = batch.column(0).slice(first, len(part)).to_pylist(), batch.column(1).slice(first, len(part)).to_pylist()
                for i, text in enumerate(part):
                    anchors, hashes = windows(text, width)
                    seeds = batch.column(3)[first + i].values
                    salts = dict(zip(seeds.field("anchor").to_pylist(), seeds.field("salts").to_pylist(), strict=True))
                    met = np.nonzero(np.isin(anchors, seeds.field("anchor").to_numpy(zero_copy_only=False)))[0]
                    if not len(met):
                        continue
                    breaks = np.nonzero((np.diff(met) != 1) | (np.diff(anchors[met]) != 0))[0] + 1
                    runs: dict[tuple[int, bytes], list[int]] = {}
                    for own in np.split(met, breaks):
                        for k in range(0, len(own), RUN):
                            w = own[k : k + RUN]
                            runs.setdefault((int(anchors[w[0]]), hashes[w].tobytes()), []).append(int(w[0]))
                    spread = zlib.crc32(str(ids[i]).encode())
                    for (anchor, w), starts in runs.items():
                        n = salts[anchor]
                        for column, value in zip(out, (ids[i], ths[i], starts, anchor, spread % n, n > 1, w), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (batch.column(0).type, *kinds), strict=True)], names=names)

    return run


def _stretches(found: list) -> list[tuple]:
    """(offset, windows, other document, place there) of windows that follow each other there too; found has a window's
    (document, place), or None."""
    out, at = [], 0
    while at < len(found):
        if found[at] is None:
            at += 1
            continue
        (other, place), end = found[at], at + 1
        while end < len(found) and found[end] == (other, place + end - at):
            end += 1
        out.append((at, end - at, other, place))
        at = end
    return out


NAMES = ["id", "th", "starts", "at", "n", "other", "place", "anchor", "mark", "windows"]


def _extend(batches):
    """Over rows sorted by anchor, salt and id: the stretches of a row that stand in a smaller id of the same salt too. Ids
    ascend, so the first id a window is met under is its smallest; what is held is one anchor's share. Where an
    anchor has several salts, the row keeps its windows, as those unmarked are to be held against other salts'."""
    import pyarrow as pa

    group, seen, runs = None, {}, {}
    for batch in batches:
        rows, out = [], []
        for i, (doc, starts, anchor, salt, salted, x) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6)), strict=True)):
            if (anchor, salt) != group:
                group, seen, runs = (anchor, salt), {}, {}
            n, first = len(x) // 8, runs.setdefault(x, (doc, starts[0]))
            if first[0] < doc:
                rows.append(i)
                out.append((0, n, *first, 0, None))
                continue
            found, mark = [], 0
            for j in range(n):
                met = seen.setdefault(x[8 * j : 8 * j + 8], (doc, starts[0] + j))
                found.append(met if met[0] < doc else None)
                mark |= (met[0] < doc) << j
            for stretch in _stretches(found) if mark else ():
                rows.append(i)
                out.append((*stretch, 0, None))
            if salted:
                rows.append(i)
                out.append((0, 0, None, 0, mark, x))
        yield _rows(batch, rows, out)


def _rows(batch, rows: list[int], out: list[tuple]):
    """Rows of NAMES: the first columns of batch's rows, and what was found."""
    import pyarrow as pa

    at = pa.array(rows, pa.int64())
    kinds = (pa.int32(), pa.int32(), batch.column(0).type, pa.int32(), pa.int64(), pa.binary())
    n, m, other, place, mark, x = (pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True))
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), n, m, other, place, batch.column(3).take(at), mark, x], names=NAMES)


def _open_windows(batches):
    """The unmarked windows of rows of _extend(), one a row: id, th, starts, anchor, wh."""
    import pyarrow as pa

    for batch in batches:
        rows, hashes, starts = [], [], []
        for i, (own, mark, x) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 8, 9)), strict=True)):
            for j, wh in enumerate(np.frombuffer(x, np.int64).tolist()):
                if not mark >> j & 1:
                    rows.append(i)
                    hashes.append(wh)
                    starts.append([s + j for s in own])
        at = pa.array(rows, pa.int64())
        columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.list_(pa.int32())), batch.column(7).take(at), pa.array(hashes, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "starts", "anchor", "wh"])


def _later(batches):
    """Over single windows sorted by anchor, hash and id: stretches of those whose first row has a smaller id."""
    window, first = None, None
    for batch in batches:
        rows, out = [], []
        for i, (doc, starts, anchor, wh) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True)):
            if (anchor, wh) != window:
                window, first = (anchor, wh), (doc, starts[0])
            if first[0] < doc:
                rows.append(i)
                out.append((0, 1, *first, 0, None))
        yield _rows(batch, rows, out)


def joined(stretches: list[dict], width: int) -> list[tuple]:
    """Maximal repeats (start, end, other document, start there), in words, of one document's stretches: those on one
    diagonal of one other document that adjoin or overlap are one. A stretch stands at each of its starts."""
    placed = sorted((x["other"], x["place"] - x["at"] - s, s + x["at"], x["n"]) for x in stretches for s in x["starts"])
    out: list[list] = []
    for other, shift, begin, n in placed:
        if out and out[-1][:2] == [other, shift] and begin <= out[-1][3]:
            out[-1][3] = max(out[-1][3], begin + n)
        else:
            out.append([other, shift, begin, begin + n])
    return [(begin, end + width - 1, other, begin + shift) for other, shift, begin, end in out]


def _cut_out(width: int, names: list[str]):
    """Removes the words of maximal repeats. The last two columns hold the text and a row's repeats."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            *columns, texts, repeats = batch.columns
            for first, part in pieces(batch, len(columns)):
                n_words, n_removed, kept = [], [], []
                for i, text in enumerate(part):
                    words = (text or b"").split()
                    spans = repeats[first + i].as_py()
                    n_words.append(len(words))
                    if not spans:
                        n_removed.append(0)
                        kept.append(b" ".join(words))
                        continue
                    gone = np.zeros(len(words), bool)
                    for x in spans:
                        gone[x["start"] : x["end"]] = True
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(part)) for c in columns), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=names)

    return run


def _maximal(width: int):
    """Rows (id, th, repeats) of rows (id, th, stretches)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("other", batch.column(0).type), ("other_start", pa.int32())]))
            found = [[dict(zip(("start", "end", "other", "other_start"), x, strict=True)) for x in joined(own, width)] for own in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, kind)], names=["id", "th", "repeats"])

    return run


def _repeats(own: DataFrame, kind: str, width: int) -> DataFrame:
    """(id, th, repeats) of the rows of own (id, t, th) that have maximal repeats in rows of smaller ids."""
    own = own.where("id is not null and t is not null")
    anchors = cut(own.select("id", "t").mapInArrow(_anchor_rows(width), f"id {kind}, anchors array<bigint>"))
    each = anchors.select("id", F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.ceil(F.col("n") / HOT).cast("int").alias("salts"))
    seeds = cut(each.join(shared, "anchor").groupBy("id").agg(F.collect_list(F.struct("anchor", "salts")).alias("seeds")))
    drop_cut(anchors)
    row = f"id {kind}, th bigint, starts array<int>, "
    out = f"{row}at int, n int, other {kind}, place int, anchor bigint, mark bigint, windows binary"
    met = own.join(seeds, "id").select("id", "th", "t", "seeds").mapInArrow(_window_rows(width), f"{row}anchor bigint, salt int, salted boolean, windows binary")
    near = met.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "id")
    extended = cut(near.mapInArrow(_extend, out))
    drop_cut(seeds)
    single = extended.where("windows is not null").mapInArrow(_open_windows, f"{row}anchor bigint, wh bigint").repartition("anchor", "wh").sortWithinPartitions("anchor", "wh", "id")
    stretches = extended.where("n > 0").unionByName(single.mapInArrow(_later, out))
    gathered = stretches.groupBy("id", "th").agg(F.collect_list(F.struct("starts", "at", "n", "other", "place")).alias("stretches"))
    return gathered.mapInArrow(_maximal(width), f"id {kind}, th bigint, repeats array<struct<start: int, end: int, other: {kind}, other_start: int>>")


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id_col, start, end, other, other_start): the words [start, end) of a document, width at least, stand in the document
    other, of a smaller id, from its word other_start on; of the places of a window the first of the smallest id is told.
    Rows of equal ids and texts tell the same; null ids and texts none."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"), F.xxhash64(text_col).alias("th"))
    return _repeats(own, kind, width).select(F.col("id").alias(id_col), F.inline("repeats"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with three more columns: n_words, n_removed and kept_text, the words outside every window of
    width words that also stands in a row of a smaller id, joined by one space.

    Columns of docs with these names are replaced, others may have any name. Windows are judged on the input, over whole
    texts of any length. A null text has no words and an empty kept_text. A row with a null id loses nothing and takes
    nothing from others. Rows of equal ids, repeated rows as well, take nothing from each other, whatever their texts.
    """
    own = Named(docs, "n_words", "n_removed", "kept_text")
    id_, text = own.at(id_col), own.at(text_col)
    kind = own.types[int(id_[3:])].simpleString()
    rows = own.df.withColumns({"t": F.col(text).cast("binary"), "th": F.xxhash64(text)})
    found = _repeats(rows.select(F.col(id_).alias("id"), "t", "th"), kind, width).withColumnsRenamed({"id": "its_id", "th": "its_th"})
    whole = rows.join(found, (F.col(id_) == F.col("its_id")) & (F.col("th") == F.col("its_th")), "left").select(*own.inside, "t", "repeats")
    schema = own.schema(("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType()))
    return own.back(whole.mapInArrow(_cut_out(width, schema.names), schema), "n_words", "n_removed", "kept_text")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, ties, empty and repeated rows as in drop_repeats()."""
    out = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_sql() -> str:
    return r"""
    with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
    g as (select doc_id, p, array_to_string(list_slice(ws, p, p + 12), ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as p from w)),
    m as (select g, min(doc_id) as least from g group by g),
    gone as (select distinct doc_id, unnest(range(p, p + 13)) as p from g join m using (g) where least < doc_id),
    gs as (select doc_id, list(p) as ps from gone group by doc_id)
    select doc_id, len(ws)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
           sha256(coalesce(array_to_string(case when ps is null then ws else (select list(w order by i) from (select unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i) where not list_contains(ps, i)) end, ' '), '')) as kept_sha256
    from w left join gs using (doc_id)
    """
