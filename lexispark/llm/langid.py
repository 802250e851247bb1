"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ORDER long, with the counts of the bytes that followed.
A byte's code length under a tree comes from its longest known context; where the byte is new there,
an escape leads to the next shorter one, whose bytes already ruled out are excluded; below the empty
context all bytes left are equally likely. Counts are frozen once learned, so a text's code length
under each language is exact and independent of other texts. The shortest code wins.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.llm.common import Named, cut, drop_cut, pieces, table

ORDER = 3
#: A language learns from so many texts at most, those with the smallest hashes, and in that order
#: from whole texts until so many bytes are reached.
LEARN_TEXTS, LEARN_BYTES = 400, 2_000_000
#: Texts that pass the bound on hashes, to those that are wanted: more than the error of the approximate count.
SPARE = 2
#: Contexts seen less often are left out of the trees.
LEAST_SEEN = 2
#: Up to so many languages' bounds are broadcast (16 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 10_000
UNDETERMINED = "und"


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed, known, lengths): for every byte of the texts, it and up to order bytes before it in its text as an
    integer, how many bytes before it there are (order at most), and the texts' lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    known = np.minimum(np.arange(len(flat)) - starts, order).astype(np.uint8)
    packed = flat.astype(np.uint64)
    for k in range(1, order + 1):
        packed[k:] |= np.where(known[k:] >= k, flat[:-k], 0).astype(np.uint64) << np.uint64(8 * k)
    return packed, known, lengths


def _low(packed: np.ndarray, n: int) -> np.ndarray:
    return packed & np.uint64((1 << 8 * n) - 1)


@dataclass
class Tree:
    """By order: contexts (sorted), their totals and numbers of distinct bytes, for each the total in its
    parent of its own bytes (what an escape excludes), and the sorted context-byte pairs with their counts."""

    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    distinct: list[np.ndarray]
    excluded: list[np.ndarray]
    pairs: list[np.ndarray]
    counts: list[np.ndarray]

    @classmethod
    def learn(cls, texts: list[bytes], order: int = ORDER) -> Tree:
        packed, known, _ = grams(texts, order)
        out = cls([], [], [], [], [], [])
        for k in range(order + 1):
            pairs, counts = np.unique(_low(packed[known >= k], k + 1), return_counts=True)
            contexts, first = np.unique(pairs >> np.uint64(8), return_index=True)
            totals = np.add.reduceat(counts, first) if len(first) else np.empty(0, np.int64)
            if k:
                often = totals >= LEAST_SEEN
                kept = np.repeat(often, np.diff([*first, len(pairs)]))
                contexts, totals, pairs, counts = contexts[often], totals[often], pairs[kept], counts[kept]
                first = np.searchsorted(pairs >> np.uint64(8), contexts)
                # A kept context's suffix is kept too and has all its bytes.
                above = out.counts[k - 1][np.searchsorted(out.pairs[k - 1], _low(pairs, k))]
                out.excluded.append(np.add.reduceat(above, first) if len(first) else np.empty(0, np.int64))
            else:
                out.excluded.append(np.zeros(len(contexts), np.int64))
            out.distinct.append(np.diff([*first, len(pairs)]))
            out.contexts.append(contexts)
            out.totals.append(totals)
            out.pairs.append(pairs)
            out.counts.append(counts)
        return out

    def bits(self, packed: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Code lengths of bytes after contexts, in bits."""
        n = len(packed)
        out, open_ = np.zeros(n), np.ones(n, bool)
        out_total, out_distinct = np.zeros(n, np.int64), np.zeros(n, np.int64)  # what the context above rules out
        for k in range(len(self.contexts) - 1, -1, -1):
            if not len(self.contexts[k]):
                continue
            here = np.nonzero(open_ & (known >= k))[0]
            context = _low(packed[here], k + 1) >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            hit = self.contexts[k][at] == context
            here, at = here[hit], at[hit]
            pair = _low(packed[here], k + 1)
            p = np.minimum(np.searchsorted(self.pairs[k], pair), len(self.pairs[k]) - 1)
            met = self.pairs[k][p] == pair
            total, distinct = self.totals[k][at] - out_total[here], self.distinct[k][at] - out_distinct[here]
            some = np.maximum(total + distinct, 1)
            taken = np.where(met, self.counts[k][p], distinct)
            out[here] += np.where(total > 0, np.log2(some) - np.log2(np.maximum(taken, 1)), 0.0)
            open_[here[met]] = False
            out_total[here], out_distinct[here] = self.excluded[k][at], self.distinct[k][at]
        seen = self.distinct[0][0] if len(self.distinct[0]) else 0
        out[open_] += np.log2(max(256 - seen, 1))
        return out


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def code_lengths(texts: list[bytes], trees: list[Tree]) -> np.ndarray:
    """Bits of each text (rows) under each tree (columns)."""
    import pandas as pd

    order = len(trees[0].contexts) - 1
    packed, known, lengths = grams(texts, order)
    codes, unique = pd.factorize(packed | known.astype(np.uint64) << np.uint64(56))
    packed, known = unique & np.uint64((1 << 56) - 1), (unique >> np.uint64(56)).astype(np.uint8)
    out = np.zeros((len(texts), len(trees)))
    some = lengths > 0
    starts = (np.cumsum(lengths) - lengths)[some]
    for j, tree in enumerate(trees):
        if len(starts):
            out[some, j] = np.add.reduceat(tree.bits(packed, known)[codes], starts)
    return out


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, Tree]:
    """Trees by language, from the rows of labelled whose text and language are not null: of each language a
    bounded sample of its distinct texts (LEARN_TEXTS, LEARN_BYTES), the same for every partitioning.

    A language's approximate number of distinct texts gives a bound on their hashes that about SPARE times as many pass as
    are wanted, and only these are ranked: what meets in a task does not grow with the corpus.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null and text <> ''")
    rows = rows.withColumn("h", F.xxhash64("text"))
    share = SPARE * LEARN_TEXTS / F.approx_count_distinct("h")
    bounds = cut(rows.groupBy("lang").agg(F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise(((2 * share - 1) * float(1 << 63)).cast("bigint")).alias("most")))
    few = bounds.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    found = cut(rows.join(F.broadcast(bounds) if few else bounds, "lang").where("h <= most").groupBy("lang", "h").agg(F.min("text").alias("text")))
    drop_cut(bounds)
    order = W.partitionBy("lang").orderBy("h")
    before = F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = found.select("lang", "h", F.row_number().over(order).alias("r"), before.alias("bytes")).where((F.col("r") <= LEARN_TEXTS) & (F.col("bytes") < LEARN_BYTES))
    sample = found.join(kept.select("lang", "h"), ["lang", "h"])

    def fit(key, frame):
        import pandas as pd

        texts = [t.encode() for t in frame.sort_values("h")["text"]]
        return pd.DataFrame({"lang": [key[0]], "tree": [pickle.dumps(Tree.learn(texts))]})

    trees = sample.select("lang", "h", "text").groupBy("lang").applyInPandas(fit, "lang string, tree binary").collect()
    drop_cut(found)
    return {r["lang"]: pickle.loads(r["tree"]) for r in sorted(trees, key=lambda r: r["lang"])}


def predict(docs: DataFrame, trees: dict[str, Tree], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns keep (all but the text, unless named) with lang_pred and score; columns of docs with these names are
    replaced, others may have any name.

    score is the winner's share of the languages' probabilities of a byte of the text (their mean by code lengths): 1 over
    the number of languages where none fits better, near 1 where all others need many bits more a byte. A text that is null
    or has no letter is undetermined, as is every text if no language was learned; its score is 0. Among equally short codes
    the first language by name wins. Texts are judged whole and one by one, so repeated rows get equal answers; an empty
    table gives an empty one.
    """
    import pyarrow as pa

    added = ("lang_pred", "score")
    own = Named(docs, *added).keep(keep, *([text_col] if keep is None else []))
    inside = own.inside
    shared = docs.sparkSession.sparkContext.broadcast((list(trees), list(trees.values())))

    def judge(texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        langs, models = shared.value
        told = [i for i, t in enumerate(texts) if langs and t and has_letter(t)]
        out, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if told:
            bits = code_lengths([texts[i] for i in told], models)
            best = bits.argmin(1)
            each = np.array([len(texts[i]) for i in told])[:, None]
            share = 1 / np.exp2((bits.min(1)[:, None] - bits) / each).sum(1)
            for i, b, s in zip(told, best.tolist(), share.tolist(), strict=True):
                out[i], scores[i] = langs[b], s
        return out, scores

    def run(batches):
        for batch in batches:
            for first, part in pieces(batch, len(inside)):
                langs, scores = judge(part)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(part)) for k in range(len(inside))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*inside, *added])

    rows = own.df.select(*inside, F.col(own.at(text_col)).cast("binary").alias("t"))
    return own.back(rows.mapInArrow(run, own.schema(("lang_pred", T.StringType()), ("score", T.DoubleType()))), *added)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the rows that are not held out; a null id counts as an empty text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    digest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = docs.withColumn("held_out", digest % 3 == 1)
    trees = learn(docs.where("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), trees).select("doc_id", "held_out", "lang_pred", "score")
