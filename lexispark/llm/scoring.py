"""Masked pseudo-likelihood: a network predicts every token from its neighbours on both sides.

Tokens are words: the commonest have ids of their own, all others share hashed ids. The network adds an
embedding for each neighbour's id and place and squashes the sum; from that it predicts the class of the token's
id, and the id within its class, so that thousands of ids cost little more than their classes. A word of a shared
id has a probability among all words of that id too, from the counts of all words of the corpus. A text's score
is the sum, over its tokens, of the log-probability of the token given its neighbours.

Word counts cover the whole corpus, and so does training: every document is in one round. In a round each
partition of the input trains a copy of the network on its documents, where they lie; what the copies learned is
averaged by their numbers of tokens, row by row of the parameters, and starts the next round.
"""

from __future__ import annotations

from collections.abc import Collection
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.llm.common import Named, cut, pieces, row_key, table

#: Sizes of the classes of own words, by falling counts, and of shared ids: small where tokens are many.
OWN_CLASSES, SHARED_CLASSES = (16,) * 4 + (32,) * 14 + (240,) * 30, (32,) * 16
OWN, HASHED, WIDTH = sum(OWN_CLASSES), sum(SHARED_CLASSES), 16
#: Ids: 0 stands beyond a text's ends, then the own words, then the shared ids. Class c has the ids FIRST[c] to FIRST[c + 1] - 1.
IDS = 1 + OWN + HASHED
FIRST = np.cumsum((1, *OWN_CLASSES, *SHARED_CLASSES))
CLASS_OF = np.repeat(np.arange(len(FIRST)), np.diff(FIRST, prepend=0))  # of an id, plus one
#: Places of the neighbours.
PLACES = (-2, -1, 1, 2)
#: Rounds that share all documents among them, targets a step, its size, and targets that are scored at a time.
ROUNDS, BATCH, RATE, BLOCK = 2, 1 << 14, 0.1, 1 << 16
#: Rows of targets whose classes are scored at a time, so that their logits stay in a core's cache.
STRIP = 1 << 12
#: Logits within these bounds are raised as they are.
FAR = 40
#: Words whose counts every worker holds; the counts of all others are joined, to the same scores.
COMMON = 300_000
#: What each word, and all words unseen together, have besides their counts among the words of a shared id.
EXTRA = 0.5
#: Sums of logarithms, and of what copies of the network learned, are of whole multiples of 1 / FINE, so that their order does not tell.
FINE = 1 << 30
LEARNED_FINE = 1 << 16
#: Words that a worker counts before it hands counts on.
MOST_WORDS = 300_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, n) over all texts; a worker sums a task's counts before they are shuffled."""
    import pyarrow as pa

    def run(batches):
        held: list = []  # tables of different words each
        for batch in batches:
            for _, part in pieces(batch, 0):
                found = pa.array(list(chain.from_iterable(map(words_of, part))), pa.binary()).value_counts()
                held.append(pa.table([found.field("values"), found.field("counts")], names=["word", "n"]))
                if sum(x.num_rows for x in held) > 2 * MOST_WORDS:
                    held = [summed(held)]
                    if held[0].num_rows > MOST_WORDS:
                        yield from held.pop().to_batches()
        if held:
            yield from summed(held).to_batches()

    def summed(held):
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    rows = docs.select(F.col(text_col).cast("binary").alias("t")).where("t is not null").mapInArrow(run, "word binary, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _hashes(words: Collection[bytes], seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))


def _different(words) -> tuple[list[bytes], np.ndarray]:
    """(the different ones of a list or an Arrow array of words, the place there of each word), so that each is looked up once."""
    import pyarrow as pa

    told = (pa.array(words, pa.binary()) if isinstance(words, list) else words).dictionary_encode()
    return told.dictionary.to_numpy(zero_copy_only=False).tolist(), told.indices.to_numpy()


def _places(at: dict[bytes, int], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words' values in at, -1 where it has none; the places of the latter)."""
    out = np.fromiter(map(at.get, words, repeat(-1)), np.int64, len(words))
    return out, np.flatnonzero(out < 0)


def _shared_ids(words: list[bytes]) -> np.ndarray:
    return 1 + OWN + (_hashes(words, 0) % np.uint64(HASHED)).astype(np.int64)


class Tokens:
    """Words to ids: own ones by place in the list, from 1 on, others by their hash."""

    def __init__(self, commonest: list[bytes]):
        self.own, self.at = list(commonest), None

    def __getstate__(self):
        return self.own

    def __setstate__(self, own):
        self.own, self.at = own, None

    def ids(self, words) -> np.ndarray:
        """Of a list or an Arrow array of words."""
        if self.at is None:
            self.at = dict(zip(self.own, range(1, 1 + len(self.own)), strict=True))
        each, told = _different(words)
        out, other = _places(self.at, each)
        out[other] = _shared_ids([each[k] for k in other.tolist()])
        return out[told]


def examples(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(target ids, neighbours' ids by place) of texts of these lengths, whose ids follow each other in flat."""
    pad = max(map(abs, PLACES))
    wide = np.zeros(len(flat) + pad * (len(lengths) + 1), np.int64)
    at = np.arange(len(flat)) + pad * (1 + np.repeat(np.arange(len(lengths)), lengths))
    wide[at] = flat
    return flat, np.stack([wide[at + p] for p in PLACES])


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(z's exponentials, in its place, but for a factor a row; the rows' sums; the logs of these factors, None if all are 1)."""
    shift = None
    if z.size and (z.max() > FAR or z.min() < -FAR):
        shift = z.max(1)
        z -= shift[:, None]
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], np.float32), shift


def _logs(z: np.ndarray) -> np.ndarray:
    """Of the sums of the rows' exponentials."""
    _, total, shift = _exponentials(z)
    logs = np.log(total.astype(np.float64))
    return logs if shift is None else logs + shift


class Network:
    """Parameters in one flat vector of rows of WIDTH: an embedding table a place, a row a class, a row an id, the biases."""

    SHAPES = ((len(PLACES), IDS, WIDTH), (len(FIRST) - 1, WIDTH), (IDS, WIDTH), (len(FIRST) - 1,), (IDS,))
    SIZE = -(-sum(int(np.prod(s)) for s in SHAPES) // WIDTH) * WIDTH

    def __init__(self, flat: np.ndarray):
        self.flat, at, self.parts = flat.astype(np.float32), 0, []
        for shape in self.SHAPES:
            n = int(np.prod(shape))
            self.parts.append(self.flat[at : at + n].reshape(shape))  # views
            at += n

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Small fixed random tables, and the frequencies of ids (counts, by id) and classes as biases."""
        rng = np.random.default_rng(11)
        flat = np.zeros(cls.SIZE)
        tables = sum(int(np.prod(s)) for s in cls.SHAPES[:3])
        flat[:tables] = rng.normal(0, 0.1, tables)
        out = cls(flat)
        counts = counts + 1.0
        counts[0] = 0
        by_class = np.add.reduceat(counts[1:], FIRST[:-1] - 1)
        out.parts[3][:] = np.log(by_class / by_class.sum())
        out.parts[4][1:] = np.log(counts[1:] / by_class[CLASS_OF[1:] - 1])
        return out

    def hidden(self, near: np.ndarray) -> np.ndarray:
        table = self.parts[0]
        h = table[0].take(near[0], 0, mode="clip")
        for k in range(1, len(PLACES)):
            h += table[k].take(near[k], 0, mode="clip")
        return np.tanh(h, out=h)

    @staticmethod
    def _by_class(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """(order of targets by class, classes in that order, (class, first, end) of each class met)."""
        own = (CLASS_OF[targets] - 1).astype(np.uint16)
        order = np.argsort(own, kind="stable")
        met = own[order].astype(np.int64)
        first = np.flatnonzero(np.diff(met, prepend=-1)).tolist()
        return order, met, [(int(met[a]), a, b) for a, b in zip(first, [*first[1:], len(met)], strict=True)]

    def log_probabilities(self, targets: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Of each target given its neighbours: of its class, and of the target within that."""
        _, tops, rows, top_bias, bias = self.parts
        out = np.empty(len(targets))
        for i in range(0, len(targets), BLOCK):
            order, classes, runs = self._by_class(targets[i : i + BLOCK])
            order += i
            t, h = targets[order], self.hidden(near[:, order])
            own = np.empty(len(t))
            for a in range(0, len(t), STRIP):
                z = h[a : a + STRIP] @ tops.T
                z += top_bias
                own[a : a + STRIP] = z[np.arange(len(z)), classes[a : a + STRIP]]
                own[a : a + STRIP] -= _logs(z)
            for c, a, b in runs:
                z = h[a:b] @ rows[FIRST[c] : FIRST[c + 1]].T
                z += bias[FIRST[c] : FIRST[c + 1]]
                own[a:b] += z[np.arange(b - a), t[a:b] - FIRST[c]].astype(np.float64)
                own[a:b] -= _logs(z)
            out[order] = own
        return out

    @staticmethod
    def _softmax(h: np.ndarray, rows: np.ndarray, bias: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the summed negative log-probability of the right rows: of h, of the rows and of the bias. The
        exponentials are not scaled to probabilities: what they are multiplied with is."""
        z = h @ rows.T
        z += bias
        z, total, _ = _exponentials(z)
        z[np.arange(len(h)), right] -= total
        scale = 1 / total
        back = z @ rows
        back *= scale[:, None]
        return back, z.T @ (h * scale[:, None]), scale @ z

    def gradients(self, targets: np.ndarray, near: np.ndarray):
        """Of the summed negative log-probability: yields (part, rows of it, gradient of these rows)."""
        _, tops, rows, top_bias, bias = self.parts
        order, classes, runs = self._by_class(targets)
        targets, near = targets[order], near[:, order]
        h = self.hidden(near)
        back, of_tops, of_bias = np.empty_like(h), np.zeros_like(tops), np.zeros_like(top_bias)
        for a in range(0, len(h), STRIP):
            at = slice(a, a + STRIP)
            back[at], step, more = self._softmax(h[at], tops, top_bias, classes[at])
            of_tops += step
            of_bias += more
        yield 1, slice(None), of_tops
        yield 3, slice(None), of_bias
        for c, a, b in runs:
            own = slice(FIRST[c], FIRST[c + 1])
            more, of_rows, of_own = self._softmax(h[a:b], rows[own], bias[own], targets[a:b] - FIRST[c])
            back[a:b] += more
            yield 2, own, of_rows
            yield 4, own, of_own
        h *= h
        back *= np.subtract(1, h, out=h)
        weights, columns = back.ravel(), np.arange(WIDTH)
        for k in range(len(PLACES)):
            own = near[k][:, None] * WIDTH + columns
            yield 0, k, np.bincount(own.ravel(), weights, IDS * WIDTH).reshape(IDS, WIDTH).astype(np.float32)

    def train(self, targets: np.ndarray, near: np.ndarray, past: list[np.ndarray]) -> None:
        """One pass of gradient descent with steps scaled by past gradients, whose squares past sums."""
        for i in range(0, len(targets), BATCH):
            for part, at, step in list(self.gradients(targets[i : i + BATCH], near[:, i : i + BATCH])):
                seen, own = past[part][at], self.parts[part][at]  # views
                seen += step * step
                step *= RATE
                step /= np.sqrt(seen)
                own -= step

    def past(self) -> list[np.ndarray]:
        return [np.ones(s, np.float32) for s in self.SHAPES]


def id_counts(counts: DataFrame, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, different words) of each id, from counts (word, n)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids = tokens.ids(batch.column(0))
            n, kinds = np.bincount(ids, batch.column(1).to_numpy(), IDS).astype(np.int64), np.bincount(ids, minlength=IDS)
            some = np.flatnonzero(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(kinds[some])], names=["id", "n", "kinds"])

    n, kinds = np.zeros(IDS), np.zeros(IDS)
    for r in counts.select("word", "n").mapInArrow(run, "id bigint, n bigint, kinds bigint").groupBy("id").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        n[r["id"]], kinds[r["id"]] = r["n"], r["kinds"]
    return n, kinds


def _learned(tokens: Tokens, flat: np.ndarray):
    """Trains a copy of the network on a partition's texts: rows (row, d0, ...) of parameters, what was added to each times
    the number of tokens, in multiples of 1 / LEARNED_FINE; row -1 holds that number."""

    def run(batches):
        import pyarrow as pa

        model, total = Network(flat.copy()), 0
        past, names = model.past(), ["row", *(f"d{k}" for k in range(WIDTH))]
        for batch in batches:
            for _, part in pieces(batch, 0, 2_000_000):
                words = [words_of(t) for t in part]
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                targets, near = examples(tokens.ids(list(chain.from_iterable(words))), lengths)
                model.train(targets, near, past)
                total += len(targets)
        if total:
            learned = (model.flat.astype(np.float64) - flat).reshape(-1, WIDTH)
            some = np.flatnonzero((learned != 0).any(1))
            scaled = np.rint(learned[some] * (total * float(LEARNED_FINE))).astype(np.int64)
            head = np.zeros((1, WIDTH), np.int64)
            head[0, 0] = total
            rows, scaled = np.append(some, -1).astype(np.int32), np.concatenate((scaled, head))
            yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(np.ascontiguousarray(scaled[:, k])) for k in range(WIDTH))], names=names)

    return run


def fit(docs: DataFrame, text_col: str = "text", counts: DataFrame | None = None) -> tuple[Tokens, Network]:
    """Ids from the counts of all words (count_words(), unless given), and a network trained on all documents. The driver
    sees the own words, a number an id, and sums of the parameters' rows: as much for any corpus."""
    counted = count_words(docs, text_col) if counts is None else counts
    tokens = Tokens([bytes(r["word"]) for r in counted.orderBy(F.desc("n"), "word").limit(OWN).collect()])
    network = Network.start(id_counts(counted, tokens)[0])
    own = Named(docs)
    rows = own.df.select(F.col(own.at(text_col)).cast("binary").alias("t"), F.pmod(row_key(own.df), F.lit(ROUNDS)).alias("turn")).where("t is not null")
    sums = [F.sum(f"d{k}").alias(f"d{k}") for k in range(WIDTH)]
    fields = "row int, " + ", ".join(f"d{k} bigint" for k in range(WIDTH))
    for turn in range(ROUNDS):
        learned = rows.where(F.col("turn") == turn).select("t").mapInArrow(_learned(tokens, network.flat), fields)
        found = learned.groupBy("row").agg(*sums).toArrow()
        if not found.num_rows:
            continue
        at = found["row"].to_numpy()
        added = np.stack([found[f"d{k}"].to_numpy() for k in range(WIDTH)], 1)
        total = added[at == -1][0, 0]
        flat = network.flat.astype(np.float64).reshape(-1, WIDTH)
        flat[at[at >= 0]] += added[at >= 0] / (float(total) * LEARNED_FINE)
        network = Network(flat.ravel())
    return tokens, network


def within(counts: DataFrame, tokens: Tokens) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(the COMMON commonest words at most, log(n + EXTRA) of each, log of each id's total with all EXTRAs); the latter
    are 0 for words and ids of their own. A word's log-probability among its id's words is the difference."""
    n, kinds = id_counts(counts, tokens)
    totals = np.log(n + EXTRA * kinds + EXTRA)
    totals[: 1 + OWN] = 0
    least, held = None, 0
    for row in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(COMMON).collect():
        held += row["words"]
        if held > COMMON + len(tokens.own):
            break
        least = row["n"]
    common = dict.fromkeys(tokens.own, 0.0)
    if least is not None:
        found = counts.where(F.col("n") >= least).select("word", "n").toArrow()
        common = dict(zip(found["word"].to_pylist(), np.log(found["n"].to_numpy() + EXTRA).tolist(), strict=True)) | common
    return list(common), np.array(list(common.values())), totals


class _Shared:
    """What workers score with; a worker's words are put in place once and kept over its tasks."""

    def __init__(self, tokens: Tokens, flat: np.ndarray, inner: tuple | None):
        self.flat, self.counted, self.own = flat, inner is not None, None
        self.words, self.logs, self.totals = inner or (tokens.own, np.zeros(len(tokens.own)), np.zeros(IDS))
        self.ids, self.logs = np.append(tokens.ids(self.words), 0), np.append(self.logs, 0.0)  # the last: of a word not held

    def known(self) -> dict[bytes, int]:
        if self.own is None:
            self.own = dict(zip(self.words, range(len(self.words)), strict=True))
        return self.own


def score(docs: DataFrame, tokens: Tokens, network: Network, text_col: str = "text", keep: list[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Columns keep (all but the text, unless named) with n_tokens, log_likelihood (the sum over all tokens of the whole
    text), mean_log_likelihood and perplexity; columns of docs with these names are replaced, others may have any name.

    With counts (word, n), a table of count_words(), each word of a shared id adds its log-probability among all words of
    that id; without, the sum is over ids alone. A null text, or one without words, has no tokens, the sum 0, and null
    mean and perplexity; very long texts are scored whole. Rows are independent: repeated ones score equally, and an
    empty table gives an empty one.
    """
    import pyarrow as pa

    added = ("n_tokens", "log_likelihood", "mean_log_likelihood", "perplexity")
    own = Named(docs, *added).keep(keep, *([text_col] if keep is None else []))
    inside = own.inside
    shared = docs.sparkSession.sparkContext.broadcast(_Shared(tokens, network.flat, None if counts is None else within(counts, tokens)))
    names = [*inside, "n_tokens", "log_likelihood", "rest"]

    def run(batches):
        held = shared.value
        model, inner, logs, totals = Network(held.flat), held.counted, held.logs, held.totals
        for batch in batches:
            for first, part in pieces(batch, len(inside), 2_000_000):
                known = held.known()
                told = [words_of(t) for t in part]
                lengths = np.fromiter(map(len, told), np.int64, len(told))
                flat_words = list(chain.from_iterable(told))
                each, at = _different(flat_words)
                places, other = _places(known, each)
                rare = [each[k] for k in other.tolist()]
                ids = held.ids[places]
                ids[other] = _shared_ids(rare)
                targets, near = examples(ids[at], lengths)
                sums, rest = np.zeros(len(part)), pa.nulls(len(part), pa.list_(pa.int64()))
                if len(targets):
                    some, starts = lengths > 0, np.cumsum(lengths) - lengths
                    found = model.log_probabilities(targets, near)
                    if inner:
                        hashes = np.zeros(len(each), np.int64)
                        hashes[other] = _hashes(rare, 42).view(np.int64)
                        found += logs[places][at] - totals[targets]
                        open_ = np.flatnonzero((places < 0)[at])
                        ends = np.searchsorted(open_, np.cumsum(lengths))
                        rest = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(hashes[at[open_]]), mask=pa.array(np.diff(ends, prepend=0) == 0))
                    sums[some] = np.add.reduceat(found, starts[some])
                columns = [*(batch.column(k).slice(first, len(part)) for k in range(len(inside))), pa.array(lengths), pa.array(sums), rest]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = own.schema(("n_tokens", T.LongType()), ("log_likelihood", T.DoubleType()), ("rest", T.ArrayType(T.LongType())))
    out = own.df.select(*inside, F.col(own.at(text_col)).cast("binary").alias("t")).mapInArrow(run, schema)
    if counts is not None:
        out = _with_rest(out, counts)
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    out = out.withColumn("mean_log_likelihood", mean).withColumn("perplexity", F.exp(-F.col("mean_log_likelihood")))
    return own.back(out, *added)


def _with_rest(scored: DataFrame, counts: DataFrame) -> DataFrame:
    """scored, with log(n + EXTRA) of the words whose hashes are in rest added to log_likelihood; a word without a count
    has n = 0."""
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    words = scored.where("rest is not null").select("row", F.explode("rest").alias("h"))
    term = F.round(F.log(F.coalesce("n", F.lit(0)) + EXTRA) * FINE).cast("bigint")
    known = counts.select(F.xxhash64("word").alias("h"), "n")
    rest = words.join(known, "h", "left").groupBy("row").agg(F.sum(term).alias("more"))
    out = scored.drop("rest").join(rest, "row", "left")
    return out.withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce(F.col("more") / FINE, F.lit(0.0)))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, empty texts and repeated rows as in score()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = cut(count_words(docs))
    return score(docs, *fit(docs, counts=counts), counts=counts)
