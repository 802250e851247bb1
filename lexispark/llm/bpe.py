"""Subword encoding and decoding of whole texts, by a trie over distinct words.

What a prefix's encoding ends with depends on that prefix alone, so words that share a prefix share its
work. Distinct words are inserted into a trie; a depth-first walk gives each node the last token of its
prefix's encoding; a word's tokens follow by stepping back from its end, token by token.

A token that ends a prefix is its encoding's last one if and only if merging the symbols of that token
and of the last token before it leaves the two apart.
"""

from __future__ import annotations

import functools
import json
import string
import struct
from collections.abc import Iterable
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.llm.common import Named, give_back, pieces, table

#: Characters of words, and as many of runs, whose encodings a worker keeps during a task (a short one counts as KEPT_LEAST), and pairs whose test it
#: keeps. Words and runs that were not met again go in two steps, so that common ones stay; pairs start afresh beyond that.
MOST_KEPT, KEPT_LEAST, MOST_PAIRS = 12_000_000, 40, 1_000_000
#: Characters of a word up to which states are found when asked for.
DEEP = 100
#: Characters by which the lengths of tokens are looked up, first of those that have LONG_TAIL at least, and the lengths
#: of the tokens that have less than TAIL.
LONG_TAIL, TAIL, SHORT = 6, 3, (2, 1)
VOCABULARY = "word_bpe_49k.json"
END = "</w>"
#: Texts of these characters alone are their own canonical composition and lower-case character by
#: character, and all engines class them alike; the library's normalizer takes the rest.
PLAIN = r"[^\t\n\r\x20-\x7e¡-ɏ]"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next from 256 on."""
    moved = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(moved)) for b in range(256)]


class WordBpe:
    """The merges of a word-end vocabulary file of the tokenizers library (decoder, unknown token and dropout unset)."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        assert model["type"] == "BPE" and model["end_of_word_suffix"] == END and spec["decoder"] is None
        self.ids: dict[str, int] = model["vocab"]
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max([*self.ids.values(), *self.specials.values()]))
        for name, i in (*self.ids.items(), *self.specials.items()):
            self.names[i] = name
        lengths: dict[str, dict[str, set[int]]] = {"": {}, END: {}}
        longer: dict[str, dict[str, set[int]]] = {"": {}, END: {}}
        for name in self.ids:
            body, end = (name[: -len(END)], END) if name.endswith(END) and len(name) > len(END) else (name, "")
            if len(body) < LONG_TAIL:
                lengths[end].setdefault(body[-TAIL:], set()).add(len(body))
            else:
                longer[end].setdefault(body[-LONG_TAIL:], set()).add(len(body))
        #: By word end or not, and by the last TAIL characters: the lengths of the tokens that may end a prefix, the longest first.
        self.lengths = {end: {tail: tuple(sorted({*found, *SHORT}, reverse=True)) for tail, found in own.items()} for end, own in lengths.items()}
        #: The same by the last LONG_TAIL characters, of the tokens that have so many.
        self.longer = {end: {tail: tuple(sorted(found, reverse=True)) for tail, found in own.items()} for end, own in longer.items()}
        #: Characters of each token.
        self.sizes = [len(name) - len(END) if name.endswith(END) and len(name) > len(END) else len(name) for name in self.names]
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self.odd = regex.compile(PLAIN)
        self.symbols = byte_symbols()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}  # pieces
        self.runs: dict[str, bytes] = {}  # between white spaces
        self.kept = [0, 0]  # characters in each of the two
        self.older: list[dict[str, bytes]] = [{}, {}]  # what the two held before; what is met again goes back to them
        self.packed = np.empty((0, 3), np.int32)  # pairs, between tasks

    def symbols_of(self, token: int) -> list[int]:
        name = self.names[token]
        body, end = (name[: -len(END)], True) if name.endswith(END) and len(name) > len(END) else (name, False)
        out = [self.ids[c] for c in body]
        if end:
            out[-1] = self.ids[body[-1] + END]
        return out

    def merged(self, symbols: list[int]) -> list[int]:
        """Plain merging, by rank and from the left: the definition, for short sequences."""
        out, merges, none = list(symbols), self.merges, (1 << 30, 0)
        found = [merges.get(pair, none) for pair in zip(out, out[1:])]
        while found:
            least = min(found)
            if least is none:
                break
            i = found.index(least)
            out[i : i + 2] = [least[1]]
            del found[i]
            if i:
                found[i - 1] = merges.get((out[i - 1], out[i]), none)
            if i < len(found):
                found[i] = merges.get((out[i], out[i + 1]), none)
        return out

    def apart(self, a: int, b: int) -> bool:
        """Whether token b may follow token a in an encoding; a is -1 at a word's start."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            found = self.merged(self.symbols_of(b)) == [b] if a < 0 else self.merged(self.symbols_of(a) + self.symbols_of(b)) == [a, b]
            self.pairs[a, b] = found
        return found

    def last_token(self, word: str, n: int, lasts: list[int | None], end: str = "") -> int:
        """The last token of the first n characters of word. lasts[k] is that of its first k characters, None
        until it is asked for: then it is found here and kept for all words that share these characters."""
        ids, pairs = self.ids, self.pairs
        lengths = self.lengths[end].get(word[n - TAIL if n > TAIL else 0 : n], SHORT)
        if n >= LONG_TAIL:
            longer = self.longer[end].get(word[n - LONG_TAIL : n])
            if longer is not None:
                lengths = longer + lengths
        for length in lengths:
            if length <= n:
                token = ids.get(word[n - length : n] + end)
                if token is not None:
                    before = lasts[n - length]
                    if before is None:
                        before = lasts[n - length] = self.last_token(word, n - length, lasts)
                    found = pairs.get((before, token))
                    if found or found is None and self.apart(before, token):
                        return token
        raise ValueError(f"no token ends {word[:n]!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The tokens of distinct words (of byte symbols), by depth-first traversal of their trie.

        The trie is held as its words in depth-first order, which is that of their symbols: the path from the root
        to a word is the word, and what two neighbours share is the path to the node where they part. On the way
        from one word to the next, the states of the nodes above that one stay, and those below are dropped.
        """
        out: dict[str, list[int]] = {}
        sizes = self.sizes
        path, lasts = "", [-1]  # lasts[k]: the state of the node that is k characters down the path
        for word in sorted(words):
            shared, n = 0, len(word)
            most = min(len(path), n)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            lasts[shared + 1 :] = [None] * (n - shared)
            path = word
            for k in range(DEEP, n):  # far down, states are found on the way, as asking for them later would nest too deeply
                if lasts[k] is None:
                    lasts[k] = self.last_token(word, k, lasts)
            token = self.last_token(word, n, lasts, END)
            tokens, at = [token], n - sizes[token]
            while at:
                token = lasts[at]
                if token is None:
                    token = lasts[at] = self.last_token(word, at, lasts)
                tokens.append(token)
                at -= sizes[token]
            out[word] = tokens[::-1]
        return out

    def split(self, text: str) -> list[str]:
        """The pieces that are encoded apart, in byte symbols; special tokens stand as themselves."""
        if "<|" in text:
            parts = self.special.split(text)
            if len(parts) > 1:
                return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.split(part))]
        if text.isascii() and not self.odd.search(text):
            return self.words.findall(text.lower())
        if not self.odd.search(text):
            s = self.symbols
            return [w if w.isascii() else "".join([s[b] for b in w.encode()]) for w in self.words.findall(text.lower())]
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def split_run(self, run: str) -> list[str]:
        """split() of a run of a plain text: letters, and ASCII punctuation at their end, need no pattern."""
        low = run.lower()
        if low.isalpha():
            out = [low]
        elif "<|" in run:
            return self.split(run)
        else:
            body = low.rstrip(string.punctuation)
            out = [body, low[len(body) :]] if body.isalpha() else self.words.findall(low)
        if low.isascii():
            return out
        s = self.symbols
        return [w if w.isascii() else "".join([s[b] for b in w.encode()]) for w in out]

    def _unknown(self, k: int, met: set[str]) -> set[str]:
        """Those of the words (k 0) or runs (k 1) met that neither the kept ones nor those kept before have; the latter are kept again."""
        kept, older = (self.known, self.runs)[k], self.older[k]
        out = met.difference(kept)
        back = {x: older[x] for x in out if x in older}
        kept.update(back)
        self._count(k, back)
        return out.difference(back)

    def _count(self, k: int, new: Iterable[str]) -> None:
        self.kept[k] += sum([n if n > KEPT_LEAST else KEPT_LEAST for n in map(len, new)])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's token ids as little-endian unsigned 32-bit integers.

        No piece of a plain text crosses white space, so each distinct run between white spaces is split and
        encoded once; other texts are split as a whole.
        """
        if self.kept[0] > MOST_KEPT // 2:
            self.older[0], self.known, self.kept[0] = self.known, {}, 0
        if self.kept[1] > MOST_KEPT // 2:
            self.older[1], self.runs, self.kept[1] = self.runs, {}, 0
        runs, known = self.runs, self.known
        plain = [None if self.odd.search(t) else t.split() for t in texts]
        fresh = {r: self.split_run(r) for r in self._unknown(1, set().union(*[p for p in plain if p is not None]))}
        whole = [self.split(t) if p is None else () for t, p in zip(texts, plain, strict=True)]
        for name, i in self.specials.items():
            known[name] = np.array([i], "<u4").tobytes()
        missing = self._unknown(0, set(chain.from_iterable((*fresh.values(), *whole))))
        self._count(0, missing)
        self._count(1, fresh)
        for w, tokens in self.encode_words(missing).items():
            known[w] = struct.pack(f"<{len(tokens)}I", *tokens)
        for r, pieces_ in fresh.items():
            runs[r] = known[pieces_[0]] if len(pieces_) == 1 else b"".join([known[w] for w in pieces_])
        return [b"".join(map(known.__getitem__, w) if p is None else map(runs.__getitem__, p)) for p, w in zip(plain, whole, strict=True)]

    def forget(self) -> None:
        """Drops the words and runs that are kept, and packs the pairs: a worker stays, with what it holds, while other
        operators' tasks run."""
        flat = np.fromiter(chain.from_iterable((a, b, apart) for (a, b), apart in self.pairs.items()), np.int32, 3 * len(self.pairs))
        self.packed = np.concatenate((self.packed, flat.reshape(-1, 3)))[-MOST_PAIRS:]
        self.known, self.runs, self.kept, self.older, self.pairs = {}, {}, [0, 0], [{}, {}], {}
        give_back()

    def recall(self) -> None:
        """Unpacks the pairs."""
        self.pairs.update({(a, b): bool(apart) for a, b, apart in self.packed.tolist()})
        self.packed = self.packed[:0]

    def decode(self, ids: bytes) -> str:
        """The tokens' names, joined by one space: what a file without a decoder asks for."""
        names = self.names
        return " ".join(map(names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def model_at(path: str | None) -> WordBpe:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return WordBpe(path)


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns keep (all but the text, unless named) with n_tokens and ids, the packed token ids of the whole text.

    path: of the vocabulary file on every machine; None: the installed public one. Columns of docs named
    n_tokens or ids are replaced, others may have any name. A null text is encoded as an empty one, to no token; very long
    texts are encoded whole. Rows are independent: repeated ones encode equally, and an empty table gives an empty one.
    """
    import pyarrow as pa

    own = Named(docs, "n_tokens", "ids").keep(keep, *([text_col] if keep is None else []))
    inside = own.inside

    def run(batches):
        model = model_at(path)
        model.recall()
        try:
            for batch in batches:
                for first, part in pieces(batch, len(inside), 2_000_000):
                    ids = model.encode_batch([(x or b"").decode("utf-8", "replace") for x in part])
                    counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(part)) for k in range(len(inside))), counts, pa.array(ids, pa.binary())], names=[*inside, "n_tokens", "ids"])
        finally:
            model.forget()

    rows = own.df.select(*inside, F.col(own.at(text_col)).cast("binary").alias("t"))
    return own.back(rows.mapInArrow(run, own.schema(("n_tokens", T.LongType()), ("ids", T.BinaryType()))), "n_tokens", "ids")


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """encoded with the column decoded, the text of its packed ids; null ids decode to a null. A column of that name is
    replaced, others may have any name."""
    import pyarrow as pa

    own = Named(encoded, "decoded")
    inside = own.inside

    def run(batches):
        model = model_at(path)
        for batch in batches:
            for first, part in pieces(batch, len(inside), 2_000_000):
                texts = pa.array([None if x is None else model.decode(x) for x in part], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(part)) for k in range(len(inside))), texts], names=[*inside, "decoded"])

    rows = own.df.select(*inside, F.col(own.at(ids_col)).alias("packed"))
    return own.back(rows.mapInArrow(run, own.schema(("decoded", T.StringType()))), "decoded")


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, empty texts and repeated rows as in encode()."""
    out = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
