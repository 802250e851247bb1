import base64
import gzip
import hashlib
import math
import random
import re
import time
import uuid
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from pyspark.sql import functions as F

from lexispark.llm import bpe, common, langid, mixing, quality, scoring, simhash, substrings, urls, warc
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string, taken string"


def docs(spark, rows):
    """Rows (doc_id, text, lang, source), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


# quality rules


def repeated_words(ws):
    seen = {}
    for i in range(len(ws) - 4):
        seen.setdefault(tuple(ws[i : i + 5]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)})


def measured(text):
    ws, lines = brute.words(text), [x for x in (text or "").split("\n") if brute.words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines)), repeated_words(ws)


def test_measures(spark):
    r = random.Random(1)
    texts = [None, "", "\n \t\n", "a b c d e a b c d e", "x " * 3000, "ä#*$ %&|<>\n\nb\r\nb\r\n\x0b\x0c", "\u00a0 \u2003", "a" * 100_000]
    texts += [" ".join(r.choice(["a", "b", "c#", "d\n"]) for _ in range(r.randint(0, 40))) for _ in range(60)]
    got = quality.judge(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()
    for row in got:
        want = measured(texts[row["doc_id"]])
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == want
        assert row["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (row["base_failed"] and row["kept"])


def test_fences_follow_groups(spark):
    r = random.Random(2)
    clean = lambda: " ".join("".join(r.choices("abcdefgh", k=r.randint(3, 8))) for _ in range(60))
    rows = [(i, clean(), "en", "a") for i in range(80)]
    rows += [(100 + i, clean().replace(" ", " # "), "en", "b") for i in range(80)]  # symbols are usual here
    rows += [(200, clean().replace(" ", " # "), "en", "a"), (201, clean(), None, None), (202, clean(), "en", "few"), (203, clean().replace(" ", " # "), "xx", "few")]
    kept = {x["doc_id"]: x["kept"] for x in quality.judge(docs(spark, rows)).collect()}
    assert not kept.pop(200) and all(kept.values())
    assert quality.judge(docs(spark, rows).where("false")).count() == 0
    many = quality.judge(docs(spark, rows), "text", "lang", "source").columns
    assert many.count("n_words") == 1 and "taken" in many


CLASH = ("in_0", "_m", "_lk", "_sk", "_v", "symbols_most", "sk", "range", "key", "_base", "base", "d", "_marks", "_bytes", "_text", "t", "rk", "th", "own_id", "_row", "h", "id")


@pytest.mark.parametrize("name", ["urls", "judge", "mix", "keep_first", "drop_repeats", "encode", "decode", "predict", "score"])
def test_names_that_clash(spark, name):
    """Columns with any names pass through unchanged."""
    text = " ".join(f"word{i}" for i in range(20))
    frame = docs(spark, [(1, text, "en", "a"), (2, text + " x", "en", None), (None, None, None, "b")])
    frame = frame.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce("text", F.lit(""))).alias(c) for c in CLASH])
    out = {
        "urls": lambda: urls.judge(frame, urls.Model(), "text"),
        "judge": lambda: quality.judge(frame),
        "mix": lambda: mixing.mix(frame),
        "keep_first": lambda: simhash.keep_first(frame),
        "drop_repeats": lambda: substrings.drop_repeats(frame),
        "encode": lambda: bpe.encode(frame, keep=frame.columns),
        "decode": lambda: bpe.decode(bpe.encode(frame, keep=frame.columns)),
        "predict": lambda: langid.predict(frame, langid.learn(frame), keep=frame.columns),
        "score": lambda: scoring.score(frame, *scoring.fit(frame), keep=frame.columns),
    }[name]()
    got = out.collect()
    assert len(got) == (2 if name == "keep_first" else 3) and set(CLASH) <= set(out.columns) and "text" in out.columns
    for x in got:
        assert all(x[c] == f"{c} {x['text'] or ''}" for c in CLASH)


def test_sketches_merge(spark):
    frame = docs(spark, [(i, "word " * (10 + i % 7) + f"x{i} " * 3, "en", "ab"[i % 2]) for i in range(90)])
    whole = quality.sketch(quality.measured(frame, "text", "lang", "source"))
    parts = [quality.sketch(quality.measured(frame.where(f"doc_id % 3 = {k}"), "text", "lang", "source")) for k in range(3)]
    merged = quality.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), "_lk", "_sk")
    key = lambda f: sorted(map(tuple, f.select("_lk", "_sk", "metric", "bucket", "n").collect()))
    assert key(whole) == key(merged)


# mixing


def level(sizes):
    """Targets by repeated sharing: the contract's own words."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 30))), None, s) for i, s in enumerate(["a"] * 300 + ["b"] * 5 + ["ä"] * 40 + [None] * 20 + ["z", "zz"])]
    rows += [(3, rows[3][1], None, "a"), (None, "null id here", None, "a"), (None, None, None, "b"), (998, "", None, "empty")]
    out = mixing.mix(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = level(sizes)
    for s in sizes:
        own = [x for x in out if x["source"] == s]
        assert {x["source_size"] for x in own} == {sizes[s]} and own[0]["target"] == pytest.approx(want[s])
        assert abs(sum(x["taken"] for x in own) - want[s]) <= max(x["size"] for x in own) / 2 + 1e-6
        whole = math.floor(own[0]["target"] / sizes[s]) if sizes[s] else 0
        assert all(x["taken"] in (x["size"] * whole, x["size"] * (whole + 1)) and x["taken"] <= 3 * x["size"] for x in own)
    again = mixing.mix(docs(spark, rows[::-1]).repartition(7)).collect()
    key = lambda x: repr((x["doc_id"], x["text"], x["source"], x["taken"]))
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.mix(docs(spark, rows).where("false")).count() == 0


def test_sampling_prefers_quality(spark):
    rows = [(i, "word " * 20 + ("# " * 20 if i % 2 else "more " * 20), None, "a") for i in range(400)] + [(1000 + i, "word " * 40, None, "b") for i in range(400)]
    out = mixing.mix(docs(spark, rows)).where("source = 'a'").collect()
    assert 0 < sum(x["taken"] > 0 for x in out) < 400
    taken = lambda odd: sum(x["taken"] > 0 for x in out if x["doc_id"] % 2 == odd)
    assert taken(0) > 1.5 * taken(1)  # a symbol every other word: a third of the weight


def test_mixing_in_many_ranges(spark, monkeypatch):
    """Small ranges give the same mix; ranges grow in number, not in size; null ids draw apart by their texts."""
    r = random.Random(5)
    rows = [(i if i % 3 else None, " ".join(f"w{r.random()}" for _ in range(r.randint(1, 12))), None, "ab"[i % 5 == 0]) for i in range(3000)]
    frame = docs(spark, rows)
    key = lambda f: sorted(repr((x["text"], x["target"], x["taken"])) for x in f.collect())
    whole = key(mixing.mix(frame))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    assert key(mixing.mix(frame)) == whole
    nulls = {x["taken"] > 0 for x in mixing.mix(frame).where("doc_id is null and source = 'a'").collect()}
    assert nulls == {True, False}


# subword encoding


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def test_bpe_matches_the_library(library):
    model, r = bpe.model_at(None), random.Random(6)
    alphabet = ["a", "b", "th", "e", "'s", "'", "<|endoftext|>", "<|startoftext|>", "<|", " ", "\n", "\x1c", "\u00a0", "\u0130", "\u03a3", "\u0391\u03a3", "e\u0301", "\u00e9", "\u65e5\u672c", "\U0001f600"]
    alphabet += ["1", "\u00b2", "\u00bd", "\u200b", "\u3000", "\u00df", "\ufb01", "</w>", "\u01c5", "_", "-", "\x00", "\ufffd", "\u0345", "\u2177", "QUIET", "ing"]
    texts = ["", "The quick brown fox", "w" * 5000, "ab " * 3000] + ["".join(r.choices(alphabet, k=r.randint(0, 25))) for _ in range(4000)]
    want = library.encode_batch(texts, add_special_tokens=False)
    got = model.encode_batch(texts)
    for text, own, ref in zip(texts, got, want, strict=True):
        assert np.frombuffer(own, "<u4").tolist() == ref.ids, repr(text)
        assert model.decode(own) == library.decode(ref.ids, skip_special_tokens=False)


def test_bpe_trie_matches_plain_merging():
    model, r = bpe.model_at(None), random.Random(8)
    words = {"".join(r.choices("aehinorst", k=r.randint(1, 14))) for _ in range(2000)}
    for word, tokens in model.encode_words(words).items():
        assert tokens == model.merged([*(model.ids[c] for c in word[:-1]), model.ids[word[-1] + bpe.END]])


def test_bpe_pairs_outlive_a_task():
    """What a task's end packs, the next one finds again, and the same tokens come out."""
    model, r = bpe.model_at(None), random.Random(9)
    texts = ["".join(r.choices("aehinorst ", k=200)) for _ in range(50)]
    before, pairs = model.encode_batch(texts), dict(model.pairs)
    model.forget()
    assert not model.pairs and not model.known and not model.runs and len(model.packed) == len(pairs) > 0
    model.forget()  # as of a task without texts
    model.recall()
    assert model.pairs == pairs and not len(model.packed) and model.encode_batch(texts) == before


def test_bpe_work_is_done_once(monkeypatch, library):
    """A run is split once for all texts of a batch, and words that come again outlive what the bound makes room for."""
    import public_tokenizers

    class Counted:
        def __init__(self, pattern):
            self.pattern, self.asked = pattern, []

        def findall(self, text):
            self.asked.append(text)
            return self.pattern.findall(text)

    model, r = bpe.WordBpe(public_tokenizers.path(bpe.VOCABULARY)), random.Random(12)
    model.words = Counted(model.words)
    texts = ["x1y again, it's \u00e9t\u00e9s!! <| a<|"] * 5
    ref = library.encode(texts[0], add_special_tokens=False).ids
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode_batch(texts)] == [ref] * 5
    assert model.words.asked.count("x1y") == 1
    monkeypatch.setattr(bpe, "MOST_KEPT", 75 * bpe.KEPT_LEAST)
    encoded = []
    plain = model.encode_words
    monkeypatch.setattr(model, "encode_words", lambda words: encoded.extend(words) or plain(words))
    for _ in range(12):
        batch = ["common " + " ".join("".join(r.choices("aehinorst", k=12)) for _ in range(40))]
        assert np.frombuffer(model.encode_batch(batch)[0], "<u4").tolist() == library.encode(batch[0], add_special_tokens=False).ids
    assert encoded.count("common") == 1 and len(model.known) + len(model.older[0]) <= 75 + 2 * 41


def test_bpe_frames(spark, library):
    rows = [(1, "Hello WORLD\u00e9", "en", "a"), (None, None, None, None), (2, "", "x", "b"), (2, "", "x", "b"), (3, "a b " * 20_000, None, "c")]
    frame = docs(spark, rows).withColumnRenamed("taken", "ids")
    out = bpe.decode(bpe.encode(frame))
    assert out.columns == ["doc_id", "lang", "source", "n_words", "n_tokens", "ids", "decoded"]
    for row in out.collect():
        text = next(t for d, t, _, _ in rows if d == row["doc_id"]) or ""
        ref = library.encode(text, add_special_tokens=False)
        assert np.frombuffer(row["ids"], "<u4").tolist() == ref.ids and row["n_tokens"] == len(ref.ids) and row["decoded"] == library.decode(ref.ids, skip_special_tokens=False)
    assert bpe.encode(frame.where("false")).count() == 0


# language identification


def plain_bits(texts, text, order=langid.ORDER, least=langid.LEAST_SEEN):
    """Prediction by partial matching with exclusions, byte by byte."""
    counts = {}
    for t in texts:
        for i, b in enumerate(t):
            for k in range(min(i, order) + 1):
                counts.setdefault(t[i - k : i], {}).setdefault(b, 0)
                counts[t[i - k : i]][b] += 1
    counts = {c: n for c, n in counts.items() if not c or sum(n.values()) >= least}
    total = 0.0
    for i, b in enumerate(text):
        out = set()
        for k in range(min(i, order), -1, -1):
            own = {x: n for x, n in counts.get(text[i - k : i], {}).items() if x not in out}
            if text[i - k : i] in counts and own:
                n, d = sum(own.values()), len(own)
                if b in own:
                    total += math.log2((n + d) / own[b])
                    break
                total += math.log2((n + d) / d)
            out |= set(counts.get(text[i - k : i], {}))
        else:
            total += math.log2(256 - len(counts.get(b"", {})))
    return total


def test_code_lengths_match_brute_force():
    r = random.Random(9)
    make = lambda: bytes(r.choice(b"abc\xc3\xa9 ") for _ in range(r.randint(0, 40)))
    learned, told = [make() for _ in range(12)], [make() for _ in range(12)] + [b"", b"zzzz\xff"]
    got = langid.code_lengths(told, [langid.Tree.learn(learned)])[:, 0]
    assert got == pytest.approx([plain_bits(learned, t) for t in told])


def test_language_predictions_match_brute_force(spark):
    """Whole documents: the language of the shortest code, byte by byte, ties and repeated rows as well."""
    learned = {"de": ["der hund und die katze", "ein haus und noch ein haus"], "en": ["the dog and the cat", "a house and another house"], "fr": ["le chien et le chat", "une maison"]}
    told = ["die katze", "the house", "le chat et la maison", "dog dog", "xyz", "zz the der", "the house", "\u00e9\u00e9\u00e9"]
    frame = docs(spark, [(i, t, g, None) for i, (g, t) in enumerate((g, t) for g, ts in learned.items() for t in ts)])
    got = langid.predict(docs(spark, [(i, t, None, None) for i, t in enumerate(told)]), langid.learn(frame)).collect()
    for x in got:
        text = told[x["doc_id"]].encode()
        order = [t.encode() for t in learned]
        bits = {g: plain_bits([t.encode() for t in learned[g]], text) for g in learned}
        assert x["lang_pred"] == min(sorted(bits), key=bits.get) and len(order) == 3
        assert x["score"] == pytest.approx(1 / sum(2 ** ((min(bits.values()) - b) / len(text)) for b in bits.values()))
    same = langid.predict(docs(spark, [(1, "the", None, None)] * 3), {g: langid.Tree.learn([b"x y"]) for g in ("b", "a")} | {}).collect()
    assert {(x["lang_pred"], x["score"]) for x in same} == {("b", 0.5)}


def test_learning_is_bounded(spark, monkeypatch):
    """Texts, then bytes; the smallest hashes, whatever the partitioning, and however often a text occurs."""
    monkeypatch.setattr(langid, "LEARN_TEXTS", 20)
    monkeypatch.setattr(langid, "LEARN_BYTES", 150)
    rows = [(i, f"text number {i % 300}", "en", None) for i in range(900)] + [(i, "one text", "en", None) for i in range(2000)] + [(5, "long " * 1000, "de", None), (6, "short", "de", None)]
    a, b = langid.learn(docs(spark, rows)), langid.learn(docs(spark, rows[::-1]).repartition(6))
    for g in ("en", "de"):
        assert all(np.array_equal(x, y) for x, y in zip(a[g].pairs + a[g].counts, b[g].pairs + b[g].counts, strict=True))
    assert 150 - 20 <= a["en"].totals[0].sum() <= 150 + 20 and a["de"].totals[0].sum() in (5, 5000, 5005)


def test_language_held_out(spark, sf):
    found = langid.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(found) > 30 and np.mean([x["lang"] == x["lang_pred"] for x in found]) >= 0.95


def test_language_edges(spark):
    rows = [(1, "das ist ein kleiner text und noch ein text", "de", None), (2, "this is a little text and another text", "en", None), (None, None, "en", None), (3, "", None, None), (4, "12 34 \u00b2", "en", None), (5, "this", None, None), (6, "das " * 30_000, None, None)]
    frame = docs(spark, rows)
    trees = langid.learn(frame)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(frame, trees).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "de", 2: "en", None: "und", 3: "und", 4: "und", 5: "en", 6: "de"}
    assert all(0 <= v[1] <= 1 for v in got.values()) and got[None][1] == 0
    nothing = langid.learn(frame.where("false"))
    assert nothing == {} and {x["lang_pred"] for x in langid.predict(frame, nothing).collect()} == {"und"}


# URL filters


def plain_rule(host, path):
    fits = [(r, v) for r, v in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits, key=lambda x: len(x[0])) if fits else None


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[end:]
    return rest[:end].translate({c: c + 32 for c in range(65, 91)}), tail[: min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]


def test_urls(spark):
    given = [None, "", "no scheme/x", "http://A.Example.ORG/es/1", "https://example.org/en/12?x#y", "http://example.org/en/2", "ftp://x.com/de/", "http://COM/fr/", "http://telecom/fr/", "http://a.net", "http://\u00c4.org/?/", "a://b://c/d", "http://org?x/", "http://x.com/fr/\n/z"]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(given)], "page_id bigint, url string, html string, host string")
    labelled = spark.createDataFrame([("x.com", "/a", "block"), ("y.org", "/b", "allow")] * 3, "host string, path string, verdict string")
    model = urls.learn(labelled)
    for row in urls.judge(pages, model).collect():
        host, path = plain_parts(given[row["page_id"]])
        fits = plain_rule(host, path)
        assert (row["host"], row["path"], row["rule"]) == (host, path, fits[0] if fits else None)
        assert row["verdict"] == (fits[1] if fits else "block" if row["block_score"] > 0.5 else "allow")
        rows, slots = urls.features([host], [path])
        z = model.bias + sum(model.weights[s] for s in slots) / math.sqrt(max(1, len(slots)))
        assert row["block_score"] == pytest.approx(1 / (1 + math.exp(-z)))
    assert urls.judge(pages.where("false"), model).count() == 0
    assert urls.learn(labelled.where("false")).chance(["a"], ["/"]).tolist() == [0.5]


def test_url_model_generalises(spark):
    """Trained on some of the labelled URLs, it agrees with the rules on others."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect()
    told = [(h, p, f[1] == "block") for h, p in (plain_parts(x["url"]) for x in pages) if (f := plain_rule(h, p))]
    train, test = told[::2], told[1::2]
    model = urls.Model().fit([t[0] for t in train], [t[1] for t in train], [t[2] for t in train])
    right = (model.chance([t[0] for t in test], [t[1] for t in test]) > 0.5) == np.array([t[2] for t in test])
    assert right.mean() >= 0.85


# scoring


def plain_log_probability(network, ids, i):
    """Of token i given its neighbours: the class among all, then the id among its class's."""
    table, tops, rows, top_bias, bias = (p.astype(float) for p in network.parts)
    h = np.tanh(sum(table[k][ids[i + p] if 0 <= i + p < len(ids) else 0] for k, p in enumerate(scoring.PLACES)))
    own = max(c for c in range(len(scoring.FIRST) - 1) if scoring.FIRST[c] <= ids[i])
    inside = range(scoring.FIRST[own], scoring.FIRST[own + 1])
    log_share = lambda z, at: z[at] - z.max() - math.log(np.exp(z - z.max()).sum())
    return log_share(tops @ h + top_bias, own) + log_share(rows[inside] @ h + bias[inside], ids[i] - inside[0])


def test_network_is_a_distribution_and_learns():
    r = np.random.default_rng(3)
    targets = r.integers(1, 30, 40_000)
    near = np.stack([np.roll(targets, -p) for p in scoring.PLACES])
    near[2] = (targets * 7) % 30  # the next token tells the target
    start = scoring.Network.start(np.bincount(targets, minlength=scoring.IDS).astype(float))
    before = start.log_probabilities(targets, near).mean()
    model = scoring.Network(start.flat.copy())
    model.train(targets, near, model.past())
    model.train(targets, near, model.past())
    assert model.log_probabilities(targets, near).mean() > before + 0.3
    every = np.arange(1, scoring.IDS)
    for m in (start, model):
        assert np.exp(m.log_probabilities(every, np.repeat(near[:, :1], len(every), 1))).sum() == pytest.approx(1, abs=1e-4)


def test_gradients_match_differences():
    """One training step against numeric derivatives of the plain definition."""
    r = np.random.default_rng(5)
    ids = r.choice([1, 2, 17, 70, 600, scoring.IDS - 1, 3], 60)
    network = scoring.Network(r.normal(0, 0.3, scoring.Network.SIZE))
    targets, near = scoring.examples(ids, np.array([len(ids)]))
    loss = lambda: -sum(plain_log_probability(network, ids, i) for i in range(len(ids)))
    full = [np.zeros(s) for s in scoring.Network.SHAPES]
    for part, at, step in network.gradients(targets, near):
        full[part][at] += step
    checked = 0
    for part, rows in ((0, [(1, 17, 3), (2, 0, 0), (3, 600, 15), (0, 5, 5)]), (1, [(0, 3), (60, 1)]), (2, [(1, 2), (600, 7), (4, 4)]), (3, [(0,), (20,)]), (4, [(70,), (18,)])):
        for at in rows:
            own, kept = network.parts[part], network.parts[part][at]
            own[at] = kept + 1e-2
            up = loss()
            own[at] = kept - 1e-2
            down = loss()
            own[at] = kept
            assert full[part][at] == pytest.approx((up - down) / 2e-2, abs=5e-3)
            checked += full[part][at] != 0
    assert checked > 7
    before, past = [p.copy() for p in network.parts], network.past()
    network.train(targets, near, past)
    for p, b, g in zip(network.parts, before, full, strict=True):
        assert np.allclose(p, b - scoring.RATE * g / np.sqrt(1 + g * g), atol=1e-4)


def test_scores(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    tokens, network = scoring.fit(frame)
    rows = [(1, "The of a b", "en", "a"), (None, None, None, None), (2, " \n", None, None), (3, "the quick " * 700, None, None), (1, "The of a b", "en", "a"), (4, "x", None, None)]
    got = scoring.score(docs(spark, rows), tokens, network).collect()
    assert len(got) == len(rows)
    for row in got:
        text = next(t for d, t, _, _ in rows if d == row["doc_id"])
        ids = tokens.ids(scoring.words_of((text or "").encode())).tolist()
        at = range(len(ids)) if len(ids) < 50 else [0, 1, 2, 3, len(ids) - 2, len(ids) - 1]
        want = [plain_log_probability(network, ids, i) for i in at]
        if len(ids) > 50:  # the middle repeats itself
            want += [want[2] * (len(ids) - 4) / 2 - want[2], want[3] * (len(ids) - 4) / 2 - want[3]]
        assert row["log_likelihood"] == pytest.approx(sum(want), rel=1e-4, abs=1e-3)
        assert row["n_tokens"] == len(ids) and (row["perplexity"] is None) == (not ids)
    counted = {bytes(x["word"]): x["n"] for x in scoring.count_words(frame).collect()}
    want = {}
    for x in frame.collect():
        for w in scoring.words_of((x["text"] or "").encode()):
            want[w] = want.get(w, 0) + 1
    assert counted == want
    nothing = scoring.fit(frame.where("false"))
    assert scoring.score(frame.where("false"), *nothing).count() == 0 and scoring.score(frame, *nothing).where("log_likelihood > 0").count() == 0


def test_different_words_are_looked_up_once(spark, monkeypatch):
    """Words that repeat cost one look and one hash, and a worker keeps none but those it is given."""
    import pyarrow as pa
    import xxhash

    hashed, plain = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda word, seed=0: hashed.append(word) or plain(word, seed))
    tokens = scoring.Tokens([b"the", b"of"])
    words = [b"the", b"rare\xff", b"of", b"rare\xff", b"other"] * 1000
    want = [1, *(1 + scoring.OWN + plain(w, 0) % scoring.HASHED for w in (b"rare\xff", b"other"))]
    for given in (words, pa.array(words, pa.binary())):
        assert tokens.ids(given).tolist() == [want[0], want[1], 2, want[1], want[2]] * 1000
    assert sorted(hashed) == [b"other"] * 2 + [b"rare\xff"] * 2
    assert all(len(x) == 2 for x in vars(tokens).values())
    assert tokens.ids([]).tolist() == []
    frame = docs(spark, [(1, "a b a", "en", "a"), (2, None, "en", "a")])
    nothing = scoring.count_words(frame.where("false"))
    got = {x["doc_id"]: x for x in scoring.score(frame, *scoring.fit(frame.where("false")), counts=nothing).collect()}
    assert got[1]["n_tokens"] == 3 and -1e3 < got[1]["log_likelihood"] < 0 and got[2]["log_likelihood"] == 0


def test_training_is_the_weighted_mean_over_partitions(spark):
    """Each partition trains a copy on all its rows of the round, copies of a text included, and the copies are averaged
    by their tokens; a single document reaches the weights."""
    rows = [(i, f"one text for many rows x{i % 3}", "en", "a") for i in range(40)] + [(7, "one row", "en", "a")] * 20 + [(9, None, "en", "a"), (10, " ", "en", "a")]
    frame = docs(spark, rows).repartition(3).sortWithinPartitions("doc_id").cache()
    counts = scoring.count_words(frame).cache()
    tokens, network = scoring.fit(frame, counts=counts)
    keyed = frame.withColumns({"p": F.spark_partition_id(), "turn": F.pmod(common.row_key(frame), F.lit(scoring.ROUNDS))}).collect()
    assert {x["turn"] for x in keyed} == {0, 1}
    now = scoring.Network.start(scoring.id_counts(counts, tokens)[0]).flat.astype(float)
    for turn in range(scoring.ROUNDS):
        total, added = 0, 0
        for p in range(3):
            words = [scoring.words_of(x["text"].encode()) for x in keyed if x["p"] == p and x["turn"] == turn and x["text"] is not None]
            targets, near = scoring.examples(tokens.ids([w for x in words for w in x]), np.array(list(map(len, words))))
            copy = scoring.Network(now.copy())
            copy.train(targets, near, copy.past())
            added, total = added + len(targets) * (copy.flat.astype(float) - now.astype(np.float32)), total + len(targets)
        now = now.astype(np.float32) + added / total
    assert np.allclose(network.flat, now, atol=1e-4)
    _, alone = scoring.fit(docs(spark, [(1, "a b a b a c", "en", "a")]))
    assert not np.array_equal(alone.parts[0], scoring.Network.start(np.zeros(scoring.IDS)).parts[0])


def test_every_word_has_a_probability(spark, monkeypatch):
    """Words of one shared id score by their counts, held by workers or joined, and with the unseen they sum to 1."""
    words = [f"w{i}" for i in range(scoring.OWN + 3000) for _ in range(1 + i % 7 + 900 // (1 + i))]
    frame = docs(spark, [(i, " ".join(words[i::40]), "en", "a") for i in range(40)])
    counts = scoring.count_words(frame).cache()
    tokens, network = scoring.fit(frame, counts=counts)
    n = {bytes(x["word"]): x["n"] for x in counts.collect()}
    ids = dict(zip(n, tokens.ids(list(n)), strict=True))
    shared = next(k for k in ids.values() if k > scoring.OWN)
    told = sorted((w for w, k in ids.items() if k == shared), key=n.get)
    junk = next(w for w in (b"junk%d" % i for i in range(10_000)) if tokens.ids([w]) == [shared])
    texts = [*(w.decode() for w in [junk, *told]), "w0 " + told[0].decode() + " " + junk.decode(), None, ""]
    rows = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    plain = {x["doc_id"]: x["log_likelihood"] for x in scoring.score(rows, tokens, network).collect()}
    total = sum(n[w] + 0.5 for w in told) + 0.5
    share = [math.log((n.get(w, 0) + 0.5) / total) for w in [junk, *told]]
    want = [*share, share[0] + share[1], 0, 0]
    assert sum(map(math.exp, share)) == pytest.approx(1) and len(told) > 2 and n[told[-1]] > n[told[0]]
    for held in (0, 3000, 200_000):
        monkeypatch.setattr(scoring, "COMMON", held)
        got = scoring.score(rows, tokens, network, counts=counts).collect()
        assert len(got) == len(texts) and got[0].asDict().keys() == scoring.score(rows, tokens, network).first().asDict().keys()
        for x in got:
            assert x["log_likelihood"] - plain[x["doc_id"]] == pytest.approx(want[x["doc_id"]], abs=1e-6)
    empty = frame.where("false")
    assert scoring.score(empty, *scoring.fit(empty), counts=scoring.count_words(empty)).count() == 0


# WARC


PAGE = '<html><head><title>T &amp; U</title><script>var x = "</p>";</script><style>p{}</style></head><body><!-- no --><p>One  <b>two</b></p><p>caf&eacute; 1 < 2</p></body></html>'


def test_warc_text_and_links(spark):
    rows = [(1, "http://a.org/x", PAGE), (1, "http://a.org/x", PAGE), (2, None, None), (None, "u", ""), (3, "http://b\r\nEvil: 1", "<p>" + "long " * 30_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, block string")
    out = warc.derivatives(pages).collect()
    assert len(out) == 3 * len(rows)
    assert [x["block"] for x in out if x["page_id"] == 1 and x["record_type"] == "conversion"] == ["T & U\nOne two\ncaf\u00e9 1 < 2"] * 2
    for x in out:
        source = [y for y in out if y["record_type"] == "response" and y["page_id"] == x["page_id"]][0]
        assert x["refers_to"] == (None if x["record_type"] == "response" else source["record_id"]) and x["payload_digest"] == source["payload_digest"]
        if x["block"] is not None:
            assert x["content_length"] == len(x["block"].encode()) and x["block_digest"] == warc.digest(x["block"].encode())
    meta = next(x for x in out if x["page_id"] == 1 and x["record_type"] == "metadata")
    text = next(x for x in out if x["page_id"] == 1 and x["record_type"] == "conversion")
    assert f"text-record-id: {text['record_id']}\r\n" in meta["block"] and "source-http-content-type: text/html; charset=utf-8\r\n" in meta["block"]
    assert warc.derivatives(pages.where("false")).count() == 0


class Reader(HTMLParser):
    """Plain text by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in warc.SILENT
        self.out.append("\n" if tag in warc.BREAKS else "")

    def handle_startendtag(self, tag, attrs):
        self.out.append("\n" if tag in warc.BREAKS else "")

    def handle_endtag(self, tag):
        if tag in warc.SILENT:
            self.silent -= 1
            self.out.append(" ")
        self.out.append("\n" if tag in warc.BREAKS else "")

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_data(self, data):
        self.out.append("" if self.silent else data)


def read_plainly(page):
    r = Reader()
    r.feed(page)
    r.close()
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in "".join(r.out).split("\n"))
    return "\n".join(x for x in lines if x)


def test_warc_query_matches_brute_force(spark, sf):
    """All records of all pages, from the standard library alone."""
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    urn = lambda *p: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(p))}>"
    got = {(x["page_id"], x["record_type"]): x for x in warc.op9_warc_derivatives(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == 3 * len(pages)
    for page in pages:
        body, uri = (page["html"] or "").encode(), page["url"] or ""
        own = urn(uri, str(page["page_id"]), sha1(body))
        response, meta, text = (got[page["page_id"], k] for k in ("response", "metadata", "conversion"))
        assert response["record_id"] == own and response["content_length"] == len(body) + len("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: \r\n\r\n") + len(str(len(body)))
        plain = read_plainly(page["html"] or "")
        assert text["block"] == plain and text["record_id"] == urn(own, "conversion") and text["refers_to"] == meta["refers_to"] == own
        assert {text["payload_digest"], meta["payload_digest"], response["payload_digest"]} == {sha1(body)}
        assert text["block_digest"] == sha1(plain.encode()) and meta["block_digest"] == sha1(meta["block"].encode())
        told = dict(x.split(": ", 1) for x in meta["block"].split("\r\n") if x)
        assert told["text-digest"] == sha1(plain.encode()) and told["text-record-id"] == text["record_id"] and told["source-content-length"] == str(len(body))
        assert all(x["target_uri"] == uri for x in (response, meta, text))


@pytest.mark.parametrize("page", ["<!--" * 50_000, "<a " * 60_000, "<p" * 60_000, "<script>" * 30_000, "</script" * 30_000, "<" * 200_000, "&#" + "9" * 100_000 + ";", "<!-- x --" * 30_000, "<style>" + "</style " * 30_000])
def test_hostile_pages_take_linear_time(page):
    began = time.monotonic()
    warc.plain_text(page)
    assert time.monotonic() - began < 1.0


def test_plain_text_of_odd_pages():
    assert warc.plain_text("a<!-- b") == "a" and warc.plain_text("a <b c") == "a <b c" and warc.plain_text("1 < 2 <3> x") == "1 < 2 <3> x"
    assert warc.plain_text("x<script>y") == "x" and warc.plain_text("x<SCRIPT a>y</Script >z<br/>w&#x110000;&#99999999999;&amp;lt;") == "x z\nw\ufffd\ufffd&lt;"


def raw_record(kind, block, length=None, more=""):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{kind}>\r\nWARC-Target-URI: http://a\r\n{more}Content-Length: {len(block) if length is None else length}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_warc_faults_and_marks_in_blocks():
    inner = b"text WARC/1.1 and WARC/1.0\r\nWARC-Type: fake\r\nContent-Length: 3\r\n\r\nabc" * 3
    data = b"junk" + raw_record("one", inner) + raw_record("bad", b"xy", "many") + raw_record("two", b"") + b"WARC/1.0\r\nWARC-Type: headless" + raw_record("three", b"z", more="X-Long: a\r\n  b\r\n") + raw_record("cut", b"abc", 99)
    for form in (data, gzip.compress(data[:50]) + gzip.compress(data[50:])):
        got = [(warc.named(f, "warc-type"), b, fault) for f, b, fault in warc.parse(form)]
        assert [(k, x) for k, _, x in got] == [("one", None), ("bad", "no length"), ("two", None), (None, "no end of the head"), ("three", None), ("cut", "cut off")]
        assert got[0][1] == inner and got[4][1] == b"z" and got[5][1].startswith(b"abc")
    assert list(warc.parse(b"")) == [] and warc.fields_of("x\r\nA: 1\r\n b\r\nbad") == [("A", "1 b")]


def test_bodies_are_decoded():
    head = lambda *x: b"HTTP/1.1 200 OK\r\n" + "\r\n".join(x).encode() + b"\r\n\r\n"
    text = "<p>caf\u00e9 na\u00efve</p>"
    latin = head("Content-Type: text/html; charset=iso-8859-1") + text.encode("latin-1")
    meta = head("Content-Type: text/html") + b"<meta charset='windows-1252'>" + text.encode("latin-1")
    zipped = gzip.compress(text.encode())
    chunks = b"".join(b"%x;q=1\r\n%s\r\n" % (len(zipped[i : i + 7]), zipped[i : i + 7]) for i in range(0, len(zipped), 7)) + b"0\r\n\r\n"
    coded = head("Transfer-Encoding: chunked", "content-encoding: gzip") + chunks
    raw = zlib.compressobj(wbits=-15)
    deflated = head("Content-Encoding: deflate") + raw.compress(text.encode()) + raw.flush()
    odd = head("Content-Type: text/html; charset=nothing-such") + text.encode()
    for block in (latin, meta, coded, deflated, odd):
        assert warc.derive("<x>", "u", warc.DATE, block)[1][5] == "caf\u00e9 na\u00efve".encode()
    assert warc.unchunked(b"no chunks") == b"no chunks" and warc.unchunked(b"3\r\nabc\r\nzz\r\n") == b"abczz\r\n"
    broken = head("Content-Encoding: gzip") + b"not gzip"
    assert warc.derive("<x>", "u", warc.DATE, broken)[1][5] == b"not gzip"


def test_warc_files(spark, tmp_path):
    """Responses written to files, read, derived, written and read again, blocks of any bytes whole."""
    body = warc.http_response(PAGE.encode()) + bytes(range(256)) + b" WARC/1.1\r\n end"
    own = warc.record_id("x")
    raw = warc.record("warcinfo", warc.record_id("i"), "", warc.DATE, "application/warc-fields", b"a: b\r\n\r\nWARC/1.1 no\r\n") + warc.record("response", own, "http://a\r\nX: y", "2020-01-01T00:00:00Z", "application/http", body, payload="sha1:GIVEN")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc").write_bytes(raw)
    (tmp_path / "in/b.warc.gz").write_bytes(gzip.compress(raw_record("resource", b"r")) + gzip.compress(raw_record("response", b"cut", 10_000)))
    (tmp_path / "in/c.warc").write_bytes(b"")
    records = warc.read(spark, str(tmp_path / "in"))
    found = {x["record_type"] + (x["fault"] or ""): bytes(x["block"]) for x in records.collect()}
    assert found["response"] == body and found["resource"] == b"r" and set(found) == {"warcinfo", "response", "responsecut off", "resource"}
    derived = warc.derive_records(records)
    got = {r["record_type"]: r for r in derived.collect()}
    assert {k: (r["refers_to"], r["target_uri"], r["warc_date"], r["payload_digest"]) for k, r in got.items()} == {k: (own, "http://a X: y", "2020-01-01T00:00:00Z", "sha1:GIVEN") for k in ("metadata", "conversion")}
    told = bytes(got["metadata"]["block"]).decode()
    assert "source-warc-warc-payload-digest: sha1:GIVEN\r\n" in told and "source-warc-content-type: application/http\r\n" in told and "source-http-content-type: text/html; charset=utf-8\r\n" in told
    everything = records.where("fault is null").unionByName(derived)
    warc.write(everything, str(tmp_path / "out"))
    parts = list((tmp_path / "out").glob("part-*.gz"))
    assert parts and all(gzip.decompress(p.read_bytes())[:9] in (b"WARC/1.1\r", b"") for p in parts)
    back = warc.read(spark, str(tmp_path / "out"))
    key = lambda f: sorted(repr((r["record_type"], r["record_id"], r["refers_to"], r["payload_digest"], bytes(r["block"]), r["fault"])) for r in f.collect())
    assert key(back) == key(everything)
    assert warc.derive_records(records.where("false")).count() == 0
