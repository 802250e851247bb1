import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import common, forest, graph, simhash, substrings
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, fp string, kept_text int"


def docs(spark, rows, **kinds):
    """Rows (doc_id, text), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, "x", 7) for d, t in rows], SCHEMA)


def sentences(seed, n, size):
    r = random.Random(seed)
    return [" ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randint(0, size))) for _ in range(n)]


def corpus():
    texts = sentences(1, 40, 60)
    copies = [t + " tail" for t in texts[:10]] + texts[:5] + ["  ".join(texts[7].split()) + "\n"]
    passage = " ".join(f"p{i}" for i in range(60))
    holders = [f"{a} {passage} {b}" for a, b in zip(texts[10:16], texts[16:22], strict=True)]
    odd = [None, "", " \t\n", "a", "A", "ß É x", passage, "line one two\n" * 300, "x " * 20000]
    return list(enumerate(texts + copies + holders + odd))


def test_fingerprint_matches_brute_force():
    for _, t in corpus():
        assert simhash.fingerprint(None if t is None else t.encode()) & (1 << 64) - 1 == brute.fingerprint(t)


def test_simhash_classes(spark):
    rows = corpus()
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    want = brute.near_classes(rows)
    assert {r["doc_id"]: (f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in got} == want


def test_simhash_tiles(spark, monkeypatch):
    """Small tiles, hence many pairs of them, give the same links."""
    monkeypatch.setattr(simhash, "TILE_LEAST", 3)
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(12)} | {0, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    found = graph.connected_components(simhash.fingerprint_links(frame)).collect()
    label = {r["node"]: r["component"] for r in found}
    want = brute.components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    groups = {}
    for f, c in zip(signed, want, strict=True):
        groups.setdefault(c, set()).add(label.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_near_pairs_skip_nothing():
    r = np.random.default_rng(4)
    x = r.integers(0, 1 << 63, 60, np.uint64)
    y = np.concatenate([x ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64)) for _ in range(3)] + [x])
    for radius in (0, 2, 4, 20):
        got = {p for i, j in simhash.near_pairs(x, y, radius) for p in zip(i.tolist(), j.tolist(), strict=True)}
        assert got == {(i, j) for i in range(len(x)) for j in range(len(y)) if (int(x[i]) ^ int(y[j])).bit_count() <= radius}


def test_simhash_tiles_stay_small(spark, monkeypatch):
    """Four times the fingerprints: more tiles, none of them larger than the bound."""
    monkeypatch.setattr(simhash, "TILE_LEAST", 64)
    monkeypatch.setattr(simhash, "TILE_MOST", 64)
    seen = []
    for n in (2000, 8000):
        fps = np.random.default_rng(n).integers(0, 1 << 62, n).tolist()
        monkeypatch.setattr(simhash, "_tile_links", lambda radius: lambda found: __import__("pyarrow").table({"a": [max(map(len, found["fps"].to_pylist()))], "b": [found.num_rows]}))
        sizes = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()
        seen.append((max(x["a"] for x in sizes), len(sizes)))
    assert seen[0][0] < 2.5 * 64 and seen[1][0] < 2.5 * 64 and seen[1][1] > 3 * seen[0][1]


def test_keep_first_chooses_the_same_row(spark):
    """Rows of one id and text, apart in other columns only: reruns and other partitionings keep the same one."""
    rows = spark.createDataFrame([(1, "a b c d e", f"x{i}", i) for i in range(30)], "doc_id bigint, text string, in_0 string, rk int")
    kept = [simhash.keep_first(f).collect() for f in (rows, rows.orderBy("rk", ascending=False).repartition(5))]
    assert kept[0] == kept[1] and len(kept[0]) == 1


@pytest.mark.parametrize("few", [0, 1 << 40])
def test_spread_join(spark, monkeypatch, few):
    """Hot keys, broadcast or not, give the same rows."""
    monkeypatch.setattr(common, "FEW", few)
    monkeypatch.setattr(common, "MOST_HOT", 4)
    rows = spark.createDataFrame([(i % 7 if i > 300 else 1, i) for i in range(500)], "k int, v int")
    known = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    got = common.spread_join(rows, known, "k", "n", 500)
    assert got.count() == 500 and got.where("least > v").count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(0, i) for i in range(100, 200)], "a bigint, b bigint")
    assert {r["component"] for r in graph.connected_components(chain).collect()} == {0}


def test_what_a_cut_shuffled_goes_at_once(spark):
    """Not only when the driver collects its garbage: an operator's disk is that of one step."""

    def shuffled():
        return {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}

    before, told = shuffled(), spark.conf.get(common.SHUFFLES_GO)
    rows = spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count()
    out = common.cut(rows)
    until = time.monotonic() + 20
    while shuffled() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(common.SHUFFLES_GO) == told
    assert out.collect() and sorted(out.collect()) == sorted(rows.collect())  # which can run again


def test_simhash_edges(spark):
    empty = docs(spark, []).where("false")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0
    rows = docs(spark, [(3, "same words here now"), (3, "same words here now"), (None, "same words here now"), (None, None), (9, None), (8, "")])
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(rows).collect())
    assert got == [(-1, 3), (-1, 8), (3, 3), (3, 3), (8, 8), (9, 8)]
    kept = simhash.keep_first(rows)
    assert kept.columns == rows.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, "same words here now"), (8, "")]
    alone = docs(spark, [(None, None), (None, None)])
    assert simhash.near_duplicates(alone).where("component_id is null").count() == 2 and simhash.keep_first(alone).count() == 1


def test_components_of_long_chains(spark):
    n = 300
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (None, 3), (2000, 2001), (2001, 2000)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in graph.connected_components(chain).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {2000: 2000, 2001: 2000}


@pytest.mark.parametrize("hot", [1, 3, 300])
def test_substrings_match_brute_force(spark, monkeypatch, hot):
    """With every anchor hot, some, and none."""
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = corpus()
    out = substrings.drop_repeats(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "fp", "n_words", "n_removed", "kept_text"]
    want = brute.without_repeats(rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"].split(" ") if r["kept_text"] else []) for r in out.collect()}
    assert got == want


def test_substrings_edges(spark):
    text = " ".join(f"w{i}" for i in range(20))
    empty = docs(spark, []).where("false")
    assert substrings.drop_repeats(empty).count() == 0
    rows = docs(spark, [(None, text), (5, text), (5, text), (5, text + " other end"), (7, text), (1, None)])
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substrings.drop_repeats(rows).collect())
    assert got == [(-1, 20, 0), (1, 0, 0), (5, 20, 0), (5, 20, 0), (5, 22, 0), (7, 20, 20)]


@pytest.mark.parametrize("hot", [2, 300])
def test_maximal_repeats(spark, monkeypatch, hot):
    """Each repeat stands where it says, and cannot be longer there; together they cover what is to be removed."""
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = corpus()
    words = {d: brute.words(t) for d, t in rows}
    covered = {}
    found = substrings.maximal_repeats(docs(spark, rows)).collect()
    for x in found:
        own, other, n = words[x["doc_id"]], words[x["other"]], x["end"] - x["start"]
        a, b = x["start"], x["other_start"]
        assert n >= 13 and x["other"] < x["doc_id"] and own[a : a + n] == other[b : b + n]
        covered.setdefault(x["doc_id"], set()).update(range(a, a + n))
    assert {d: len(c) for d, c in covered.items()} == {d: v[1] for d, v in brute.without_repeats(rows).items() if v[1]}
    assert max(x["end"] - x["start"] for x in found) >= 60
    stretch = lambda *v: dict(zip(("starts", "at", "n", "other", "place"), v, strict=True))
    assert substrings.joined([stretch([5], 0, 3, 1, 10), stretch([8], 0, 2, 1, 13), stretch([9], 1, 1, 1, 15), stretch([20], 0, 1, 1, 26)], 13) == [(5, 23, 1, 10), (20, 33, 1, 26)]


def test_substrings_random(spark):
    r = random.Random(3)
    for width in (1, 2, 5):
        rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 12)))) for i in range(60)]
        got = {x["doc_id"]: x["n_removed"] for x in substrings.drop_repeats(docs(spark, rows), width=width).collect()}
        assert got == {d: v[1] for d, v in brute.without_repeats(rows, width).items()}


def vectors(n=900, dims=16):
    r = np.random.default_rng(2)
    base = r.normal(size=(n, dims))
    near = base[:200] + r.normal(scale=0.04, size=(200, dims))
    cluster = base[0] + r.normal(scale=0.02, size=(150, dims))
    return np.concatenate([base, near, cluster, base[300:320], base[300:320] * 3])


def neighbours(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= forest.COSINE
    np.fill_diagonal(near, False)
    return near


def test_forest_recall(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF", 100)
    monkeypatch.setattr(forest, "TILE", 64)
    x = vectors()
    frame = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int, n_links int")
    got = {r["vec_id"]: r for r in forest.near_vectors(frame).collect()}
    near = neighbours(x)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.97 * near.sum()
    want = brute.components(len(x), [(i, j) for i, j in np.argwhere(near) if j < i])
    same = np.mean([got[i]["component_id"] == want[i] for i in range(len(x))])
    assert same >= 0.97 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


@pytest.mark.parametrize("sparse", [1, 1 << 40])
def test_forest_splits_fitted_leaves_further(spark, monkeypatch, sparse):
    """With a sample too small for leaves of LEAF vectors, leaves stay as small, and recall stays; links are counted once
    either way, whether near pairs are looked at one by one or all together."""
    monkeypatch.setattr(forest, "LEAF", 60)
    monkeypatch.setattr(forest, "FIT", 64)
    monkeypatch.setattr(forest, "SPARSE", sparse)
    x = vectors(700)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    tree = forest.Tree.fit(u[:64], 16, np.random.default_rng(1), 4)
    row, leaf = tree.leaves_of(u)
    assert set(row) == set(range(len(u))) and leaf.max() < tree.leaves and len(tree.deeper) == 4
    inside = np.bincount(leaf[(row > 0) & ((row < 900) | (row >= 1050))])  # all but the tight cluster
    assert inside.max() < len(u) / 6
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in forest.near_vectors(frame).collect()}
    near = neighbours(x).sum(1)
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= near).all() and found.sum() >= 0.95 * near.sum()


def test_forest_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0]), (8, [1.0, 0.0]), (None, [1.0, 0.0]), (9, [float("inf"), 0.0]), (10, [1e-300, 0.0]), (11, [0.0, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in forest.near_vectors(frame).collect()}
    linked = {1: (3, 1, True), 2: (3, 1, False), 8: (3, 1, False), 10: (3, 1, False)}
    assert got == linked | {i: (0, i, True) for i in (3, 4, 5, 6, 7, 9, 11)} | {None: (0, None, False)}
    assert forest.near_vectors(frame.where("false")).count() == 0
    assert forest.near_vectors(frame.where("vec_id = 3")).count() == 1
    floats = frame.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    assert {r["vec_id"]: r["n_links"] for r in forest.near_vectors(floats.where("vec_id in (1, 2, 11)")).collect()} == {1: 1, 2: 1, 11: 0}


def test_near_vectors_of_mixed_lengths(spark):
    """Each length links among its own, the rarer ones as well."""
    x, y = vectors(300, 16)[:300], vectors(200, 9)[:200]
    rows = [(i, [float(k) for k in v]) for i, v in enumerate([*x, *y, *x[:5], *y[:60], y[0] * 2, [1.0], [2.0], [-1.0]])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in forest.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    want = {}
    for d in (16, 9, 1):
        own = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if len(v) == d]
        u = np.array([v for _, v in own])
        for (i, _), n in zip(own, (u @ u.T >= forest.COSINE - 1e-12).sum(1) - 1, strict=True):
            want[i] = int(n)
    assert {i: g[0] for i, g in got.items()} == want
    assert got[505][0] >= 1 and got[505][1] <= 300 and not got[505][2] and got[567][1] == 566 and got[568][2]
