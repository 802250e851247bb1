import hashlib
import os

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexispark.llm import common
from lexispark.llm.common import cut
from tests.llm import brute
from tests.llm.test_text import level

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def stage(spark, name, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return dict(cp.STAGES)[name](spark, frame, None)


def as_rows(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=repr)


def test_run_matches_brute_force(spark, sf):
    """Every stage's decisions, by plain code over what the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = as_rows(docs)
    kept = as_rows(kept_frame := cut(cp.quality_rules(spark, docs, sf)))
    verdicts = brute.quality([r[:4] for r in rows])
    assert kept == [r for r in rows if verdicts[r[0]][1]] and 0.5 * len(rows) < len(kept) < len(rows)

    classes = brute.near_classes([(r[0], r[1]) for r in kept])
    first = as_rows(first_frame := cut(cp.near_duplicates(spark, kept_frame, sf)))
    assert first == [r for r in kept if classes[r[0]][1] == r[0]]

    cleaned = brute.without_repeats([(r[0], r[1]) for r in first])
    want = []
    for d, t, lang, source, n in first:
        _, gone, words = cleaned[d]
        want.append((d, " ".join(words), lang, source, len(" ".join(words))) if gone else (d, t, lang, source, n))
    passed = as_rows(passed_frame := cut(cp.repeated_passages(spark, first_frame, sf)))
    assert passed == sorted(want, key=repr)

    mixed = as_rows(mixed_frame := cut(cp.source_mixing(spark, passed_frame, sf)))
    copies = {r[0]: mixed.count(r) for r in passed}
    size = {r[0]: len(brute.words(r[1])) for r in passed}
    sizes = {}
    for r in passed:
        sizes[r[3]] = sizes.get(r[3], 0) + size[r[0]]
    for s, target in level(sizes).items():
        own = [r[0] for r in passed if r[3] == s]
        assert abs(sum(copies[d] * size[d] for d in own) - target) <= max(size[d] for d in own) / 2 + 1e-6
    assert set(mixed) <= set(passed) and max(copies.values()) <= 3

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t, *_ in mixed:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, cp.encoding(spark, mixed_frame, sf).collect())) == sorted(want)
    before = set(common._held[-1])
    got = cp.run(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert set(common._held[-1]) - before == {got._scratch}  # of all that the run cut, its result alone is left


def test_a_step_deletes_what_the_step_before_it_cut(spark, tmp_path):
    docs = spark.createDataFrame(ODD, SCHEMA)
    start = set(common._held[-1])
    judged = cp.quality_rules(spark, docs, None)
    cuts = set(common._held[-1]) - start
    chained = cp.near_duplicates(spark, judged, None)  # not written: what it reads stays
    assert cuts & set(common._held[-1])
    kept = as_rows(chained)
    judged.write.parquet(f"{tmp_path}/judged")
    written = spark.read.parquet(f"{tmp_path}/judged")
    first = cp.near_duplicates(spark, written, None)
    assert not cuts & set(common._held[-1])
    assert as_rows(first) == kept and kept


def test_a_cut_starts_few_processes(spark):
    """Each file and each folder of a task is a process (chmod) on a local file system: none for checksums or marks, and
    few where a table is known to be small."""
    rows = spark.range(1000).repartition(50)
    out = cut(rows, 1000)
    assert sorted(x["id"] for x in out.collect()) == list(range(1000))
    names = os.listdir(out._scratch.removeprefix("file:"))
    assert len(names) == len(out.inputFiles()) <= spark.sparkContext.defaultParallelism and all(n.endswith(".parquet") for n in names)
    assert len(cut(rows).inputFiles()) == 50


PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ODD = [(None, None, None, None, None), (1, PROSE, "en", "a", 80), (1, PROSE, "en", "a", 80), (None, PROSE, None, None, None), (2, "", "en", None, 0), (3, PROSE.replace(" ", "\n") + " more", "de", "b", 5), (4, "w " * 30_000, "en", "a", 9)]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_take_odd_rows(spark, name):
    out = stage(spark, name, ODD)
    out.collect()
    assert name == "encoding" or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    frame = spark.createDataFrame(ODD, SCHEMA)
    assert dict(cp.STAGES)[name](spark, frame.where("false"), None).count() == 0
    more = frame.withColumns({c: frame["lang"] for c in ("kept", "size", "n_words", "fp", "th", "in_0", "_m", "copy", "kept_text", "n_removed", "taken", "sk", "decoded")})
    out = dict(cp.STAGES)[name](spark, more, None)
    got = out.collect()
    assert name == "encoding" or out.columns == more.columns and all(x["kept_text"] == x["in_0"] == x["kept"] == x["lang"] for x in got)
