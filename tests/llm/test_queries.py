"""The registered queries whole, against plain code over the same tables."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexispark.llm import scoring
from lexispark.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_text import plain_parts, plain_rule


def rows_of(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet").collect()


def test_op2(spark, sf):
    got = {x["page_id"]: x for x in QUERIES["op2_url_filters"](spark, sf).collect()}
    pages = rows_of(spark, sf, "pages")
    assert len(got) == len(pages)
    for p in pages:
        x, (host, path) = got[p["page_id"]], plain_parts(p["url"])
        fits = plain_rule(host, path)
        assert (x["host"], x["path"], x["rule"]) == (host, path, fits[0] if fits else None)
        assert x["verdict"] == (fits[1] if fits else "block" if x["block_score"] > 0.5 else "allow")


def test_op3(spark, sf):
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in QUERIES["op3_substring_dedup"](spark, sf).collect()}
    want = brute.without_repeats([(x["doc_id"], x["text"]) for x in rows_of(spark, sf, "documents")])
    assert got == {d: (n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for d, (n, gone, kept) in want.items()}


def test_op5(spark, sf):
    got = {x["doc_id"]: (x["base_failed"], x["kept"]) for x in QUERIES["op5_quality_rules"](spark, sf).collect()}
    assert got == brute.quality([(x["doc_id"], x["text"], x["lang"], x["source"]) for x in rows_of(spark, sf, "documents")])


def test_op6(spark, sf):
    """Every document, all its tokens; the same again; a text of the corpus is likelier than its words in another order."""
    docs = rows_of(spark, sf, "documents")
    got = {x["doc_id"]: (x["n_tokens"], x["log_likelihood"]) for x in QUERIES["op6_lm_scoring"](spark, sf).collect()}
    assert {d: n for d, (n, _) in got.items()} == {x["doc_id"]: len(scoring.words_of((x["text"] or "").encode())) for x in docs}
    again = {x["doc_id"]: x["log_likelihood"] for x in QUERIES["op6_lm_scoring"](spark, sf).collect()}
    assert all(got[d][1] == again[d] and got[d][1] <= 0 for d in got)
    frame = spark.createDataFrame([(x["doc_id"], x["text"]) for x in docs], "doc_id bigint, text string")
    counts = scoring.count_words(frame).cache()
    mixed = spark.createDataFrame([(x["doc_id"], " ".join(np.random.default_rng(x["doc_id"]).permutation((x["text"] or "").split()))) for x in docs], "doc_id bigint, text string")
    fitted = scoring.fit(frame, counts=counts)
    mean = lambda f: {x["doc_id"]: x["mean_log_likelihood"] for x in scoring.score(f, *fitted, counts=counts).collect()}
    own, other = mean(frame), mean(mixed)
    long = [x["doc_id"] for x in docs if (own[x["doc_id"]] is not None and got[x["doc_id"]][0] >= 50)]
    assert np.mean([own[d] > other[d] for d in long]) > 0.7


def test_op7(spark, sf):
    got = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in QUERIES["op7_simhash_near_dedup"](spark, sf).collect()}
    assert got == brute.near_classes([(x["doc_id"], x["text"]) for x in rows_of(spark, sf, "documents")])


def test_op10(spark, sf):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {x["doc_id"]: (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in QUERIES["op10_bpe_encode_decode"](spark, sf).collect()}
    docs = rows_of(spark, sf, "documents")
    assert len(got) == len(docs)
    for x in docs:
        ids = library.encode(x["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[x["doc_id"]] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("name", QUERIES)
def test_schemas(spark, sf, name):
    assert QUERIES[name](spark, sf).columns[0] in ("doc_id", "page_id", "vec_id")
