"""A training corpus from raw documents: quality rules, near-duplicates, repeated passages, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import bpe, mixing, quality, simhash, substrings
from lexispark.llm.common import Named, cut, drop_cut, release, scope, steps, table


@steps
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor their group's fences reject. Null, empty and short texts go; null languages
    and sources are groups of their own; repeated rows stay or go together; columns may have any other names."""
    own = Named(docs)
    text, lang, source = own.at("text"), own.at("lang"), own.at("source")
    return own.back(quality.judge(own.df, text, lang, source).where("kept"))


@steps
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of SimHash near-duplicates; null and empty texts are one class, and of equal ids
    one row stays, as simhash.keep_first() says."""
    return simhash.keep_first(docs)


@steps
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has; an untouched text stays as it is, a null one null, and
    rows of null or equal ids lose nothing to each other."""
    own = Named(docs)
    out = substrings.drop_repeats(own.df, own.at("doc_id"), own.at("text"))
    cleaned, changed = {own.at("text"): F.col("kept_text"), own.at("n_chars"): F.length("kept_text").cast("bigint")}, F.col("n_removed") > 0
    return own.back(out.withColumns({c: F.when(changed, new).otherwise(F.col(c)) for c, new in cleaned.items()}))


@steps
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; those without words go, and a null source is one of its own."""
    own = Named(docs)
    out = mixing.mix(own.df, own.at("doc_id"), own.at("text"), own.at("source"))
    copies = F.when(F.col("size") > 0, F.expr("cast(taken div size as int)")).otherwise(0)
    return own.back(out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))))


@steps
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of token ids and decoded text, of every copy; a null text is encoded as an empty one."""
    own = Named(docs)
    found = own.df.select(F.col(own.at("doc_id")).alias("doc_id"), F.col(own.at("text")).alias("text"))
    out = bpe.decode(bpe.encode(found))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mixing", source_mixing),
    ("encoding", encoding),
]

#: SQL has no SimHash links over several steps and no subword merges: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage's result is a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scope():
            written = cut(stage(spark, docs, sf_dir))
            kept = release(written)
        drop_cut(docs)
        docs = kept
    return docs
