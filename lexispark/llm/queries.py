"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm.bpe import op10_bpe_encode_decode
from lexispark.llm.forest import op4_embedding_near_dedup, op4_sql
from lexispark.llm.langid import op1_language_id
from lexispark.llm.mixing import op8_source_mixing, op8_sql
from lexispark.llm.quality import op5_quality_rules, op5_sql
from lexispark.llm.scoring import op6_lm_scoring
from lexispark.llm.simhash import op7_simhash_near_dedup
from lexispark.llm.substrings import op3_sql, op3_substring_dedup
from lexispark.llm.urls import op2_url_filters
from lexispark.llm.warc import op9_warc_derivatives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_url_filters": op2_url_filters,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_bpe_encode_decode": op10_bpe_encode_decode,
}

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": op3_sql(),
    "op4_embedding_near_dedup": op4_sql(),
    "op5_quality_rules": op5_sql(),
    "op8_source_mixing": op8_sql(),
}
