"""Registered queries over the test tables, and the SQL that gives the same rows. Model calls go to the offline
provider, whose answers SQL can compute: what is compared is batching, order, joins and types, not answers' quality."""

from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import fusion
from lexispark.operators import search
from lexispark.plans import engine_queries
from lexispark.session import Session
from lexispark.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
_sessions: weakref.WeakKeyDictionary[SparkSession, Session] = weakref.WeakKeyDictionary()
#: Offline models by name: their rule.
RULES = {"digest": "md5", "upper": "upper", "has_the": "contains: the ", "count": "count", "record": "object"}


def session(spark: SparkSession) -> Session:
    """A session with the offline models, one a SparkSession."""
    if spark not in _sessions:
        s = _sessions[spark] = Session(spark)
        for name, rule in RULES.items():
            s.sql(f"""CREATE MODEL('{name}', 'rules', 'offline', {{"model_parameters": {{"rule": "{rule}"}}, "max_batch_size": 64}})""")
        s.sql("CREATE PROMPT('digest-text', 'Give the digest of the text')")
    return _sessions[spark]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def _ask(*columns: str, **more: str) -> dict:
    return {"prompt": "Answer about the row", "context_columns": [{"data": c, "name": c} for c in columns]} | more


# fusion and search


def hybrid_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: parts ranked by price and by size, fused, the best twenty."""
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    both = search.ranked(search.ranked(parts, "p_retailprice", "price_rank"), "p_size", "size_rank")
    fused = fusion.fuse_ranks(both, "price_rank", "size_rank", name="score")
    return search.top_k(fused.select("p_partkey", "price_rank", "size_rank", F.round("score", 12).alias("score")), 20, "score", "p_partkey")


HYBRID_RANK_FUSION = """
with r as (
  select p_partkey, dense_rank() over (order by p_retailprice desc nulls last)::int as price_rank,
         dense_rank() over (order by p_size desc nulls last)::int as size_rank from part)
select *, round(1.0::double / (60 + price_rank) + 1.0::double / (60 + size_rank), 12) as score from r order by score desc, p_partkey limit 20
"""


def fusion_rrf_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part")
    both = search.ranked(search.ranked(parts, "p_retailprice", "r1", ["p_brand"]), "p_size", "r2", ["p_brand"])
    return both.select("p_partkey", F.round(fusion.fusion_rrf("r1", "r2", scope=["p_brand"]), 12).alias("rrf"))


FUSION_RRF_BY_GROUP = """
with r as (
  select p_partkey, p_brand, dense_rank() over (partition by p_brand order by p_retailprice desc nulls last) as r1,
         dense_rank() over (partition by p_brand order by p_size desc nulls last) as r2 from part),
m as (select *, max(r1) over w as m1, max(r2) over w as m2, count(*) over w as n from r window w as (partition by p_brand))
select p_partkey, round(case when m1 > 1 or (n = 1 and r1 = 1) then 1.0::double / (60 + r1) else 0 end
                        + case when m2 > 1 or (n = 1 and r2 = 1) then 1.0::double / (60 + r2) else 0 end, 12) as rrf from m
"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount")
    return search.min_max(lines, "l_extendedprice", "l_quantity", "l_discount")


_NORMAL = """
with b as (
  select min(l_extendedprice)::double as a0, max(l_extendedprice)::double as a1, min(l_quantity)::double as b0, max(l_quantity)::double as b1,
         min(l_discount)::double as c0, max(l_discount)::double as c1 from lineitem),
z as (
  select l_orderkey, l_linenumber, coalesce((l_extendedprice::double - a0) / nullif(a1 - a0, 0), 0) as x,
         coalesce((l_quantity::double - b0) / nullif(b1 - b0, 0), 0) as y, coalesce((l_discount::double - c0) / nullif(c1 - c0, 0), 0) as w from lineitem, b)
"""


def _comb(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        fused = getattr(fusion, f"fusion_{name}")("l_extendedprice_norm", "l_quantity_norm", "l_discount_norm")
        return _scores(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(fused, 9).alias("score"))

    return query


_COMB_SQL = {
    "combsum": "x + y + w",
    "combmnz": "(x + y + w) * ((x <> 0)::int + (y <> 0)::int + (w <> 0)::int)",
    "combmed": "list_sort([x, y, w])[2]",
    "combanz": "(x + y + w) / 3",
}


def score_fusion_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = _scores(spark, sf_dir).withColumn("score", F.round(fusion.fusion_combsum("l_extendedprice_norm", "l_quantity_norm"), 9))
    return search.top_k(fused.select("l_orderkey", "l_linenumber", "score"), 15, "score", "l_orderkey", "l_linenumber")


def fusion_null_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, NaN and zero scores through all five functions."""
    values = "(1, null, 0.14, 1, 4), (2, 0.4, 0.41, 2, 2), (3, null, 0, 3, 1), (4, 0.8, 1, 4, 5), (5, 1, double('NaN'), 5, null)"
    rows = spark.sql(f"select id, double(a) as a, double(b) as b, int(r1) as r1, int(r2) as r2 from values {values} as t(id, a, b, r1, r2)")
    fused = {n: F.round(getattr(fusion, f"fusion_{n}")("a", "b"), 12) for n in _COMB_SQL}
    return fusion.fuse_ranks(rows, "r1", "r2", name="rrf").select("id", F.round("rrf", 12).alias("rrf"), *[c.alias(n) for n, c in fused.items()])


FUSION_NULL_NAN = """
select * from (values
  (1, round(1.0::double / 61 + 1.0::double / 64, 12), 0.14::double, 0.14::double, 0.07::double, 0.07::double),
  (2, round(2.0::double / 62, 12), 0.81, 1.62, 0.405, 0.405),
  (3, round(1.0::double / 63 + 1.0::double / 61, 12), 0, 0, 0, 0),
  (4, round(1.0::double / 64 + 1.0::double / 65, 12), 1.8, 3.6, 0.9, 0.9),
  (5, round(1.0::double / 65 + 1.0::double / 60, 12), 1, 1, 0.5, 0.5)) as t(id, rrf, combsum, combmnz, combmed, combanz)
"""


# scalar functions


def llm_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", session(spark).llm_complete({"model_name": "digest"}, _ask("text", "source")).alias("answer"))


def llm_complete_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part")
    model = {"model_name": "upper", "is_async": False, "max_batch_size": 10, "tuple_format": "Markdown"}
    return parts.select("p_partkey", session(spark).llm_complete(model, _ask("p_name")).alias("answer"))


def llm_complete_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No context: one request for all rows."""
    answer = session(spark).llm_complete({"model_name": "digest"}, {"prompt": "One answer"})
    return _table(spark, sf_dir, "nation").select("n_nationkey", answer.alias("answer"))


def llm_complete_named_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = {"prompt_name": "digest-text", "version": 1, "context_columns": [{"data": F.col("text")}]}
    return _table(spark, sf_dir, "benchmark").select("item_id", session(spark).llm_complete({"model_name": "digest", "tuple_format": "json"}, prompt).alias("answer"))


def structured_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers, then their fields."""
    docs = _table(spark, sf_dir, "documents")
    answer = session(spark).llm_complete({"model_name": "record"}, _ask("text"))
    fields = docs.select("doc_id", F.from_json(answer, "digest string, length long").alias("a"))
    return fields.select("doc_id", "a.digest", "a.length")


def llm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", session(spark).llm_filter({"model_name": "digest"}, _ask("text")).alias("fits"))


def filter_after_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows that pass the plain predicate are asked about."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    kept = session(spark).semantic_filter(docs, {"model_name": "has_the"}, _ask("text"), (F.col("lang") == "en") & (F.col("n_chars") > 1000))
    return kept.select("doc_id", "n_chars")


def llm_filter_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = session(spark).llm_filter({"model_name": "digest"}, {"prompt": "Is it so?"})
    return _table(spark, sf_dir, "region").select("r_regionkey", answer.alias("fits"))


def llm_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    vector = session(spark).llm_embedding({"model_name": "digest"}, {"context_columns": [{"data": "lang"}, {"data": "text"}]})
    return docs.select("doc_id", vector.alias("v")).select("doc_id", F.array_join(F.transform("v", lambda x: F.round(x * 255).cast("int").cast("string")), ",").alias("embedding"))


def embedding_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of the benchmark's items, and the pairs above a threshold."""
    vector = session(spark).llm_embedding({"model_name": "digest"}, {"context_columns": [{"data": "text"}]})
    items = _table(spark, sf_dir, "benchmark").select("item_id", vector.alias("v"))
    return search.similar_pairs(items, "item_id", "v", 0.9).withColumn("similarity", F.round("similarity", 9))


def audio_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audio column is transcribed before the model reads it."""
    column = {"data": "url", "name": "clip", "type": "audio", "transcription_model": "digest"}
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", session(spark).llm_complete({"model_name": "digest"}, {"prompt": "Describe", "context_columns": [column]}).alias("answer"))


def audio_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    column = {"data": "url", "type": "audio", "transcription_model": "digest"}
    vector = session(spark).llm_embedding({"model_name": "digest"}, {"context_columns": [column]})
    return _table(spark, sf_dir, "pages").select("page_id", F.round(vector[0], 9).alias("first"))


def answers_joined_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as features, joined to other tables by id."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", session(spark).llm_complete({"model_name": "digest"}, _ask("text")).alias("digest"))
    labels = _table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "digest", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions inside Spark SQL."""
    s = session(spark)
    context = {"context_columns": [{"data": F.lit("")}]}
    s.register("lex_digest", "complete", {"model_name": "digest"}, {"prompt": "Digest"} | context)
    s.register("lex_fits", "filter", {"model_name": "has_the"}, {"prompt": "Fits?"} | context)
    _table(spark, sf_dir, "documents").createOrReplaceTempView("lex_documents")
    return s.sql("select doc_id, lex_digest(named_struct('c0', text)) as digest from lex_documents where lang = 'en' and lex_fits(named_struct('c0', text))")


# aggregates


def llm_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages are few and hold whole corpora, so their texts are streamed, not gathered."""
    docs = _table(spark, sf_dir, "documents")
    s = session(spark)
    least = s.reduce_groups(docs, ["lang"], {"model_name": "digest"}, _ask("text"), "least", order_by="doc_id")
    counted = s.reduce_groups(docs, ["lang"], {"model_name": "count"}, _ask("doc_id"), "counted")
    return s.join_groups(["lang"], docs.groupBy("lang").agg(F.count("*").alias("n")), least, counted)


def llm_reduce_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large groups reduced in parts, then the parts' summaries."""
    s = session(spark)
    s_model = {"model_name": "digest", "model_parameters": {"rule": "max"}}
    return s.reduce_groups(_table(spark, sf_dir, "documents"), ["lang"], s_model, _ask("source"), "greatest", spread=8)


def llm_reduce_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where("doc_id < 0").agg(session(spark).llm_reduce({"model_name": "count"}, _ask("text")).alias("counted"), F.count("*").alias("n"))


def _turns(spark: SparkSession, sf_dir: str, function: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    answer = getattr(session(spark), function)({"model_name": "digest"}, _ask("turn", "text"), "turn")
    return turns.groupBy("conv_id").agg(answer.alias("answer"))


def llm_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.get_json_object("answer", "$[0].data[0]").cast("bigint")
    return _turns(spark, sf_dir, "llm_first").select("conv_id", turn.alias("turn"))


def llm_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.get_json_object("answer", "$[0].data[0]").cast("bigint")
    return _turns(spark, sf_dir, "llm_last").select("conv_id", turn.alias("turn"))


def llm_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns' numbers in the order of relevance."""
    turns = F.from_json(F.get_json_object("answer", "$[0].data"), "array<string>")
    return _turns(spark, sf_dir, "llm_rerank").select("conv_id", F.array_join(turns, ",").alias("turns"))


# catalog


def model_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    for text in (
        "CREATE GLOBAL MODEL('fast', 'gpt-4o-mini', 'openai', {\"max_batch_size\": 8})",
        "CREATE MODEL('own', 'llama3', 'ollama');",
        "UPDATE MODEL('own', 'llama3.1', 'ollama') -- a newer one",
        "CREATE LOCAL MODEL('gone', 'm', 'azure')",
        "DELETE MODEL 'gone'",
        "UPDATE MODEL 'own' TO GLOBAL",
    ):
        s.sql(text)
    out = s.sql("GET MODELS").where("model_name in ('fast', 'own', 'gone', 'default')")
    s.close()
    return out


MODEL_CATALOG = """
select * from (values ('global', 'default', 'gpt-4o-mini', 'openai', '{}'), ('global', 'fast', 'gpt-4o-mini', 'openai', '{"max_batch_size": 8}'),
  ('global', 'own', 'llama3.1', 'ollama', '{}')) as t(scope, model_name, model, provider_name, model_args)
"""


def prompt_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    for text in ("CREATE PROMPT('sum', 'v one')", "UPDATE PROMPT('sum', 'v two')", "CREATE GLOBAL PROMPT('tag', 'x')", "UPDATE PROMPT 'sum' TO GLOBAL", "UPDATE PROMPT('sum', 'v three')"):
        s.sql(text)
    out = s.sql("GET PROMPT 'sum'").unionByName(s.sql("GET PROMPTS")).select("scope", "prompt_name", "prompt", "version")
    s.close()
    return out


PROMPT_CATALOG = """
select * from (values ('global', 'sum', 'v three', '3'), ('global', 'sum', 'v two', '2'), ('global', 'sum', 'v one', '1'), ('global', 'sum', 'v three', '3'),
  ('global', 'tag', 'x', '1'), ('global', 'hello-world', 'Tell me hello world', '1')) as t(scope, prompt_name, prompt, version)
"""


def metered_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of ten rows, and what it cost. The limit is the feature: it comes before the model."""
    s = Session(spark)
    s.sql("CREATE MODEL('m', 'rules', 'offline', {\"max_batch_size\": 4, \"model_parameters\": {\"tokens\": [5, 2]}})")
    s.llm_reset_metrics()
    sample = _table(spark, sf_dir, "part").orderBy("p_partkey").limit(10).coalesce(1)
    sample.select(s.llm_complete({"model_name": "m"}, _ask("p_name")).alias("a")).write.format("noop").mode("overwrite").save()
    out = s.metrics_df().select("call", "input_tokens", "output_tokens", "total_tokens", "api_calls", "model_name", "provider")
    s.close()
    return out


METERED_RUN = "select 'llm_complete_1' as call, 15::bigint as input_tokens, 6::bigint as output_tokens, 21::bigint as total_tokens, 3::bigint as api_calls, 'm' as model_name, 'offline' as provider"

_BYTE = "((strpos('0123456789abcdef', substr({m}, {i}, 1)) - 1) * 16 + strpos('0123456789abcdef', substr({m}, {j}, 1)) - 1) / 255.0::double"
_VECTOR = "list_transform(range(8), lambda k: round(((strpos('0123456789abcdef', substr(m, 2 * k + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(m, 2 * k + 2, 1)) - 1) / 255.0::double, 9))"
_TURN = "arg_{f}(turn, {{'d': md5(turn::varchar || '|' || coalesce(text, 'NULL')), 't': turn}})"

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        hybrid_rank_fusion,
        fusion_rrf_by_group,
        score_fusion_topk,
        fusion_null_nan,
        llm_complete,
        llm_complete_sync,
        llm_complete_bare,
        llm_complete_named_prompt,
        structured_extraction,
        llm_filter,
        filter_after_predicate,
        llm_filter_bare,
        llm_embedding,
        embedding_similarity,
        audio_answers,
        audio_embedding,
        answers_joined_back,
        sql_functions,
        llm_reduce,
        llm_reduce_spread,
        llm_reduce_empty,
        llm_first,
        llm_last,
        llm_rerank,
        model_catalog,
        prompt_catalog,
        metered_run,
    )
} | {f"fusion_{n}": _comb(n) for n in _COMB_SQL} | engine_queries.QUERIES

ORACLE_SQL: dict[str, str] = {
    "hybrid_rank_fusion": HYBRID_RANK_FUSION,
    "fusion_rrf_by_group": FUSION_RRF_BY_GROUP,
    "score_fusion_topk": _NORMAL + "select l_orderkey, l_linenumber, round(x + y, 9) as score from z order by score desc, l_orderkey, l_linenumber limit 15",
    "fusion_null_nan": FUSION_NULL_NAN,
    "llm_complete": "select doc_id, md5(coalesce(text, 'NULL') || '|' || coalesce(source, 'NULL')) as answer from documents",
    "llm_complete_sync": "select p_partkey, upper(coalesce(p_name, 'NULL')) as answer from part",
    "llm_complete_bare": "select n_nationkey, md5('One answer') as answer from nation",
    "llm_complete_named_prompt": "select item_id, md5(coalesce(text, 'NULL')) as answer from benchmark",
    "structured_extraction": "select doc_id, md5(coalesce(text, 'NULL')) as digest, length(string_split(coalesce(text, 'NULL'), '|')[1])::bigint as length from documents",
    "llm_filter": "select doc_id, substr(md5(coalesce(text, 'NULL')), 1, 1) < '8' as fits from documents",
    "filter_after_predicate": "select doc_id, n_chars from documents where lang = 'en' and n_chars > 1000 and contains(text, ' the ')",
    "llm_filter_bare": "select r_regionkey, substr(md5('Is it so?'), 1, 1) < '8' as fits from region",
    "llm_embedding": f"select doc_id, array_to_string(list_transform({_VECTOR}, lambda x: round(x * 255)::int::varchar), ',') as embedding from (select doc_id, md5(coalesce(lang, 'NULL') || ' ' || coalesce(text, 'NULL') || ' ') as m from documents)",
    "embedding_similarity": f"""
    with v as (select item_id, {_VECTOR.replace("round(", "(").replace(", 9))", "))")} as v from (select item_id, md5(coalesce(text, 'NULL') || ' ') as m from benchmark))
    select a.item_id as "left", b.item_id as "right", round(list_cosine_similarity(a.v, b.v), 9) as similarity
    from v a join v b on a.item_id < b.item_id where list_cosine_similarity(a.v, b.v) >= 0.9
    """,
    "audio_answers": "select page_id, md5(case when url is null then '' else 'transcript of ' || url end) as answer from pages",
    "audio_embedding": f"select page_id, round({_BYTE.format(m='m', i=1, j=2)}, 9) as first from (select page_id, md5(case when url is null then 'None' else 'transcript of ' || url end || ' ') as m from pages)",
    "answers_joined_back": "select doc_id, md5(coalesce(text, 'NULL')) as digest, coalesce(quality, -1) as quality, coalesce(toxic, -1) as toxic from documents left join labels using (doc_id)",
    "sql_functions": "select doc_id, md5(text) as digest from documents where lang = 'en' and contains(text, ' the ')",
    "llm_reduce": "select lang, count(*) as n, min(md5(coalesce(text, 'NULL'))) as least, count(*)::varchar as counted from documents group by lang",
    "llm_reduce_spread": "select lang, max(coalesce(source, 'NULL')) as greatest from documents group by lang",
    "llm_reduce_empty": "select null::varchar as counted, 0::bigint as n",
    "llm_first": f"select conv_id, {_TURN.format(f='min')} as turn from conversations group by conv_id",
    "llm_last": f"select conv_id, {_TURN.format(f='max')} as turn from conversations group by conv_id",
    "llm_rerank": "select conv_id, string_agg(turn::varchar, ',' order by md5(turn::varchar || '|' || coalesce(text, 'NULL')), turn) as turns from conversations group by conv_id",
    "model_catalog": MODEL_CATALOG,
    "prompt_catalog": PROMPT_CATALOG,
    "metered_run": METERED_RUN,
} | {f"fusion_{n}": _NORMAL + f"select l_orderkey, l_linenumber, round({sql}, 9) as score from z" for n, sql in _COMB_SQL.items()} | engine_queries.ORACLE_SQL
