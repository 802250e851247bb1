"""Registered queries about the engine itself: windows of aggregates, SQL calls, batching, faults, limits, metrics, statements
and prompts. Rows that need no table come from ranges."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.render import FORMATS, RULES, TEMPLATE
from lexispark.session import Session

#: Groups of 1, 2, 17 and 100 rows by id.
GROUPS = "case when id = 0 then 1 when id < 3 then 2 when id < 20 then 17 else 100 end"
SIZES = (1, 2, 3, 16)


def _own(spark: SparkSession, **models: dict) -> Session:
    """A session with offline models of given arguments."""
    s = Session(spark, rate_window=0.5)
    for name, args in models.items():
        s.sql(f"CREATE MODEL('{name}', 'rules', 'offline', {json.dumps(args)})")
    return s


def _ask(*columns: str | Column, prompt: str = "Answer about the row") -> dict:
    return {"prompt": prompt, "context_columns": [{"data": c} for c in columns]}


def _items(spark: SparkSession, n: int, parts: int = 1) -> DataFrame:
    return spark.range(0, n, 1, parts).selectExpr("id", "concat('item ', id) as t", f"{GROUPS} as size")


def _windows(function: str, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _own(spark, **{f"w{n}": {"max_batch_size": n} for n in SIZES})
        answers = [getattr(s, function)({"model_name": f"w{n}"}, _ask("id", "t"), "id", **options).alias(f"w{n}") for n in SIZES]
        found = _items(spark, 120).groupBy("size").agg(*answers)
        ids = lambda c: F.array_join(F.from_json(F.get_json_object(c, "$[0].data"), "array<string>"), ",")
        return found.select("size", *[ids(f"w{n}").alias(f"w{n}") for n in SIZES])

    return query


_KEYED = f"select i as id, {GROUPS.replace('id', 'i')} as size, md5(i || '|item ' || i) as m from range(120) t(i)"
_ALL = ", ".join(f"x as w{n}" for n in SIZES)


def _rerank_sql() -> str:
    """One pass of windows from the list's end to its beginning, each half a window further on."""
    return f"""
    with recursive k as ({_KEYED}), b(w) as (values {", ".join(f"({n})" for n in SIZES)}),
    r as (
      select size, w, list({{'m': m, 'i': id}} order by id) as o, count(*)::bigint as e from k, b group by size, w
      union all
      select size, w, o[1:s] || list_sort(o[s + 1:e]) || o[e + 1:], case when s = 0 then 0 else s + (e - s) // 2 end
      from (select *, greatest(0, e - greatest(w, 2)) as s from r where e > 0)),
    done as (select size, w, array_to_string(list_transform(o, lambda x: x.i::varchar), ',') as ids from r where e = 0)
    select size, {", ".join(f"max(ids) filter (where w = {n}) as w{n}" for n in SIZES)} from done group by size
    """


def aggregate_back_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that overflow shrink, and no row is lost; windows of two that overflow are an error."""
    s = _own(spark, small={"max_batch_size": 16, "model_parameters": {"overflow_above": 5}}, tiny={"model_parameters": {"overflow_above": 1}})
    m, context = {"model_name": "small"}, _ask("id", "t")
    found = _items(spark, 120).groupBy("size").agg(
        s.llm_first(m, context, "id").alias("first"), s.llm_last(m, context, "id").alias("last"),
        s.llm_rerank(m, context, "id", passes=0).alias("ranked"), s.llm_reduce(m | {"model_parameters": {"rule": "count", "overflow_above": 5}}, context, "id").alias("counted"),
    )
    ids = lambda c: F.array_join(F.from_json(F.get_json_object(c, "$[0].data"), "array<string>"), ",")
    out = found.select(F.col("size").cast("string").alias("size"), ids("first").alias("first"), ids("last").alias("last"), ids("ranked").alias("ranked"), "counted")
    told = []
    for name in ("llm_first", "llm_rerank", "llm_reduce"):
        try:
            _items(spark, 3).agg(getattr(s, name)({"model_name": "tiny"}, context)).collect()
            told.append((name, None, None, None, None))
        except Exception as e:  # noqa: BLE001  the message is the result
            told.append((name, "error", None, None, str("reduced to zero" in str(e)).lower()))
    return out.unionByName(spark.createDataFrame(told, out.schema))


AGGREGATE_BACK_OFF = f"""
with k as ({_KEYED})
select size::varchar as size, arg_min(id, m)::varchar as first, arg_max(id, m)::varchar as last,
       string_agg(id::varchar, ',' order by m) as ranked, count(*)::varchar as counted from k group by size
union all select * from (values ('llm_first', 'error', null::varchar, null::varchar, 'true'), ('llm_rerank', 'error', null, null, 'true'), ('llm_reduce', null, null, null, null))
"""


def single_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of one row come back unasked; a reduction asks even then."""
    s = _own(spark, m={})
    for name in ("llm_first", "llm_last", "llm_rerank", "llm_reduce"):
        spark.range(0, 7, 1, 1).groupBy("id").agg(getattr(s, name)({"model_name": "m"}, _ask("id"))).collect()
    asked = {k: v["api_calls"] for k, v in s.metrics().items()}
    return spark.createDataFrame([(n, asked.get(f"{n}_1", 0)) for n in ("llm_first", "llm_last", "llm_rerank", "llm_reduce")], "function string, calls long")


def answer_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that a model leaves out are null, batch by batch, in both modes; null answers of a filter let rows pass."""
    s = _own(spark, m={"max_batch_size": 4, "model_parameters": {"short_by": 1, "rule": "echo"}})
    rows, m = _items(spark, 10), {"model_name": "m"}
    sync = m | {"is_async": False}
    return rows.select("id", s.llm_complete(m, _ask("t")).alias("rounds"), s.llm_complete(sync, _ask("t")).alias("turns"), s.llm_filter(m, _ask("t")).alias("passes"))


def overflow_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that overflow are halved; a row that overflows alone is null."""
    s = _own(spark, m={"max_batch_size": 16, "model_parameters": {"overflow_above": 3, "rule": "echo"}}, none={"model_parameters": {"overflow_above": 0}})
    sync = {"model_name": "m", "is_async": False}
    rows = _items(spark, 50, 3)
    return rows.select("id", s.llm_complete({"model_name": "m"}, _ask("t")).alias("rounds"), s.llm_complete(sync, _ask("t")).alias("turns"), s.llm_complete({"model_name": "none"}, _ask("t")).alias("nothing"))


def usage_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after the request that crosses the limit are null."""
    limits = {"usage_limit": {"total_tokens_limit": 100}, "is_async": False, "max_batch_size": 2, "model_parameters": {"tokens": [30, 20], "rule": "echo"}}
    s = _own(spark, m=limits)
    return _items(spark, 10).select("id", s.llm_complete({"model_name": "m"}, _ask("t")).alias("answer"))


def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five requests at two a window of half a second take two waits; all are answered."""
    s = _own(spark, m={"rate_limit": 2, "is_async": False, "max_batch_size": 1, "model_parameters": {"rule": "echo"}})
    began = time.monotonic()
    got = _items(spark, 5).select(s.llm_complete({"model_name": "m"}, _ask("t")).alias("a")).collect()
    took = time.monotonic() - began
    return spark.createDataFrame([(len(got), sum(r["a"] is not None for r in got), took >= 1.0)], "rows long, answers long, waited boolean")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused: bad row ids, unknown names, empty prompts, wrong settings."""
    s = _own(spark, bad={"model_parameters": {"rule": "bad id"}}, m={})
    rows, m = _items(spark, 3), {"model_name": "m"}
    cases = {
        "bad row id": lambda: rows.agg(s.llm_first({"model_name": "bad"}, _ask("t"))).collect(),
        "bad ranked id": lambda: rows.agg(s.llm_rerank({"model_name": "bad"}, _ask("t"))).collect(),
        "group too large": lambda: rows.agg(s.llm_reduce(m, _ask("t"), max_rows_per_group=2)).collect(),
        "unknown model": lambda: s.llm_complete({"model_name": "nobody"}, _ask("t")),
        "unknown prompt": lambda: s.llm_complete(m, {"prompt_name": "nothing", "context_columns": [{"data": "t"}]}),
        "empty prompt": lambda: s.llm_complete(m, _ask("t", prompt=" ")),
        "no columns": lambda: s.llm_reduce(m, {"prompt": "x"}),
        "image embedding": lambda: s.llm_embedding(m, {"context_columns": [{"data": "t", "type": "image"}]}),
        "audio without model": lambda: s.llm_complete(m, {"prompt": "x", "context_columns": [{"data": "t", "type": "audio"}]}),
        "batch of none": lambda: s.llm_complete(m | {"max_batch_size": 0}, _ask("t")),
        "unknown provider": lambda: s.llm_complete(m | {"provider": "nobody"}, _ask("t")),
        "unknown setting": lambda: s.sql("CREATE MODEL('x', 'y', 'ollama', {\"colour\": 1})"),
        "model taken": lambda: s.sql("CREATE MODEL('m', 'y', 'ollama')"),
        "nothing wrong": lambda: rows.select(s.llm_complete(m, _ask("t"))).collect(),
    }
    told = []
    for name, case in cases.items():
        try:
            case()
            told.append((name, False))
        except Exception:  # noqa: BLE001
            told.append((name, True))
    return spark.createDataFrame(told, "case string, refused boolean")


ERRORS = ("bad row id", "bad ranked id", "group too large", "unknown model", "unknown prompt", "empty prompt", "no columns", "image embedding", "audio without model", "batch of none", "unknown provider", "unknown setting", "model taken")


def metrics_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all tasks of a use are added up; debug metrics keep the tasks apart; a reset leaves nothing."""
    s = _own(spark, m={"max_batch_size": 2, "model_parameters": {"tokens": [3, 1]}})
    m = {"model_name": "m"}
    _items(spark, 24, 3).select(s.llm_complete(m, _ask("t"))).collect()
    _items(spark, 5).select(s.llm_filter(m, _ask("t"))).collect()
    flat, debug = s.metrics(), json.loads(s.llm_get_debug_metrics())
    out = [(k, v["api_calls"], v["total_tokens"], sum(1 for t in debug["threads"].values() for c in t.values() for f in c if f == k[:-2])) for k, v in flat.items()]
    s.llm_reset_metrics()
    return spark.createDataFrame([*out, ("after reset", len(s.metrics()), 0, len(json.loads(s.llm_get_debug_metrics())["threads"]))], "what string, calls long, tokens long, tasks long")


def statements_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model and one prompt by name, a model's arguments, deletions, and secrets, whose values are never shown."""
    s = _own(spark)
    for text in (
        "CREATE MODEL('a', 'x', 'ollama', {\"batch_size\": 3, \"tuple_format\": \"json\", \"is_async\": false})",
        "CREATE PROMPT('p', 'one')",
        "CREATE PROMPT('q', 'two')",
        "UPDATE PROMPT('q', 'three')",
        "DELETE PROMPT 'p'",
        "CREATE SECRET k (TYPE OPENAI, API_KEY 'hidden')",
        "CREATE SECRET (TYPE OLLAMA, API_URL 'http://127.0.0.1:1')",
        "DROP SECRET k",
    ):
        s.sql(text)
    model = s.sql("GET MODEL 'a'").first()
    args = json.loads(model["model_args"])
    told = [("model", model["model"]), ("provider", model["provider_name"]), ("prompts p", str(s.sql("GET PROMPT 'p'").count())), ("prompts q", str(s.sql("GET PROMPT 'q'").count()))]
    told += [(k, str(v).lower()) for k, v in sorted(args.items())] + [("secrets", ",".join(s.secrets.names()))]
    return spark.createDataFrame(told, "what string, value string")


def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts that a model reads, by format and function, two rows a request."""
    s = _own(spark, m={"max_batch_size": 2, "model_parameters": {"rule": "prompt"}})
    rows = _items(spark, 4)
    prompt = {"prompt": "Name {it}", "context_columns": [{"data": "t", "name": "thing"}, {"data": "id"}]}
    return rows.select("id", *[s.llm_complete({"model_name": "m", "tuple_format": f}, prompt).alias(f) for f in ("xml", "json", "markdown")])


def _prompt_sql(rows: str) -> str:
    text = TEMPLATE.replace("{task}", "Name {it}").replace("{rows}", "Rows below: 2\n\n@@").replace("{format}", FORMATS["string"].format(n=2)).replace("{rules}", RULES["complete"])
    before, after = (x.replace("'", "''").replace("\n", "' || chr(10) || '") for x in text.split("@@"))
    return f"'{before}' || {rows} || '{after}'"


def _rendered_sql() -> str:
    nl = "chr(10)"
    xml = f"'<header><column>thing</column><column>COLUMN 1</column></header>' || {nl} || string_agg('<row><column>' || t || '</column><column>' || i || '</column></row>' || {nl}, '' order by i) over w"
    md = f"' | COLUMN_thing | COLUMN 1 | ' || {nl} || ' | ----- | -------- | ' || {nl} || string_agg(' | \"' || t || '\" | \"' || i || '\" | ' || {nl}, '' order by i) over w"
    item = lambda x: f"string_agg('        \"' || {x} || '\"', ',' || {nl} order by i) over w"
    js = f"'{{' || {nl} || '    \"COLUMN 1\": [' || {nl} || {item('i')} || {nl} || '    ],' || {nl} || '    \"thing\": [' || {nl} || {item('t')} || {nl} || '    ]' || {nl} || '}}' || {nl}"
    return f"""
    select i as id, {_prompt_sql(xml)} as xml, {_prompt_sql(js)} as json, {_prompt_sql(md)} as markdown
    from (select i, 'item ' || i as t from range(4) r(i)) window w as (partition by i // 2)
    """


def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values are JSON, nulls the text NULL."""
    s = _own(spark, m={"model_parameters": {"rule": "echo"}})
    rows = spark.range(0, 3, 1, 1).selectExpr("id", "named_struct('a', id, 'b', 'x') as s", "array(id, null) as xs", "map('k', id) as kv", "if(id = 1, null, array(id)) as none")
    asked = {c: s.llm_complete({"model_name": "m"}, _ask(c)).alias(c) for c in ("s", "xs", "kv", "none")}
    return rows.select("id", *asked.values())


def stored_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored model's schema asks for objects, as one given with the call does."""
    s = _own(spark, m={"model_parameters": {"response_format": {"type": "object"}}}, plain={})
    rows = _items(spark, 6)
    own, given = s.llm_complete({"model_name": "m"}, _ask("t")), s.llm_complete({"model_name": "plain", "model_parameters": {"format": {"type": "object"}}}, _ask("t"))
    kind = "digest string, length int"
    return rows.select("id", F.from_json(own, kind).alias("a"), F.from_json(given, kind).alias("b")).select("id", "a.digest", "a.length", (F.col("a") == F.col("b")).alias("same"))


def image_description_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image's description, and the description's embedding."""
    s = _own(spark, eye={"model_parameters": {"rule": "md5"}}, vec={})
    context = [{"data": "url", "type": "image"}]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    told = pages.select("page_id", s.llm_complete({"model_name": "eye"}, {"prompt": "Describe", "context_columns": context}).alias("description"))
    vector = s.llm_embedding({"model_name": "vec"}, {"context_columns": [{"data": "description"}]})
    return told.select("page_id", "description", F.round(vector[0] * 255).cast("int").alias("first"))


def batch_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_size stands for max_batch_size, which wins where both are given."""
    s = _own(spark, old={"batch_size": 3}, both={"batch_size": 3, "max_batch_size": 6})
    for model in ({"model_name": "old"}, {"model_name": "both"}, {"model_name": "both", "batch_size": 4}):
        _items(spark, 12).select(s.llm_complete(model, _ask("t"))).collect()
    return spark.createDataFrame([(k, v["api_calls"]) for k, v in s.metrics().items()], "call string, calls long")


# calls in SQL


def _sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    s = _own(spark, digest={"max_batch_size": 64}, has_the={"max_batch_size": 64, "model_parameters": {"rule": "contains: the "}}, count={"model_parameters": {"rule": "count"}})
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"lex_{t}")
    return s.sql(text)


def sql_llm_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """SELECT doc_id, llm_complete({'model_name': 'digest'}, {'prompt': 'It''s {a}, (b)', 'context_columns': [{'data': text, 'name': 'x'}, {'data': concat(source, ', ')}]}) AS answer FROM lex_documents"""
    return _sql(spark, sf_dir, text, "documents")


def sql_llm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """SELECT doc_id, n_chars FROM (SELECT * FROM lex_documents WHERE lang = 'en') -- cheap first
      WHERE llm_filter({'model_name': 'has_the'}, {'prompt': 'Is it so?', 'context_columns': [{'data': text}]})"""
    return _sql(spark, sf_dir, text, "documents")


def sql_llm_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT item_id, cast(round(llm_embedding({'model_name': 'digest'}, {'context_columns': [{'data': text}]})[0] * 255) as int) AS first FROM lex_benchmark"
    return _sql(spark, sf_dir, text, "benchmark")


def sql_llm_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = "{'prompt': 'Which?', 'context_columns': [{'data': turn}, {'data': text}]}"
    first = lambda f: f"cast(get_json_object(llm_{f}({{'model_name': 'digest'}}, {context}, {{'order_by': turn}}), '$[0].data[0]') as bigint) AS {f}"
    ranked = f"array_join(from_json(get_json_object(llm_rerank({{'model_name': 'digest'}}, {context}), '$[0].data'), 'array<string>'), ',') AS ranked"
    text = f"SELECT conv_id, count(*) AS n, llm_reduce({{'model_name': 'count'}}, {context}) AS counted, {first('first')}, {first('last')}, {ranked} FROM lex_conversations GROUP BY conv_id"
    return _sql(spark, sf_dir, text, "conversations")


def sql_fusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ", ".join(f"round(fusion_{n}(a, b), 12) AS {n}" for n in ("combsum", "combmnz", "combmed", "combanz"))
    values = "VALUES (1, 0.5D, 3, 1), (2, null, 1, 2), (3, double('NaN'), 2, 3) AS t(id, a, r1, r2)"
    return _sql(spark, sf_dir, f"SELECT id, round(fusion_rrf(r1, r2), 12) AS rrf, {own} FROM (SELECT *, double(id) / 4 AS b FROM {values})")


def sql_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _own(spark, m={"max_batch_size": 5, "model_parameters": {"tokens": [4, 1]}})
    _items(spark, 12).createOrReplaceTempView("lex_items")
    s.sql("SELECT llm_complete({'model_name': 'm'}, {'prompt': 'x', 'context_columns': [{'data': t}]}) FROM lex_items").collect()
    before = s.sql("SELECT cast(get_json_object(llm_get_metrics(), '$.llm_complete_1.api_calls') as bigint) AS calls, cast(get_json_object(llm_get_debug_metrics(), '$.thread_count') as bigint) AS tasks")
    return before.crossJoin(s.sql("SELECT llm_reset_metrics() AS reset")).crossJoin(s.sql("SELECT llm_get_metrics() AS after"))


def sql_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "SELECT r_regionkey, llm_complete({'model_name': 'digest'}, {'prompt': 'One answer'}) AS answer, llm_filter({'model_name': 'digest'}, {'prompt': 'So?'}) AS fits FROM lex_region", "region")


QUERIES = {
    "llm_first_windows": _windows("llm_first"),
    "llm_last_windows": _windows("llm_last"),
    "llm_rerank_windows": _windows("llm_rerank"),
    "llm_rerank_passes": _windows("llm_rerank", passes=0),
} | {
    f.__name__: f
    for f in (
        aggregate_back_off,
        single_row_groups,
        answer_lengths,
        overflow_halves,
        usage_limits,
        rate_limits,
        errors,
        metrics_merge,
        statements_one,
        rendered_prompts,
        nested_values,
        stored_schema,
        image_description_embedding,
        batch_alias,
        sql_llm_complete,
        sql_llm_filter,
        sql_llm_embedding,
        sql_llm_aggregates,
        sql_fusions,
        sql_metrics,
        sql_bare,
    )
}

_SHORT = "case when i % 4 = 3 or i = 9 then 'null' else 'item ' || i end"
_TURN = "arg_{f}(turn, {{'d': md5(turn::varchar || '|' || coalesce(text, 'NULL')), 't': turn}})"
_HEX = "(strpos('0123456789abcdef', substr({m}, 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr({m}, 2, 1)) - 1"

ORACLE_SQL = {
    "llm_first_windows": f"with k as ({_KEYED}) select size, {_ALL} from (select size, arg_min(id, m)::varchar as x from k group by size)",
    "llm_last_windows": f"with k as ({_KEYED}) select size, {_ALL} from (select size, arg_max(id, m)::varchar as x from k group by size)",
    "llm_rerank_windows": _rerank_sql(),
    "llm_rerank_passes": f"with k as ({_KEYED}) select size, {_ALL} from (select size, string_agg(id::varchar, ',' order by m) as x from k group by size)",
    "aggregate_back_off": AGGREGATE_BACK_OFF,
    "single_row_groups": "select * from (values ('llm_first', 0::bigint), ('llm_last', 0), ('llm_rerank', 0), ('llm_reduce', 7)) t(function, calls)",
    "answer_lengths": f"select i as id, {_SHORT} as rounds, {_SHORT} as turns, i % 4 = 3 or i = 9 or substr(md5('item ' || i), 1, 1) < '8' as passes from range(10) r(i)",
    "overflow_halves": "select i as id, 'item ' || i as rounds, 'item ' || i as turns, 'null' as nothing from range(50) r(i)",
    "usage_limits": "select i as id, case when i < 4 then 'item ' || i else 'null' end as answer from range(10) r(i)",
    "rate_limits": "select 5::bigint as rows, 5::bigint as answers, true as waited",
    "errors": "select * from (values " + ", ".join(f"('{e}', true)" for e in ERRORS) + ", ('nothing wrong', false)) t(\"case\", refused)",
    "metrics_merge": "select * from (values ('llm_complete_1', 12::bigint, 48::bigint, 3::bigint), ('llm_filter_1', 3, 12, 1), ('after reset', 0, 0, 0)) t(what, calls, tokens, tasks)",
    "statements_one": "select * from (values ('model', 'x'), ('provider', 'ollama'), ('prompts p', '0'), ('prompts q', '2'), ('batch_size', '3'), ('is_async', 'false'), ('tuple_format', 'json'), ('secrets', '__default_ollama')) t(what, value)",
    "rendered_prompts": _rendered_sql(),
    "nested_values": """select i as id, '{"a":' || i || ',"b":"x"}' as s, '[' || i || ',null]' as xs, '{"k":' || i || '}' as kv, case when i = 1 then 'NULL' else '[' || i || ']' end as "none" from range(3) r(i)""",
    "stored_schema": "select i as id, md5('item ' || i) as digest, length('item ' || i)::int as length, true as same from range(6) r(i)",
    "image_description_embedding": f"select page_id, d as description, ({_HEX.format(m='e')})::int as first from (select *, md5(d || ' ') as e from (select page_id, md5(case when url is null then '' else 'image ' || url end) as d from pages))",
    "batch_alias": "select * from (values ('llm_complete_1', 4::bigint), ('llm_complete_2', 2), ('llm_complete_3', 3)) t(call, calls)",
    "sql_llm_complete": "select doc_id, md5(coalesce(text, 'NULL') || '|' || coalesce(source || ', ', 'NULL')) as answer from documents",
    "sql_llm_filter": "select doc_id, n_chars from documents where lang = 'en' and contains(coalesce(text, 'NULL'), ' the ')",
    "sql_llm_embedding": f"select item_id, ({_HEX.format(m='e')})::int as first from (select item_id, md5(coalesce(text, 'NULL') || ' ') as e from benchmark)",
    "sql_llm_aggregates": f"select conv_id, count(*) as n, count(*)::varchar as counted, {_TURN.format(f='min')} as first, {_TURN.format(f='max')} as last, string_agg(turn::varchar, ',' order by md5(turn::varchar || '|' || coalesce(text, 'NULL')), turn) as ranked from conversations group by conv_id",
    "sql_fusions": """select * from (values (1, round(1/63::double + 1/61::double, 12), 0.75::double, 1.5::double, 0.375::double, 0.375::double),
      (2, round(1/61::double + 1/62::double, 12), 0.5, 0.5, 0.25, 0.25), (3, round(1/62::double + 1/63::double, 12), 0.75, 0.75, 0.375, 0.375)) t(id, rrf, combsum, combmnz, combmed, combanz)""",
    "sql_metrics": "select 3::bigint as calls, 1::bigint as tasks, 'Metrics reset successfully' as reset, '{}' as after",
    "sql_bare": "select r_regionkey, md5('One answer') as answer, substr(md5('So?'), 1, 1) < '8' as fits from region",
}
