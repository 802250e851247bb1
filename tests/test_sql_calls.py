import hashlib

import pytest

from lexispark.plans import rewrite as W
from lexispark.plans.engine_queries import QUERIES
from lexispark.plans.spec import SpecError
from lexispark.session import Session


def test_values():
    text = "{'a': [1, -2.5, true, null], b: {'c': 'it''s'}, 'data': upper(concat(x, ':,')) || 'y' -- note\n}"
    assert W.value_of(W.tokens(text)) == {"a": [1, -2.5, True, None], "b": {"c": "it's"}, "data": "upper(concat(x, ':,')) || 'y'"}
    assert isinstance(W.value_of(W.tokens("x + 1")), W.Expression) and W.value_of(W.tokens("{}")) == {}
    for wrong in ("{'a'}", "{'a': }", "[1, ]"):
        with pytest.raises(W.RewriteError):
            W.value_of(W.tokens(wrong))


def test_rewrite_finds_calls_only():
    told = []

    def call(name, values, texts):
        told.append((name, values))
        return f"<{name}>"

    text = "select 'llm_filter(1)', /* llm_reduce(2) */ s.llm_first(3), llm_last, `llm_rerank(4)`, LLM_Complete ( {'a': fusion_combsum(x, y)} ) from t -- llm_filter(5)"
    assert W.rewrite(text, call) == text.replace("LLM_Complete ( {'a': fusion_combsum(x, y)} )", "<llm_complete>")
    assert told == [("fusion_combsum", ["x", "y"]), ("llm_complete", [{"a": "<fusion_combsum>"}])]
    with pytest.raises(W.RewriteError, match="closing"):
        W.rewrite("select llm_filter({'a': 1}", call)


def test_calls_in_sql(spark):
    s = Session(spark)
    s.sql("CREATE MODEL('m', 'rules', 'offline')")
    spark.createDataFrame([(1, "a'b", [1]), (2, None, None)], "id int, t string, xs array<int>").createOrReplaceTempView("lex_odd")
    got = s.sql("select id, llm_complete({'model_name': 'm'}, {'prompt': 'x', 'context_columns': [{'data': t}, {'data': xs}, {'data': 'a\\'b'}]}) as a from lex_odd order by id").collect()
    assert [r["a"] for r in got] == [hashlib.md5(x.encode()).hexdigest() for x in ("a'b|[1]|a'b", "NULL|NULL|a'b")]
    nested = s.sql("select llm_embedding({'model_name': 'm'}, {'context_columns': [{'data': llm_complete({'model_name': 'm'}, {'prompt': 'x', 'context_columns': [{'data': t}]})}]}) as v from lex_odd where id = 1").first()["v"]
    inner = hashlib.md5(b"a'b").hexdigest()
    assert nested == [x / 255 for x in hashlib.md5(f"{inner} ".encode()).digest()[:8]]
    assert s.sql("select llm_reduce({'model_name': 'm'}, {'prompt': 'x', 'context_columns': [{'data': t}]}) as a from lex_odd where id > 9").first()["a"] is None
    for wrong in ("llm_complete('m', 'x')", "llm_filter({'model_name': 'm'})", "llm_embedding({'model_name': 'm'}, {'prompt': 'x'})", "fusion_rrf()"):
        with pytest.raises((SpecError, W.RewriteError)):
            s.sql(f"select {wrong} from lex_odd")
    s.close()


@pytest.mark.parametrize("name", QUERIES)
def test_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
