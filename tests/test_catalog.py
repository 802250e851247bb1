import json

import pytest

from lexispark.plans import statements as S
from lexispark.plans.catalog import Catalog, CatalogError, checked_args
from lexispark.plans.spec import SpecError, resolve_columns, resolve_model, resolve_prompt
from lexispark.session import Session


@pytest.fixture()
def session(spark, tmp_path):
    s = Session(spark, tmp_path / "global")
    yield s
    s.close()


@pytest.mark.parametrize(
    "text, want",
    [
        ("create model('m', 'g', 'openai')", S.Statement("create", "model", "m", ("g", "openai"))),
        ("CREATE GLOBAL MODEL ( 'm','g','openai', {\"batch_size\": 3, \"model_parameters\": {\"a\": \"}\"}} ) ;", S.Statement("create", "model", "m", ("g", "openai"), {"batch_size": 3, "model_parameters": {"a": "}"}}, "global")),
        ("-- a comment\nUPDATE MODEL 'm' TO local -- another", S.Statement("move", "model", "m")),
        ("update prompt('p', 'it -- is; text')", S.Statement("update", "prompt", "p", ("it -- is; text",))),
        ("DELETE PROMPT 'p';", S.Statement("delete", "prompt", "p")),
        ("get models", S.Statement("get", "model")),
        ("GET MODELS 'x'", S.Statement("get", "model", "x")),
        ("GET PROMPT 'x'", S.Statement("get", "prompt", "x")),
        ("CREATE SECRET (TYPE OPENAI, API_KEY 'k')", S.Statement("create", "secret", None, ("openai",), {"api_key": "k"})),
        ("create persistent secret mine (type azure_llm, api_key 'k', resource_name = 'r')", S.Statement("create", "secret", "mine", ("azure_llm",), {"api_key": "k", "resource_name": "r"})),
    ],
)
def test_parse(text, want):
    assert S.is_own(text) and S.parse(text) == want


@pytest.mark.parametrize("text", ["CREATE MODEL('m', 'g')", "CREATE MODEL('', 'g', 'o')", "CREATE MODEL('m','g','o', {bad})", "DELETE MODEL m", "GET MODEL", "GET MODELS 'a' 'b'", "UPDATE MODEL 'm' TO here", "CREATE PROMPT('p')", "CREATE PROMPT('p','x') y", "CREATE MODEL('m','g','o'", "create secret (api_key 'x')", "GET PROMPTS $"])
def test_reject(text):
    with pytest.raises(S.StatementError):
        S.parse(text)


def test_other_sql_is_sparks(session):
    assert not S.is_own("select 'get models'") and session.sql("select 1 as x").first()["x"] == 1


def test_models(session, spark):
    sql = session.sql
    assert sql("CREATE MODEL('m', 'g', 'openai')").first()["status"] == "Model created successfully"
    for taken in ("m", "default"):
        with pytest.raises(CatalogError, match="already exist"):
            sql(f"CREATE GLOBAL MODEL('{taken}', 'g', 'openai')")
    sql("UPDATE MODEL('m', 'h', 'ollama', {\"rate_limit\": 3})")
    row = sql("GET MODEL 'm'").first()
    assert (row["scope"], row["model"], row["provider_name"], json.loads(row["model_args"])) == ("local", "h", "ollama", {"rate_limit": 3})
    assert sql("UPDATE MODEL 'm' TO GLOBAL").first()["status"] == "Model scope updated successfully"
    with pytest.raises(CatalogError, match="already exist"):
        sql("UPDATE MODEL 'm' TO GLOBAL")
    sql("UPDATE MODEL 'absent' TO GLOBAL")
    other = Session(spark, session.catalog.shared.path.parent)
    assert other.sql("GET MODEL 'm'").first()["scope"] == "global"
    other.close()
    sql("DELETE MODEL 'm'")
    sql("DELETE MODEL 'm'")
    with pytest.raises(CatalogError, match="doesn't exist"):
        sql("UPDATE MODEL('m', 'h', 'ollama')")
    empty = sql("GET MODEL 'm'")
    assert empty.count() == 0 and empty.columns == ["scope", "model_name", "model", "provider_name", "model_args"]
    assert sql("GET MODELS").count() == 7


def test_prompts(session):
    sql = session.sql
    sql("CREATE PROMPT('p', 'one')")
    with pytest.raises(CatalogError, match="already exist"):
        sql("CREATE GLOBAL PROMPT('p', 'x')")
    sql("UPDATE PROMPT('p', 'two')")
    sql("UPDATE PROMPT 'p' TO GLOBAL")
    sql("UPDATE PROMPT('p', 'three')")
    assert [(r["scope"], r["prompt"], r["version"]) for r in sql("GET PROMPT 'p'").collect()] == [("global", "three", "3"), ("global", "two", "2"), ("global", "one", "1")]
    assert {(r["prompt_name"], r["version"]) for r in sql("GET PROMPTS").collect()} == {("p", "3"), ("hello-world", "1")}
    c = session.catalog
    assert c.prompt("p") == "three" and c.prompt("p", 2) == "two"
    assert resolve_prompt({"prompt_name": "p", "version": 1}, c) == "one" and resolve_prompt({"prompt_name": "p", "version": "2"}, c) == "two"
    for wrong in ({}, {"prompt": ""}, {"prompt": "x", "prompt_name": "p"}, {"version": 1}, {"prompt_name": "p", "version": 9}):
        with pytest.raises(ValueError):
            resolve_prompt(wrong, c)
    sql("DELETE PROMPT 'p'")
    with pytest.raises(CatalogError, match="doesn't exist"):
        sql("UPDATE PROMPT('p', 'x')")


def test_locked_catalog(session, monkeypatch):
    import lexispark.plans.catalog as C

    monkeypatch.setattr(C, "ATTACH_PAUSE", 0.01)
    path = session.catalog.shared.path
    path.parent.mkdir(parents=True)
    path.with_suffix(".lock").touch()
    with pytest.raises(CatalogError, match="locked"):
        session.sql("CREATE GLOBAL MODEL('m', 'g', 'openai')")


@pytest.mark.parametrize("args", [{"x": 1}, {"batch_size": 0}, {"max_batch_size": -1}, {"batch_size": True}, {"batch_size": "3"}, {"tuple_format": 3}, {"tuple_format": "csv"}, {"model_parameters": "x"}, {"is_async": "yes"}, {"rate_limit": 0}, {"usage_limit": {}}, {"usage_limit": {"tokens": 3}}, {"usage_limit": {"total_tokens_limit": 0}}])
def test_model_args_rejected(args):
    with pytest.raises(ValueError):
        checked_args(args)


def test_resolution():
    c = Catalog()
    c.create_model("m", "g", "Azure", {"max_batch_size": 4, "tuple_format": "json", "usage_limit": {"total_tokens_limit": 9}})
    own = resolve_model({"model_name": "m"}, c)
    assert (own.model, own.provider, own.secret, own.batch, own.format.name, own.is_async, own.usage_limit) == ("g", "azure", "__default_azure_llm", 4, "JSON", True, (("total_tokens_limit", 9),))
    own = resolve_model({"model_name": "m", "max_batch_size": 2, "batch_size": 7, "secret_name": "s", "is_async": False, "model_parameters": '{"t": 1}'}, c)
    assert (own.batch, own.secret, own.is_async, own.settings) == (2, "s", False, {"t": 1})
    with pytest.warns(DeprecationWarning):
        assert resolve_model({"model_name": "default", "batch_size": 7}, c).batch == 7
    own = resolve_model({"model_name": "default"}, c)
    assert (own.model, own.provider, own.batch, own.format.name) == ("gpt-4o-mini", "openai", 16, "XML")
    for wrong in ({}, {"model_name": "absent"}, {"model_name": "m", "colour": 1}, {"model_name": "m", "provider": "x"}, "m"):
        with pytest.raises(ValueError):
            resolve_model(wrong, c)


@pytest.mark.parametrize("columns", ["x", [{"name": "a"}], [{"data": "a", "other": 1}], [{"data": "a", "type": "audio"}], [{"data": "a", "transcription_model": "default"}], ["a"]])
def test_context_columns_rejected(columns):
    with pytest.raises(SpecError):
        resolve_columns(columns, Catalog())
