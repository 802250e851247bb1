import pytest
from pyspark.sql import functions as F

from lexispark.functions import fusion
from lexispark.functions import render as R
from lexispark.operators import search

NAN = float("nan")


def values(spark, rows, expr, schema="id int, a double, b double"):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    return [r[0] for r in frame.select("id", expr.alias("x")).orderBy("id").select("x").collect()]


def rrf(spark, rows):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a int, b int")
    one = [r["x"] for r in frame.withColumn("x", fusion.fusion_rrf("a", "b")).orderBy("id").collect()]
    assert one == [r["score"] for r in fusion.fuse_ranks(frame, "a", "b").orderBy("id").collect()]
    return one


def test_rrf(spark):
    assert rrf(spark, [(1, 1)]) == [1 / 61 + 1 / 61]
    own = [(7, 2), (1, 9), (30, 30), (2, 1)]
    assert rrf(spark, own) == [1 / (60 + a) + 1 / (60 + b) for a, b in own]
    assert rrf(spark, [(1, r) for r in (6, 2, 11)]) == [1 / 66, 1 / 62, 1 / 71]
    assert rrf(spark, [(None, 1), (2, 2)]) == [1 / 60 + 1 / 61, 1 / 62 + 1 / 62]
    assert rrf(spark, [(0, 0)]) == [0.0]


def test_rrf_scope(spark):
    frame = spark.createDataFrame([("p", 1, 1), ("q", 1, 1), ("q", 1, 2)], "g string, a int, b int")
    assert sorted((r["g"], r["x"]) for r in frame.withColumn("x", fusion.fusion_rrf("a", "b", scope=["g"])).collect()) == [("p", 2 / 61), ("q", 1 / 62), ("q", 1 / 61)]


@pytest.mark.parametrize("name, of", [("combanz", lambda x, y: (x + y) / 2), ("combsum", lambda x, y: x + y), ("combmnz", lambda x, y: (x + y) * ((x != 0) + (y != 0))), ("combmed", lambda x, y: (x + y) / 2)])
def test_comb(spark, name, of):
    """Two scores by the definitions; null and NaN count as 0."""
    rows = [(0.25, 0.5), (None, 0.75), (NAN, 2.0), (None, None), (-1.5, 0.5), (0.0, 3.0)]
    zero = lambda v: 0.0 if v is None or v != v else v
    assert values(spark, rows, getattr(fusion, f"fusion_{name}")("a", "b")) == [of(zero(x), zero(y)) for x, y in rows]


def test_comb_shapes(spark):
    row = [(3.0, -1.0)]
    assert values(spark, row, fusion.fusion_combmed("a", "b", F.lit(7))) == [3.0]
    assert values(spark, row, fusion.fusion_combmnz("a", "b")) == [4.0]  # a negative score is a hit
    with pytest.raises(ValueError):
        fusion.fusion_combsum()


def test_fusion_stays_in_codegen(spark):
    frame = spark.range(10).select(fusion.fusion_combmnz("id", "id"), fusion.fusion_combanz("id", F.lit(2)))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_ranks_and_normalisation(spark):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate([5, 7, 7, None, 1, 5])], "id int, v int")
    got = [r["r"] for r in search.ranked(frame, "v", "r").orderBy("id").collect()]
    assert got == [2, 1, 1, 4, 3, 2]
    assert [r["v_norm"] for r in search.min_max(frame, "v").orderBy("id").collect()] == [4 / 6, 1, 1, None, 0, 4 / 6]
    assert [r["v_norm"] for r in search.min_max(frame.where("v = 7"), "v").collect()] == [None, None]
    assert [r["id"] for r in search.top_k(frame, 3, "v", "id").collect()] == [1, 2, 0]


def test_cosine(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in frame.select(search.cosine_similarity("a", "b")).collect()]
    assert got[0] == pytest.approx(2**-0.5) and got[1:] == [None, None]


TWO = [{"data": ["pear", "fig"]}, {"data": ["1", "2"]}]
COUNT = "Rows below: {}\n\n"


def test_tuples():
    x, j, m = R.TupleFormat.XML, R.TupleFormat.JSON, R.TupleFormat.MARKDOWN
    assert R.tuples(TWO, x) == COUNT.format(2) + "<header><column>COLUMN 1</column><column>COLUMN 2</column></header>\n<row><column>pear</column><column>1</column></row>\n<row><column>fig</column><column>2</column></row>\n"
    assert R.tuples(TWO, m) == COUNT.format(2) + ' | COLUMN 1 | COLUMN 2 | \n | -------- | -------- | \n | "pear" | "1" | \n | "fig" | "2" | \n'
    assert R.tuples(TWO, j) == COUNT.format(2) + '{\n    "COLUMN 1": [\n        "pear",\n        "fig"\n    ],\n    "COLUMN 2": [\n        "1",\n        "2"\n    ]\n}\n'
    assert R.tuples([], x) == COUNT.format(0) + "<header></header>\n<row></row>\n"
    assert R.tuples([], m) == COUNT.format(0) + " | Empty | \n | ----- | \n"
    assert R.tuples([], j) == COUNT.format(0) + "{}\n"
    named = [{"name": "width"}, {"name": "depth"}]
    assert R.header(named, x) == "<header><column>width</column><column>depth</column></header>\n"
    assert R.header(named, m) == " | COLUMN_width | COLUMN_depth | \n | ----- | ----- | \n"
    assert R.column_names([{"name": "a"}, {}, {"name": "b"}, {}]) == ["a", "COLUMN 1", "b", "COLUMN 2"]


def test_prompts():
    text = R.render("Sum {it}", TWO, R.TupleFormat.XML, "complete", "string", 2)
    assert "Sum {it}" in text and "fig" in text and "exactly 2 strings" in text
    assert R.with_summary("p", "s") == 'p\n\n{\n    "Previous Batch Summary": "s"\n}'
    assert [len(x) for x in R.split_media([{"type": "image/png"}, {"type": "audio"}, {}, {"type": "tabular"}])] == [2, 1, 1]
    assert R.transcription_name("clip") == "transcription_of_clip" and R.transcription_name(None) == "transcription"
    assert R.TupleFormat.of("markDOWN") is R.TupleFormat.MARKDOWN
    with pytest.raises(ValueError):
        R.TupleFormat.of("csv")
