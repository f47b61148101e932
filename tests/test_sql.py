"""Functions for SQL: table arguments, and the generator with checked answers."""

import json
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_functions import ARGUMENTS

import docweave as dw
from docweave.operators.answers import read_arguments, reply_arguments
from docweave.operators.extract import explode_definitions, parse_modules

CALL = '{"choices": [{"message": {"function_call": %s}}]}'
NAME = "respond_with_structured_docstring_data_for_function"
REPLIES = [
    CALL % json.dumps({"name": NAME, "arguments": '{"description": "A"}'}),
    CALL % json.dumps({"name": NAME, "arguments": {}}),
    CALL % json.dumps({"name": NAME, "arguments": "{"}),
    CALL % json.dumps({"name": NAME}),
    CALL % json.dumps({"name": "other", "arguments": "{}"}),
    CALL % json.dumps({"name": "skip_function"}),
    CALL % "null", CALL % "5", "{", "", '{"choices": []}', '{"choices": 1}', "[]", "null",
    CALL % json.dumps({"name": NAME, "arguments": "{}"}) + " and more",
]


@pytest.mark.parametrize("kind", ["function", "class"])
def test_arguments_are_read_like_columns(spark, kind):
    rows = spark.createDataFrame(list(enumerate(ARGUMENTS)), "n INT, t STRING")
    from docweave.functions.replies import parse_arguments

    for row in rows.select("t", parse_arguments(F.col("t"), F.lit(kind)).alias("d")).collect():
        column = row["d"].asDict(recursive=True) if isinstance(row["d"], Row) else None
        assert read_arguments(row["t"], kind) == column, row["t"]
    for text in ('{"description": "a", "description": "b"}', '{"description": NaN}', '{"x": Infinity}'):
        assert read_arguments(text, kind) is None


def test_replies_are_read_like_columns(spark):
    from docweave.functions.replies import read_reply

    rows = spark.createDataFrame([(t,) for t in REPLIES], "t STRING")
    for row in rows.select("t", read_reply(F.col("t"), F.lit(NAME)).alias("r")).collect():
        assert reply_arguments(row["t"], NAME) == (row["r"]["status"], row["r"]["arguments"]), row["t"]


def naming_generator():
    def naming(language, definition, definition_type, temperature):  # within, so that it travels whole
        if definition == "bad":
            raise ValueError("no")
        if definition == "long":
            raise dw.TooManyTokens("too long")
        if definition == "list":
            return []
        return REPLIES[int(definition)] if definition.isdigit() else {"description": uuid.uuid4().hex}

    return naming


def test_equal_requests_of_a_batch_are_called_once(spark):
    dw.register_generator(spark, naming_generator(), "named")
    rows = spark.range(3000).select("id", F.concat(F.lit("text "), F.col("id") % 7).alias("d")).coalesce(1)
    got = spark.sql("SELECT d, named('python', d, 'function', 0.25D).data.description AS x FROM {rows}", rows=rows)
    assert got.groupBy("d").agg(F.count_distinct("x").alias("n")).where("n > 1").count() == 0
    assert got.select("x").distinct().count() == 7


def test_failures_are_answers(spark):
    dw.register_generator(spark, naming_generator(), "named")
    cases = {"bad": "generation_error", "long": "too_many_tokens", "list": "generation_error", "0": "ok", "1": "invalid_arguments"}
    rows = spark.createDataFrame([*cases.items()], "d STRING, wanted STRING")
    sql = "SELECT d, wanted, named('python', d, 'function', 0.25D) AS a FROM {rows}"
    for row in spark.sql(sql, rows=rows).collect():
        assert row["a"]["status"] == row["wanted"], row
        assert (row["a"]["data"] is None) == (row["a"]["error"] is not None) == (row["wanted"] != "ok")
    odd = spark.sql("SELECT named('python', 'x', 'module', 0.25D).status AS s").first()
    assert odd["s"] == "unsupported_definition_type"


def test_table_function_takes_whole_tables(spark):
    codes = ["def f():\n  pass\n", "class A:\r\n  def g(self): pass\r\n", "def (", "", None, "\ufeffdef h(): pass\n"]
    rows = spark.createDataFrame([(i, f"m{i}.py", c) for i, c in enumerate(codes)], "more INT, path STRING, code STRING")
    dw.register_definitions_table(spark)
    found = spark.sql("SELECT * FROM extract_definitions_table(TABLE({rows}))", rows=rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert {r["path"] for r in got if r["error"]} == {"m2.py", "m4.py"}
    fields = ["path", "name", "kind", "line", "col", "depth", "has_docstring", "body_indent"]
    plain = parse_modules(rows.select("path", F.regexp_replace(F.regexp_replace("code", "\r\n", "\n"), "^\ufeff", "").alias("code")))
    wanted = explode_definitions(plain, text=False).select(fields)
    assert {tuple(r[f] for f in fields) for r in got if not r["error"]} == {tuple(r) for r in wanted.collect()}
    assert found.where("path = 'none'").count() == 0
    assert spark.sql("SELECT * FROM extract_definitions_table(TABLE({rows}))", rows=rows.where("false")).collect() == []
