"""Rendering, replies, requests and options against plain Python."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import docweave as dw
from docweave.functions.models import over_budget, route_model
from docweave.functions.render import docstring_indent
from docweave.functions.replies import parse_arguments, read_reply, strict_json_object
from docweave.operators.requests import distinct_requests, hot_keys, join_by_key
from docweave.schema import DOC_DATA

DATA = {
    "description": "Adds.",
    "parameters": [
        {"name": "a", "description": "First.", "assumed_type": "int"},
        {"name": "", "description": "", "assumed_type": ""},
    ],
    "return_values": [{"name": "", "description": "Sum.", "assumed_type": "int, float"}],
    "exceptions": [{"name": "E", "description": "Bad."}, {"name": "", "description": "Odd."}],
}


def rendered(spark, style, data=DATA):
    rows = spark.createDataFrame([(json.dumps(data),)], "j STRING")
    parsed = rows.select(F.from_json("j", DOC_DATA).alias("d"))
    return parsed.select(style.render(F.col("d"), F.lit("\t"))).first()[0]


def test_google(spark):
    assert rendered(spark, dw.GoogleStyle()) == (
        "\nAdds.\n\nArgs:\n\ta (int): First.\n\tvalue: \n\nReturns:\n\tvalue (int, float): Sum.\n"
        "\nRaises:\n\tE: Bad.\n\tvalue: Odd.\n\n"
    )


def test_numpy(spark):
    assert rendered(spark, dw.NumpyStyle()) == (
        "\nAdds.\n\nParameters\n----------\n\ta : int\n\t\tFirst.\n\tvalue : \n\t\t\n\nReturns\n-------\n"
        "\tvalue : int, float\n\t\tSum.\n\nRaises\n------\n\tE : \n\t\tBad.\n\tvalue : \n\t\tOdd.\n\n"
    )


def test_early_layouts(spark):
    assert rendered(spark, dw.EarlyStyle("google_v0")) == (
        "Adds.\n\nArgs:\n    a (int): First.\n     (): \n\nReturns:\n     (int, float): Sum.\n"
        "\nRaises:\n    E: Bad.\n    : Odd.\n"
    )
    assert rendered(spark, dw.EarlyStyle("numpy_v0")) == (
        "Adds.\n\nParameters\n----------\na : int\n    First.\n : \n    \n\nReturns\n-------\n"
        " : int, float\n    Sum.\n\nRaises\n------\nE\n    Bad.\n\n    Odd.\n"
    )
    with pytest.raises(ValueError):
        dw.EarlyStyle("other")


def test_empty_sections_and_base_style(spark):
    bare = {"description": "D", "parameters": [], "return_values": [], "exceptions": []}
    for style in (dw.GoogleStyle(), dw.NumpyStyle()):
        assert rendered(spark, style, bare) == "\nD\n\n"
    with pytest.raises(NotImplementedError):
        dw.DocstringStyle().render(F.lit(1), F.lit(""))
    assert dw.GoogleStyle() == dw.GoogleStyle() != dw.NumpyStyle()


def test_docstring_indent(spark):
    rows = [(True, "    ", 0, 9), (True, "  ", 4, 9), (False, "\t\t", 0, 3), (False, "  ", 0, 2)]
    frame = spark.createDataFrame(rows, "s BOOLEAN, i STRING, c INT, b INT")
    got = frame.select(docstring_indent(F.col("s"), F.col("i"), F.col("c"), F.col("b"))).collect()
    assert [r[0] for r in got] == ["    ", "  " * 4, "\t\t\t", "  "]


def valid_in_python(text, is_class):
    """The rules, stated on parsed JSON."""
    try:
        value = json.loads(text)
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    out = {"description": value.get("description", "")}
    if not isinstance(out["description"], str):
        return None
    for name, fields in [
        ("parameters", ("name", "description", "assumed_type")),
        ("return_values", ("name", "description", "assumed_type")),
        ("exceptions", ("name", "description")),
    ]:
        items = [] if is_class else value.get(name, [])
        if not isinstance(items, list) or not all(isinstance(i, dict) for i in items):
            return None
        out[name] = [{f: i.get(f, "") for f in fields} for i in items]
        if not all(isinstance(v, str) for i in out[name] for v in i.values()):
            return None
    return out


ARGUMENTS = [
    "{}", "", " ", "null", "[]", "5", '"x"', "{", '{"description": "A"} trailing',
    '{"description": "A"}] x', '{"description": "A"}, {"b": 1', '{"description": "A"}, "x"] y',
    '{"description": "A"}}', ' {"description": "A"} \n', '{"description": null}',
    '{"description": 5}', '{"description": true}', '{"description": {"k": 1}}', '{"description": ["a"]}',
    '{"description": "null"}', '{"description": "é \\u00e9 \\n \\" x"}', '{"other": 1, "description": "A"}',
    '{"parameters": null}', '{"parameters": {}}', '{"parameters": [null]}', '{"parameters": [1]}',
    '{"parameters": [[]]}', '{"parameters": []}', '{"parameters": [{}]}',
    '{"parameters": [{"name": "a"}, {"name": 5}]}', '{"parameters": [{"name": "a"}, {"name": null}]}',
    '{"parameters": [{"name": "a", "extra": null}]}', '{"parameters": [{"name": "a", "extra": [{"name": 1}]}]}',
    '{"return_values": [{"assumed_type": "int", "name": "r", "description": "d"}]}',
    '{"exceptions": [{"name": "E", "assumed_type": 5}]}', '{"exceptions": [{"description": 1.5}]}',
    '{"description": "A", "parameters": 5}', json.dumps(DATA),
]


@pytest.mark.parametrize("kind", ["function", "class"])
def test_arguments_are_checked_strictly(spark, kind):
    rows = spark.createDataFrame(list(enumerate(ARGUMENTS)), "n INT, t STRING")
    data = parse_arguments(F.col("t"), F.lit(kind))
    got = [r[0] for r in rows.orderBy("n").select(data).collect()]
    for text, mine in zip(ARGUMENTS, got):
        mine = mine.asDict(recursive=True) if isinstance(mine, Row) else mine
        assert mine == valid_in_python(text, kind == "class"), text


def test_strict_object_and_reply(spark):
    texts = ['{"a": 1}', '{"a": 1} 2', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n INT, t STRING")
    got = rows.orderBy("n").select(strict_json_object(F.col("t")).isNotNull()).collect()
    assert [r[0] for r in got] == [True, False, False]
    call = '{"choices": [{"message": {"function_call": {"name": "f", "arguments": %s}}}]}'
    replies = [call % '"{}"', call % "{}", call.replace('"f"', '"g"') % '"{}"', "{", '{"choices": []}', None]
    rows = spark.createDataFrame(list(enumerate(replies)), "n INT, t STRING")
    read = rows.orderBy("n").select(read_reply(F.col("t"), F.lit("f")).alias("r")).collect()
    assert [r.r.status for r in read] == [
        "ok", "invalid_arguments", "unexpected_function", "no_function_call", "no_function_call",
        "no_function_call",
    ]
    assert [r.r.arguments for r in read] == ["{}"] + [None] * 5


def test_models(spark):
    rows = spark.createDataFrame([(1,), (4096,), (4097,), (16384,), (16385,)], "n INT")
    got = rows.select(over_budget(F.col("n")), route_model(F.col("n"))).collect()
    small, large = "gpt-3.5-turbo-0613", "gpt-3.5-turbo-16k-0613"
    assert [tuple(r) for r in got] == [
        (False, small), (False, small), (True, large), (True, large), (True, None),
    ]


def test_hot_keys_are_split_and_nothing_is_lost(spark):
    """One key holds most rows: it must be spread, and the join must stay exact."""
    rows = spark.range(30_000).select(
        F.col("id"), F.when(F.col("id") % 3 != 0, "hot").otherwise(F.col("id").cast("string")).alias("cache_key")
    )
    keyed = rows.withColumns({n: F.lit(n) for n in ("language", "definition", "definition_type")})
    requests = distinct_requests(keyed.withColumn("temperature", F.lit(0.25)), "id")
    hot = hot_keys(requests, 30_000, 64)
    assert [tuple(r) for r in hot.collect()] == [("hot", 43)]
    answers = requests.where("cache_key <> '9'").select("cache_key", F.length("cache_key").alias("a"))
    joined = join_by_key(rows, answers, hot, F.col("id"))
    wanted = rows.join(answers, "cache_key", "left").select("cache_key", "id", "a")
    assert joined.count() == 30_000
    assert joined.select("cache_key", "id", "a").exceptAll(wanted).isEmpty()


def test_options():
    good = {"generate_docstring_func": dw.offline_generator}
    assert dw.DocumentationConfig(**good).max_workers == 16
    for bad, error in [
        ({"quote_style": "`"}, ValueError),
        ({"docstring_builder": "google"}, ValueError),
        ({"include_rules": "a.py"}, TypeError),
        ({"exclude_rules": [1]}, TypeError),
        ({"generate_docstring_func": None}, TypeError),
        ({"language": "cpp"}, ValueError),
        ({"max_workers": 0}, ValueError),
    ]:
        with pytest.raises(error):
            dw.DocumentationConfig(**{**good, **bad})
    with pytest.raises(AttributeError):
        dw.DocumentationConfig(**good).inplace = True


def test_answers_checked_in_the_workers_are_those_of_the_columns(spark):
    """calls give checked answers, as the columns would check them."""
    from docweave.operators.answers import checked_answer
    from docweave.operators.generate import check_answers

    raws = [
        "{}", "null", "[]", '{"description":"a"} x', ' {"description":"a"} ', '{"description":null}', '{"description":"a","description":"b"}',
        '{"parameters":[null]}', '{"parameters":[{}]}', '{"parameters":{}}', '{"x":NaN}', '{"description":"\\ud800"}', '{"x":' + "9" * 1001 + "}",
        '{"x":' + "9" * 1000 + "}", '{"x":' + "[" * 998 + "]" * 998 + "}", '{"x":' + "[" * 999 + "]" * 999 + "}", '{"parameters":[{"name":"a","b":{}}]}', None,
    ]
    rows = [(f"{i}-{kind}", kind, raw, False, "ok", None) for i, raw in enumerate(raws) for kind in ("function", "class", "module")]
    names = ["cache_key", "definition_type", "raw", "is_reply", "status", "error"]
    table = spark.createDataFrame(rows, "cache_key string, definition_type string, raw string, is_reply boolean, status string, error string")
    got = {r["cache_key"]: (r["data"] and r["data"].asDict(True), r["status"], r["error"]) for r in check_answers(table).collect()}
    for row in rows:
        answer = checked_answer(dict(zip(names, row)))
        assert got[row[0]] == (answer["data"], answer["status"], answer["error"]), row
