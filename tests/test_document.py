"""The whole job: real modules, failures, cache, options."""

import ast
import glob
import io
import os
import sys
import sysconfig
import tokenize

import pytest
from pyspark.cloudpickle import register_pickle_by_value

import docweave as dw
from docweave.streaming.incremental import document_stream

register_pickle_by_value(sys.modules[__name__])


def described(language, definition, definition_type, temperature):
    return {"description": "This function zzz marks\n\nthe `text`."}


def counting(folder):
    """A generator that leaves one file per call."""

    def generate(language, definition, definition_type, temperature):
        import tempfile

        os.close(tempfile.mkstemp(dir=folder)[0])
        return {"description": f"This class is {len(definition)} long."}

    return generate


def frame(spark, modules):
    return spark.createDataFrame(list(modules.items()), "path STRING, code STRING")


def run(spark, modules, func=described, **options):
    config = dw.DocumentationConfig(generate_docstring_func=func, **options)
    return dw.document_files(frame(spark, modules), config)


def outputs(done):
    return {r.path: r.code for r in done.outputs().collect()}


def without_added(tree):
    removed = 0
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            value = getattr(node.body[0], "value", None)
            if isinstance(value, ast.Constant) and "Zzz marks" in str(value.value):
                node.body.pop(0)
                removed += 1
    return removed


def comments(code):
    tokens = tokenize.generate_tokens(io.StringIO(code).readline)
    return [t.string for t in tokens if t.type == tokenize.COMMENT]


def check_rewritten(original, new):
    before, after = ast.parse(original), ast.parse(new)
    removed = without_added(after)
    assert ast.dump(before) == ast.dump(after)
    assert comments(original) == comments(new)
    return removed


def test_standard_library_keeps_its_meaning(spark):
    folder = sysconfig.get_path("stdlib")
    modules = {}
    for path in sorted(glob.glob(f"{folder}/[ab]*.py") + glob.glob(f"{folder}/asyncio/*.py")):
        with open(path, encoding="utf-8") as file:
            modules[path] = file.read()
    done = run(spark, modules)
    got = outputs(done)
    assert set(got) == set(modules)
    removed = sum(check_rewritten(code, got[path]) for path, code in modules.items())
    assert removed == done.docstrings().count() > 300

    again = run(spark, got)
    assert again.levels == 0 and outputs(again) == got


ODD = {
    "tabs.py": "class A:\n\tdef f(self):\n\t\treturn 1\n",
    "header.py": "def f(\n  a,  # note\n  b,\n):  # tail\n  return a\n",
    "one.py": "class A:\n    def f(self, a=1): x = a; return x  # tail\n",
    "many.py": "def f(a): return (a,\n  1)\n\nx = 1\n",
    "split.py": "def f(\n  a): return a\n",
    "slash.py": "def f(a): \\\n  return a\n",
    "string.py": 'def f(a="""x\ny"""): return """p\n  q""" + a\n',
    "unicode.py": "def é(ü): return 'ß'\n",
    "nofinal.py": "def f():\n  pass",
    "crlf.py": "def f():\r\n  # c\r\n  return 1\r\n",
    "nested.py": "def f():\n  def g():\n    def h(): pass\n    return h\n  return g\n",
    "decorated.py": "class A:\n  @property\n  def f(self):\n    return 1\n  x = 1\n",
    "fstring.py": 'def f(a):\n  return f"""{a\n  }x\n"""\n',
    "plain.py": "x = 1\n",
    "empty.py": "",
}


@pytest.mark.parametrize("quote", ['"""', "'''", '"', "'"])
def test_odd_modules(spark, quote):
    got = outputs(run(spark, ODD, quote_style=quote))
    assert set(got) == set(ODD)
    for path, code in ODD.items():
        plain = code.replace("\r\n", "\n")
        wanted = sum(
            isinstance(n, (ast.FunctionDef, ast.ClassDef)) for n in ast.walk(ast.parse(plain))
        )
        assert check_rewritten(plain, got[path]) == wanted, path


def test_exact_text_of_a_one_line_method(spark):
    code = "class A:\n    def dot(a, b): return a * b\n"
    got = outputs(run(spark, {"a.py": code}, lambda **_: {"description": "Multiplies."}))
    inner = " " * 16  # the whole indent once per column, kept from the rendering rule
    assert got["a.py"] == (
        'class A:\n    """    \n    Multiplies.\n    """\n    \n'
        f'    def dot(a, b):\n        """{inner}\n{inner}Multiplies.\n{inner}"""\n        \n'
        "        return a * b\n        \n"
    )


def test_outer_text_shows_inner_docstrings(spark):
    def echo(language, definition, definition_type, temperature):
        return {"description": f"Sees {definition.count('Sees')} others in {definition_type}."}

    code = "class A:\n  def f(self):\n    def g(): pass\n  def h(self): pass\n"
    rows = run(spark, {"a.py": code}, echo).docstrings().collect()
    assert {r.d.name: r.data.description for r in rows} == {
        "g": "Sees 0 others in function.",
        "h": "Sees 0 others in function.",
        "f": "Sees 1 others in function.",
        "A": "Sees 3 others in class.",
    }


def test_failures_stay_where_they_are(spark):
    def fussy(language, definition, definition_type, temperature):
        if "boom" in definition:
            raise ValueError("boom")
        if "big" in definition:
            raise dw.TooManyTokens("too big")
        if "void" in definition:
            return {"description": "This function "}
        if "number" in definition:
            return {"description": 5}
        if "nothing" in definition:
            return None
        return dw.FunctionDoc("works.", [dw.ParameterDoc("a", "x")], [], [dw.ExceptionDoc("E", "y")])

    names = ["boom", "big", "void", "number", "nothing", "good"]
    modules = {f"{n}.py": f"def {n}():\n  return 1\n" for n in names} | {"broken.py": "def ("}
    done = run(spark, modules, fussy)
    got = outputs(done)
    assert set(got) == set(modules) - {"broken.py"}
    unchanged = {n for n in names if got[f"{n}.py"] == modules[f"{n}.py"]}
    assert unchanged == set(names) - {"good"}
    assert "Raises:\n    E: y" in got["good.py"]
    summary = {(r.stage, r.status): r.n for r in done.summary().collect()}
    assert summary == {
        ("file", "ok"): 6, ("file", "failed"): 1,
        ("definition", "ok"): 1, ("definition", "generation_error"): 2,
        ("definition", "too_many_tokens"): 1, ("definition", "empty_description"): 1,
        ("definition", "invalid_arguments"): 1,
    }
    errors = {(r.path, r.stage) for r in done.errors().collect()}
    assert errors == {(f"{n}.py", "generate") for n in names if n != "good"} | {("broken.py", "parse")}
    mapping = {r.path: r.written_path for r in done.mapping().collect()}
    assert mapping["good.py"] == "modified_good.py" and "broken.py" not in mapping


def test_each_text_is_generated_once_and_cached(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    modules = {f"m{i}.py": "def same():\n  return 1\n" for i in range(30)}
    modules["own.py"] = "def other(): pass\n"
    options = {"cache_path": str(tmp_path / "cache"), "max_workers": 2, "calls_per_task": 1}
    first = run(spark, modules, counting(calls), **options)
    assert len(os.listdir(calls)) == 2
    second = run(spark, modules, counting(calls), **options)
    assert len(os.listdir(calls)) == 2
    assert outputs(first) == outputs(second)
    run(spark, modules, counting(calls), temperature=0.5, **options)
    assert len(os.listdir(calls)) == 4


def test_many_waves_give_the_same_result(spark):
    modules = {f"m{i}.py": f"def f{i}():\n  return {i}\n" for i in range(40)}
    one = run(spark, modules, dw.offline_generator)
    many = run(spark, modules, dw.offline_generator, max_workers=3, calls_per_task=2)
    assert outputs(one) == outputs(many)
    assert many.docstrings().where("status = 'ok'").count() == 40


def test_failed_answers_are_not_cached(spark, tmp_path):
    def failing(**_):
        raise RuntimeError("down")

    modules, options = {"a.py": "def f(): pass\n"}, {"cache_path": str(tmp_path / "cache")}
    assert outputs(run(spark, modules, failing, **options)) == modules
    assert "Zzz" in outputs(run(spark, modules, **options))["a.py"]


def test_whole_replies_are_validated(spark):
    def reply(model, messages, temperature, function_name):
        assert messages[0]["content"].startswith("You are a robot") and temperature == 0.25
        name, definition = function_name, messages[1]["content"]
        call = f'{{"name": "{name}", "arguments": "{{\\"description\\": \\"from a reply\\"}}"}}'
        if "silent" in definition:
            return '{"choices": [{"message": {"content": "no"}}]}'
        if "skip" in definition:
            call = '{"name": "skip_function", "arguments": "{}"}'
        return f'{{"choices": [{{"message": {{"function_call": {call}}}}}]}}'

    modules = {"a.py": "def f(): pass\ndef silent(): pass\ndef skip(): pass\nclass C: pass\n"}
    rows = run(spark, modules, dw.chat_generator(reply)).docstrings().collect()
    assert {r.d.name: r.status for r in rows} == {
        "f": "ok", "C": "ok", "silent": "no_function_call", "skip": "skipped",
    }
    assert {r.data.description for r in rows if r.data} == {"From a reply"}


def test_init_and_styles(spark):
    modules = {"a.py": "class A:\n  def __init__(self): pass\n"}
    assert run(spark, modules).docstrings().count() == 1
    assert run(spark, modules, skip_init_methods=False).docstrings().count() == 2
    func = dw.PythonStyle(lambda data, indent: f"\n{data['description']}|{len(indent)}\n\n")
    assert "`text`.|2" in outputs(run(spark, modules, docstring_builder=func))["a.py"]
    numpy = outputs(run(spark, {"a.py": "def f(x): return x\n"}, dw.offline_generator,
                        docstring_builder=dw.NumpyStyle()))
    assert "Parameters\n    ----------\n        x : \n            The x.\n" in numpy["a.py"]


def test_a_record_keeps_its_own_sections(spark):
    def generate(language, definition, definition_type, temperature):
        if "Plain" in definition or "def" in definition:
            return dw.ClassDoc("stands alone.")
        if "Mapped" in definition:
            return {"description": "d", "parameters": [{"name": "x"}]}
        return dw.FunctionDoc("takes.", [dw.ParameterDoc("x", "An x.", "int")])

    code = "class Plain: pass\nclass Full: pass\nclass Mapped: pass\ndef f(): pass\n"
    rows = run(spark, {"a.py": code}, generate).docstrings().collect()
    assert {r.d.name: len(r.data.parameters) for r in rows} == {
        "Plain": 0, "Full": 1, "Mapped": 0, "f": 0,
    }


def test_nothing_to_document(spark):
    done = run(spark, {"a.py": "x = 1\n", "b.py": ""})
    assert outputs(done) == {"a.py": "x = 1\n", "b.py": ""}
    assert done.errors().count() == 0
    assert [(r.stage, r.status, r.n) for r in done.summary().collect()] == [("file", "ok", 2)]


def test_stream_of_new_files(spark, tmp_path):
    source, calls = tmp_path / "source", tmp_path / "calls"
    calls.mkdir()
    frame(spark, {"a.py": "def f(): pass\n"}).write.parquet(str(source))
    config = dw.DocumentationConfig(
        generate_docstring_func=counting(calls), cache_path=str(tmp_path / "cache")
    )
    seen = {}

    def advance():
        files = spark.readStream.schema("path STRING, code STRING").parquet(str(source))
        query = document_stream(
            files, config, str(tmp_path / "state"), lambda done, _: seen.update(outputs(done))
        )
        query.awaitTermination()

    advance()
    frame(spark, {"b.py": "def f(): pass\n", "c.py": "class C: pass\n"}).write.mode("append").parquet(str(source))
    advance()
    assert set(seen) == {"a.py", "b.py", "c.py"}
    assert len(os.listdir(calls)) == 2


def test_code_is_not_shuffled_again(spark, monkeypatch):
    """Joins by path use the buckets: only docstrings are exchanged."""
    from docweave.plans import document

    plans = []
    save = document.Run.save

    def recording(self, name, rows):
        if name in ("outputs", "definitions/level=1"):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return save(self, name, rows)

    monkeypatch.setattr(document.Run, "save", recording)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = run(spark, {"a.py": "class A:\n  def f(self): pass\n", "b.py": "x = 1\n"})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(outputs(done)) == 2 and len(plans) == 2
    for plan in plans:
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert "SortMergeJoin" in plan


def test_texts_to_call_stay_where_they_are(spark, monkeypatch):
    """with copies, one text of each key is called; keys and paths are exchanged, texts are not."""
    from docweave.plans import document

    parts, plans = [], []
    generate = document.generate

    def recording(part, func, workers, **limits):
        parts.extend(part.collect())
        plans.append(part._jdf.queryExecution().executedPlan().toString())
        return generate(part, func, workers, **limits)

    monkeypatch.setattr(document, "generate", recording)
    modules = {f"m{i}.py": f"def same(): pass\ndef f{i % 7}(a):\n  return {i % 7}\n" for i in range(40)}
    done = run(spark, modules, dw.offline_generator, max_workers=2, calls_per_task=2)
    assert sorted(r["definition"].split("(")[0] for r in parts) == sorted(["def same", *(f"def f{i}" for i in range(7))])
    assert len(plans) > 1 and not any("Exchange" in plan for plan in plans)
    assert done.docstrings().where("status = 'ok'").count() == 80
    assert {r["uses"] for r in done.table("requests").collect()} == {40, 5, 6}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("docweave_")]
