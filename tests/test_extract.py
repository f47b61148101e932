"""Positions, docstring detection and texts of hand-written modules."""

import textwrap

import pytest

from docweave import register_table_function
from docweave.operators.extract import explode_definitions, module_facts, parse_modules


def only(code, name="f"):
    return next(d for d in module_facts(code)["defs"] if d["name"] == name)


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ('"""x"""', True),
        ('r"x"', True),
        ('u"x"', True),
        ('("x")', True),
        ('"d"; x = 1', True),
        ('b"x"', True),
        ('"a" "b"', False),
        ('("a"\n   "b")', False),
        ('f"x"', False),
        ('"x" + "y"', False),
        ('"x".strip()', False),
        ("...", False),
        ('# c\n  "x"', True),
        ("pass", False),
        ('if x: "d"', False),
    ],
)
def test_has_docstring(body, expected):
    assert only(f"def f():\n  {body}\n")["has_docstring"] is expected
    assert only(f"class f:\n  {body}\n")["has_docstring"] is expected


def test_one_line_bodies_never_have_a_docstring():
    assert not only('def f(): "one"\n')["has_docstring"]
    assert not only('def f(): \\\n  "one"\n')["has_docstring"]
    assert only('def f(\n a): "one"\n')["suite"]
    assert not only('def f(\n a): "one"\n')["single_line"]


def test_levels_wait_for_inner_definitions():
    code = textwrap.dedent(
        '''
        class A:
            def __init__(self):
                def inner(): pass
            class B:
                """Has."""
                def m(self): pass
        def f():
            return 1
        '''
    )
    levels = {d["name"]: d["level"] for d in module_facts(code)["defs"]}
    assert levels == {"A": 1, "__init__": -1, "inner": 0, "B": -1, "m": 0, "f": 0}
    levels = {d["name"]: d["level"] for d in module_facts(code, skip_init=False)["defs"]}
    assert levels["__init__"] == 1 and levels["A"] == 2
    depths = {d["name"]: d["depth"] for d in module_facts(code)["defs"]}
    assert depths == {"A": 0, "__init__": 1, "inner": 2, "B": 1, "m": 2, "f": 0}


def test_definitions_inside_other_statements():
    code = textwrap.dedent(
        """
        try:
            def a(): pass
        except E:
            def b(): pass
        else:
            def c(): pass
        finally:
            def d(): pass
        match x:
            case 1:
                def e(): pass
        with y:
            for z in w:
                async def g(): pass
        """
    )
    assert [d["name"] for d in module_facts(code)["defs"]] == list("abcdeg")


def test_long_elif_chain_does_not_overflow():
    code = "if a: pass\n" + "elif a: pass\n" * 3000 + "else:\n  def f(): pass\n"
    assert only(code)["depth"] == 0


def texts(spark, code):
    rows = explode_definitions(parse_modules(spark.createDataFrame([("m.py", code)], "path STRING, code STRING")))
    return {row.name: row.definition for row in rows.collect()}


def test_definition_text(spark):
    code = textwrap.dedent(
        '''\
        # module comment
        def first(): pass

        # about A
        @dec(1)
        class A:
            # about m
            def m(self, a="""x
            y"""):
                return "é" + \\
            a
                # end of m
            # end of A
        x = """
        def not_a_definition(): pass
        """
        if x:
            pass
            # end of if
        # about last
        def last(): pass
        # end of module
        '''
    )
    got = texts(spark, code)
    assert got["first"] == "def first(): pass"
    assert got["A"].startswith("# about A\n@dec(1)\nclass A:\n    # about m\n")
    assert got["A"].endswith("# end of m\n    # end of A")
    assert got["m"] == (
        '# about m\ndef m(self, a="""x\n    y"""):\n    return "é" + \\\n    a\n    # end of m'
    )
    assert got["last"] == "# about last\ndef last(): pass"
    assert "not_a_definition" not in got


def test_bad_modules_keep_their_row(spark):
    bad = [("a.py", "def ("), ("b.py", None), ("c.py", "x\0"), ("d.py", ""), ("e.py", "x = 1")]
    rows = parse_modules(spark.createDataFrame(bad, "path STRING, code STRING")).collect()
    failed = {r.path: r.error for r in rows if r.error}
    assert set(failed) == {"a.py", "b.py", "c.py"}
    assert failed["a.py"].startswith("SyntaxError")


def test_table_function(spark):
    register_table_function(spark)
    spark.createDataFrame([("a.py", "class A:\n  def f(self): pass\n")], "path STRING, code STRING"
                          ).createOrReplaceTempView("modules")
    rows = spark.sql(
        "SELECT path, d.name, d.kind, d.line FROM modules, LATERAL extract_definitions(code) d"
    ).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("a.py", "A", "class", 1), ("a.py", "f", "function", 2),
    ]


def test_layout_without_tokens_is_that_of_the_tokenizer():
    """strings, brackets and line breaks say as much as all tokens."""
    from docweave.operators.extract import _Layout

    cases = [
        "", "x = 1", "\n\n# c\n", "def f():\n\tif 1:\n\t\tpass\n\t# c\n  \n\tx = (1,\n2)\n# z",
        "def f(a):\n  return a or\"x\" if a else'y'\n", "class A:\n  '''a\nb''' ; x = 1\n  def g(self): pass",
        "def f(): return rb'a' + Rb\"\"\"x\n\\\"\"\"\" + u'é'\nx = 'é' ; y = \"#\"\n", "def f(): '''a\nb'''; return 1\n",
        "def é(a='#', b=\"'\"): # 'x\n  return {'a': [1,\n\n # (\n 2]}\n", "x = '\\\n y'\n  # c\n", "def f():\n  pass\n  #",
    ]
    for code in cases:
        quick, slow = (_Layout.__new__(_Layout) for _ in range(2))
        for one in (quick, slow):
            one.lines, one.indent, one.logical_ends, one.strings, one.dedents, one.spans = code.split("\n"), "", [], [], set(), []
        assert quick._scan(code)
        slow._tokenize(code)
        for name in ("indent", "logical_ends", "strings", "spans"):
            assert getattr(quick, name) == getattr(slow, name), (code, name)
    for code in ("x = f'{1}'\n", "x = 1 + \\\n  2\n", "x = 1\n\x0c\ny = 2\n"):
        one = _Layout(code)
        assert not one._scan(code)
