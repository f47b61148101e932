"""References between definitions: scopes, imports, hops, and texts within a budget."""

import pytest
from pyspark.sql import functions as F

import docweave as dw
from docweave.functions.text import token_count
from docweave.operators.extract import explode_definitions, parse_modules
from docweave.operators.references import module_name, module_names

FILES = {
    "lib/pkg/__init__.py": "from .core import helper as tool\nfrom .extra import *\n",
    "lib/pkg/core.py": "def helper(a):\n  return inner(a)\n\ndef inner(a):\n  return a\n\ndef helper2():\n  return helper(1)\n",
    "lib/pkg/extra.py": "def spare():\n  return spare()\n\nclass Base:\n  def go(self):\n    return self.stop() + self.gone\n\n  def stop(this):\n    return this.go()\n",
    "lib/app.py": (
        "import pkg\nimport pkg.core as c\nfrom pkg import spare, tool\n\n"
        "def one(x):\n  return tool(x)\n\n"
        "def two(tool):\n  return tool(1)\n\n"
        "def three():\n  spare = 1\n  return spare\n\n"
        "def four():\n  return [c.helper2 for c in pkg.core.inner] + [c.helper2]\n\n"
        "def five():\n  from pkg.extra import Base as B\n  return lambda one: one(B.go, four)\n\n"
        "@one\nclass Six(pkg.Base):\n  limit = one\n  def two(self, at=three):\n    return two(limit), len(self.five.six)\n\n"
        "def seven():\n  def one():\n    return eight()\n  return one()\n\n"
        "def eight():\n  global two\n  two = 5\n  return two\n"
    ),
    "lib/broken.py": "def (:\n",
    "lib/empty.py": "",
}
WANTED = {
    ("app.one", "pkg.core.helper"),  # through the package's own import
    ("app.four", "pkg.core.helper2"),
    ("app.four", "pkg.core.inner"),
    ("app.five", "pkg.extra.Base.go"),
    ("app.five", "app.four"),
    ("app.Six", "app.one"),
    ("app.Six", "pkg.extra.Base"),  # through an import of all names
    ("app.Six.two", "app.three"),
    ("app.Six.two", "app.two"),  # the class body is not seen from the method
    ("app.Six.two", "app.Six"),  # an attribute that no definition has
    ("app.seven", "app.seven.one"),
    ("app.seven.one", "app.eight"),
    ("app.eight", "app.two"),
    ("pkg.core.helper", "pkg.core.inner"),
    ("pkg.core.helper2", "pkg.core.helper"),
    ("pkg.extra.Base.go", "pkg.extra.Base.stop"),
    ("pkg.extra.Base.go", "pkg.extra.Base"),
    ("pkg.extra.Base.stop", "pkg.extra.Base.go"),
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([*FILES.items(), ("lib/null.py", None)], "path STRING, code STRING")


@pytest.fixture(scope="module")
def found(files):
    return dw.references(files, roots=["lib"])


@pytest.fixture(scope="module")
def symbols(found):
    return {r["def_id"]: r["symbol"] for r in found.symbols.collect()}


def test_names_are_resolved_by_scope_and_import(found, symbols):
    got = {(symbols[r["caller"]], symbols[r["callee"]]) for r in found.edges.collect()}
    assert got == WANTED


def test_ids_are_those_of_the_definitions(files, symbols):
    ids = {r[0] for r in explode_definitions(parse_modules(files), text=False).select("def_id").collect()}
    assert ids == set(symbols)


def test_hops_are_the_fewest(found, symbols):
    reach = {
        (symbols[r["caller"]], symbols[r["callee"]]): r["hops"] for r in dw.reachable(found, hops=3).collect()
    }
    assert len(reach) == dw.reachable(found, hops=3).count()
    brute = dict.fromkeys(WANTED, 1)
    for hops in (2, 3):
        for a, b in [pair for pair, n in brute.items() if n == hops - 1]:
            for c, d in WANTED:
                if b == c and a != d:
                    brute.setdefault((a, d), hops)
    assert reach == brute


def test_a_definition_that_all_use_is_spread(spark):
    """Nine of ten functions use one helper, which uses the others: nothing is lost."""
    uses = "".join(f"def f{i}():\n  return hub()\n\n" for i in range(400))
    others = "".join(f"def g{i}():\n  return 1\n\n" for i in range(40))
    hub = "def hub():\n  return [" + ", ".join(f"g{i}()" for i in range(40)) + "]\n"
    found = dw.references(spark.createDataFrame([("m.py", uses + others + hub)], "path STRING, code STRING"))
    counts = {r["hops"]: r["n"] for r in dw.reachable(found, 2).groupBy("hops").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 400 + 40, 2: 400 * 40}


def test_context_keeps_to_its_budget(files, found, symbols):
    definitions = explode_definitions(parse_modules(files))
    texts = {r["def_id"]: r["definition"] for r in definitions.collect()}
    ids = {symbol: def_id for def_id, symbol in symbols.items()}
    reached = dw.reachable(found, hops=2)
    full = {symbols[r["caller"]]: r for r in dw.reference_context(definitions, reached, 10_000).collect()}
    near, far = texts[ids["pkg.core.helper"]], texts[ids["pkg.core.inner"]]
    assert (full["app.one"]["context"], full["app.one"]["n_references"]) == (f"{near}\n\n{far}", 2)
    tokens = definitions.where(F.col("def_id") == ids["pkg.core.helper"]).select(token_count(F.col("definition"))).first()[0]
    small = {symbols[r["caller"]]: r["context"] for r in dw.reference_context(definitions, reached, tokens).collect()}
    assert small["app.one"] == near
    assert dw.reference_context(definitions, reached, 0).collect() == []


def test_odd_modules(spark):
    for code in (None, "", "def (", "\x00", "x = " + "(" * 500 + ")" * 500, "é = 1\r\ndef f(): return é"):
        assert module_names(code, "m", False)["uses"] == []
    deep = "def f():\n  return " + "+".join(["g()"] * 800) + "\ndef g(): pass\n"
    assert module_names(deep, "m", False)["uses"] == [{"line": 1, "col": 0, "target": "m.g"}]
    empty = spark.createDataFrame([], "path STRING, code STRING")
    found = dw.references(empty)
    assert found.edges.collect() == found.symbols.collect() == dw.reachable(found, 3).collect() == []


def test_module_names_of_paths(spark):
    paths = ["/a/lib/x/y.py", "/a/z.py", "x/__init__.py", "/a/lib/__init__.py.py"]
    rows = spark.createDataFrame([(p,) for p in paths], "p STRING")
    got = [r[0] for r in rows.select(module_name(F.col("p"), ["/a", "/a/lib/"])).collect()]
    assert got == ["x.y", "z", "x", "__init__.py"]
