"""Rules, file reading and writing on real folders."""

import glob
import os

import pytest

import docweave as dw
from docweave.operators.checks import failed_outputs
from docweave.sources.code_files import decode_sources, read_sources, write_sources
from docweave.sources.globs import expand_rules, require_paths, set_difference, source_paths


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name in (
        "a.py", "b.py", "__init__.py", "_c.py", ".hidden.py", "notes.txt", "test_a.py",
        "pkg/__init__.py", "pkg/d.py", "pkg/test_d.py", "pkg/sub/e.py", "pkg/sub/deep/f.py",
        ".git/g.py", "x[1].py",
    ):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"# {name}\n")
    return str(root)


RULES = [
    "*.py", "**/*.py", "*/*.py", "a.py", "./a.py", "missing.py", "nothing/*.py", "[ab].py",
    "_*.py", ".*.py", "*", "**", "pkg/*/e.py", "pkg/**", "pkg/", "**/sub/*.py", "x[[]1].py", "?.py",
]


def listed(frame):
    return sorted(r.path for r in frame.collect())


def test_rules_match_like_glob(spark, tree):
    for recursive in (False, True):
        rules = [f"{tree}/{rule}" for rule in RULES]
        want = sorted(p for rule in rules for p in set(glob.glob(rule, recursive=recursive)))
        got = expand_rules(spark, rules, recursive)
        assert sorted(set(listed(got))) == sorted(set(want)), recursive


def test_set_difference_compares_spelling(spark, tree, monkeypatch):
    make = lambda names: spark.createDataFrame([(n,) for n in names], "path STRING")
    got = set_difference(make(["a.py", "a.py", "./a.py", "b.py"]), make(["a.py", "c.py"]))
    assert listed(got) == ["./a.py", "b.py"]


def test_nothing_to_process(spark, tree):
    with pytest.raises(dw.DocumentationError, match="No paths to process"):
        require_paths(source_paths(spark, [f"{tree}/*.py"], [f"{tree}/*.py"]))
    with pytest.raises(dw.DocumentationError):
        dw.document_sources(spark, dw.DocumentationConfig(dw.offline_generator))


def test_reading_keeps_every_row(spark, tmp_path):
    (tmp_path / "__init__.py").write_bytes(b"x = 1\r\ny = 2\r")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "mark.py").write_bytes(b"\xef\xbb\xbfx\n")
    (tmp_path / "folder.py").mkdir()
    rows = decode_sources(read_sources(expand_rules(spark, [f"{tmp_path}/*.py"]))).collect()
    got = {os.path.basename(r.path): (r.code, r.error) for r in rows}
    assert got["__init__.py"] == ("x = 1\ny = 2\n", None)
    assert got["bad.py"] == (None, None)
    assert got["mark.py"] == ("x\n", None)
    assert got["folder.py"][0] is None and "IsADirectoryError" in got["folder.py"][1]


def test_code_files_format(spark, tree, tmp_path):
    dw.register_source(spark)
    read = spark.read.format("code_files")
    rows = read.load(f"{tree}/pkg/*.py")
    assert {os.path.basename(r.path) for r in rows.collect()} == {"__init__.py", "d.py", "test_d.py"}
    assert rows.where("error IS NULL").count() == 3
    names = read.option("content", "false").option("recursive", "true").load(f"{tree}/**/*.py")
    want = glob.glob(f"{tree}/**/*.py", recursive=True)
    assert listed(names.select("path")) == sorted(want)
    assert names.where("content IS NOT NULL").count() == 0
    assert read.load(f"{tree}/none/*.py").count() == 0

    out = spark.createDataFrame(
        [(f"{tmp_path}/m{i}.py", f"x = {i}\n") for i in range(5)], "written_path STRING, code STRING"
    )
    out.write.format("code_files").mode("append").save()
    assert (tmp_path / "m3.py").read_text() == "x = 3\n"
    assert len(os.listdir(tmp_path)) == 5


def test_writing_isolates_failures(spark, tmp_path):
    rows = [("a", f"{tmp_path}/a.py", "x"), ("b", f"{tmp_path}/missing/b.py", "y")]
    done = write_sources(spark.createDataFrame(rows, "path STRING, written_path STRING, code STRING"))
    errors = {r.path: r.error for r in done.collect()}
    assert errors["a"] is None and "FileNotFoundError" in errors["b"]
    assert (tmp_path / "a.py").read_text() == "x"


def test_failed_outputs(spark):
    outputs = spark.createDataFrame(
        [("a", "ma", "x"), ("b", "mb", ""), ("c", "mc", "y")], "path STRING, written_path STRING, code STRING"
    )
    listing = spark.createDataFrame([("ma",), ("mb",)], "path STRING")
    got = {(r.path, r.reason) for r in failed_outputs(outputs, listing).collect()}
    assert got == {("b", "empty"), ("c", "missing")}


@pytest.mark.parametrize("inplace", [False, True])
def test_documenting_a_folder(spark, tmp_path, inplace):
    (tmp_path / "__init__.py").write_text("def dot(a, b): return a * b\n")
    (tmp_path / "broken.py").write_text("def (\n")
    (tmp_path / "bad.py").write_bytes(b"def f(): '\xff'\n")
    (tmp_path / "test_x.py").write_text("def t(): pass\n")
    config = dw.DocumentationConfig(
        generate_docstring_func=dw.offline_generator,
        include_rules=[f"{tmp_path}/*.py"],
        exclude_rules=[f"{tmp_path}/test_*.py", f"{tmp_path}/modified_*.py"],
        inplace=inplace,
    )
    done = dw.document_sources(spark, config)
    written = tmp_path / ("__init__.py" if inplace else "modified___init__.py")
    assert "Is dot with 1 lines." in written.read_text()
    assert {r.path: r.written_path for r in done.mapping().collect()} == {
        f"{tmp_path}/__init__.py": str(written)
    }
    failed = {os.path.basename(r.path): r.stage for r in done.errors().collect()}
    assert failed == {"broken.py": "parse", "bad.py": "parse"}
    assert len(os.listdir(tmp_path)) == (4 if inplace else 5)
