"""What must hold at any size: even tasks, nothing lost in silence, no work done twice."""

import os

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

import docweave as dw
from docweave import workspace
from docweave.operators.extract import explode_definitions, parse_modules
from docweave.operators.generate import generate
from docweave.operators.requests import cache_misses, distinct_requests, hot_keys, with_request
from docweave.sources import files
from docweave.sources.code_files import CodeFilesReader, read_sources, register_source, write_sources
from docweave.sources.globs import expand_rules
from docweave.streaming.incremental import document_stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def requests(spark, count):
    rows = spark.range(count).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("definition"))
    return with_request(rows.withColumn("definition_type", F.lit("class")), "python", 0.25)


@pytest.mark.parametrize("workers", [2, 4, 7])
def test_calls_run_in_as_many_tasks_as_asked(spark, workers):
    """The shuffle has 4 partitions; adaptive execution is on."""

    def name_task(language, definition, definition_type, temperature):
        return dw.ClassDoc(f"task {TaskContext.get().partitionId()}")

    answers = generate(distinct_requests(requests(spark, 400), "id"), name_task, workers)
    assert answers.select("data.description").distinct().count() == workers


def test_requests_are_distinct_without_sorting_texts(spark):
    rows = requests(spark, 50).unionByName(requests(spark, 50).withColumn("id", F.col("id") + 50))
    made = distinct_requests(rows, "id")
    assert "SortAggregate" not in plan(made)
    assert {(r["definition"], r["uses"]) for r in made.collect()} == {(f"text {i}", 2) for i in range(50)}
    assert cache_misses(made, made.where("definition = 'text 7'")).count() == 49


def test_hot_keys_are_relative_to_a_task(spark):
    uses = spark.createDataFrame([("a", 600), ("b", 90), ("c", 60), ("d", 250)], "cache_key string, uses long")
    assert {tuple(r) for r in hot_keys(uses, 1000, 10).collect()} == {("a", 6), ("d", 3)}


def test_definitions_without_text_do_not_touch_code(spark):
    modules = spark.createDataFrame([("a.py", "def f():\n  return 1\n")], "path string, code string")
    slim = explode_definitions(parse_modules(modules), text=False)
    assert "split(" not in plan(slim) and [r["name"] for r in slim.collect()] == ["f"]


@pytest.fixture
def folders(tmp_path):
    for i in range(64):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "m.py").write_text(f"x = {i}\n")
    return tmp_path


def test_listing_and_reading_use_several_tasks(spark, folders):
    paths = expand_rules(spark, [f"{folders}/*/*.py"])
    assert paths.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1
    read = read_sources(paths)
    assert read.count() == 64
    assert read.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1


def test_one_folder_is_split_and_the_driver_expands_little(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"m{i}.py").write_text("x = 1\n")
    register_source(spark)
    df = spark.read.format("code_files").option("splits", "8").load(f"{tmp_path}/*.py")
    assert df.rdd.getNumPartitions() == 8 and df.select("path").distinct().count() == df.count() == 200
    for i in range(100):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "m.py").write_text("x = 1\n")
    reader = CodeFilesReader({"path": f"{tmp_path}/*/*.py", "splits": "8"})
    splits = reader.partitions()
    assert len(splits) <= 16
    assert sorted(row[0] for s in splits for row in reader.read(s)) == sorted(map(str, tmp_path.glob("*/*.py")))


def test_listing_errors_are_raised_but_missing_folders_are_empty(tmp_path, monkeypatch):
    assert files.list_names(str(tmp_path / "none"), False) == []
    (tmp_path / "file").write_text("")
    assert files.list_names(str(tmp_path / "file"), False) == []

    def broken(path):
        raise OSError(5, "the store does not answer")

    monkeypatch.setattr(os, "scandir", broken)
    with pytest.raises(OSError):
        files.list_names(str(tmp_path), False)


def test_failed_writes_leave_no_draft(tmp_path):
    (tmp_path / "taken.py").mkdir()
    with pytest.raises(OSError):
        files.write_text(str(tmp_path / "taken.py"), "x")
    assert os.listdir(tmp_path) == ["taken.py"]
    # A remote system goes through a draft and a move as well.
    files._write_remote(f"file://{tmp_path}/new.py", b"x = 1\n")
    assert (tmp_path / "new.py").read_text() == "x = 1\n" and len(os.listdir(tmp_path)) == 2
    with pytest.raises(OSError):
        files._write_remote(f"file://{tmp_path}/taken.py", b"x")
    assert len(os.listdir(tmp_path)) == 2


def test_writers_report_what_they_could_not_write(spark, tmp_path):
    (tmp_path / "taken.py").mkdir()
    rows = [(str(tmp_path / "taken.py"), "x"), (str(tmp_path / "a.py"), "x = 1\n"), (None, "x"), (str(tmp_path / "b.py"), None)]
    frame = spark.createDataFrame([(w, w, c) for w, c in rows], "path string, written_path string, code string")
    done = {r["written_path"]: r["error"] for r in write_sources(frame).collect()}
    assert [w for w, e in done.items() if e is None] == [str(tmp_path / "a.py")]
    register_source(spark)
    good = frame.where(f"written_path = '{tmp_path}/a.py'")
    good.write.format("code_files").mode("overwrite").save()
    with pytest.raises(Exception, match="is there already"):
        good.write.format("code_files").mode("append").save()
    with pytest.raises(Exception, match="not written"):
        frame.write.format("code_files").mode("overwrite").save()


def test_in_place_failures_and_outcomes(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f(): pass\n")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "c.py").write_text("def (\n")
    (tmp_path / "d.py").write_text("def g(): pass\n")
    (tmp_path / "modified_d.py").mkdir()
    config = dw.DocumentationConfig(dw.offline_generator, include_rules=[f"{tmp_path}/[a-d]*.py"])
    run = dw.document_sources(spark, config)
    assert {(os.path.basename(r["path"]), r["stage"]) for r in run.errors().collect()} == {
        ("bad.py", "parse"), ("c.py", "parse"), ("d.py", "write"),
    }
    assert [os.path.basename(r["path"]) for r in run.mapping().collect()] == ["a.py"]
    assert {(r["stage"], r["status"]): r["n"] for r in run.summary().collect()} == {
        ("file", "ok"): 1, ("file", "failed"): 3, ("definition", "ok"): 2,
    }
    assert run.found().first()[0] == 4
    inplace = dw.DocumentationConfig(dw.offline_generator, include_rules=[f"{tmp_path}/a.py"], inplace=True)
    dw.document_sources(spark, inplace)
    assert '"""' in (tmp_path / "a.py").read_text()
    assert os.path.isdir(run.folder)
    run.drop()
    assert not os.path.exists(run.folder)


def test_repeated_paths(spark):
    rows = [("a.py", "def f(): pass\n")] * 3 + [("b.py", "def g(): pass\n"), ("b.py", "def h(): pass\n"), (None, "x = 1\n"), ("c.py", "x = 1\n")]
    run = dw.document_files(spark.createDataFrame(rows, "path string, code string"), dw.DocumentationConfig(dw.offline_generator))
    assert sorted(r["path"] for r in run.outputs().collect()) == ["a.py", "c.py"]
    assert {(r["path"], r["stage"]) for r in run.errors().collect()} == {("b.py", "read"), (None, "read")}


def test_waves_read_only_their_own_folder(spark, monkeypatch):
    """Fifty waves: what each reads does not grow with those before."""
    seen = []

    def counting(part, func, workers):
        seen.append(len(part.inputFiles()))
        return generate(part, func, workers)

    monkeypatch.setattr("docweave.plans.document.generate", counting)
    code = "".join(f"def f{i}(): return {i}\n" for i in range(50))
    config = dw.DocumentationConfig(dw.offline_generator, max_workers=1, calls_per_task=1)
    run = dw.document_files(spark.createDataFrame([("a.py", code)], "path string, code string"), config)
    assert len(seen) > 20 and max(seen) == 1
    assert run.docstrings().where("status = 'ok'").count() == 50


def test_a_stream_keeps_the_newest_version(spark, tmp_path):
    rows = [("a.py", "def old(): pass\n", 1), ("a.py", "def new(): pass\n", 2), ("b.py", "x = 1\n", 1)]
    spark.createDataFrame(rows, "path string, code string, v int").coalesce(1).write.parquet(f"{tmp_path}/in")
    found = {}

    def on_run(run, batch):
        found.update({r["path"]: r["code"] for r in run.outputs().collect()})

    stream = spark.readStream.schema("path string, code string, v int").parquet(f"{tmp_path}/in")
    config = dw.DocumentationConfig(dw.offline_generator)
    document_stream(stream, config, f"{tmp_path}/check", on_run, version="v").awaitTermination()
    assert set(found) == {"a.py", "b.py"} and "def new" in found["a.py"]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        named = None

        def get(self, key, default):
            return self.named or default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(dw.DocumentationError):
        workspace.shared_folder(Session)
    Session.sparkContext.master = "local[4]"
    assert workspace.shared_folder(Session)
    Conf.named = "hdfs://store/shared/"
    Session.sparkContext.master = "yarn"
    assert workspace.shared_folder(Session) == "hdfs://store/shared"


def test_models_and_declarations(spark):
    def naming_model(model, messages, temperature, function_name, function):
        fields = ",".join(sorted(function["parameters"]["properties"]))
        raise ValueError(f"{model} {function['name'] == function_name} {fields}")

    code = "def f(a): pass\nclass C:\n  x = 1\n\ndef long(a):\n  return (" + "a + " * 300 + "a)\n"
    config = dw.DocumentationConfig(dw.chat_generator(naming_model), models=[("small", 12), ("large", 60)])
    run = dw.document_files(spark.createDataFrame([("a.py", code)], "path string, code string"), config)
    rows = {r["d"]["name"]: (r["status"], r["error"]) for r in run.docstrings().collect()}
    assert rows["long"][0] == "too_many_tokens"
    assert rows["f"] == ("generation_error", "ValueError: small True description,exceptions,parameters,return_values")
    assert rows["C"] == ("generation_error", "ValueError: small True description")


def test_a_custom_style_can_tell_classes_from_functions(spark):
    style = dw.PythonStyle(lambda data, indent: f"\n{','.join(sorted(data))}\n\n")
    config = dw.DocumentationConfig(dw.offline_generator, docstring_builder=style)
    code = "def f(a): pass\nclass C:\n  x = 1\n"
    run = dw.document_files(spark.createDataFrame([("a.py", code)], "path string, code string"), config)
    shown = {r["d"]["name"]: r["docstring"] for r in run.docstrings().collect()}
    assert "description,exceptions,parameters,return_values" in shown["f"]
    assert "description" in shown["C"] and "," not in shown["C"]
