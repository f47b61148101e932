"""Streams: versions that come late, state that expires, files that appear between batches and restarts."""

import os
import time

import pytest
from pyspark.sql import functions as F

import docweave as dw
from docweave.config import DocumentationError
from docweave.sources import code_files
from docweave.sources.code_files import CodeFilesReader, CodeFilesStreamReader, register_source
from docweave.streaming.incremental import document_stream
from docweave.streaming.versions import newest_versions, use_rocksdb
from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringContains, StringStartsWith
from test_document import counting, outputs


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, "path STRING, code STRING, v INT").coalesce(1).write.mode("append").parquet(str(folder))


def test_an_older_version_in_a_later_batch_is_refused(spark, tmp_path):
    source, calls = tmp_path / "source", tmp_path / "calls"
    calls.mkdir()
    config = dw.DocumentationConfig(generate_docstring_func=counting(calls), cache_path=str(tmp_path / "cache"))
    seen, refused = [], []

    def advance(rows):
        arrive(spark, source, rows)
        files = spark.readStream.schema("path STRING, code STRING, v INT").parquet(str(source))
        query = document_stream(
            files, config, str(tmp_path / "state"), lambda run, _: seen.append(outputs(run)), version="v",
            on_refused=lambda rows, _: refused.extend((r.path, r.version, r.status) for r in rows.collect()),
        )
        query.awaitTermination()

    advance([("a.py", "def f2(): pass\n", 2), ("a.py", "def f1(): pass\n", 1), ("b.py", "def g1(): pass\n", 1)])
    advance([("a.py", "def old(): pass\n", 1), ("a.py", "def f2(): pass\n", 2), ("b.py", "def g3(): pass\n", 3), ("b.py", "def other(): pass\n", 1)])
    advance([("b.py", "def g2(): pass\n", 2), ("b.py", "def x(): pass\n", 3), ("a.py", "def f3(): pass\n", 3)])
    assert [sorted((p, c.split("(")[0]) for p, c in one.items()) for one in seen] == [
        [("a.py", "def f2"), ("b.py", "def g1")], [("b.py", "def g3")], [("a.py", "def f3")],
    ]
    assert sorted(refused) == sorted([
        ("a.py", 1, "superseded"), ("a.py", 1, "late"), ("a.py", 2, "repeated"), ("b.py", 1, "conflict"),
        ("b.py", 2, "late"), ("b.py", 3, "conflict"),
    ])
    assert len(os.listdir(calls)) == 4


def test_two_texts_of_one_version_are_an_error_of_the_run(spark, tmp_path):
    arrive(spark, tmp_path / "source", [("a.py", f"def f{i}(): pass\n", 1) for i in range(4)] + [(None, "x = 1\n", None), ("b.py", None, 1)])
    files = spark.readStream.schema("path STRING, code STRING, v INT").parquet(f"{tmp_path}/source")
    errors = []
    config = dw.DocumentationConfig(generate_docstring_func=dw.offline_generator)
    document_stream(
        files, config, f"{tmp_path}/state", lambda run, _: errors.extend(run.errors().collect()), version="v"
    ).awaitTermination()
    assert {(e.path, e.stage) for e in errors} >= {("a.py", "read"), (None, "read")}


def test_state_expires(spark, tmp_path):
    use_rocksdb(spark)
    (tmp_path / "judged").mkdir()
    source = spark.createDataFrame([], "path STRING, code STRING, v INT")
    source.write.parquet(f"{tmp_path}/source")
    files = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/source")
    judged = newest_versions(files, "v", expire_after=6)
    writer = judged.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state")
    query = writer.trigger(processingTime="1 second").start(f"{tmp_path}/judged")

    def got():
        rows = spark.read.schema(judged.schema).parquet(f"{tmp_path}/judged").collect()
        return {r.version: r.status for r in rows}

    def advance(version):
        arrive(spark, tmp_path / "source", [("a.py", "x = 1\n", version)])
        until = time.time() + 40
        while version not in got() and time.time() < until:
            time.sleep(0.5)

    try:
        advance(5)
        advance(4)
        time.sleep(8)
        advance(3)
    finally:
        query.stop()
    assert got() == {5: "newest", 4: "late", 3: "newest"}
    config = dw.DocumentationConfig(generate_docstring_func=dw.offline_generator)
    with pytest.raises(ValueError):
        document_stream(files, config, f"{tmp_path}/other", print, version="v", expire_after=6)


SCHEMA = "path STRING, content BINARY, error STRING, changed BIGINT"


def write(folder, name, text):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_stream_of_files_over_restarts(spark, tmp_path):
    source = tmp_path / "source"
    register_source(spark)
    for i in range(7):
        write(source, f"d{i % 2}/m{i}.py", f"x = {i}\n")
    fail = []

    def start():
        files = spark.readStream.format("code_files").schema(SCHEMA).options(
            log=f"{tmp_path}/log", max_files="3", settle="0"
        ).load(f"{source}/*/*.py")

        def keep(batch, batch_id):
            rows = batch.select(F.lit(batch_id).alias("batch"), "path", F.col("content").cast("string").alias("text"))
            rows.write.mode("overwrite").parquet(f"{tmp_path}/got/batch={batch_id}")
            if fail:
                raise RuntimeError("lost")

        return files.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").start()

    def got():
        rows = spark.read.schema("path STRING, text STRING, batch BIGINT").parquet(f"{tmp_path}/got").collect()
        return sorted((os.path.basename(r.path), r.text) for r in rows)

    query = start()
    query.processAllAvailable()
    assert got() == [(f"m{i}.py", f"x = {i}\n") for i in range(7)]
    write(source, "d0/new.py", "x = 7\n")
    query.processAllAvailable()
    query.stop()
    assert len(got()) == 8
    # While it is stopped: a new file, a changed one, and one moved in with an old time of change.
    write(source, "d1/later.py", "x = 8\n")
    write(source, "d0/m0.py", "x = 9\n")
    write(tmp_path, "elsewhere.py", "x = 10\n")
    os.utime(tmp_path / "elsewhere.py", (1, 1))
    os.rename(tmp_path / "elsewhere.py", source / "d0" / "moved.py")
    fail.append(1)
    query = start()
    with pytest.raises(Exception, match="lost"):
        query.processAllAvailable()
    fail.clear()
    query = start()  # the batch that was lost is read again
    query.processAllAvailable()
    query.stop()
    wanted = [(f"m{i}.py", f"x = {i}\n") for i in range(7)]
    wanted += [("new.py", "x = 7\n"), ("later.py", "x = 8\n"), ("m0.py", "x = 9\n"), ("moved.py", "x = 10\n")]
    assert got() == sorted(wanted)
    batches = spark.read.parquet(f"{tmp_path}/got").groupBy("batch").count().collect()
    assert max(r["count"] for r in batches) <= 3


def test_batches_can_be_planned_again(tmp_path):
    for i in range(5):
        write(tmp_path / "s", f"m{i}.py", "x\n")
    options = {"path": f"{tmp_path}/s/*.py", "log": f"{tmp_path}/log", "max_files": "2", "settle": "0"}
    reader = CodeFilesStreamReader(options, ["path"])
    marks = [reader.initialOffset()]
    while (mark := reader.latestOffset()) != marks[-1]:
        marks.append(mark)
    fresh = CodeFilesStreamReader(options, ["path"])  # after a restart: no list is held

    def paths(one, start, end):
        return sorted(row[0] for part in one.partitions(start, end) for row in one.read(part))

    parts = [paths(fresh, a, b) for a, b in zip(marks, marks[1:])]
    assert [len(p) for p in parts] == [2, 2, 1] and sorted(sum(parts, [])) == sorted(str(p) for p in (tmp_path / "s").iterdir())
    assert paths(reader, marks[-2], marks[-1]) == parts[-1]
    # A file that changes before its batch is read is left to a later one.
    write(tmp_path / "s", os.path.basename(parts[0][0]), "changed\n")
    assert paths(fresh, marks[0], marks[1]) == parts[0][1:]
    assert fresh.latestOffset() != marks[-1]
    unsettled = CodeFilesStreamReader(options | {"settle": "60", "log": f"{tmp_path}/other"}, ["path"])
    assert unsettled.latestOffset() == unsettled.initialOffset()
    with pytest.raises(DocumentationError):
        CodeFilesStreamReader({"path": "x"}, ["path"])


def test_folders_outside_the_filter_are_not_listed(spark, tmp_path, monkeypatch):
    for name in ("a/x/m.py", "a/y/m.py", "b/x/m.py", "ab/x/m.py"):
        write(tmp_path, name, "x = 1\n")
    listed = []
    expand = code_files.expand_component

    def watching(prefix, rest, recursive):
        listed.append(prefix.removeprefix(f"{tmp_path}/"))
        return expand(prefix, rest, recursive)

    monkeypatch.setattr(code_files, "expand_component", watching)

    def found(*filters, rule="*/*/*.py", **options):
        listed.clear()
        reader = CodeFilesReader({"path": f"{tmp_path}/{rule}", "splits": "2"} | options, ["path"])
        left = list(reader.pushFilters(list(filters)))
        return sorted(r[0].removeprefix(f"{tmp_path}/") for s in reader.partitions() for r in reader.read(s)), left

    path = ("path",)
    assert found(StringStartsWith(path, f"{tmp_path}/a/"), IsNotNull(path)) == (["a/x/m.py", "a/y/m.py"], [])
    assert not [p for p in listed if p.startswith("b")] and "a/x/" in listed
    assert found(StringStartsWith(path, f"{tmp_path}/a"))[0] == ["a/x/m.py", "a/y/m.py", "ab/x/m.py"]
    assert found(EqualTo(path, f"{tmp_path}/a/y/m.py"))[0] == ["a/y/m.py"]
    assert set(listed) <= {"", "a/", "a/y/"}
    assert found(In(path, (f"{tmp_path}/b/x/m.py", f"{tmp_path}/b/none.py", None)))[0] == ["b/x/m.py"]
    assert found(EqualTo(path, f"{tmp_path}/a/y/m.py"), StringStartsWith(path, f"{tmp_path}/b"))[0] == []
    kept = StringContains(path, "x")
    assert found(kept)[1] == [kept]
    deep = found(StringStartsWith(path, f"{tmp_path}/b/"), rule="**/*.py", recursive="true")
    assert deep[0] == ["b/x/m.py"] and not [p for p in listed if p.startswith("a/")]
    # The same by Spark, and no content is read unless the schema has it.
    register_source(spark)
    rows = spark.read.format("code_files").load(f"{tmp_path}/*/*/*.py")
    for condition in (f"path LIKE '{tmp_path}/a/%'", f"path IN ('{tmp_path}/b/x/m.py', 'c')", "path LIKE '%y/m.py'", f"path > '{tmp_path}/b'"):
        wanted = spark.createDataFrame(rows.collect(), rows.schema).where(condition)
        assert sorted(map(tuple, rows.where(condition).collect())) == sorted(map(tuple, wanted.collect()))
    opened = []
    monkeypatch.setattr(code_files, "read_file", lambda name: opened.append(name))
    assert len(found()[0]) == 4 and not opened
