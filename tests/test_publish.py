"""Writing in place: files changed meanwhile, jobs lost while they write, repeated tasks."""

import hashlib
import os

import pytest

import docweave as dw
from docweave.plans import document
from docweave.sources.files import ChangedFile, replace_text
from test_document import described


def sources(folder, count):
    folder.mkdir()
    for i in range(count):
        (folder / f"m{i}.py").write_bytes(f"def f{i}(a):\r\n  return a\r\n".encode() if i % 2 else f"def f{i}(a):\n  return a\n".encode())
    return dw.DocumentationConfig(generate_docstring_func=described, include_rules=[f"{folder}/*.py"], inplace=True)


def texts(folder):
    return {name: (folder / name).read_text() for name in sorted(os.listdir(folder))}


def test_changed_and_missing_files_are_errors(spark, tmp_path):
    folder = tmp_path / "code"
    config = sources(folder, 5)
    run = dw.document_sources(spark, config, publish=False)
    assert "Zzz" not in "".join(texts(folder).values())
    (folder / "m1.py").write_text("x = 1\n")
    (folder / "m2.py").unlink()
    os.chmod(folder / "m3.py", 0o640)
    run.publish()
    now = texts(folder)
    assert now["m1.py"] == "x = 1\n" and "m2.py" not in now
    assert all("Zzz" in now[f"m{i}.py"] for i in (0, 3, 4))
    assert os.stat(folder / "m3.py").st_mode & 0o777 == 0o640
    errors = {os.path.basename(r.path): r.error for r in run.errors().collect()}
    assert set(errors) == {"m1.py", "m2.py"} and "changed" in errors["m1.py"] and "gone" in errors["m2.py"]
    assert {os.path.basename(r.path) for r in run.mapping().collect()} == {"m0.py", "m3.py", "m4.py"}
    assert {(r.status, r.n) for r in run.summary().where("stage = 'file'").collect()} == {("ok", 3), ("failed", 2)}
    assert not [name for name in os.listdir(folder) if name.endswith(".part")]


def test_a_lost_publish_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    folder = tmp_path / "code"
    config = sources(folder, 8)
    run = dw.document_sources(spark, config, publish=False)
    assert run.folder in dw.unpublished_runs(spark)
    begun, write = [], document.write_sources

    def failing(rows):
        if len(begun) == 2:
            # The third wave writes its files, but is lost before that is committed.
            write(rows).collect()
            raise RuntimeError("lost")
        begun.append(1)
        return write(rows)

    with monkeypatch.context() as lost:
        lost.setattr(document, "write_sources", failing)
        with pytest.raises(RuntimeError):
            run.publish(parts_per_wave=1)
    part_way = texts(folder)
    assert run.folder in dw.unpublished_runs(spark)
    assert any("Zzz" in text for text in part_way.values())
    # A file of a finished wave is edited, and so is one whose turn is still to come, if there is any.
    finished = spark.read.parquet(f"{run.folder}/published/wave=0", f"{run.folder}/published/wave=1")
    done = [os.path.basename(r.path) for r in finished.collect()]
    waiting = [name for name, text in part_way.items() if "Zzz" not in text]
    for name in done[:1] + waiting[:1]:
        (folder / name).write_text("edited = 1\n")
    calls = []
    monkeypatch.setattr(document, "generate", lambda *_: calls.append(1))
    again = dw.resume_publish(spark, config, run.folder, parts_per_wave=1)
    assert not calls and run.folder not in dw.unpublished_runs(spark)
    now = texts(folder)
    assert all(now[name] == "edited = 1\n" for name in done[:1] + waiting[:1])
    assert all("Zzz" in text for name, text in now.items() if name not in done[:1] + waiting[:1])
    failed = {os.path.basename(r.path) for r in again.errors().collect()}
    assert failed == set(waiting[:1])  # what was published first and edited later is no conflict
    assert again.mapping().count() == 8 - len(failed)


def test_replacing_is_safe_to_repeat(tmp_path):
    name = tmp_path / "a.py"
    name.write_text("old")
    digest = hashlib.sha256(b"old").hexdigest()
    for path in (str(name), f"file://{name}"):
        replace_text(path, "new", digest)
        replace_text(path, "new", digest)  # by a repeated task
        assert name.read_text() == "new"
        with pytest.raises(ChangedFile):
            replace_text(path, "newer", digest)
        name.write_text("old")
    name.unlink()
    with pytest.raises(ChangedFile):
        replace_text(str(name), "new", digest)
    assert os.listdir(tmp_path) == []


def test_unchanged_files_are_not_touched(spark, tmp_path):
    folder = tmp_path / "code"
    config = sources(folder, 2)
    (folder / "plain.py").write_text("x = 1\n")
    os.utime(folder / "plain.py", (1, 1))
    dw.document_sources(spark, config)
    assert os.stat(folder / "plain.py").st_mtime == 1
    before = texts(folder)
    dw.document_sources(spark, config)
    assert texts(folder) == before
