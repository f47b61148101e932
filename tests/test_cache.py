"""The cache of answers: segments, merging, what joins move, lost and simultaneous writers."""

import os

import docweave as dw
from docweave.operators import cache as caches
from docweave.operators.cache import AnswerCache, compact_cache
from docweave.schema import DOC_DATA
from test_document import counting, outputs, run


def answers(spark, start, end, text="x"):
    data = f"from_json('{{\"description\": \"{text}\"}}', '{DOC_DATA}') AS data"
    return spark.range(start, end).selectExpr("sha2(string(id), 256) AS cache_key", data)


def held(cache, requests):
    rows = cache.lookup(requests, cache.segments()).collect()
    cache.close()
    return {r["cache_key"]: r["data"]["description"] for r in rows}


def data_files(path):
    found = [os.path.join(at, name) for at, _, names in os.walk(path) for name in names]
    return [name for name in found if name.endswith(".parquet")]


def test_segments_are_merged_and_keys_stay(spark, tmp_path):
    cache = AnswerCache(spark, str(tmp_path), buckets=3, keep_segments=4, retain_seconds=0)
    for i in range(12):
        cache.commit(answers(spark, i * 10, i * 10 + 12))
        assert len(cache.segments()) <= 4
    cache.commit(answers(spark, 0, 0))  # nothing to add is no segment
    everything = answers(spark, 0, 200)
    assert len(held(cache, everything)) == 122
    compact_cache(spark, str(tmp_path), retain_seconds=0)
    assert [s.rows for s in cache.segments()] == [122]
    assert len(held(cache, everything)) == 122
    # What was replaced is gone: files do not grow with the number of commits.
    cache.vacuum()
    assert len(cache.manifests()) == 1 and len(data_files(tmp_path)) <= 3
    # A cache that is there keeps its number of buckets.
    assert AnswerCache(spark, str(tmp_path), buckets=50).buckets == 3


def test_replaced_segments_stay_for_jobs_that_read_them(spark, tmp_path):
    cache = AnswerCache(spark, str(tmp_path), buckets=2)
    for i in range(3):
        cache.commit(answers(spark, i * 10, i * 10 + 10))
    reader = AnswerCache(spark, str(tmp_path))
    begun = reader.lookup(answers(spark, 0, 30), reader.segments())
    compact_cache(spark, str(tmp_path))
    assert begun.count() == 30 and len(cache.segments()) == 1 and len(cache.manifests()) == 4
    reader.close()


def test_lost_and_simultaneous_writers(spark, tmp_path, monkeypatch):
    cache = AnswerCache(spark, str(tmp_path), buckets=2)
    cache.commit(answers(spark, 0, 10, "old"))
    cache.commit(answers(spark, 5, 15, "old"))
    both = cache.segments()
    assert len(held(cache, answers(spark, 0, 20))) == 15  # one answer for a key that two jobs made
    # A merge that is lost before its manifest leaves everything as it was.
    with monkeypatch.context() as lost:
        lost.setattr(caches, "write_small_file", lambda *_: 1 / 0)
        try:
            cache.compact()
        except ZeroDivisionError:
            pass
    cache.close()
    assert cache.segments() == both and len(held(cache, answers(spark, 0, 20))) == 15
    # Two merges of the same segments at the same time, and a commit between them.
    for _ in range(2):
        cache._write(caches._one_per_key(cache.table(both)), both)
    cache.commit(answers(spark, 20, 22))
    assert len(cache.segments()) == 3 and len(held(cache, answers(spark, 0, 30))) == 17
    cache.compact()
    assert [s.rows for s in cache.segments()] == [17]
    cache.close()


def test_the_cache_is_not_moved(spark, tmp_path):
    cache = AnswerCache(spark, str(tmp_path), buckets=5)
    cache.commit(answers(spark, 0, 50))
    cache.commit(answers(spark, 50, 90))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for segments in (cache.segments(), cache.segments()[:1]):
            found = cache.lookup(answers(spark, 0, 7), segments)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
            assert "FileScan" not in plan[plan.index("Exchange"):]  # it is the requests that move
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        cache.close()


def test_each_amount_is_rewritten_a_few_times_only():
    sizes, written = [], 0
    for _ in range(1000):
        sizes = sorted([*sizes, 1])
        if len(sizes) > 8:
            chosen = caches._merged_at_once(sizes, 8)
            written += sum(sizes[:chosen])
            sizes = sorted([*sizes[chosen:], sum(sizes[:chosen])])
    assert sum(sizes) == 1000 and written < 6000


def test_runs_share_a_cache_that_stays_small(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    options = {"cache_path": str(tmp_path / "cache"), "cache_buckets": 2, "cache_segments": 2}
    for i in range(4):
        modules = {f"m{j}.py": f"def f{j}(): pass\nclass C{j}:\n  def g{j}(self): pass\n" for j in range(i + 2)}
        done = run(spark, modules, counting(calls), **options)
        assert len(os.listdir(calls)) == 3 * len(modules)
    cache = AnswerCache(spark, options["cache_path"])
    assert len(cache.segments()) <= 2 and sum(s.rows for s in cache.segments()) == 15
    compact_cache(spark, options["cache_path"])
    again = run(spark, modules, counting(calls), **options)
    assert len(os.listdir(calls)) == 15 and outputs(again) == outputs(done)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("docweave_")]


def test_a_lost_job_keeps_its_finished_waves(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    calls.mkdir()
    modules = {f"m{i}.py": f"def f{i}(): pass\n" for i in range(30)}
    options = {"cache_path": str(tmp_path / "cache"), "cache_buckets": 2, "max_workers": 2, "calls_per_task": 2}
    commit, done = AnswerCache.commit, []

    def failing(self, rows):
        if len(done) == 3:
            raise RuntimeError("lost")
        done.append(1)
        commit(self, rows)

    with monkeypatch.context() as lost:
        lost.setattr(AnswerCache, "commit", failing)
        try:
            run(spark, modules, counting(calls), **options)
        except RuntimeError:
            pass
    before = len(os.listdir(calls))
    assert 0 < before < 30
    kept = sum(s.rows for s in AnswerCache(spark, options["cache_path"]).segments())
    assert isinstance(run(spark, modules, counting(calls), **options), dw.Run)
    assert len(os.listdir(calls)) == before + 30 - kept


def test_manifests_are_read_once(spark, tmp_path, monkeypatch):
    """a commit does not read again what earlier ones have written."""
    from docweave.operators import cache

    read, names = cache.read_small_file, []
    monkeypatch.setattr(cache, "read_small_file", lambda spark, name: names.append(name) or read(spark, name))
    kept = AnswerCache(spark, str(tmp_path / "cache"), 2, 100)
    for i in range(5):
        kept.commit(answers(spark, i * 10, i * 10 + 10))
    assert len(names) == 5 and [s.rows for s in kept.segments()] == [10] * 5
