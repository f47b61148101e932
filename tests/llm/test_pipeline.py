"""The stages against brute force, and the entry points with and without the corpus operators."""

import importlib
import re
import sys

import corpus_pipeline
import pytest
from helpers import ODD_TEXTS, SF_DIR, documents
from test_decontamination import brute as brute_items
from test_simhash import brute_components, brute_fingerprint
from test_text_operators import brute_spans

import __spark_entry__ as entry_points
from docweave.llm import queries
from docweave.llm.common import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_the_stages_are_those_dealt():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "simhash near-dedup", "benchmark decontamination", "personal data", "sentencepiece",
    ]


def test_each_stage_against_brute_force(spark):
    docs = read_table(spark, SF_DIR, "documents")
    items = [tuple(r) for r in read_table(spark, SF_DIR, "benchmark").collect()]
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, SF_DIR, "labels").collect()}
    # 1: what the query rejects goes, whole rows stay; good documents are kept.
    kept = {r["doc_id"] for r in queries.QUERIES["op9_quality_rules"](spark, SF_DIR).where("kept").collect()}
    first = corpus_pipeline.quality(spark, docs, SF_DIR).cache()
    assert sorted(map(tuple, first.collect())) == sorted(tuple(r) for r in docs.collect() if r["doc_id"] in kept)
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.8 * len(good)
    # 2: the least id of each component.
    rows = {r["doc_id"]: tuple(r) for r in first.collect()}
    prints = [(i, brute_fingerprint(r[1])) for i, r in rows.items()]
    least = set(brute_components(prints))
    second = corpus_pipeline.near_duplicates(spark, first, SF_DIR).cache()
    assert sorted(map(tuple, second.collect())) == sorted(r for i, r in rows.items() if i in least)
    # 3: documents without an item.
    held = {d for d, _ in brute_items([(i, rows[i][1]) for i in least], items)}
    third = corpus_pipeline.decontaminate(spark, second, SF_DIR).cache()
    assert {r["doc_id"] for r in third.collect()} == least - held
    # 4: no base span of the original is left.
    fourth = corpus_pipeline.personal_data(spark, third, SF_DIR).cache()
    assert fourth.columns == COLUMNS and fourth.count() == third.count()
    for row in fourth.collect():
        original = rows[row["doc_id"]][1]
        for start, _, end in brute_spans(original):
            assert original[start:end] not in row["text"]
        assert row["n_chars"] == len(row["text"])
    # 5: all documents, with their pieces.
    last = corpus_pipeline.encode(spark, fourth, SF_DIR)
    assert last.columns == [*COLUMNS, "n_tokens", "token_ids"]
    assert {r["doc_id"]: r["n_tokens"] for r in last.collect()}.keys() == least - held
    assert all(len(r["token_ids"]) == 4 * r["n_tokens"] for r in last.collect())


def test_run_is_all_stages(spark):
    got = corpus_pipeline.run(spark, SF_DIR).cache()
    assert got.count() > 0 and got.count() == got.select("doc_id").distinct().count()
    pattern = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    assert not [r for r in got.collect() if re.search(pattern, r["text"])]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, name, stage):
    odd = documents(spark, [*ODD_TEXTS, "mail a@b.cd " * 5], True, [None, *range(len(ODD_TEXTS))])
    got = stage(spark, odd, SF_DIR)
    assert got.columns[: len(odd.columns)] == odd.columns
    got.collect()
    assert stage(spark, odd.where("false"), SF_DIR).collect() == []


def test_entry_points(monkeypatch):
    names = set(entry_points.queries())
    assert {n for n in names if re.match(r"op\d+_", n)} == set(queries.QUERIES) and "pipeline" in names
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, len(queries.QUERIES) + 1))
    assert set(entry_points.oracle_sql()) <= names
    # Without the folder the rest is there; any other missing module is an error.
    with monkeypatch.context() as without:
        without.setitem(sys.modules, "docweave.llm.queries", None)
        bare = importlib.reload(entry_points).queries()
        assert bare and not [n for n in bare if re.match(r"op\d+_|pipeline", n)]
    assert set(importlib.reload(entry_points).queries()) == names
