"""Benchmarks in which items are copied, and benchmarks of several blocks, against brute force."""

import random

import pytest
from helpers import documents, prose
from test_decontamination import altered, brute, pairs, planted

from docweave.llm import decontamination


def test_copies_in_the_benchmark_lose_no_passage():
    items = [(i, prose(0 if i % 3 == 0 else i, 50 + (0 if i % 3 == 0 else i % 9))) for i in range(180)]
    pick = random.Random(7)
    docs = [
        prose(1000 + d) + " " + altered(prose(0, 50), pick.sample(range(50), 1 + d % 3)) + " " + prose(2000 + d)
        for d in range(10)
    ] + [altered(prose(i, 50 + i % 9), pick.sample(range(50), 2)) for i in (1, 2, 5, 7, 8, 10)]
    index = decontamination.Index(items)
    got = {(d, items[n][0]): best[0] for d, text in enumerate(docs) for n, best in index.search(text).items()}
    want = brute(list(enumerate(docs)), items)
    assert got == pytest.approx(want)
    assert sum(s < 0.9 for s in want.values()) > 150


@pytest.mark.parametrize("block", [1 << 20, 300, 1])
def test_similarities_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    items, texts = planted()
    items = [*items[:8], *items[-5:], (30, prose(5, 20) + " " + prose(40, 9))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = pairs(decontamination.contaminated_pairs(documents(spark, texts, True), benchmark).collect())
    assert got == pytest.approx(brute(list(enumerate(texts)), items))
