import re
from collections import Counter
from math import log

import pytest
from helpers import ODD_TEXTS, SF_DIR, documents, prose

from docweave.llm import decontamination, queries
from docweave.llm.common import read_table


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def shingled(tokens, size):
    return [tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1)]


def brute(docs, items):
    """The pairs whose best window of the item's size reaches the threshold, with that similarity."""
    own = {i: shingled(w, min(5, len(w))) for i, t in items if (w := words(t))}
    frequency = Counter(s for shingles in own.values() for s in set(shingles))
    weight = {s: log(1 + len(own) / n) for s, n in frequency.items()}
    found = {}
    for d, text in docs:
        tokens = words(text)
        for i, shingles in own.items():
            all_windows = shingled(tokens, len(shingles[0]))
            if not set(all_windows) & set(shingles):
                continue
            counts = Counter(shingles)
            whole = sum(weight[s] * n for s, n in counts.items())
            for start in range(max(len(all_windows) - len(shingles), 0) + 1):
                window = Counter(all_windows[start : start + len(shingles)])
                shared = sum(weight[s] * min(n, window[s]) for s, n in counts.items())
                if shared / whole >= 0.8:
                    found[d, i] = max(found.get((d, i), 0), round(shared / whole, 9))
    return found


def pairs(rows):
    return {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows}


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in read_table(spark, SF_DIR, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in read_table(spark, SF_DIR, "benchmark").collect()]
    got = pairs(queries.QUERIES["op5_benchmark_decontamination"](spark, SF_DIR).collect())
    assert got == brute(docs, items) and got


def altered(text, at):
    tokens = text.split()
    for i in at:
        tokens[i] = f"other{i}"
    return " ".join(tokens)


def planted():
    items = [(i, prose(i, 12 + 3 * i)) for i in range(20)] + [(20, "only three words"), (21, prose(3, 21)), (22, ""), (23, None), (24, "one")]
    docs = [
        prose(100) + " " + prose(5, 27) + " " + prose(101),
        prose(102) + "\n" + prose(7, 33).upper().replace(" ", " | ") + "### " + prose(103),
        prose(104) + " " + altered(prose(9, 39), [0, 38]) + " " + prose(105),
        prose(106) + " " + altered(prose(9, 39), range(0, 39, 4)) + " " + prose(107),
        "x only three words y", "only three", prose(3, 21), prose(108, 2000), prose(19, 69) + " " + prose(18, 66),
        " ".join(prose(19, 69).split()[:30]), "one",
    ]
    return items, docs


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_planted_passages(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    items, texts = planted()
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(spark, texts, True)
    got = pairs(decontamination.contaminated_pairs(docs, benchmark).collect())
    # Weights are those of the block an item is in; the pairs are the same.
    want = brute(list(enumerate(texts)), items)
    assert set(got) == set(want)
    if block > 300:
        assert got == pytest.approx(want)
    assert {d for d, _ in want} == {0, 1, 2, 4, 6, 8, 10}
    clean = decontamination.clean_rows(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {3, 5, 7, 9}


def test_many_blocks_give_the_pairs_of_one(spark, monkeypatch):
    """Fifty blocks: each read alone, the rows written once, copies of an item in several blocks."""
    items = [(i, prose(i % 45, 20 + i % 9)) for i in range(120)] + [(200, "  "), (None, prose(3, 23)), (201, None)]
    texts = [prose(300 + i) + " " + prose(i, 20 + i % 9) + " " + prose(400 + i) for i in range(45)] + [None, ""]
    docs = documents(spark, texts, True)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = lambda: sorted(map(tuple, decontamination.contaminated_pairs(docs, benchmark).collect()), key=repr)
    one = rows()
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 330)
    blocks = decontamination.Blocks(benchmark)
    assert len(blocks) >= 50
    read = [blocks.read(n) for n in range(len(blocks))]
    assert max(sum(len(t.encode()) for _, t in block[0]) for block in read) <= 330 + 300
    assert sorted((i for block in read for i, _ in block[0]), key=repr) == sorted((i for i, t in items if t is not None), key=repr)
    monkeypatch.setattr(decontamination.Blocks, "__len__", lambda self: len(self.names))
    written = []
    keep = decontamination.stored
    monkeypatch.setattr(decontamination, "stored", lambda rows, name, *a: (written.append(name), keep(rows, name, *a))[1])
    assert rows() == one and len({r[0] for r in one}) == 45
    assert written.count("rows") == 1 and set(written) == {"items", "rows"}
    clean = decontamination.clean_rows(docs, benchmark)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [45, 46]


def test_hamming_lists_hold_all_within_the_radius():
    items = [(i, prose(i % 7, 30) if i % 2 else altered(prose(i % 7, 30), [i % 30])) for i in range(60)]
    index = decontamination.Index(items)
    for _, _, _, prints, blocks in index.groups:
        for p in prints:
            split = [(int(p) >> (8 * j)) & 255 for j in range(8)]
            listed = {int(n) for j, v in enumerate(split) for n in blocks[j][v]}
            near = {n for n, q in enumerate(prints) if (int(p) ^ int(q)).bit_count() <= index.radius}
            assert near <= listed


def test_odd_rows_and_empty_tables(spark):
    docs = documents(spark, ODD_TEXTS, True)
    benchmark = spark.createDataFrame([(1, "same text here"), (None, "word word word word word")], "item_id bigint, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontamination.contaminated_pairs(docs, benchmark).collect()), key=repr)
    assert got == [(11, None), (15, 1), (16, 1)]
    none = benchmark.where("false")
    assert decontamination.contaminated_pairs(docs, none).collect() == []
    assert decontamination.clean_rows(docs, none).count() == len(ODD_TEXTS)
    assert decontamination.clean_rows(docs.where("false"), benchmark).collect() == []
