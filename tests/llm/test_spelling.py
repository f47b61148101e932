"""Spelling variants against brute force, with words dealt to grids, odd texts and empty tables."""

import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from docweave.llm import queries, spelling
from docweave.llm.common import read_table
from helpers import ODD_TEXTS, SF_DIR, documents, rows_of

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_counts(rows, typo_every):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typo_every and h % typo_every == 0:
                gone = h % len(run)
                run = run[:gone] + run[gone + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {word: n for word, n in counts.items() if n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(counts):
    """Words that can be near share what is left of them after one deletion, or are each other's."""
    shared = defaultdict(set)
    for word in counts:
        for i in range(len(word)):
            shared[word[:i] + word[i + 1 :]].add(word)
        shared[word].add(word)
    near = defaultdict(set)
    for group in shared.values():
        for a in group:
            near[a] |= {b for b in group if b != a and one_edit(a, b)}
    form = {}
    for word, others in near.items():
        if others:
            best = min(others, key=lambda other: (-counts[other], other))
            if counts[best] >= 2 * counts[word]:
                form[word] = best

    def root(word):
        while word in form:
            word = form[word]
        return word

    return sorted(
        (w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()
    )


def same(got, wanted):
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == wanted


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, SF_DIR, "documents").collect()]
    wanted = brute_groups(brute_counts(docs, 97))
    assert sum(1 for row in wanted if row[1]) > 50
    same(queries.QUERIES["op11_spelling_variants"](spark, SF_DIR), wanted)


def invented(seed, size, alphabet="abéÿ"):
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list(alphabet), rng.integers(5, 8))) for _ in range(size)}
    return {word: int(n) for word, n in zip(sorted(words), rng.geometric(0.2, len(words)) + 2)}


@pytest.mark.parametrize("part_words", [20_000, 40])
def test_dense_words_in_parts_and_grids(spark, monkeypatch, part_words):
    monkeypatch.setattr(spelling, "HELD_PAIRS", 500)
    monkeypatch.setattr(spelling, "HELD_LETTERS", 64)
    counts = invented(5, 1500)
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    near = spelling.near_words(words, spelling.letter_groups(words), len(counts), part_words)
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in near.collect()}
    wanted = {}
    for word, _, _, _, n_near, _ in brute_groups(counts):
        if n_near:
            best = min((w for w in counts if one_edit(w, word)), key=lambda w: (-counts[w], w))
            wanted[word] = (n_near, counts[best], best)
    assert len(wanted) > 1000 and got == wanted


def test_all_one_edits_are_found():
    base = b"abcdefgh"
    words = [base]
    for i in range(9):
        words += [base[:i] + c + base[i:] for c in (b"a", b"z", b"\xe9")]
        words += [base[:i] + c + base[i + 1 :] for c in (b"a", b"z", b"\xe9") if i < 8]
        words.append(base[:i] + base[i + 1 :])
    words = sorted(set(words))
    every = np.ones(len(words), bool)
    for groups in (np.arange(256) % spelling.GROUPS, np.zeros(256, np.int64)):
        a, b = spelling.search(words, every, every, groups)
        pairs = [frozenset((words[i], words[j])) for i, j in zip(a, b)]
        wanted = {frozenset((x, y)) for x in words for y in words if x != y and one_edit(x, y)}
        assert len(pairs) == len(set(pairs)) and set(pairs) == wanted


def test_a_chain_of_forms_is_followed_to_its_end(spark):
    chain = {"a" * (5 + i): 3 * 2**i for i in range(30)}
    forms = spark.createDataFrame([("a" * (5 + i), "a" * (6 + i)) for i in range(29)], "word string, form string")
    assert set(map(tuple, spelling.roots(forms).collect())) == {(w, "a" * 34) for w in list(chain)[:-1]}


def test_odd_repeated_and_empty_tables(spark):
    texts = [*ODD_TEXTS, "Strasse strasse STRASSE straße Strase strase strase", "é" * 3000, *["ÀÉ×÷é àé"] * 3, *["e" * 70_000] * 3]
    ids = [None, *range(1, len(texts))]
    odd = documents(spark, texts, True, ids)
    rows = list(zip(ids, texts))
    same(spelling.spelling_groups(odd, typo_every=97), brute_groups(brute_counts(rows, 97)))
    same(spelling.spelling_groups(odd, typo_every=1), brute_groups(brute_counts(rows, 1)))
    same(spelling.spelling_groups(odd.union(odd)), brute_groups(brute_counts(rows * 2, 0)))
    assert rows_of(spelling.spelling_groups(odd.where("false"))) == []
    with pytest.raises(ValueError):
        spelling.spelling_groups(odd, ratio=1)
