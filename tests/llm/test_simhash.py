import random
import re

import numpy as np
import pytest
import xxhash
from helpers import ODD_TEXTS, SF_DIR, documents, prose

from docweave.llm import queries, simhash
from docweave.llm.common import read_table


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: list of (id, fingerprint). The least id that each reaches."""
    least = [i for i, _ in prints]
    changed = True
    while changed:
        changed = False
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if (x ^ y).bit_count() <= 4 and least[b] is not None:
                    if least[a] is None or least[b] < least[a]:
                        least[a], changed = least[b], True
    return least


@pytest.mark.parametrize("text", [*ODD_TEXTS, "Ab\x0bC d\x85e F", prose(1) + " " + prose(2)])
def test_fingerprint_is_the_majority_of_its_shingles(text):
    assert simhash.fingerprint(text or "") % (1 << 64) == brute_fingerprint(text)


def test_shingles_are_counted_in_parts(monkeypatch):
    text = prose(3, 300)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "COUNTED_SHINGLES", 7)
    assert simhash.fingerprint(text) == whole


def test_query_equals_all_pairs(spark):
    docs = [tuple(r) for r in read_table(spark, SF_DIR, "documents").select("doc_id", "text").collect()]
    prints = [(i, brute_fingerprint(t)) for i, t in docs]
    want = {i: (f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints))}
    got = queries.QUERIES["op1_simhash_near_dedup"](spark, SF_DIR)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want


def test_odd_rows_and_clashing_columns(spark):
    texts = [*ODD_TEXTS, prose(1), prose(1)]
    ids = [*range(len(texts) - 2), None, 3]
    got = [tuple(r) for r in simhash.near_duplicates(documents(spark, texts, True, ids)).collect()]
    prints = [(i, brute_fingerprint(t)) for i, t in zip(ids, texts)]
    want = [(i, p, c) for (i, p), c in zip(prints, brute_components(prints))]
    assert sorted(((i, p % (1 << 64), c) for i, p, c in got), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    empty = documents(spark, ["x"]).where("false")
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.one_of_each_class(empty).collect() == []


def near_group(seed, size):
    """Fingerprints a few bits from one another, and from those before."""
    pick = random.Random(seed)
    made = [pick.getrandbits(64)]
    while len(made) < size:
        flipped = pick.choice(made)
        for bit in pick.sample(range(64), pick.randint(1, 5)):
            flipped ^= 1 << bit
        made.append(flipped)
    return made


@pytest.mark.parametrize("prefix_rows", [4096, 8])
@pytest.mark.parametrize("listed", [100_000, 0])
def test_full_prefixes_are_dealt_out_and_lose_no_link(spark, monkeypatch, prefix_rows, listed):
    monkeypatch.setattr(simhash, "BROADCAST_PREFIXES", listed)
    monkeypatch.setattr(simhash, "HELD_VARIANTS", 1 << 14)
    prints = sorted({p for seed in range(6) for p in near_group(seed, 40)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    links = simhash.ball_links(df, len(prints), prefix_rows=prefix_rows).collect()
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in links:
        parent[root(a % (1 << 64))] = root(b % (1 << 64))
    got = {}
    for p in prints:
        got.setdefault(root(p), set()).add(p)
    ids = list(enumerate(prints))
    want = {}
    for (_, p), c in zip(ids, brute_components(ids)):
        want.setdefault(c, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_prefix_lengths_give_the_same_links():
    prints = np.array(sorted(set(near_group(9, 120))), np.uint64)
    for bits in (8, 12):
        linked = set()
        for prefix in range(1 << bits):
            off = np.bitwise_count((prints >> np.uint64(64 - bits)) ^ np.uint64(prefix))
            if (off <= 2).any():
                a, _ = simhash._met(prints[off <= 2], prefix, bits, 0, 1, 4)
                linked |= set(a.tolist())
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
        with_smaller = {int(p) for i, p in enumerate(prints) if near[i, :i].any()}
        assert with_smaller <= linked


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.ball_links(spark.createDataFrame([(1,)], "fp bigint"), 1, radius=3)


def test_one_of_each_class_stays(spark):
    texts = [prose(1), prose(2), prose(1), None, "", prose(3), prose(1)]
    ids = [5, 7, 2, 9, 8, None, 2]
    kept = simhash.one_of_each_class(documents(spark, texts, True, ids))
    assert kept.columns == documents(spark, texts, True).columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None) == sorted(
        [(2, prose(1)), (7, prose(2)), (8, "")]
    )
    assert [r["text"] for r in kept.where("doc_id IS NULL").collect()] == [prose(3)]
