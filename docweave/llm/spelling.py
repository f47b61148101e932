"""Spelling variants: which words differ by one letter, and which of them the others stand for.

A word's letters are dealt to `GROUPS` groups; how many letters it has of each group is its frequency
vector. One inserted letter adds one to a group (a surplus), a deleted one takes one away (a deficit), a
replaced one does both or neither. Words stand in a trie whose levels are the counts of successive groups. The
words near a word are found by a depth-first search that may spend one surplus and one deficit on its
way down; the words at the leaves it reaches are compared letter by letter. Each pair is sought
once, from the shorter word, or from the one with less of the first group in which they differ: so the
surplus is spent before the deficit. Equal vectors are sought from the lesser word.

The upper levels of the trie are the shuffle: a word is at home in the part of its own first counts,
and asks in the parts of all first counts that the budget reaches. The number of such levels grows with
the number of words. Parts with more than `PART_WORDS` words at home become a grid of tasks: words at home
are dealt to its rows, asking ones to its columns. A task searches the trie once for all that ask in it,
and returns one row per word (how many are near, and the most frequent), not the pairs.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. Null and empty texts have none,
texts are read whole, repeated rows count again, and a null id counts as an empty one. Extra columns of
the input are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory, stored

MIN_CHARS, MIN_COUNT, TYPO_EVERY, RATIO = 5, 3, 97, 2
#: Words at home that a task holds, and about as many parts as it takes for that.
PART_WORDS = 20_000
#: Full parts whose list may be broadcast (16 bytes each); beyond it, a join.
BROADCAST_PARTS = 100_000
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 400_000
GROUPS = 12
#: Pairs held before they are verified, and letters compared at a time.
HELD_PAIRS, HELD_LETTERS = 1 << 18, 1 << 22

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_STEPS = np.random.default_rng(7).integers(1, 1 << 62, GROUPS, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def word_counts(rows: DataFrame, text: str = "text", doc_id: str = "doc_id", typo_every: int = 0) -> DataFrame:
    """`word` and `n`, how often it occurs in all texts.

    With `typo_every`, a run loses a letter wherever that number divides the unsigned crc32 h of
    `<doc_id>:<run>`: the one at h modulo its length. Runs that cannot reach `MIN_CHARS` are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def made() -> pa.RecordBatch:
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at, one in enumerate(batch.column(0).to_pylist()):
                runs = _RUN.findall((texts[at].as_py() or b"").lower())
                words = [run for run in runs if len(run) >= MIN_CHARS]
                if typo_every:
                    start = crc32(f"{'' if one is None else one}:".encode())
                    changed = [run for run in words if not crc32(run, start) % typo_every]
                    held.update(words)
                    for run in changed:
                        held[run] -= 1
                        if not held[run]:
                            del held[run]
                        letters, h = run.decode(), crc32(run, start)
                        gone = h % len(letters)
                        held[(letters[:gone] + letters[gone + 1 :]).encode()] += 1
                else:
                    held.update(words)
                if len(held) > HELD_WORDS:
                    yield made()
                    held.clear()
        yield made()
        held.clear()
        release_memory()

    counted = rows.select(F.col(doc_id).cast("string"), F.col(text)).mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.char_length("word") >= MIN_CHARS)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> np.ndarray:
    """The group of each of the 256 letters: letters by falling frequency are dealt out in turn."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    found = letters.orderBy(F.desc("count"), "letter").select("letter").collect()  # 90 at most
    dealt = np.zeros(256, np.int64)
    for rank, row in enumerate(row for row in found if row["letter"]):
        dealt[ord(row["letter"])] = rank % groups
    return dealt


def frequency_vectors(words: list[bytes], group_of: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """One row of counts for each Latin-1 word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    owner = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(owner * groups + group_of[flat], minlength=len(words) * groups)
    return counts.reshape(len(words), groups)


def levels_for(n: int) -> int:
    """How many levels of the trie the shuffle is by."""
    return min(GROUPS, max(3, int(np.ceil(np.log(max(n, 1) / 2000 + 1) / np.log(3)))))


def parts_reached(vectors: np.ndarray, levels: int, parts: int, own_only: bool = False) -> np.ndarray:
    """For each vector its own part and, after it, those of all first counts its search can reach;
    -1 where there is none, or one named before."""
    steps = _STEPS[:levels]
    first = vectors[:, :levels].astype(np.uint64)
    own = first @ steps
    reached, there = [own], [np.ones(len(own), bool)]
    if not own_only:
        for i in range(levels):
            reached.append(own + steps[i])
            there.append(there[0])
            for j in range(i + 1, levels):
                reached.append(own + steps[i] - steps[j])
                there.append(vectors[:, j] > 0)
    keys = np.stack(reached, axis=1)
    keys = (keys ^ (keys >> np.uint64(31))) * _MIX
    found = np.where(np.stack(there, axis=1), ((keys >> np.uint64(33)) % np.uint64(parts)).astype(np.int64), -1)
    order = np.argsort(found, axis=1, kind="stable")
    ranked = np.take_along_axis(found, order, axis=1)
    again = np.zeros(found.shape, bool)
    np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], axis=1)
    return np.where(again, -1, found)


def _one_edit(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the pairs (a, b), b as long as a or longer by one: whether one edit makes b of a."""
    good = np.zeros(len(a), bool)
    by = np.argsort(sizes[a], kind="stable")
    bounds = np.flatnonzero(np.diff(sizes[a[by]], prepend=-1, append=-1))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        size = int(sizes[a[by[lo]]])
        step = max(1, HELD_LETTERS // (size + 1))
        for at in range(lo, hi, step):
            some = by[at : min(at + step, hi)]
            longer = sizes[b[some]] > size
            same, more = some[~longer], some[longer]
            along = np.arange(size)
            if len(same):
                differ = words[starts[a[same], None] + along] != words[starts[b[same], None] + along]
                good[same] = differ.sum(axis=1) == 1
            if len(more):
                short = words[starts[a[more], None] + along]
                head = short != words[starts[b[more], None] + along]
                tail = (short != words[starts[b[more], None] + along + 1])[:, ::-1]
                equal = [np.where(d.any(axis=1), d.argmax(axis=1), size) for d in (head, tail)]
                good[more] = equal[0] + equal[1] >= size
    return good


def search(
    words: list[bytes], home: np.ndarray, asks: np.ndarray, group_of: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indexes: a word that asks, and a near one at home that its search finds. `words` are
    distinct."""
    vectors = frequency_vectors(words, group_of)
    sizes = vectors.sum(axis=1)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(words) else sizes
    flat = np.frombuffer(b"".join(words), np.uint8)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    at_home = np.flatnonzero(home)
    at_home = at_home[np.lexsort(vectors[at_home].T[::-1])]
    trie = vectors[at_home]
    held_a, held_b, found_a, found_b, held = [], [], [], [], 0

    def verify() -> None:
        nonlocal held
        if held:
            a, b = np.concatenate(held_a), np.concatenate(held_b)
            good = _one_edit(flat, starts, sizes, a, b)
            found_a.append(a[good])
            found_b.append(b[good])
        held_a.clear()
        held_b.clear()
        held = 0

    def leaf(there: np.ndarray, asking: np.ndarray, spent: np.ndarray) -> None:
        nonlocal held
        step = max(1, HELD_PAIRS // len(there))
        for at in range(0, len(asking), step):
            a = np.repeat(asking[at : at + step], len(there))
            b = np.tile(there, len(asking[at : at + step]))
            once = (np.repeat(spent[at : at + step], len(there)) > 0) | (rank[a] < rank[b])
            held_a.append(a[once])
            held_b.append(b[once])
            held += int(once.sum())
            if held > HELD_PAIRS:
                verify()

    def descend(level: int, lo: int, hi: int, asking: np.ndarray, spent: np.ndarray) -> None:
        """Below the node that at_home[lo:hi] share; `spent`: 0 nothing, 1 the surplus, 2 both."""
        if level == GROUPS:
            leaf(at_home[lo:hi], asking, spent)
            return
        counts = trie[lo:hi, level]
        cuts = [0, *(np.flatnonzero(counts[1:] != counts[:-1]) + 1).tolist(), hi - lo]
        wanted = vectors[asking, level]
        for start, end in zip(cuts[:-1], cuts[1:]):
            over = counts[start] - wanted
            # A surplus can be spent first, a deficit after it.
            go = np.flatnonzero((over == 0) | ((over == 1) & (spent == 0)) | ((over == -1) & (spent == 1)))
            if len(go):
                descend(level + 1, lo + start, lo + end, asking[go], spent[go] + (over[go] != 0))

    if len(at_home):
        asking = np.flatnonzero(asks)
        descend(0, 0, len(at_home), asking, np.zeros(len(asking), np.int8))
    verify()
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _latin(words: pa.Array) -> list[bytes]:
    return [word.encode("latin-1") for word in words.to_pylist()]


def near_words(words: DataFrame, group_of: np.ndarray, n: int, part_words: int = PART_WORDS) -> DataFrame:
    """For each word of `words` (distinct `word`, `n`; n of them) that has near ones: `word`, `n_near`, and
    `near` (best_n, best), the most frequent one; of equally frequent ones the least."""
    levels, parts = levels_for(n), max(8, -(-2 * n // part_words))

    def deal(own_only: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 4096):
                    some = batch.slice(start, 4096)
                    vectors = frequency_vectors(_latin(some.column(0)), group_of)
                    reached = parts_reached(vectors, levels, parts, own_only)
                    at, which = np.nonzero(reached >= 0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(column.take(pa.array(at)) for column in some.columns),
                            pa.array(reached[at, which].astype(np.int32)),
                            pa.array(which == 0),
                        ],
                        ["word", "n", "part", "home"],
                    )

        return words.select("word", "n").mapInArrow(run, "word string, n bigint, part int, home boolean")

    full = deal(own_only=True).groupBy(F.col("part").alias("of")).count().where(F.col("count") > part_words)
    full = stored(full.select("of", F.ceil(F.col("count") / part_words).cast("int").alias("side")), "full_parts")
    dealt = deal(own_only=False)
    if listed := full.count():
        grids = F.broadcast(full) if listed <= BROADCAST_PARTS else full
        dealt = dealt.join(grids, F.col("part") == F.col("of"), "left")
        side = F.coalesce("side", F.lit(1)).cast("bigint")
        dealt_to, every = F.pmod(F.xxhash64("word"), side), F.sequence(F.lit(0).cast("bigint"), side - 1)
        # At home in one row of the grid, in all its columns; asking in one column, in all rows.
        dealt = dealt.withColumn("asks", F.explode(F.array(F.lit(True), F.lit(False)))).where("asks OR home")
        dealt = dealt.withColumn("line", F.explode(F.when(F.col("asks"), every).otherwise(F.array(dealt_to))))
        dealt = dealt.withColumn("column", F.explode(F.when(F.col("asks"), F.array(dealt_to)).otherwise(every)))
        roles = [F.bool_or(~F.col("asks")).alias("home"), F.bool_or("asks").alias("asks")]
        dealt = dealt.groupBy("part", "line", "column", "word", "n").agg(*roles)
        dealt = dealt.withColumn("part", F.xxhash64("part", "line", "column"))
    else:
        dealt = dealt.withColumn("asks", F.lit(True)).withColumn("part", F.col("part").cast("bigint"))
    dealt = dealt.select("word", "n", "part", "home", "asks")

    def find(table: pa.Table) -> pa.Table:
        texts = table["word"].to_pylist()
        own = [text.encode("latin-1") for text in texts]
        counts = table["n"].to_numpy()
        a, b = search(own, table["home"].to_numpy(), table["asks"].to_numpy(), group_of)
        word, other = np.concatenate([a, b]), np.concatenate([b, a])
        rank = np.empty(len(own), np.int64)
        rank[sorted(range(len(own)), key=own.__getitem__)] = np.arange(len(own))
        by = np.lexsort([rank[other], -counts[other], word])
        word, other = word[by], other[by]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        names = pa.array(texts, pa.string())
        made = pa.table({
            "word": names.take(pa.array(word[first])),
            "n_near": pa.array(np.diff(np.append(first, len(word)))),
            "best_n": pa.array(counts[other[first]]),
            "best": names.take(pa.array(other[first])),
        })
        release_memory()
        return made

    found = dealt.groupBy("part").applyInArrow(find, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("down"), F.col("best").alias("best")))
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("near"))
    return summed.select("word", "n_near", (-F.col("near.down")).alias("best_n"), F.col("near.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """`of` and `root` for each row (word, form): the last word that its chain of forms leads to.

    Along a chain the counts at least double, so it has at most 63 steps, and as the chains known
    double in length from round to round, six rounds follow any. Each is written down."""
    current = stored(forms.select(F.col("word").alias("of"), F.col("form").alias("root")), "roots")
    while True:
        further = current.select(F.col("of").alias("via"), F.col("root").alias("next"))
        joined = current.join(further, F.col("root") == F.col("via"), "left")
        moved = joined.select("of", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = stored(moved, "roots")
        current = moved.select("of", "root")
        if moved.where("moved").isEmpty():
            return current


def spelling_groups(
    rows: DataFrame, text: str = "text", doc_id: str = "doc_id", typo_every: int = 0, ratio: int = RATIO
) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words with `MIN_COUNT` occurrences.

    A word's form is its near word with the largest n (of equal ones the least), if that is at least
    `ratio` (over one) times the word's own n; otherwise null."""
    if ratio <= 1:
        raise ValueError("the ratio must be over one: chains of forms would not end")
    counts = word_counts(rows, text, doc_id, typo_every)
    words = stored(counts.where(F.col("n") >= MIN_COUNT), "words")
    group_of = letter_groups(words)
    near = near_words(words, group_of, words.count())
    has_form: Column = F.col("best_n") >= ratio * F.col("n")
    named = words.join(near.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(has_form, F.col("best")).alias("form"),
        F.when(has_form, F.col("best_n")).alias("form_n"),
    )
    named = stored(named, "forms")
    last = roots(named.where("form IS NOT NULL"))
    return named.join(last, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
