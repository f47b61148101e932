"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Words are runs of letters, digits and underscores in lower case, so punctuation and line breaks
do not matter; shingles are five words (an item of fewer words is one shingle of all its words). A
shingle weighs ln(1 + items / items that have it). For every size that an item has, windows of that
many words slide over the whole text. The signs of the summed weights of a window's shingle bits are
its SimHash; only shingles vote that an item of that size has, so changed words cannot outvote the rest. Fingerprints are cut into blocks of 8 bits; within `radius` bits at least one block of an
item's fingerprint differs in at most radius // 8 bits, so the lists of the blocks in that reach
hold every item within the radius. Each such pair is then compared exactly: the weight of the
item's shingles that the window has (with multiplicity), over the item's weight. From `threshold`
on, the document holds the item.

Windows in which the shingles of the items of that size weigh less than `threshold` times the
lightest of those items cannot reach the threshold, so they get no fingerprint; nothing else is left
out.

The benchmark is read in blocks of bounded size, each broadcast alone with its shingles' frequencies in
the whole benchmark, so it may have any size and similarities do not depend on the blocks. Null
and empty texts hold nothing, items without words are in nothing, items with equal texts are all
reported, repeated documents each. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import new_run_folder
from .common import WholeRow, map_text, stored

SHINGLE_WORDS, THRESHOLD, RADIUS = 5, 0.8, 23
#: Bytes of item texts that are broadcast together.
BLOCK_BYTES = 8 << 20
#: Distinct words a task remembers the hash of; words of a text that are handled at a time.
TABLE_WORDS, PART_WORDS = 100_000, 1 << 14

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for every `size` consecutive word hashes."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    mixed = np.full(n, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ words[i : n + i]) * _MIX
        mixed ^= mixed >> np.uint64(31)
    return mixed


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Rows of 64 entries, +1 or -1."""
    raw = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return raw.astype(np.float64) * 2 - 1


def _signs(sums: np.ndarray) -> np.ndarray:
    # Rounded, so that a sum of weights does not depend on where the window starts.
    return np.packbits(np.round(sums, 6) > 0, axis=1, bitorder="little").view("<u8").ravel()


class Index:
    """Items of one block of the benchmark, by window size, ready to be searched.

    `counted`: items with words in the whole benchmark, the hashes of the block's shingles and how many
    of all items have each. Without it the block is the whole benchmark."""

    def __init__(
        self, items: list[tuple[int, str]], threshold: float = THRESHOLD, radius: int = RADIUS,
        counted: tuple[int, np.ndarray, np.ndarray] | None = None,
    ):
        self.threshold, self.radius = threshold, radius
        self.word_hash = _Hashes()
        own = {}
        for number, (_, text) in enumerate(items):
            words = self.hashed(text)
            if len(words):
                size = min(SHINGLE_WORDS, len(words))
                own[number] = (size, len(words) - size + 1, shingles(words, size))
        if counted is None:
            n_items = len(own)
            frequency = Counter(h for _, _, hashes in own.values() for h in set(hashes.tolist()))
        else:
            n_items = counted[0]
            frequency = dict(zip(counted[1].tolist(), counted[2].tolist()))
        self.ids = [item for item, _ in items]
        known = sorted(frequency)
        self.known = np.array(known, np.uint64)
        self.known_weight = np.array([math.log(1 + n_items / frequency[h]) for h in known])
        self.weight_of = dict(zip(known, self.known_weight.tolist()))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.counts = {n: Counter(hashes.tolist()) for n, (_, _, hashes) in own.items()}
        self.weights = {n: sum(self.weight_of[h] * c for h, c in self.counts[n].items()) for n in own}
        groups: dict[tuple[int, int], list[int]] = defaultdict(list)
        for number, (size, span, _) in own.items():
            groups[size, span].append(number)
        # Groups: items of one size in words; by the words of a shingle, and by the shingles in them.
        self.groups: list[tuple] = []
        self.sizes = sorted({size for size, _ in groups})
        self.in_groups: dict[int, list[int]] = defaultdict(list)
        for (size, span), numbers in sorted(groups.items()):
            for h in {h for n in numbers for h in self.counts[n]}:
                self.in_groups[h].append(len(self.groups))
            prints = np.concatenate([
                _signs((_bits(own[n][2]) * self.weights_of(own[n][2])[:, None]).sum(axis=0, keepdims=True))
                for n in numbers
            ])
            least = min(self.weights[n] for n in numbers)
            self.groups.append((span, least, np.array(numbers), prints, self._blocks(prints)))

    def _blocks(self, prints: np.ndarray) -> list[list[np.ndarray]]:
        """For each of 8 blocks and each of its 256 values, the items within reach in that block."""
        reach = self.radius // 8
        values = np.arange(256, dtype=np.uint8)
        split = prints.astype("<u8").view(np.uint8).reshape(-1, 8)
        near = [np.bitwise_count(values[:, None] ^ split[None, :, i]) <= reach for i in range(8)]
        return [[np.flatnonzero(row) for row in block] for block in near]

    def hashed(self, text: str) -> np.ndarray:
        words = _WORDS(text.lower())
        if len(self.word_hash) > TABLE_WORDS:
            self.word_hash.clear()
        return np.fromiter(map(self.word_hash.__getitem__, words), np.uint64, len(words))

    def weights_of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.known_weight[at], 0.0)

    def search(self, text: str) -> dict[int, tuple[float, int, int]]:
        """Item number to its best similarity and that window's first word and end (the first best)."""
        found: dict[int, tuple[float, int, int]] = {}
        if not self.sizes:
            return found
        words = self.hashed(text)
        for size in self.sizes:
            hashes = shingles(words, size)
            maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)])
            if not len(maybe):
                continue
            at = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
            hits: dict[int, list[int]] = defaultdict(list)
            for place in maybe[self.known[at] == hashes[maybe]].tolist():
                for group in self.in_groups[int(hashes[place])]:
                    hits[group].append(place)
            for group, places in hits.items():
                span, least, *items = self.groups[group]
                hit = np.array(places)
                summed = np.concatenate([[0.0], np.cumsum(self.weights_of(hashes[hit]))])
                # A text shorter than the window is one window.
                last = max(len(hashes) - span, 0)
                starts = np.unique(np.clip(hit[:, None] - np.arange(span)[None, :], 0, last).ravel())
                ends = np.minimum(starts + span, len(hashes))
                within = summed[np.searchsorted(hit, ends)] - summed[np.searchsorted(hit, starts)]
                heavy = within >= self.threshold * least - 1e-6
                if heavy.any():
                    voting = np.zeros(len(hashes))
                    voting[hit] = self.weights_of(hashes[hit])
                    self._compare(found, hashes, voting, size, starts[heavy], ends[heavy], *items)
        return found

    def _compare(self, found, hashes, voting, size, starts, ends, numbers, prints, blocks) -> None:
        for a, b in _runs(starts, ends):
            low, high = int(starts[a]), int(ends[b - 1])
            own = hashes[low:high]
            votes = np.vstack([
                np.zeros(64), np.cumsum(_bits(own) * voting[low:high, None], axis=0)
            ])
            signs = _signs(votes[ends[a:b] - low] - votes[starts[a:b] - low])
            split = signs.astype("<u8").view(np.uint8).reshape(-1, 8)
            for i, (start, end) in enumerate(zip(starts[a:b].tolist(), ends[a:b].tolist())):
                listed = np.unique(np.concatenate([blocks[j][v] for j, v in enumerate(split[i])]))
                near = listed[np.bitwise_count(prints[listed] ^ signs[i]) <= self.radius]
                if not len(near):
                    continue
                window = Counter(hashes[start:end].tolist())
                for number in numbers[near].tolist():
                    items = self.counts[number]
                    shared = sum(self.weight_of[h] * min(c, window[h]) for h, c in items.items() if h in window)
                    similarity = round(shared / self.weights[number], 9)
                    best = (similarity, start, end + size - 1)
                    if similarity >= self.threshold and (
                        number not in found or (-similarity, start) < (-found[number][0], found[number][1])
                    ):
                        found[number] = best


def _runs(starts: np.ndarray, ends: np.ndarray):
    """Consecutive windows that overlap or touch, cut where they get too long."""
    a = 0
    for i in range(1, len(starts) + 1):
        if i == len(starts) or starts[i] > ends[i - 1] or ends[i] - starts[a] > PART_WORDS:
            yield a, i
            a = i


_WORDS = re.compile(r"\w+").findall


def _item_shingles(text: str, word_hash: _Hashes) -> np.ndarray:
    """The distinct shingle hashes of an item."""
    words = np.fromiter(map(word_hash.__getitem__, _WORDS(text.lower())), np.uint64)
    return np.unique(shingles(words, min(SHINGLE_WORDS, len(words)))) if len(words) else words


def _counted_items(benchmark: DataFrame) -> tuple[int, int, DataFrame]:
    """The number of items with words, the bytes of all texts, and all items with the hashes of their
    shingles and how many items of the whole benchmark have each."""

    def factory() -> Callable[[list[str]], list[tuple]]:
        word_hash = _Hashes()
        return lambda texts: [(_item_shingles(one, word_hash).view(np.int64).tolist(),) for one in texts]

    known = benchmark.where("text IS NOT NULL").select("item_id", "text")
    passed = {name: F.col(name) for name in ("item_id", "text")}
    items = map_text(known, "text", passed, "shingles array<bigint>", factory)
    items = stored(items.withColumn("number", F.monotonically_increasing_id()), "items")
    each = items.select("number", F.explode("shingles").alias("hash"))
    counts = each.groupBy("hash").agg(F.count("*").alias("n")).withColumnRenamed("hash", "of")
    weights = (
        each.join(counts, F.col("hash") == F.col("of"))
        .groupBy(F.col("number").alias("item"))
        .agg(F.collect_list(F.struct("hash", "n")).alias("counted"))
    )
    rows = items.join(weights, F.col("number") == F.col("item"), "left").select(
        "number", "item_id", "text", F.col("counted")["hash"].alias("hashes"), F.col("counted")["n"].alias("counts")
    )
    total = items.agg(F.count_if(F.size("shingles") > 0), F.sum(F.octet_length("text"))).first()
    return total[0], total[1] or 0, rows


Block = tuple[list[tuple[int, str]], tuple[int, np.ndarray, np.ndarray]]


class Blocks:
    """The benchmark's items in blocks of at most BLOCK_BYTES of text and one more item, each with the
    counts of its shingles in the whole benchmark. Blocks are made and written by Spark; only their
    numbers, and one block at a time, come to the driver."""

    def __init__(self, benchmark: DataFrame):
        self.n_items, total, rows = _counted_items(benchmark)
        in_order = Window.partitionBy("bucket").orderBy("item_id", "text", "number")
        before = F.sum(F.octet_length("text")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
        dealt = rows.withColumn(
            "bucket", F.pmod(F.xxhash64("number"), F.lit(-(-total // BLOCK_BYTES) or 1)).cast("int")
        ).withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / F.lit(BLOCK_BYTES)).cast("int"))
        self.spark = benchmark.sparkSession
        _, folder = new_run_folder(self.spark)
        self.folder = f"{folder}/blocks"
        dealt.write.partitionBy("bucket", "part").parquet(self.folder)
        self.schema = rows.schema
        found = self.spark.read.schema(dealt.schema).parquet(self.folder)
        self.names = [tuple(r) for r in found.select("bucket", "part").distinct().orderBy("bucket", "part").collect()]

    def __len__(self) -> int:
        return max(1, len(self.names))

    def read(self, number: int) -> Block:
        items: list[tuple[int, str]] = []
        counts: dict[int, int] = {}
        if self.names:
            bucket, part = self.names[number]
            rows = self.spark.read.schema(self.schema).parquet(f"{self.folder}/bucket={bucket}/part={part}")
            for row in rows.orderBy("item_id", "text").collect():
                items.append((row["item_id"], row["text"]))
                counts.update(zip(row["hashes"] or (), row["counts"] or ()))
        hashes = np.fromiter(counts.keys(), np.int64, len(counts)).view(np.uint64)
        return items, (self.n_items, hashes, np.fromiter(counts.values(), np.int64, len(counts)))


def find_items(
    rows: DataFrame, benchmark: DataFrame, text: str = "text", passed: dict[str, Column] | None = None,
    threshold: float = THRESHOLD, radius: int = RADIUS,
) -> DataFrame:
    """The passed columns (doc_id unless given) and `items`: array of (item_id, similarity,
    start_word, end_word), empty for a clean document."""
    passed = {"doc_id": F.col("doc_id")} if passed is None else passed
    made = (
        "items array<struct<item_id: bigint, similarity: double, start_word: bigint, end_word: bigint>>"
    )

    def one_block(of: DataFrame, shared: Broadcast, kept: dict[str, Column] | None, text: str) -> DataFrame:
        def factory() -> Callable[[list[str]], list[tuple]]:
            items, counted = shared.value
            index = Index(items, threshold, radius, counted)

            def of_text(one: str) -> tuple:
                found = sorted(index.search(one).items())
                keys = ("similarity", "start_word", "end_word")
                return ([{"item_id": index.ids[n], **dict(zip(keys, best))} for n, best in found],)

            return lambda texts: list(map(of_text, texts))

        return map_text(of, text, kept, made, factory)

    blocks = Blocks(benchmark)
    broadcast = rows.sparkSession.sparkContext.broadcast
    if len(blocks) == 1:
        return one_block(rows, broadcast(blocks.read(0)), passed, text)
    # Further blocks: the rows are written once, and numbered; a pass over their texts for each block
    # keeps the numbers and items of the rows that hold any.
    whole = isinstance(passed, WholeRow)
    kept = F.struct(*[c.alias(n) for n, c in passed.items()]).alias("passed")
    own_text = [] if whole else [F.col(text).alias("text")]
    held = stored(rows.select(F.monotonically_increasing_id().alias("number"), kept, *own_text), "rows")
    texts = held.select("number", (F.col("passed")["row"][text] if whole else F.col("text")).alias("text"))
    _, folder = new_run_folder(rows.sparkSession)
    for number in range(len(blocks)):
        shared = broadcast(blocks.read(number))
        found = one_block(texts, shared, {"number": F.col("number")}, "text").where(F.size("items") > 0)
        found.write.parquet(f"{folder}/pass={number}")
        shared.destroy()
    passes = rows.sparkSession.read.schema(found.schema).parquet(folder)
    all_items = F.array_sort(F.flatten(F.collect_list("items"))).alias("items")
    hits = passes.groupBy("number").agg(all_items)
    joined = held.drop("text").join(hits, "number", "left")
    return joined.select("passed.*", F.coalesce("items", F.array().cast(hits.schema["items"].dataType)).alias("items"))


def contaminated_pairs(rows: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, similarity, start_word, end_word: one row for each item a document holds."""
    found = find_items(rows, benchmark, **options)
    return found.select("doc_id", F.explode("items").alias("item")).select("doc_id", "item.*")


def clean_rows(rows: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """All columns of the rows that hold no item."""
    found = find_items(rows, benchmark, text, passed=WholeRow())
    return found.where(F.size("items") == 0).select("row.*")
