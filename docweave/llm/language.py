"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are runs of one to three characters of the whole text, letters in lower case and everything
else as one space, hashed to 2^15 buckets: (1 + ln count) times the inverse document frequency, scaled
to length one. Frequencies are counted over all training documents. Weights are fitted by
follow-the-regularised-leader with L1 and L2 penalties, on a bounded sample of training documents with
equal shares for all languages, and a temperature is then chosen on a part of it that the weights have
not seen. Labelled rows that are repeated count once; their ids may be null or repeated.

A text that is null or has no letter is `und` with score 0, and so is every text if there is
nothing to learn from. Repeated rows are predicted each; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_text

BUCKET_BITS, ORDERS = 15, 3
#: Documents that weights are fitted on, at most, in equal shares for the labels; one in eight of them for
#: the temperature.
TRAIN_ROWS = 4000
UNKNOWN = "und"
#: Code points of a text that are handled at a time.
PART_CHARS = 1 << 18

_SIZE = 1 << BUCKET_BITS
_FACTOR = np.uint32(0x9E3779B1)


@functools.cache
def letter_table() -> np.ndarray:
    """Code point to its lower-case letter, or to a space (32) if it is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            lower = char.lower()
            table[point] = ord(lower) if len(lower) == 1 else point
    return table


def bucket_counts(text: str, table: np.ndarray) -> np.ndarray | None:
    """How often each bucket occurs; None if the text has no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letters = table[points]
    is_letter = letters != 32
    if not is_letter.any():
        return None
    # Runs of other characters are one space, also before and after the text.
    kept = is_letter.copy()
    kept[1:] |= is_letter[:-1]
    letters = np.concatenate([[32], letters[kept], [32]]).astype(np.uint32)
    counts = np.zeros(_SIZE, np.int64)
    for at in range(0, len(letters), PART_CHARS):
        part = letters[at : at + PART_CHARS + ORDERS - 1]
        mixed = np.zeros(len(part), np.uint32)
        for order in range(ORDERS):
            n = len(part) - order
            if n < 1:
                break
            mixed = (mixed[:n] + part[order:] + np.uint32(order + 1)) * _FACTOR
            mixed ^= mixed >> np.uint32(15)
            counts += np.bincount(mixed[:PART_CHARS] >> np.uint32(32 - BUCKET_BITS), minlength=_SIZE)
    return counts


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    return at, values / max(np.sqrt((values**2).sum()), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket by language
    temperature: float

    def predict(self, counts: np.ndarray | None) -> tuple[str, float]:
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        at, values = _vector(counts, self.idf)
        shares = _softmax(values @ self.weights[at] / self.temperature)
        best = int(np.argmax(shares))
        return self.languages[best], round(float(shares[best]), 6)


def _softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def ftrl(
    vectors: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, classes: int,
    passes: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01,
) -> np.ndarray:
    """Weights (bucket by class) by per-coordinate follow-the-regularised-leader."""
    z, n = np.zeros((_SIZE, classes)), np.zeros((_SIZE, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(vectors)):
            at, values = vectors[i]
            w = weights(z[at], n[at])
            error = _softmax(values @ w)
            error[targets[i]] -= 1
            gradient = values[:, None] * error[None, :]
            squared = n[at] + gradient**2
            z[at] += gradient - (np.sqrt(squared) - np.sqrt(n[at])) / alpha * w
            n[at] = squared
    return weights(z, n)


def _temperature(scores: np.ndarray, targets: np.ndarray) -> float:
    """The temperature of least log loss, from a grid of powers of two and a half."""
    grid = [1.2**power for power in range(-25, 16)]
    rows = np.arange(len(targets))
    losses = [-np.log(np.maximum(_softmax(scores / t)[rows, targets], 1e-12)).mean() for t in grid]
    return grid[int(np.argmin(losses))]


def label_sample(labelled: DataFrame, bound: int) -> DataFrame:
    """At most `bound` different rows of (key, label, text), with a hash of each; by that hash, so the same
    rows in each run. Every label has an equal share, and what small ones leave goes to the others: a
    rare language is learned at any size. Repeated rows count once. With more labels than `bound`, the
    most frequent are taken."""
    hashed = labelled.withColumn("hash", F.xxhash64("label", "key", "text"))
    narrow = hashed.select("label", "hash").distinct()
    sizes = narrow.groupBy("label").count().orderBy(F.desc("count"), "label").limit(bound).collect()
    # Labels with no more rows than an equal share of what is left are taken whole.
    share, left = 0, bound
    for taken, row in enumerate(reversed(sizes)):
        share = left // (len(sizes) - taken)
        if row["count"] > share:
            break
        share = row["count"]
        left -= row["count"]
    named = F.broadcast(labelled.sparkSession.createDataFrame([(r["label"],) for r in sizes], "label string"))
    order = Window.partitionBy("label").orderBy("hash")
    ranked = narrow.join(named, "label", "left_semi").withColumn("rank", F.row_number().over(order))
    picked = ranked.where(F.col("rank") <= share).select("label", "hash")
    rows = hashed.join(F.broadcast(picked), ["label", "hash"], "left_semi")
    return rows.groupBy("label", "hash").agg(F.first(F.struct("key", "text")).alias("one")).select(
        "one.key", "label", "one.text", "hash"
    )


def fit(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id",
        train_rows: int = TRAIN_ROWS) -> Model:
    """A model of the labelled rows. Frequencies come from all of them, weights from a sample."""
    labelled = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    labelled = labelled.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(text).alias("text"))

    shared_table = rows.sparkSession.sparkContext.broadcast(letter_table())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, docs = shared_table.value, np.zeros(_SIZE, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                counts = bucket_counts(value.as_py(), table)
                if counts is not None:
                    seen += counts > 0
                    docs += 1
        if docs:
            at = np.flatnonzero(seen)
            # Bucket -1 counts the documents.
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(at, -1)), pa.array(np.append(seen[at], docs))], ["bucket", "docs"]
            )

    counted = labelled.select("text").mapInArrow(frequencies, "bucket bigint, docs bigint")
    seen = counted.groupBy("bucket").agg(F.sum("docs").alias("docs")).toArrow()
    frequency = np.zeros(_SIZE)
    buckets, docs = seen["bucket"].to_numpy(), seen["docs"].to_numpy()
    total = int(docs[buckets == -1].sum())
    frequency[buckets[buckets >= 0]] = docs[buckets >= 0]
    idf = np.log((1 + total) / (1 + frequency)) + 1
    if not total:
        return Model([], idf, np.zeros((_SIZE, 0)), 1.0)

    def features() -> Callable[[list[str]], list[tuple]]:
        table = shared_table.value

        def of_text(one: str) -> tuple:
            counts = bucket_counts(one, table)
            at = np.flatnonzero(counts) if counts is not None else np.zeros(0, np.int64)
            return at.tolist(), (counts[at].tolist() if len(at) else [])

        return lambda texts: list(map(of_text, texts))

    sample = map_text(
        label_sample(labelled, train_rows), "text",
        {"key": F.col("key"), "label": F.col("label"), "hash": F.col("hash")}, "at array<int>, counts array<int>", features,
    ).where(F.size("at") > 0)
    learned = sample.toArrow().sort_by([("key", "ascending"), ("label", "ascending"), ("hash", "ascending")])
    languages = sorted(set(learned["label"].to_pylist()))
    targets = np.array([languages.index(name) for name in learned["label"].to_pylist()], np.int64)
    vectors = []
    for at, counts in zip(learned["at"], learned["counts"]):
        counted_at = np.zeros(_SIZE, np.int64)
        counted_at[at.values.to_numpy()] = counts.values.to_numpy()
        vectors.append(_vector(counted_at, idf))
    held = np.arange(len(targets)) % 8 == 7
    weights = ftrl([v for v, h in zip(vectors, held) if not h], targets[~held], len(languages))
    temperature = 1.0
    if held.any():
        scores = np.array([values @ weights[at] for (at, values), h in zip(vectors, held) if h])
        temperature = _temperature(scores, targets[held])
    return Model(languages, idf.astype(np.float32), weights.astype(np.float32), temperature)


def predict(rows: DataFrame, model: Model, text: str = "text", passed: dict[str, Column] | None = None) -> DataFrame:
    """The passed columns (doc_id unless given), lang_pred and score of each whole text."""
    context = rows.sparkSession.sparkContext
    shared, shared_table = context.broadcast(model), context.broadcast(letter_table())

    def factory():
        table, fitted = shared_table.value, shared.value
        return lambda texts: [fitted.predict(bucket_counts(one, table)) for one in texts]

    made = "lang_pred string, score double"
    return map_text(rows, text, passed, made, factory)


def held_out(key: Column) -> Column:
    """Documents whose CRC-32 of the id as text leaves 2 when divided by 4; never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
