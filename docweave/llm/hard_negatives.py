"""Hard negatives: rows of another label whose score with an anchor is close to that of its positives.

Vectors are quantised to integers (`floor(SCALE * x)`), and a score is the integer inner product, so
results do not depend on the order of sums. The index deals rows by falling length to partitions and
cuts those into buckets of similar length; a bucket holds its vectors and, for each coordinate, the
order of its rows by that coordinate of the unit vectors: sorted coordinate lists.

A search wants, for an anchor, the first rows with a score of at least a threshold and at most a ceiling.
Over the lengths of anchor and bucket these bound the angle between them. If no angle is left, the
bucket is passed over. Otherwise each of the anchor's largest (focus) coordinates has a range of values
that a row within these angles can have; the ranges are found in the sorted lists, the shortest list is taken and
those of its rows that are in the other ranges too are scored exactly. Anchors whose ranges leave more than
`DENSE_SHARE` of a bucket are scored against all of it, in one matrix product. Thresholds rise as a
task goes from bucket to bucket; what its buckets give is merged by Spark.

Anchors come in blocks of bounded size. Each is broadcast alone and searches the whole index, twice: for
its positives (highest scores of the same label), then for the negatives of each positive.

Rows with a null id, label or vector, or a null or non-finite component, take no part, nor do vectors
so long (2^31 after quantising) that scores could leave 64 bits. Missing components of shorter vectors count as zero.
Other rows of an anchor are those with another id; rows that share an id each take part, and equal
anchor rows are one. Equal scores are ordered by id, then label. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import new_run_folder
from .common import release_memory, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is within these shares (of 100) of the positive's.
LEAST_SHARE, MOST_SHARE = 30, 90
#: Rows of a bucket, and the least ratio of its lengths.
BUCKET_ROWS, LENGTH_RATIO = 2048, 0.9
FOCUS = 4
#: From this share of a bucket on, its sorted lists save nothing.
DENSE_SHARE = 0.25
#: Bytes of one block of anchors, and scores that a task holds at a time.
BLOCK_BYTES, HELD_SCORES = 4 << 20, 1 << 20
LEAST = np.iinfo(np.int64).min
_SLACK = 1e-9

BUCKET_DDL = (
    "ids binary, labels binary, vectors binary, orders binary, dims int, shortest double, longest double"
)


def valid_rows(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """id, label (bigint), vector (doubles) and length of the rows that take part."""
    doubles = F.col(vector).cast("array<double>")
    unusable = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    squares = F.transform(doubles, lambda x: F.pow(F.floor(x * SCALE).cast("double"), F.lit(2.0)))
    length = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
    whole = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()
    kept = rows.where(whole).where(~unusable)
    return kept.select(
        F.col(key).cast("bigint").alias("id"),
        F.col(label).cast("bigint").alias("label"),
        doubles.alias("vector"),
        length.alias("length"),
    ).where(F.col("length") < F.lit(float(1 << 31)))


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Quantised vectors, filled up with zeros."""
    sizes = pc.list_value_length(vectors).to_numpy()
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * SCALE).astype(np.int64)
    made = np.zeros((len(sizes), dims), np.int64)
    made[np.arange(dims) < sizes[:, None]] = flat
    return made


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    return vectors / np.maximum(lengths, 1e-300)[:, None], lengths


@dataclass
class Bucket:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    units: np.ndarray
    #: By coordinate, rows in the order of its values, and these values.
    orders: np.ndarray
    sorted_units: np.ndarray
    shortest: float
    longest: float

    @classmethod
    def of(cls, row: dict) -> Bucket:
        ids = np.frombuffer(row["ids"], np.int64)
        vectors = np.frombuffer(row["vectors"], np.int32).reshape(len(ids), row["dims"]).astype(np.int64)
        units, _ = _units(vectors)
        orders = np.frombuffer(row["orders"], np.int16).reshape(row["dims"], len(ids))
        sorted_units = np.take_along_axis(units.T, orders.astype(np.int64), axis=1)
        labels = np.frombuffer(row["labels"], np.int64)
        return cls(ids, labels, vectors, units, orders, sorted_units, row["shortest"], row["longest"])


def _bucket_row(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict:
    units, lengths = _units(vectors)
    return {
        "ids": ids.tobytes(),
        "labels": labels.tobytes(),
        "vectors": vectors.astype(np.int32).tobytes(),
        "orders": np.argsort(units.T, axis=1, kind="stable").astype(np.int16).tobytes(),
        "dims": vectors.shape[1],
        "shortest": float(lengths.min()),
        "longest": float(lengths.max()),
    }


_BUCKET = pa.schema([
    ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("orders", pa.binary()),
    ("dims", pa.int32()), ("shortest", pa.float64()), ("longest", pa.float64()),
])


def index(valid: DataFrame, dims: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Buckets of similar length. Equal lengths are split by id, so no length fills one task."""
    placed = valid.repartitionByRange(F.desc("length"), F.xxhash64("id"))
    ordered = placed.sortWithinPartitions(F.desc("length"), "id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, first = 0, 0.0

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            row = _bucket_row(table["id"].to_numpy(), table["label"].to_numpy(), _matrix(table["vector"].chunk(0), dims))
            return pa.RecordBatch.from_pylist([row], schema=_BUCKET)

        for batch in batches:
            lengths = batch.column(3).to_numpy()
            at = 0
            while at < len(lengths):
                first = first if n else lengths[at]
                end = min(len(lengths), at + bucket_rows - n)
                shorter = np.flatnonzero(lengths[at:end] < LENGTH_RATIO * first)
                end = at + int(shorter[0]) if len(shorter) else end
                held.append(batch.slice(at, end - at))
                n, at = n + end - at, end
                if n and (n == bucket_rows or len(shorter)):
                    yield made()
                    held, n = [], 0
        if n:
            yield made()
        release_memory()

    return ordered.mapInArrow(build, BUCKET_DDL)


def candidates(
    bucket: Bucket, queries: np.ndarray, least: np.ndarray, most: np.ndarray
) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Which queries must be scored against the whole bucket, and for others the rows that remain.

    For each query the rows with a score from `least` to `most` are among them."""
    units, lengths = _units(queries)
    n = len(bucket.ids)
    shortest, longest = bucket.shortest * (1 - _SLACK), bucket.longest * (1 + _SLACK)
    bounded = (least > 0) & (lengths > 0) & (shortest > 0)
    over = np.where(bounded, lengths, 1.0)
    cos_least = np.where(bounded, least / over / max(longest, 1e-300), -1.0)
    cos_most = np.minimum(np.where(bounded, most / over / max(shortest, 1e-300), 1.0) + _SLACK, 1.0)
    # No angle left: the bucket's vectors are too short for the threshold.
    possible = ~(bounded & ((cos_least > 1 + _SLACK) | (most < least)))
    widest = np.arccos(np.clip(cos_least - _SLACK, -1, 1))
    narrowest = np.arccos(np.clip(cos_most, -1, 1))
    focus = np.argsort(-np.abs(units), axis=1)[:, :FOCUS]
    own = np.arccos(np.clip(np.take_along_axis(units, focus, axis=1), -1, 1))
    nearest = np.maximum(0, np.maximum(own - widest[:, None], narrowest[:, None] - own))
    high = np.cos(nearest) + _SLACK
    low = np.cos(np.minimum(np.pi, own + widest[:, None])) - _SLACK
    starts, ends = np.zeros(focus.shape, np.int64), np.full(focus.shape, n)
    for coordinate in np.unique(focus[bounded & possible]).tolist() if len(focus) else []:
        at = np.nonzero((focus == coordinate) & (bounded & possible)[:, None])
        values = bucket.sorted_units[coordinate]
        starts[at] = np.searchsorted(values, low[at], "left")
        ends[at] = np.searchsorted(values, high[at], "right")
    sizes = np.maximum(ends - starts, 0)
    shortest_list = sizes.argmin(axis=1) if focus.shape[1] else np.zeros(len(queries), np.int64)
    best = sizes[np.arange(len(queries)), shortest_list] if focus.shape[1] else np.full(len(queries), n)
    dense = possible & (best > DENSE_SHARE * n)
    few = []
    for q in np.flatnonzero(possible & ~dense & (best > 0)).tolist():
        pick = shortest_list[q]
        rows = bucket.orders[focus[q, pick], starts[q, pick] : ends[q, pick]].astype(np.int64)
        for other in range(focus.shape[1]):
            if other != pick and len(rows):
                values = bucket.units[rows, focus[q, other]]
                rows = rows[(values >= low[q, other]) & (values <= high[q, other])]
        if len(rows):
            few.append((q, rows))
    return np.flatnonzero(dense), few


def _scores(queries: np.ndarray, vectors: np.ndarray, small: bool) -> np.ndarray:
    """Exact: floating point where no sum can leave its 53 bits, else integers."""
    if small:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


def scored(
    bucket: Bucket, queries: np.ndarray, least: np.ndarray, most: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query and row indexes with their scores, for all rows with a score within the query's bounds."""
    _, lengths = _units(queries)
    small = float(lengths.max(initial=0)) * bucket.longest < (1 << 52)
    dense, few = candidates(bucket, queries, least, most)
    step = max(1, HELD_SCORES // max(len(bucket.ids), 1))
    for at in range(0, len(dense), step):
        some = dense[at : at + step]
        scores = _scores(queries[some], bucket.vectors, small)
        q, row = np.nonzero((scores >= least[some, None]) & (scores <= most[some, None]))
        yield some[q], row, scores[q, row]
    at = 0
    while at < len(few):
        q, rows, held = [], [], 0
        while at < len(few) and held < HELD_SCORES // 64:
            q.append(np.full(len(few[at][1]), few[at][0]))
            rows.append(few[at][1])
            held += len(rows[-1])
            at += 1
        of, row = np.concatenate(q), np.concatenate(rows)
        scores = np.einsum("ij,ij->i", queries[of], bucket.vectors[row])
        kept = (scores >= least[of]) & (scores <= most[of])
        yield of[kept], row[kept], scores[kept]


class Best:
    """For each slot the first `size` entries by falling score, then id, then label."""

    def __init__(self, slots: int, size: int) -> None:
        self.size = size
        self.slot = self.score = self.id = self.label = np.zeros(0, np.int64)
        #: The last score among a full slot's entries; what is below it cannot enter.
        self.bound = np.full(slots, LEAST)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        fresh = score >= self.bound[slot]
        if not fresh.any():
            return
        slot = np.concatenate([self.slot, slot[fresh]])
        score = np.concatenate([self.score, score[fresh]])
        ids = np.concatenate([self.id, ids[fresh]])
        labels = np.concatenate([self.label, labels[fresh]])
        by = np.lexsort([labels, ids, -score, slot])
        first = np.flatnonzero(np.diff(slot[by], prepend=-1))
        place = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        by, place = by[place < self.size], place[place < self.size]
        self.slot, self.score, self.id, self.label = slot[by], score[by], ids[by], labels[by]
        last = place == self.size - 1
        self.bound[self.slot[last]] = self.score[last]


@dataclass
class Block:
    """Anchors of one block, and for the second search the positives: owner, id, label and score by slot."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    owner: np.ndarray | None = None
    positive_id: np.ndarray | None = None
    positive_score: np.ndarray | None = None


def positives_of(block: Block, buckets: Iterator[Bucket], size: int) -> Best:
    """Slots are the anchors."""
    best = Best(len(block.ids), size)
    no_ceiling = np.full(len(block.ids), np.iinfo(np.int64).max)
    for bucket in buckets:
        for q, row, score in scored(bucket, block.vectors, best.bound, no_ceiling):
            good = (bucket.labels[row] == block.labels[q]) & (bucket.ids[row] != block.ids[q])
            best.add(q[good], score[good], bucket.ids[row[good]], bucket.labels[row[good]])
    return best


def negatives_of(block: Block, buckets: Iterator[Bucket], size: int) -> Best:
    """Slots are the positives; each has its own range of scores."""
    owner, score = block.owner, block.positive_score
    # Least and most integer scores s with LEAST_SHARE * p <= 100 * s <= MOST_SHARE * p, without overflow.
    whole, rest = np.divmod(score, 100)
    floor = LEAST_SHARE * whole + -(-LEAST_SHARE * rest // 100)
    ceiling = MOST_SHARE * whole + MOST_SHARE * rest // 100
    best = Best(len(owner), size)
    # Slots in the order of their owners; an anchor's search covers all of its positives.
    starts = np.searchsorted(owner, np.arange(len(block.ids) + 1))
    counts = np.diff(starts)
    searching = np.flatnonzero(counts > 0)
    queries = block.vectors[searching]
    for bucket in buckets:
        lowest = np.maximum(floor, best.bound)
        least = np.minimum.reduceat(lowest, starts[searching]) if len(searching) else lowest
        most = np.maximum.reduceat(ceiling, starts[searching]) if len(searching) else ceiling
        for q, row, found in scored(bucket, queries, least, most):
            anchor = searching[q]
            other = bucket.labels[row] != block.labels[anchor]
            anchor, row, found = anchor[other], row[other], found[other]
            for turn in range(int(counts.max(initial=0))):
                has = counts[anchor] > turn
                slot = starts[anchor[has]] + turn
                good = (found[has] >= lowest[slot]) & (found[has] <= ceiling[slot])
                at = row[has][good]
                best.add(slot[good], found[has][good], bucket.ids[at], bucket.labels[at])
    return best


def _searched(
    buckets: DataFrame, block: Block, search: Callable[..., Best], size: int
) -> tuple[DataFrame, Broadcast]:
    """slot, score, id, other (its label) and rank: the first `size` per slot. The block is broadcast."""
    sent = buckets.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def held() -> Iterator[Bucket]:
            for batch in batches:
                for at in range(batch.num_rows):
                    yield Bucket.of(batch.slice(at, 1).to_pylist()[0])

        best = search(sent.value, held(), size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (best.slot, best.score, best.id, best.label)], ["slot", "score", "id", "other"]
        )
        release_memory()

    found = buckets.mapInArrow(run, "slot bigint, score bigint, id bigint, other bigint")
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size), sent


def _blocks(anchors: DataFrame, dims: int, block_bytes: int) -> Iterator[Block]:
    """The anchors, so many at a time; only one block is in the driver."""
    total = anchors.count()
    blocks = max(1, -(-total * dims * 8 // block_bytes))
    folder = f"{new_run_folder(anchors.sparkSession)[1]}/blocks"
    number = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks)).cast("int")
    dealt = anchors.withColumn("block", number)
    dealt.repartition("block").write.partitionBy("block").parquet(folder)
    kept = anchors.sparkSession.read.schema(dealt.schema).parquet(folder)
    for at in range(blocks):
        held = kept.where(F.col("block") == at).orderBy("id", "label", "vector").toArrow()
        if held.num_rows:
            vectors = _matrix(held["vector"].combine_chunks(), dims)
            yield Block(held["id"].to_numpy(), held["label"].to_numpy(), vectors)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    block_bytes: int = BLOCK_BYTES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `is_anchor` is a condition on the rows; anchors' positives are the first `positives` other rows of their
    label, and each gets its first `negatives` rows of other labels within the range of scores."""
    if bucket_rows > np.iinfo(np.int16).max:
        raise ValueError("a bucket's rows are numbered by 16 bits")
    spark = rows.sparkSession
    valid = valid_rows(rows, key, label, vector)
    dims = max(valid.agg(F.max(F.size("vector"))).first()[0] or 0, 1)
    buckets = stored(index(valid, dims, bucket_rows), "buckets")
    anchors = valid_rows(rows.where(is_anchor), key, label, vector).select("id", "label", "vector").distinct()
    folder = f"{new_run_folder(spark)[1]}/negatives"
    ddl = (
        "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
        "negative_score bigint"
    )
    spark.createDataFrame([], ddl).write.parquet(f"{folder}/block=-1")
    for number, block in enumerate(_blocks(stored(anchors, "anchors"), dims, block_bytes)):
        found, sent = _searched(buckets, block, positives_of, positives)
        best = found.orderBy("slot", "rank").select("slot", "id", "score").toArrow()
        sent.unpersist()
        if not best.num_rows:
            continue
        block.owner, block.positive_id, block.positive_score = (best[c].to_numpy() for c in best.column_names)
        found, sent = _searched(buckets, block, negatives_of, negatives)
        slots = pa.table({
            "of": np.arange(best.num_rows),
            "anchor_id": block.ids[block.owner],
            "positive_id": block.positive_id,
            "positive_score": block.positive_score,
        })
        named = found.join(F.broadcast(spark.createDataFrame(slots)), F.col("slot") == F.col("of"))
        named.select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        ).write.parquet(f"{folder}/block={number}")
        sent.unpersist()
    return spark.read.schema(ddl).parquet(folder).drop("block")
