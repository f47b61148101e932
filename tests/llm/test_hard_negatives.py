"""Hard negatives against brute force and SQL; what the coordinate lists leave out; odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from docweave.llm import hard_negatives as hn
from docweave.llm import queries
from docweave.llm.common import read_table
from helpers import SF_DIR, rows_of

DDL = "vec_id bigint, embedding array<double>, label int"


def brute(rows, every=100):
    kept = []
    for key, vector, label in rows:
        if key is None or vector is None or label is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((key, [math.floor(256 * x) for x in vector], label))
    made = []
    for anchor, own, label in {(k, tuple(v), n) for k, v, n in kept if k % every == 0}:
        scored = [(-sum(x * y for x, y in zip(own, v)), k, n) for k, v, n in kept if k != anchor]
        positives = sorted(one for one in scored if one[2] == label)[:5]
        for down, positive, _ in positives:
            p = -down
            fit = sorted(one for one in scored if one[2] != label and 30 * p <= -100 * one[0] <= 90 * p)
            made += [(anchor, positive, i + 1, k, p, -s) for i, (s, k, _) in enumerate(fit[:10])]
    return sorted(made, key=repr)


def random_rows(seed, n, dims=12, labels=4, spread=1.0):
    """Vectors of very different lengths, many of them close to a coordinate axis."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, dims)) * np.exp(rng.normal(size=(n, 1)) * spread)
    vectors[np.arange(n), rng.integers(0, dims, n)] *= 6
    vectors[:: 50] = vectors[1]
    return [(int(i), v, int(c)) for i, v, c in zip(rng.permutation(n), vectors.tolist(), rng.integers(0, labels, n))]


def test_query_equals_its_sql(spark):
    con = oracle.connect(SF_DIR)
    got = queries.QUERIES["op13_hard_negatives"](spark, SF_DIR)
    assert got.count() > 100
    assert oracle.difference(con, got, queries.ORACLES["op13_hard_negatives"]) is None
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"])
            for r in read_table(spark, SF_DIR, "embeddings").collect()]
    assert rows_of(got) == brute(rows)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 200, "bucket_rows": 20}])
def test_random_vectors(spark, options):
    rows = random_rows(3, 600)
    table = spark.createDataFrame(rows, DDL).repartition(5)
    got = hn.hard_negatives(table, F.col("vec_id") % 20 == 0, **options)
    assert rows_of(got) == brute(rows, 20)


def test_lists_leave_out_most_rows_and_none_that_counts():
    rng = np.random.default_rng(8)
    drawn = rng.normal(size=(2000, 24))
    drawn[np.arange(2000), rng.integers(0, 24, 2000)] += rng.choice([-12, 12], 2000)
    vectors = np.floor(drawn / np.linalg.norm(drawn, axis=1)[:, None] * 256).astype(np.int64)
    bucket = hn.Bucket.of(hn._bucket_row(np.arange(2000), np.zeros(2000, np.int64), vectors))
    queries_ = vectors[:200]
    exact = queries_ @ vectors.T
    least = np.sort(exact, axis=1)[:, -5]
    dense, few = hn.candidates(bucket, queries_, least, np.full(200, 1 << 60))
    left = {q: set(rows.tolist()) for q, rows in few}
    for q in range(200):
        if q not in dense:
            assert set(np.flatnonzero(exact[q] >= least[q])) <= left.get(q, set())
    assert len(dense) < 100 and np.mean([len(rows) for _, rows in few]) < 400
    # Too high a threshold for the lengths: no row is looked at.
    dense, few = hn.candidates(bucket, queries_, exact.max(axis=1) * 3, np.full(200, 1 << 60))
    assert len(dense) == 0 == len(few)
    # A ceiling narrows the ranges from above.
    most = least // 2
    dense, few = hn.candidates(bucket, queries_, most - 10, most)
    left = {q: set(rows.tolist()) for q, rows in few}
    for q in set(range(200)) - set(dense.tolist()):
        assert set(np.flatnonzero((exact[q] >= most[q] - 10) & (exact[q] <= most[q]))) <= left.get(q, set())


def test_scores_beyond_floating_point_are_exact(spark):
    big = float(1 << 21)
    rows = [(0, [big, 1.0], 0), (1, [big, 0.0], 0), (2, [big / 2, 1 / 256], 1), (3, [big / 2, 2 / 256], 1), (4, [1e300, 0.0], 1)]
    got = hn.hard_negatives(spark.createDataFrame(rows, DDL), F.col("vec_id") == 0)
    assert rows_of(got) == [row for row in brute(rows[:4]) if row[0] == 0]


def test_odd_repeated_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(4, 150, dims=4, labels=2)
    rows += [(None, [1.0] * 4, 0), (500, None, 0), (501, [1.0, None, 1.0, 1.0], 1), (502, [nan] * 4, 1), (503, [inf, 0.0, 0.0, 0.0], 1),
             (504, [1.0] * 4, None), (505, [], 1), (600, [0.0] * 4, 0), (601, [2.0, 1.0], 1), (700, [], 1), (3, [1.0] * 4, 0), (3, [1.0] * 4, 1)]
    rows += rows[:40]  # repeated rows count again, repeated anchors do not
    table = spark.createDataFrame(rows, DDL)
    for name in ("id", "length", "vector", "slot", "score", "block", "rank"):
        table = table.selectExpr("*", f"'x' AS {name}")
    got = hn.hard_negatives(table, F.col("vec_id") % 10 == 0, bucket_rows=16)
    assert rows_of(got) == brute(rows, 10)
    assert hn.hard_negatives(table.where("false"), F.col("vec_id") % 10 == 0).collect() == []
    one_label = hn.hard_negatives(table.withColumn("label", F.lit(1)), F.col("vec_id") % 10 == 0)
    assert one_label.collect() == []


def test_a_hot_vector_is_split_over_tasks(spark):
    rows = [(i, [1.0, 2.0], i % 2) for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        valid = hn.valid_rows(spark.createDataFrame(rows, DDL))
        buckets = hn.index(valid, 2, 100)
        parts = buckets.rdd.glom().map(lambda part: sum(len(row["ids"]) // 8 for row in part)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(parts) == 4000 and max(parts) < 2000
