"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits of each other have a variant in common that is within half
the radius of both. So every distinct fingerprint emits all its variants within half the radius,
variants are shuffled, and fingerprints that meet in one are verified and linked.

The shuffle is by the leading bits of the variants: a fingerprint goes once to each prefix that any
of its variants has, and the variants with that prefix are made there. This moves about a fiftieth
of the rows and compares the same variants. Fingerprints that meet in a variant are all within the
radius of each other, so a chain through the least of them has the same components as all pairs:
nothing quadratic is made of a large group. A prefix with very many fingerprints is dealt to several
tasks by a hash of the variant.

Texts: A-Z in lower case, words separated by ASCII white space, shingles of `words` words joined
by a space, repeats included; a shorter text is one shingle; null, empty and blank texts have
fingerprint zero, linked like any other. Exact copies share a fingerprint, so they count once. Rows
with equal or null ids keep their place; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WholeRow, map_text, release_memory, stored
from .components import connected_components

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
#: Own fingerprints of a prefix that go to one task; beyond it the prefix is dealt to several.
PREFIX_ROWS = 4096
#: Prefixes dealt to several tasks whose list may be broadcast (16 bytes each); beyond it, a join.
BROADCAST_PREFIXES = 100_000
#: Variants that a task holds at a time.
HELD_VARIANTS = 1 << 20
#: Shingles whose bits are counted at a time.
COUNTED_SHINGLES = 1 << 15

_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """A signed 64-bit integer; bit i of it is set if it is set in over half the shingle hashes."""
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(len(tokens) - words + 1, 1)
    # Where each word starts, and where the last word of its shingle ends.
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], spaces + 1])[:n]
    ends = np.concatenate([spaces, [len(joined)]])[-n:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, COUNTED_SHINGLES):
        until = at + COUNTED_SHINGLES
        bounds = zip(starts[at:until].tolist(), ends[at:until].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in bounds], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(
    rows: DataFrame, text: str = "text", words: int = SHINGLE_WORDS, passed: dict[str, Column] | None = None
) -> DataFrame:
    """The passed columns (doc_id unless given) and `fp`."""

    def factory():
        return lambda texts: [(fingerprint(one, words),) for one in texts]

    return map_text(rows, text, passed, "fp bigint", factory)


def _masks(bits: int, weight: int) -> np.ndarray:
    """All masks of the low `bits` bits with that many set."""
    chosen = itertools.combinations(range(bits), weight)
    return np.array([sum(1 << i for i in one) for one in chosen], np.uint64)


def _forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that has edges, with the least node of its component among these edges."""
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _met(fps: np.ndarray, prefix: int, prefix_bits: int, salt: int, salts: int, radius: int):
    """Pairs (fingerprint, least fingerprint reached) that meet in variants with this prefix."""
    half = radius // 2
    low_bits = 64 - prefix_bits
    fps = np.unique(fps)
    off = np.bitwise_count((fps >> np.uint64(low_bits)) ^ np.uint64(prefix))
    base = (np.uint64(prefix) << np.uint64(low_bits)) | (fps & np.uint64((1 << low_bits) - 1))
    groups = []
    for flips in range(half + 1):
        members = np.flatnonzero(off == flips)
        masks = np.concatenate([_masks(low_bits, w) for w in range(half - flips + 1)])
        groups.append((members, masks))
    made = sum(len(members) * len(masks) for members, masks in groups)
    passes = -(-made // (salts * HELD_VARIANTS)) or 1
    all_a, all_b = [], []
    for turn in range(passes):
        variants, owners = [], []
        for members, masks in groups:
            step = max(1, HELD_VARIANTS // (4 * len(masks)))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                own = (base[part][:, None] ^ masks[None, :]).ravel()
                owner = np.repeat(part, len(masks))
                if salts * passes > 1:
                    mixed = (own * _MIX) >> np.uint64(33)
                    keep = mixed % np.uint64(salts * passes) == np.uint64(salt * passes + turn)
                    own, owner = own[keep], owner[keep]
                variants.append(own)
                owners.append(owner.astype(np.int32))
        own, owner = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(own)
        own, owner = own[order], owner[order]
        same = np.flatnonzero(own[1:] == own[:-1])
        # Along a run of one variant, neighbours are linked: verified, though they must be in reach.
        a, b = owner[same], owner[same + 1]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        all_a.append(a[near])
        all_b.append(b[near])
    return _forest(fps, np.concatenate(all_a), np.concatenate(all_b))


def prefix_bits_for(n: int) -> int:
    """So many that a prefix is the own one of about 1,000 fingerprints; at least 8, for even tasks."""
    return min(28, max(8, (n // 1000).bit_length()))


def ball_links(fps: DataFrame, n: int, radius: int = RADIUS, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of `fps.fp` (distinct, about n) within
    the radius."""
    if radius % 2:
        raise ValueError("the radius must be even: both halves of it are the same ball")
    k = prefix_bits_for(n)
    flips = F.array([F.lit(int(m)) for w in range(radius // 2 + 1) for m in _masks(k, w)])
    own = F.shiftrightunsigned("fp", 64 - k).cast("int")
    dealt = fps.select(
        "fp", F.explode(F.transform(flips, lambda flip: own.bitwiseXOR(flip))).alias("prefix")
    )
    full = fps.groupBy(own.alias("full")).agg(F.count("*").alias("rows")).where(F.col("rows") > prefix_rows)
    full = stored(full, "full_prefixes")
    if listed := full.count():
        salts = full.select("full", F.ceil(F.col("rows") / prefix_rows).cast("int").alias("salts"))
        if listed <= BROADCAST_PREFIXES:
            salts = F.broadcast(salts)
        dealt = dealt.join(salts, F.col("prefix") == F.col("full"), "left")
        dealt = dealt.select("fp", "prefix", F.coalesce("salts", F.lit(1)).alias("salts"))
    else:
        dealt = dealt.withColumn("salts", F.lit(1))
    dealt = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    # A partition of its own for each part of a prefix, also after a join by prefix.
    dealt = dealt.withColumn("part", F.xxhash64("prefix", "salt"))

    def meet(table: pa.Table) -> pa.Table:
        first = {name: table[name][0].as_py() for name in ("prefix", "salt", "salts")}
        a, b = _met(
            table["fp"].to_numpy().view(np.uint64), first["prefix"], k, first["salt"], first["salts"], radius
        )
        release_memory()
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("part").applyInArrow(meet, "a bigint, b bigint")


def near_duplicate_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp and root for each distinct fingerprint of `prints.fp`; root is one fingerprint of its class."""
    distinct = stored(prints.select("fp").distinct(), "fingerprints")
    n = distinct.count()
    roots = connected_components(ball_links(distinct, n, radius))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(rows: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id of those reachable) for every row."""
    prints = stored(fingerprints(rows, text), "prints")
    classes = near_duplicate_classes(prints, radius)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = stored(classes.join(first, "fp"), "classes")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = named.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(by_print, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def hex_fingerprint() -> Column:
    return F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")


def one_of_each_class(rows: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """All columns; of each near-duplicate class the row with the least doc_id stays (null ids come
    last; of rows with the same id, any one)."""
    numbered = fingerprints(rows, text, passed=WholeRow())
    numbered = stored(numbered.withColumn("number", F.monotonically_increasing_id()), "numbered")
    prints = numbered.select("fp", "number", F.col("row")["doc_id"].alias("doc_id"))
    classes = near_duplicate_classes(prints, radius)
    # One row for each fingerprint before it meets its class.
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "number")
    first = prints.groupBy("fp").agg(F.min(order).alias("first"))
    staying = (
        first.join(classes.withColumnRenamed("fp", "of"), F.col("fp") == F.col("of"))
        .groupBy("root")
        .agg(F.min("first").alias("first"))
        .select(F.col("first")["number"].alias("stays"))
    )
    return numbered.join(staying, F.col("number") == F.col("stays"), "left_semi").select("row.*")
