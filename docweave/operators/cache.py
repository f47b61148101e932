"""A cache of answers that many runs share, in immutable segments bucketed by key.

``path/layout-3-b<buckets>/data/segment=<name>`` holds one Parquet file per bucket; a small manifest in
``manifests`` makes a segment count. A segment that is lost half-way has no manifest, so it is
never read. Each job reads the segments that were there when it began as one bucketed table: joins
by ``cache_key`` leave it where it is, and only the keys asked for move.

Every commit adds a segment. With more than ``keep_segments`` of them the smallest are merged, bucket by
bucket, into a new one whose manifest names those it replaces: that one file is the swap. Each merge takes
at least as much again as its largest part has, or half of the segments, so an answer is rewritten a
number of times that grows with the logarithm of the cache. Replaced segments are deleted
``RETAIN_SECONDS`` later, when jobs that began before have ended.

Two jobs may add the same key, and two merges may replace the same segments: readers take one answer
per key (of the least segment name), so neither is an error.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schema import DOC_DATA
from ..workspace import drop_folder, list_folder, read_small_file, write_small_file

LAYOUT = "layout-3"
RETAIN_SECONDS = 24 * 3600
ANSWER_DDL = f"cache_key STRING, data {DOC_DATA}"


@dataclass
class Segment:
    name: str
    rows: int
    written: float
    replaces: list[str] = field(default_factory=list)


class AnswerCache:
    """``buckets`` counts for a new cache; one that is there keeps its number."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        buckets: int = 64,
        keep_segments: int = 8,
        retain_seconds: float = RETAIN_SECONDS,
    ) -> None:
        self.spark, self.keep_segments, self.retain_seconds = spark, keep_segments, retain_seconds
        prefix = f"{LAYOUT}-b"
        there = sorted(n for n in list_folder(spark, path) if n.startswith(prefix))
        self.buckets = int(there[0].removeprefix(prefix)) if there else buckets
        self.root = f"{path.rstrip('/')}/{prefix}{self.buckets}"
        self._tables: list[str] = []
        self._read: dict[str, Segment] = {}

    def manifests(self) -> list[Segment]:
        """Those that are there now; each is read once, since none ever changes."""
        folder = f"{self.root}/manifests"
        names = sorted(n for n in list_folder(self.spark, folder) if n.endswith(".json"))
        for name in names:
            if name not in self._read:
                self._read[name] = Segment(**json.loads(read_small_file(self.spark, f"{folder}/{name}")))
        return [self._read[name] for name in names]

    def segments(self) -> list[Segment]:
        """The live ones: those that no other replaces."""
        found = self.manifests()
        replaced = {name for one in found for name in one.replaces}
        return [one for one in found if one.name not in replaced]

    def _folder(self, name: str) -> str:
        return f"{self.root}/data/segment={name}"

    def table(self, segments: list[Segment]) -> DataFrame:
        """``(cache_key, data, segment)`` of these segments, bucketed. Call ``close`` when done."""
        name = f"spark_catalog.default.docweave_cache_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} ({ANSWER_DDL}, segment STRING) USING parquet PARTITIONED BY (segment) "
            f"CLUSTERED BY (cache_key) SORTED BY (cache_key) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.root}/data'"
        )
        self._tables.append(name)
        if segments:
            added = " ".join(f"PARTITION (segment = '{s.name}') LOCATION '{self._folder(s.name)}'" for s in segments)
            self.spark.sql(f"ALTER TABLE {name} ADD {added}")
        return self.spark.table(name)

    def close(self) -> None:
        """Forget the tables' names; their files stay."""
        while self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop()}")

    def lookup(self, requests: DataFrame, segments: list[Segment]) -> DataFrame:
        """``(cache_key, data)`` of the requested keys that these segments hold, one each."""
        asked = requests.select("cache_key")
        return _one_per_key(self.table(segments).join(asked, "cache_key", "left_semi"))

    def commit(self, answers: DataFrame) -> None:
        """Add ``(cache_key, data)`` as a segment; merge if there are too many then."""
        if answers.isEmpty():
            return
        self._write(answers.select("cache_key", "data").repartition(self.buckets, "cache_key"), [])
        if len(self.segments()) > self.keep_segments:
            self.compact(whole=False)

    def _write(self, answers: DataFrame, replaced: list[Segment]) -> None:
        name = uuid.uuid4().hex
        table = f"spark_catalog.default.docweave_segment_{name}"
        counted = Observation()
        (
            answers.observe(counted, F.count("*").alias("n"))
            .write.format("parquet")
            .bucketBy(self.buckets, "cache_key")
            .sortBy("cache_key")
            .option("compression", "zstd")
            .option("path", self._folder(name))
            .saveAsTable(table)
        )
        self.spark.sql(f"DROP TABLE {table}")
        made = Segment(name, counted.get["n"], time.time(), [one.name for one in replaced])
        write_small_file(self.spark, f"{self.root}/manifests/{name}.json", json.dumps(vars(made)))

    def compact(self, whole: bool = True) -> None:
        """Merge all live segments, or the smallest ones, and delete what was replaced long ago."""
        live = sorted(self.segments(), key=lambda one: (one.rows, one.name))
        chosen = live if whole else live[: _merged_at_once([one.rows for one in live], self.keep_segments)]
        if len(chosen) > 1:
            self._write(_one_per_key(self.table(chosen)), chosen)
            self.spark.sql(f"DROP TABLE {self._tables.pop()}")
        self.vacuum()

    def vacuum(self) -> None:
        """Delete segments replaced more than ``retain_seconds`` ago."""
        found = {one.name: one for one in self.manifests()}
        before = time.time() - self.retain_seconds
        for one in found.values():
            for name in one.replaces if one.written <= before else []:
                if name in found:
                    drop_folder(self.spark, self._folder(name))
                    drop_folder(self.spark, f"{self.root}/manifests/{name}.json")


def _merged_at_once(sizes: list[int], keep: int) -> int:
    """How many of the smallest segments (sizes ascending) to merge, so that at most ``keep`` are left."""
    chosen = min(max(2, len(sizes) - keep // 2), len(sizes))
    total = sum(sizes[:chosen])
    while chosen < len(sizes) and sizes[chosen] <= total:
        total += sizes[chosen]
        chosen += 1
    return chosen


def _one_per_key(rows: DataFrame) -> DataFrame:
    """Keys come twice only if two jobs made them at the same time; no exchange, by the buckets."""
    least = F.min_by(F.struct("data"), "segment").alias("kept")
    return rows.groupBy("cache_key").agg(least).select("cache_key", "kept.data")


def compact_cache(spark: SparkSession, path: str, retain_seconds: float = RETAIN_SECONDS) -> None:
    """Merge the answers below ``path`` (a job's ``cache_path``) into one segment. Jobs may run meanwhile."""
    cache = AnswerCache(spark, path, retain_seconds=retain_seconds)
    try:
        cache.compact()
    finally:
        cache.close()
