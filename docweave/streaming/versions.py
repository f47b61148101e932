"""The newest version of each path of a stream, across its batches."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

NEWEST, SUPERSEDED, LATE, REPEATED, CONFLICT = "newest", "superseded", "late", "repeated", "conflict"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestVersion(StatefulProcessor):
    """State by path: the greatest version so far and the digest of its text (empty if texts differed).

    Rows are taken one by one, and only texts with the greatest version yet are held, two of them at
    most; so a path with very many versions in one batch is no burden.
    """

    def __init__(self, version_type: str, expire_after: float | None) -> None:
        self.schema = f"version {version_type}, digest STRING"
        self.lifetime = None if expire_after is None else int(expire_after * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", self.schema, self.lifetime)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known = tuple(self.state.get()) if self.state.exists() else None
        best: Any = None
        texts: dict[str, str | None] = {}

        def row(version: Any, status: str, code: str | None = None) -> Row:
            return Row(path=key[0], code=code, version=version, status=status)

        for one in rows:
            version, code = one["version"], one["code"]
            digest = sha256((code or "").encode()).hexdigest()
            if known is not None and _order(version) < _order(known[0]):
                yield row(version, LATE)
            elif known is not None and version == known[0]:
                yield row(version, REPEATED if digest == known[1] else CONFLICT)
            elif texts and _order(version) < _order(best):
                yield row(version, SUPERSEDED)
            elif texts and version == best:
                if digest in texts:
                    yield row(version, REPEATED)
                elif len(texts) < 2:
                    texts[digest] = code
                else:
                    yield row(version, CONFLICT)
            else:
                for _ in texts:
                    yield row(best, SUPERSEDED)
                best, texts = version, {digest: code}
        for code in texts.values():
            yield row(best, NEWEST, code)
        if texts:
            self.state.update((best, next(iter(texts)) if len(texts) == 1 else ""))

    def close(self) -> None:
        """Nothing is held open."""


def _order(version: Any) -> tuple:
    """A missing version is older than any other."""
    return (version is not None, version)


def newest_versions(files: DataFrame, version: str, expire_after: float | None = None) -> DataFrame:
    """``(path, code, version, status)``: each row of a stream ``(path, code, <version>)``, judged once.

    ``newest`` rows have their code: of each batch and path the row with the greatest version, if that
    is greater than in all batches before. Others have none: ``superseded`` by their own batch,
    ``late`` after a greater version, ``repeated`` (version and text known) or in ``conflict`` (another text of
    a known version). Two texts with the same greatest version in one batch are both ``newest``: the job
    reports their path. The state of a path is forgotten ``expire_after`` seconds after its last change (a
    query with that needs a ``processingTime`` trigger: Spark never ends one that watches the clock).
    It lives in RocksDB, so it may exceed the memory; start the query with ``use_rocksdb``.
    """
    kind = files.schema[version].dataType.simpleString()
    judged = files.select("path", "code", F.col(version).alias("version")).groupBy("path")
    return judged.transformWithState(
        NewestVersion(kind, expire_after),
        outputStructType=f"path STRING, code STRING, version {kind}, status STRING",
        outputMode="append",
        timeMode="none" if expire_after is None else "processingTime",
    )


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of the session's next queries is kept in RocksDB."""
    spark.conf.set(STATE_STORE, ROCKSDB)
