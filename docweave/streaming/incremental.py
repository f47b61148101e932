"""The same job over a growing table of source files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import DocumentationConfig
from ..plans.document import Run, document_files
from ..workspace import new_run_folder
from .versions import NEWEST, newest_versions, use_rocksdb


def document_stream(
    files: DataFrame,
    config: DocumentationConfig,
    checkpoint: str,
    on_run: Callable[[Run, int], None],
    version: str | None = None,
    on_refused: Callable[[DataFrame, int], None] | None = None,
    expire_after: float | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Document each batch of a stream ``(path, code)``; ``on_run`` gets the finished run.

    Give the config a ``cache_path``: a batch that is repeated after a failure, or text
    seen in an earlier batch, then causes no generator call.

    With ``version`` (a column) only rows go on that are newer than all of their path before, in
    this batch and in those before it (see ``newest_versions``); ``on_refused`` gets the others, with their
    status. Paths that did not change for ``expire_after`` seconds are forgotten; such a query watches the
    clock and never ends by itself, so it needs a ``trigger`` other than ``availableNow``. Without the
    column every batch stands alone. If a batch has several texts of a path left, the path becomes an error of the run;
    equal copies are one file.
    """

    if expire_after is not None and (trigger is None or "availableNow" in trigger or "once" in trigger):
        raise ValueError("a query whose state expires does not end: give it a processingTime trigger")

    def document_batch(batch: DataFrame, batch_id: int) -> None:
        if version is not None:
            # Written down once: evaluating the batch again would go through the state again.
            folder = f"{new_run_folder(batch.sparkSession)[1]}/batch"
            batch.write.parquet(folder)
            batch = batch.sparkSession.read.schema(batch.schema).parquet(folder)
            if on_refused is not None:
                on_refused(batch.where(batch["status"] != NEWEST).drop("code"), batch_id)
            batch = batch.where(batch["status"] == NEWEST)
        on_run(document_files(batch.select("path", "code"), config), batch_id)

    if version is not None:
        use_rocksdb(files.sparkSession)
        files = newest_versions(files, version, expire_after)
    return (
        files.writeStream.foreachBatch(document_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
