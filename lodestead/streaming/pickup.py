"""New pages as a stream, every file once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestead.plans.ingest import ingest
from lodestead.plans.workspace import Workspace
from lodestead.sources.pages import stream_pages


def pick_up_pages(
    workspace: Workspace, folder: str, checkpoint: str, max_files: int | None = None, **ingest_options
) -> StreamingQuery:
    """Ingest everything that has arrived since the last call, then stop. A
    batch that is replayed after a failure meets its own files in the ledger
    and writes nothing twice."""

    def store(batch: DataFrame, _: int) -> None:
        ingest(workspace, batch, **ingest_options)

    return (
        stream_pages(workspace.spark, folder, max_files)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
