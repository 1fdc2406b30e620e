"""Streaming form of sync, for folders whose files keep growing.

Spark's file stream never looks at a path again once it has seen it, but
session logs are appended to. So the stream's batches are driven by the store's manifest instead: a
ticking source starts a micro-batch, and the batch (``foreachBatch``) lists the tree,
compares it with the manifest - per file: time, length, finished lines and their
checksum - reads what is new or grew, appends the new messages, and enters the files in the manifest last.

That manifest is the state of the stream. It lives in the store, so batch imports, batch syncs
and any number of restarted streams share it, and a stream with a new checkpoint folder reads nothing
twice. A batch that fails before its manifest rows are written is done again: rows are keyed by
uuid and rejected lines by file and line, so the repetition adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from logscope.plans.importer import sync
from logscope.plans.store import MessageStore


def _batch(store: MessageStore, root: str, all_of_it: bool, max_files: int | None):
    def run(tick: DataFrame, epoch_id: int) -> None:
        while True:
            done = sync(store.spark, store, root, max_files=max_files).files
            if not all_of_it or max_files is None or done < max_files:
                return
    return run


def start_sync_stream(spark: SparkSession, store: MessageStore, root: str, checkpoint_location: str,
                      available_now: bool = True, max_files_per_trigger: int | None = None,
                      interval: str = "1 minute") -> StreamingQuery:
    """Start the stream; with ``available_now`` it syncs what is there and stops, otherwise it syncs every ``interval``.

    ``checkpoint_location`` holds the tick counter: one shared folder for each stream. With
    ``max_files_per_trigger`` the files that changed longest ago come first.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    writer = (ticks.writeStream.foreachBatch(_batch(store, root, available_now, max_files_per_trigger))
              .option("checkpointLocation", checkpoint_location))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
