"""Incremental ingest as a stream of micro-batches: insert-ignore by key, then the same batch functions as ever."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tallyloom.sources.ingest import append, ingest, stored_keys


def stream_ingest(rows: DataFrame, facts_path: str, checkpoint: str, natural: bool = True, after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Appends what is new of a stream of parsed rows to the facts at a path; `after` gets each batch's new facts.

    Keys are looked up in the parts that the batch's households fall into. A batch that is run again after a failure finds its rows stored and adds nothing, so each row is added once.
    """

    def batch(df: DataFrame, _: int) -> None:
        stored = stored_keys(df.sparkSession, facts_path, df)
        added, _report = ingest(df, stored, natural)
        append(added, facts_path)
        if after is not None:
            after(added)

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
