"""Ingest as a stream: keyed state by node, a log of changes out."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from factlake.model import CHANGES, Settings
from factlake.functions.state import NodeState
from factlake.operators.lifecycle import step

STATE = "node binary"


def stream_changes(planned: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The log of changes (schema ``CHANGES``) of a stream of planned pushes, each node's in
    arrival order within and across batches.

    State is one node's open facts, watermark and seal; its watermark is its own and strict, so
    Spark's, which is one for all keys and has a delay, isn't used. Rejected pushes leave a row
    with their reason and no path. With a column ``kind``, reset and deactivate events (``at``
    in received_at) can run in the same stream.
    """
    kind = F.col("kind") if "kind" in planned.columns else F.lit("push")
    rows = planned.select("certname", "seq", kind.alias("kind"), F.col("received_at").alias("at"), "producer_ts", "reason", "clean", "durable")
    names = [c.split()[0] for c in CHANGES.split(", ")]

    def run(key, frames: Iterator, held) -> Iterator:
        import pandas as pd

        state = pickle.loads(held.get[0]) if held.exists else NodeState()
        batch = pd.concat(list(frames), ignore_index=True).sort_values(["seq", "kind"])
        out = [x for row in batch.itertuples(index=False) for x in step(state, row, settings)]
        held.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy("certname").applyInPandasWithState(run, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def write_changes(changes: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the log as Parquet, exactly once: the sink's own log names each batch's files."""
    writer = changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
