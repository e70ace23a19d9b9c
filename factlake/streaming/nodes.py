"""Ingest as a stream with state by path: each fact of a node is an entry of its own, beside one value for the node.

A batch reads a node's entries once and writes those that changed, so state written follows the
changes and not the node's size. Expiry is a timer of the node.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.utils import AnalysisException

from factlake.functions.state import NodeState
from factlake.model import CHANGES, Settings
from factlake.operators.ingest import UNREAD
from factlake.operators.intervals import fold_changes
from factlake.operators.lifecycle import step
from factlake.sources.store import FactStore

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

NODE = "first_seen timestamp_ntz, last_seen timestamp_ntz, last_producer_ts timestamp_ntz, deactivated timestamp_ntz, expired timestamp_ntz, streak bigint"
#: A change or reject (``node`` false), or what a node is after a batch.
OUT = f"{CHANGES}, node boolean, {NODE}, volatile map<string, string>, volatile_key map<string, string>, observed_at timestamp_ntz"
_OUT = [*(c.split()[0] for c in CHANGES.split(", ")), "node", *(c.split()[0] for c in NODE.split(", ")), "volatile", "volatile_key", "observed_at"]
_ROW = Row(*_OUT)
_EVENTS = ("open", "close", "tombstone", "seal")

_EPOCH, _MICRO = dt.datetime(1970, 1, 1), dt.timedelta(microseconds=1)


def _number(at: dt.datetime | None) -> int | None:
    """State holds times as microseconds, which no zone can move."""
    return None if at is None else (at - _EPOCH) // _MICRO


def _time(number: int | None) -> dt.datetime | None:
    return None if number is None else _EPOCH + number * _MICRO


class NodeProcessor(StatefulProcessor):
    """One node's pushes and control events, in arrival order, on its state.

    Rows come and go as rows: a frame for each of many small groups takes longer than their pushes.
    """

    def __init__(self, settings: Settings = Settings(), timers: bool = False) -> None:
        self.settings, self.timers = settings, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "path string", "value_hash binary, start long")
        self.node = handle.getValueState("node", "known boolean, mark long, deactivated long, closed long, first long, last long, expired long, streak long")

    def _load(self) -> tuple[NodeState, dict]:
        if not self.node.exists():
            return NodeState(), {"first": None, "last": None, "expired": None, "streak": 0}
        known, mark, deactivated, closed, first, last, expired, streak = self.node.get()
        held = {path: (bytes(value[0]), _time(value[1])) for (path,), value in self.open.iterator()}
        return NodeState(known, _time(mark), _time(deactivated), _time(closed), held), {"first": _time(first), "last": _time(last), "expired": _time(expired), "streak": streak}

    def _save(self, state: NodeState, seen: dict, before: dict) -> None:
        for path in before.keys() - state.open.keys():
            self.open.removeKey((path,))
        for path, held in state.open.items():
            if before.get(path) != held:
                self.open.updateValue((path,), (held[0], _number(held[1])))
        self.node.update((state.known, _number(state.watermark), _number(state.deactivated), _number(state.last_closed), _number(seen["first"]), _number(seen["last"]), _number(seen["expired"]), seen["streak"]))

    def _row(self, key, state: NodeState, seen: dict, latest: tuple = (None, None, None)) -> Row:
        return _ROW(key[0], *[None] * 8, True, seen["first"], seen["last"], state.watermark, state.deactivated, seen["expired"], seen["streak"], *latest)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        state, seen = self._load()
        before, latest = dict(state.open), (None, None, None)
        for row in sorted(rows, key=lambda row: (row.seq, row.kind)):
            known, shut = state.known, state.deactivated is not None
            changes = step(state, row, self.settings)
            for change in changes:
                yield _ROW(*change, False, *[None] * 9)
            if row.kind != "push":
                continue
            outcome = changes[0][3] if changes and changes[0][3] not in _EVENTS else "applied"
            if outcome == "applied":
                seen = {"first": seen["first"] or row.at, "last": max(seen["last"] or row.at, row.at), "expired": None, "streak": 0 if row.clean else seen["streak"] + 1}
                latest = row.volatile, row.volatile_key, row.producer_ts
            elif known and not shut and outcome not in UNREAD:
                seen["last"] = max(seen["last"], row.at)
        if state.known:
            self._save(state, seen, before)
            if self.timers:
                self._expire_later(state, seen)
            yield self._row(key, state, seen, latest)

    def _expire_later(self, state: NodeState, seen: dict) -> None:
        for timer in list(self.handle.listTimers()):  # one call at a time goes through
            self.handle.deleteTimer(timer)
        if state.deactivated is None and seen["expired"] is None:
            self.handle.registerTimer(_number(seen["last"] + self.settings.expire_after) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        state, seen = self._load()
        if state.deactivated is None and seen["expired"] is None:
            seen["expired"] = _time(timerValues.getCurrentProcessingTimeInMs() * 1000)
            self._save(state, seen, dict(state.open))
            yield self._row(key, state, seen)

    def close(self) -> None:
        pass


def stream_nodes(planned: DataFrame, settings: Settings = Settings(), timers: bool = False) -> DataFrame:
    """Changes, rejects and nodes (schema ``OUT``) of a stream of planned pushes, each node's in arrival
    order within and across batches; with a column ``kind``, of reset and deactivate events too.

    With ``timers``, a node that is silent for ``expire_after`` of the server's clock past its last
    contact is marked as expired by a timer, in the first batch after that; an applied push clears
    the mark. Such a stream has always a further batch to run, so it needs a trigger that goes on.
    """
    kind = F.col("kind") if "kind" in planned.columns else F.lit("push")
    rows = planned.select("certname", "seq", kind.alias("kind"), F.col("received_at").alias("at"), "producer_ts", "reason", "clean", "durable", "volatile", "volatile_key")
    mode = "ProcessingTime" if timers else "None"
    return rows.groupBy("certname").transformWithState(statefulProcessor=NodeProcessor(settings, timers), outputStructType=OUT, outputMode="Append", timeMode=mode)


def write_tables(nodes: DataFrame, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """The changes and the nodes of each batch go to folders named by its id, so a batch that runs
    again replaces what it wrote. Takes what there is, or goes on with a batch ``every`` so often."""
    spark = nodes.sparkSession

    def write(batch: DataFrame, id: int) -> None:
        batch.write.mode("overwrite").partitionBy("node").parquet(f"{root}/batch={id}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # state by path needs it; the query keeps the setting it began with
    try:
        writer = nodes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def read_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(history, nodes, volatile, rejects) of all batches that were written."""
    written = spark.read.schema(f"{OUT}, batch long").parquet(root)
    changes = written.filter("NOT node AND path IS NOT NULL")
    latest = F.max_by(F.struct(*(c.split()[0] for c in NODE.split(", "))), "batch")
    nodes = written.filter("node").groupBy("certname").agg(latest.alias("now")).select("certname", "now.*")
    held = written.filter("node AND observed_at IS NOT NULL").groupBy("certname").agg(F.max_by(F.struct("volatile", "volatile_key", "observed_at"), "batch").alias("now"))
    return fold_changes(changes), nodes, held.select("certname", "now.*"), written.filter("NOT node AND path IS NULL")


def state_entries(spark: SparkSession, checkpoint: str, changed_in: int | None = None) -> DataFrame:
    """The open facts in a stream's state, or the entries that one batch wrote."""
    found = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open")
    if changed_in is not None:
        found = found.option("readChangeFeed", "true").option("changeStartBatchId", changed_in).option("changeEndBatchId", changed_in)
    try:
        return found.load()
    except AnalysisException as e:
        raise ValueError(f"{checkpoint} holds no state") from e


def store_stream(planned: DataFrame, store: FactStore, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Pushes of a stream straight into a store, a commit for each batch; one that runs again is
    known by its id and changes nothing."""
    return planned.writeStream.foreachBatch(lambda batch, id: store.apply(batch, f"{name}-{id}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
