"""Which pushes are read at all: each node has a bucket of tokens, a push takes one.

A bucket holds ``pushes_per_minute`` tokens and fills evenly, so after a minute of silence it is
full, whatever came before. Runs of pushes without such a gap are independent of each other, and
one of no more pushes than the bucket holds is admitted whole. Only longer runs are counted push
by push, and of these only keys and times.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factlake.model import Settings

MINUTE = dt.timedelta(minutes=1)
TURNED_AWAY = "turned_away"


class Bucket:
    """A node's tokens in whole numbers: one is ``period`` microseconds times its share of them."""

    def __init__(self, size: int, period: dt.timedelta, level: int | None = None, at: int | None = None) -> None:
        self.size, self.period = size, period // dt.timedelta(microseconds=1)
        self.level, self.at = size * self.period if level is None else level, at

    def takes(self, at: int) -> bool:
        """Whether a push at ``at`` (microseconds) gets a token. What is refused costs none."""
        if self.at is not None:
            waited = min(max(at - self.at, 0), self.period)
            self.level = min(self.size * self.period, self.level + waited * self.size)
        self.at = at if self.at is None else max(at, self.at)
        if self.level < self.period:
            return False
        self.level -= self.period
        return True


def _refused(size: int, period: dt.timedelta):
    def refuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, bucket = None, None
        for batch in batches:
            names, runs, times = batch["certname"].to_pylist(), batch["run"].to_pylist(), batch["received_at"].cast(pa.int64()).to_pylist()
            keep = []
            for name, number, at in zip(names, runs, times):
                if run != (name, number):
                    run, bucket = (name, number), Bucket(size, period)
                keep.append(not bucket.takes(at))
            yield batch.select(["certname", "seq"]).filter(pa.array(keep, pa.bool_()))

    return refuse


def rate_limited(arrivals: DataFrame, settings: Settings = Settings(), period: dt.timedelta = MINUTE) -> DataFrame:
    """(certname, seq) of the pushes that find their node's bucket empty, by (received_at, seq).

    Pushes without an identity or a time have no bucket. (certname, seq) names a push; where it
    is repeated, all its rows are refused with one.
    """
    size = settings.pushes_per_minute
    order = Window.partitionBy("certname").orderBy("received_at", "seq")
    known = arrivals.select("certname", "seq", "received_at").filter("certname <> '' AND received_at IS NOT NULL")
    starts = F.coalesce(F.col("received_at") >= F.lag("received_at").over(order) + F.lit(period), F.lit(True))
    runs = known.withColumn("starts", starts).withColumn("run", F.sum(F.col("starts").cast("long")).over(order))
    long = runs.withColumn("pushes", F.count("*").over(Window.partitionBy("certname", "run"))).filter(F.col("pushes") > size)
    # by run, so that a busy node's runs are counted side by side
    dealt = long.select("certname", "run", "received_at", "seq").repartition("certname", "run").sortWithinPartitions("certname", "run", "received_at", "seq")
    return dealt.mapInArrow(_refused(size, period), "certname string, seq bigint").distinct()


def admit(raw: DataFrame, settings: Settings = Settings(), period: dt.timedelta = MINUTE) -> DataFrame:
    """``raw`` with ``turned_away``: rate-limited, what stood there before, or null."""
    before = F.col(TURNED_AWAY) if TURNED_AWAY in raw.columns else F.lit(None).cast("string")
    refused = rate_limited(raw, settings, period).withColumn("refused", F.lit(True))
    joined = raw.join(refused, ["certname", "seq"], "left")
    kept = [c for c in raw.columns if c != TURNED_AWAY]
    return joined.select(*kept, F.when(F.col("refused"), "rate-limited").otherwise(before).alias(TURNED_AWAY))


class Admission(StatefulProcessor):
    """A node's bucket as state: two numbers."""

    def __init__(self, size: int, period: dt.timedelta) -> None:
        self.size, self.period = size, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "level long, at long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        batch = pd.concat(list(rows), ignore_index=True).sort_values(["received_at", "seq"])
        held = self.bucket.get() if self.bucket.exists() else (None, None)
        bucket, away = Bucket(self.size, self.period, *held), []
        for at in batch["received_at"]:
            away.append(None if not key[0] or pd.isna(at) or bucket.takes(at.value // 1000) else "rate-limited")
        if bucket.at is not None:
            self.bucket.update((bucket.level, bucket.at))
        yield batch.assign(**{TURNED_AWAY: pd.Series(away, index=batch.index, dtype=object)})


def admit_stream(raw: DataFrame, settings: Settings = Settings(), period: dt.timedelta = MINUTE) -> DataFrame:
    """The same of a stream of (certname, seq, received_at, body), whose nodes' buckets are kept
    from batch to batch. A push that arrives after later ones finds the bucket as these left it.
    Takes the RocksDB state store."""
    fields = [f for f in raw.schema.fields if f.name != TURNED_AWAY]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), f"{TURNED_AWAY} string"])
    keyed = raw.select([f.name for f in fields]).groupBy("certname")
    return keyed.transformWithStateInPandas(Admission(settings.pushes_per_minute, period), schema, "Append", "None")
