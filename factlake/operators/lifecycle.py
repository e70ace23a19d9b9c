"""Expiry, deactivation and watermark resets. The clock is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions.state import NodeState
from factlake.functions.times import ntz
from factlake.model import CHANGES, Settings


def expire_stale(nodes: DataFrame, as_of: dt.datetime, after: dt.timedelta = Settings().expire_after) -> DataFrame:
    """Marks nodes that were last seen before ``as_of - after``; closes nothing."""
    due = (F.col("last_seen") < ntz(as_of - after)) & F.col("expired").isNull() & F.col("deactivated").isNull()
    return nodes.withColumn("expired", F.when(due, ntz(as_of)).otherwise(F.col("expired")))


def deactivate(nodes: DataFrame, history: DataFrame, which: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(nodes, history) with the nodes named in ``which`` sealed for good.

    The seal is ``as_of``, or a microsecond past the latest open start if that is later; for a
    node without open facts it is a microsecond past ``as_of``. Nodes
    that are deactivated already keep their seal; names without a node change nothing.
    """
    due = nodes.filter("deactivated IS NULL").join(which.select("certname").distinct(), "certname", "left_semi").select("certname")
    latest = history.filter("is_open").join(due, "certname", "left_semi").groupBy("certname").agg(F.max("valid_from").alias("latest"))
    now = ntz(as_of)
    seal = F.greatest(now, F.coalesce("latest", now) + F.expr("INTERVAL '0.000001' SECOND"))
    seals = due.join(latest, "certname", "left").select("certname", seal.alias("seal"))
    sealed = nodes.join(seals, "certname", "left").withColumn("deactivated", F.coalesce("deactivated", "seal")).drop("seal")
    closes = F.col("is_open") & F.col("seal").isNotNull()
    cut = history.join(seals, "certname", "left").withColumn("closes", closes)
    cut = cut.withColumn("valid_to", F.when(F.col("closes"), F.col("seal")).otherwise(F.col("valid_to"))).withColumn("ended_by", F.when(F.col("closes"), "seal").otherwise(F.col("ended_by")))
    return sealed.select(nodes.columns), cut.withColumn("is_open", F.col("is_open") & ~F.col("closes")).select(history.columns)


EVENT = "certname string, seq bigint, kind string, at timestamp_ntz"


def sequential_changes(planned: DataFrame, controls: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The log of changes (schema ``CHANGES``) of nodes with control events (schema ``EVENT``: reset
    or deactivate), each node in arrival order.

    After a reset a push may come before what is stored, so a guard needs the intervals built so
    far: no closed form. Only nodes that have controls should come here; others go through
    windows. Rejected pushes leave a row with their reason and no path.
    """
    pushes = planned.select("certname", "seq", F.lit("push").alias("kind"), F.col("received_at").alias("at"), "producer_ts", "reason", "clean", "durable")
    events = controls.select("certname", "seq", "kind", "at")
    empty = {"producer_ts": "timestamp_ntz", "reason": "string", "clean": "boolean", "durable": planned.schema["durable"].dataType}
    log = pushes.unionByName(events.select("*", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()]))

    def run(frame):
        import pandas as pd

        state = NodeState()
        out = [x for row in frame.sort_values(["seq", "kind"]).itertuples(index=False) for x in step(state, row, settings)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    return log.groupBy("certname").applyInPandas(run, CHANGES)


def step(state: NodeState, row, settings: Settings) -> list[tuple]:
    """Rows of ``CHANGES`` for one event of a node."""
    name, seq = row.certname, int(row.seq)
    if row.kind == "reset":
        state.reset()
        return []
    if row.kind == "deactivate":
        if not state.known:
            return []
        seal, changes = state.deactivate(row.at)
        return [(name, seq, seal, change, leaf["path"], None, None, None, None) for change, leaf in changes]
    if row.reason is not None:
        return [(name, seq, row.producer_ts, row.reason, None, None, None, None, None)]
    outcome = state.outcome(row.producer_ts, row.at, settings.max_skew)
    if outcome != "applied":
        return [(name, seq, row.producer_ts, outcome, None, None, None, None, None)]
    leaves = [x if isinstance(x, dict) else x.asDict() for x in row.durable]
    changes = state.apply(row.producer_ts, leaves, bool(row.clean))
    return [(name, seq, row.producer_ts, change, leaf["path"], leaf.get("fact_name"), leaf.get("value"), leaf.get("value_type"), leaf.get("value_hash")) for change, leaf in changes]

