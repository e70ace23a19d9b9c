"""A batch of pushes on top of what earlier ones left: the closed form of ingest with carried state.

A node's open facts enter the batch as pushes of their own at the times they opened, so that the
windows of a whole rebuild give what the batch changes. Guards that need the past (the watermark,
the seal, and after a reset the latest start and end) are one time for each node.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.model import CHANGES, HISTORY, Settings
from factlake.operators import ingest, intervals, lifecycle
from factlake.sources.shared import fresh_path

#: ``open_from`` and ``closed_to`` are the latest start of an open fact and the latest end of a closed
#: one: what guards a node without a watermark. ``streak`` counts its dirty passes in a row.
NODES = "certname string, first_seen timestamp_ntz, last_seen timestamp_ntz, last_producer_ts timestamp_ntz, deactivated timestamp_ntz, expired timestamp_ntz, open_from timestamp_ntz, closed_to timestamp_ntz, streak bigint"
VOLATILE = "certname string, volatile map<string, string>, volatile_key map<string, string>, observed_at timestamp_ntz"

TICK = "INTERVAL '0.000001' SECOND"


@dataclass
class Carried:
    """What a batch needs of the past: nodes, open facts, volatile values."""

    nodes: DataFrame
    open: DataFrame
    volatile: DataFrame


@dataclass
class Applied:
    """What a batch did: its outcomes, the intervals that it closed, and the state after it."""

    outcomes: DataFrame
    closed: DataFrame
    after: Carried


def nothing(spark: SparkSession) -> Carried:
    return Carried(*(spark.createDataFrame([], schema) for schema in (NODES, HISTORY, VOLATILE)))


def floor() -> Column:
    """The time that a node's next push must be past: its watermark, and its open facts' starts; an
    end may be met but not crossed."""
    return F.greatest("last_producer_ts", "open_from", F.col("closed_to") - F.expr(TICK))


def apply_batch(planned: DataFrame, carried: Carried, settings: Settings = Settings(), keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Applied:
    """A batch whose pushes arrived after all that ``carried`` holds.

    ``keep`` may store what several results are made of, the outcomes and the intervals, and give
    back the stored table; else they are computed once for each result.
    """
    known = carried.nodes.select("certname", floor().alias("floor"), F.col("deactivated").isNotNull().alias("shut"))
    outcomes = keep(ingest.push_outcomes(planned, settings, known=known), "outcomes")
    applied = ingest.applied(outcomes)
    leaf = F.struct("path", "fact_name", "value", "value_type", "value_hash")
    held = carried.open.groupBy("certname", F.col("valid_from").alias("producer_ts")).agg(F.collect_list(leaf).alias("durable")).withColumn("clean", F.lit(False))
    spans = keep(intervals.fact_history(applied.select("certname", "producer_ts", "clean", "durable").unionByName(held)), "spans")
    closed, open_ = spans.filter("NOT is_open"), spans.filter("is_open")
    latest = ingest.volatile_table(outcomes)
    volatile = carried.volatile.join(latest.select("certname"), "certname", "left_anti").unionByName(latest)
    return Applied(outcomes, closed, Carried(_nodes(outcomes, carried.nodes, spans), open_, volatile))


def _nodes(outcomes: DataFrame, before: DataFrame, spans: DataFrame) -> DataFrame:
    ok, node = F.col("outcome") == "applied", Window.partitionBy("certname")
    rows = outcomes.select("certname", "seq", "received_at", "producer_ts", "clean", "outcome", F.lit(True).alias("pushed"))
    rows = rows.withColumn("first_seq", F.min(F.when(ok, F.col("seq"))).over(node)).withColumn("last_clean", F.max(F.when(ok & F.col("clean"), F.col("producer_ts"))).over(node))
    read = ~F.col("outcome").isin(*ingest.UNREAD, "deactivated")
    batch = rows.groupBy("certname").agg(
        F.min(F.when(ok, F.col("received_at"))).alias("b_first"), F.max(F.when(read, F.col("received_at"))).alias("b_contact"),
        F.max(F.when(ok | (read & (F.col("seq") > F.col("first_seq"))), F.col("received_at"))).alias("b_after_first"),
        F.max(F.when(ok, F.col("producer_ts"))).alias("b_mark"), F.max("last_clean").alias("b_clean"),
        F.count_if(ok & (F.col("last_clean").isNull() | (F.col("producer_ts") > F.col("last_clean")))).alias("b_dirty"),
    )
    edges = spans.groupBy("certname").agg(F.max(F.when(F.col("is_open"), F.col("valid_from"))).alias("s_open"), F.max(F.when(~F.col("is_open"), F.col("valid_to"))).alias("s_closed"))
    old = F.col("first_seen").isNotNull()
    both = before.join(batch, "certname", "full").join(edges, "certname", "left").filter(old | F.col("b_first").isNotNull())
    return both.select(
        "certname", F.coalesce("first_seen", "b_first").alias("first_seen"), F.greatest("last_seen", F.when(~old, F.col("b_after_first")).when(F.col("deactivated").isNull(), F.col("b_contact"))).alias("last_seen"),
        F.coalesce("b_mark", "last_producer_ts").alias("last_producer_ts"), "deactivated", F.when(F.col("b_mark").isNull(), F.col("expired")).alias("expired"),
        F.col("s_open").alias("open_from"), F.greatest("closed_to", "s_closed").alias("closed_to"),
        (F.when(F.col("b_clean").isNull(), F.coalesce("streak", F.lit(0))).otherwise(0) + F.coalesce("b_dirty", F.lit(0))).cast("long").alias("streak"),
    )


def reset(carried: Carried, which: DataFrame) -> Carried:
    """Nodes named in ``which`` lose their watermark; their history stays."""
    hit = carried.nodes.join(which.select("certname").distinct().withColumn("hit", F.lit(True)), "certname", "left")
    nodes = hit.withColumn("last_producer_ts", F.when(F.col("hit").isNull(), F.col("last_producer_ts"))).select(carried.nodes.columns)
    return replace(carried, nodes=nodes)


def deactivate(carried: Carried, which: DataFrame) -> tuple[Carried, DataFrame]:
    """(state after, intervals that were sealed) with the nodes of ``which`` (certname, at) sealed for good."""
    times = which.groupBy("certname").agg(F.min("at").alias("at"))
    due = carried.nodes.filter("deactivated IS NULL").join(times, "certname").select("certname", "at", "open_from")
    seals = due.select("certname", F.greatest("at", F.coalesce("open_from", "at") + F.expr(TICK)).alias("seal"))
    nodes = carried.nodes.join(seals, "certname", "left").withColumn("deactivated", F.coalesce("deactivated", "seal"))
    nodes = nodes.withColumn("closed_to", F.greatest("closed_to", "seal")).withColumn("open_from", F.when(F.col("seal").isNull(), F.col("open_from"))).select(carried.nodes.columns)
    cut = carried.open.join(seals, "certname").withColumn("valid_to", F.col("seal")).withColumn("is_open", F.lit(False)).withColumn("ended_by", F.lit("seal"))
    return Carried(nodes, carried.open.join(seals, "certname", "left_anti"), carried.volatile), cut.select(carried.open.columns)


def _changes(done: Applied) -> DataFrame:
    """``CHANGES`` of one batch: its opens and ends under the push that made them, and its rejects."""
    names = [c.split()[0] for c in CHANGES.split(", ")]
    by = ingest.applied(done.outcomes).select("certname", "seq", F.col("producer_ts").alias("ts"))
    spans = done.closed.unionByName(done.after.open)
    opens = spans.withColumn("ts", F.col("valid_from")).withColumn("change", F.lit("open")).join(by, ["certname", "ts"])
    ends = done.closed.select("certname", "path", F.col("valid_to").alias("ts"), F.when(F.col("ended_by") == "change", "close").otherwise(F.col("ended_by")).alias("change")).join(by, ["certname", "ts"])
    rejects = done.outcomes.filter("outcome <> 'applied'").select("certname", "seq", F.col("producer_ts").alias("ts"), F.col("outcome").alias("change"))
    out = opens.select(names).unionByName(ends, allowMissingColumns=True).unionByName(rejects, allowMissingColumns=True)
    return out.select(names)


def _stored(part: DataFrame, at: str) -> DataFrame:
    part.write.parquet(at)
    return part.sparkSession.read.schema(part.schema).parquet(at)


def segmented_changes(planned: DataFrame, controls: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The log of changes of pushes with control events (``lifecycle.EVENT``), as
    ``lifecycle.sequential_changes`` gives it, by windows.

    A node's pushes between two controls are a segment. The first segments of all nodes, which is
    all of a node without controls, are one batch; the k-th segments of nodes with that many are
    the k-th batch, on what the control before it left. So the number of batches is that of the
    controls of the node with most, and nothing goes row by row. Each batch is stored, which ends
    its lineage.
    """
    spark = planned.sparkSession
    root = fresh_path(spark, "segments")
    by = Window.partitionBy("certname").orderBy("seq", "kind", "at")
    ordered = _stored(controls.select("certname", "seq", "kind", "at", F.row_number().over(by).alias("k")), f"{root}/controls")
    log = planned.select("*", F.lit("push").alias("kind")).unionByName(ordered.select("certname", "seq", "kind", F.lit(1).alias("one")), allowMissingColumns=True)
    passed = F.sum(F.coalesce("one", F.lit(0))).over(Window.partitionBy("certname").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pushes = log.withColumn("segment", passed).filter("one IS NULL").select(*planned.columns, "segment")
    at = f"{root}/pushes"
    pushes.write.partitionBy("segment").parquet(at)
    pushes = spark.read.schema(pushes.schema).parquet(at)
    last = ordered.agg(F.max("k")).first()[0] or 0
    carried, logs = nothing(spark), []
    for k in range(last + 1):
        batch = pushes.filter(F.col("segment") == k).drop("segment")
        done = apply_batch(batch, carried, settings, lambda df, name: _stored(df, f"{root}/{k}/{name}"))
        logs.append(_changes(done))
        if k == last:
            break
        # only nodes with a further control go on
        due = ordered.filter(F.col("k") == k + 1)
        more = Carried(*(part.join(due.select("certname"), "certname", "left_semi") for part in vars(done.after).values()))
        after, sealed = deactivate(reset(more, due.filter("kind = 'reset'")), due.filter("kind = 'deactivate'"))
        sealed = sealed.join(due.select("certname", "seq"), "certname").select("certname", "seq", F.col("valid_to").alias("ts"), F.lit("seal").alias("change"), "path")
        logs.append(_stored(sealed, f"{root}/{k}/sealed"))
        carried = Carried(*(_stored(part, f"{root}/{k}/on-{name}") for name, part in vars(after).items()))
    names = [c.split()[0] for c in CHANGES.split(", ")]
    whole = logs[0]
    for part in logs[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.select(names)
