"""Which pushes are applied, and what each node is after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.model import Settings

#: Turned away before they are read: no sign of life.
UNREAD = ("no-client-cert", "rate-limited", "backpressure")
STATUS = {"applied": 200, "skewed": 409, "stale": 409, "deactivated": 403}


def push_outcomes(planned: DataFrame, settings: Settings = Settings(), deactivations: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """``planned`` with ``outcome`` and ``status``: applied, or the first reason against it.

    A push is applied if its stamp isn't ahead of the server's clock by more than the skew, its
    node isn't deactivated, the stamp is later than all applied before it, and a node's first
    isn't behind by more than the skew. One exchange by node; rejects take no part in windows.
    ``deactivations`` has (certname, seq): what arrives later is rejected, if the node was there
    by then. A deactivation before a node's first applied push changes nothing. ``known`` has
    (certname, floor, shut) of nodes that were there before all these pushes: the time that a push
    must be past, and whether the node is deactivated.
    """
    skew = F.lit(settings.max_skew)
    # both windows in one order, which is sorted for once
    node = Window.partitionBy("certname").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = node.rowsBetween(Window.unboundedPreceding, -1)
    ts, received = F.col("producer_ts"), F.col("received_at")
    own = planned.withColumn("ahead", ts > received + skew).withColumn("behind", ts < received - skew)
    own = own.withColumn("sound", F.col("reason").isNull() & ~F.col("ahead"))
    if deactivations is not None:
        orders = deactivations.groupBy("certname").agg(F.collect_set("seq").alias("orders"))
        own = own.join(orders, "certname", "left")
    # nothing is sealed before a node's first push, so the first doesn't depend on seals
    first, sealed, floor = F.min(F.when(F.col("sound") & ~F.col("behind"), F.col("seq"))).over(node), F.lit(False), F.lit(None).cast("timestamp_ntz")
    if known is not None:
        own = own.join(known.select("certname", "floor", "shut"), "certname", "left")
        first, sealed, floor = F.when(F.col("shut").isNotNull(), F.lit(-(1 << 63))).otherwise(first), F.coalesce("shut", F.lit(False)), F.col("floor")
    own = own.withColumn("first_seq", first)
    if deactivations is not None:
        sealed_seq = F.array_min(F.filter("orders", lambda at: at >= F.col("first_seq")))
        sealed = sealed | F.coalesce(F.col("seq") > sealed_seq, F.lit(False))
    own = own.withColumn("sealed", sealed)
    sound = F.col("sound") & ~F.col("sealed")
    own = own.withColumn("mark", F.greatest(floor, F.max(F.when(sound & (F.col("seq") >= F.col("first_seq")), ts)).over(before)))
    outcome = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("ahead"), "skewed").when(F.col("sealed"), "deactivated")
        .when(F.col("first_seq").isNull() | (F.col("seq") < F.col("first_seq")), "skewed")
        .when(ts <= F.col("mark"), "stale").otherwise("applied")
    )
    code = F.coalesce("status", F.create_map(*[x for k, v in STATUS.items() for x in (F.lit(k), F.lit(v))])[F.col("outcome")])
    return own.withColumn("outcome", outcome).withColumn("status", code.cast("int")).select(*planned.columns, "outcome")


def applied(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("outcome = 'applied'")


def ingest_counts(outcomes: DataFrame) -> DataFrame:
    """Pushes by outcome and status, as a service would export them."""
    return outcomes.groupBy("outcome", "status").agg(F.count("*").alias("pushes"))


def _contacts(outcomes: DataFrame) -> tuple[DataFrame, Column, Column]:
    """(pushes of nodes that exist, which of them are applied, which are contacts)."""
    ok = F.col("outcome") == "applied"
    first = F.min(F.when(ok, F.col("seq"))).over(Window.partitionBy("certname"))
    contact = ok | (~F.col("outcome").isin(*UNREAD, "deactivated") & (F.col("seq") > F.col("first_seq")))
    return outcomes.withColumn("first_seq", first).filter(F.col("first_seq").isNotNull()), ok, contact


def node_table(outcomes: DataFrame) -> DataFrame:
    """(certname, first_seen, last_seen, last_producer_ts, deactivated, expired) by node.

    A node exists from its first applied push. Later rejects are contacts too, but for those
    that are turned away before they are read or come after a deactivation.
    """
    none = F.lit(None).cast("timestamp_ntz")
    nodes, ok, contact = _contacts(outcomes.select("certname", "seq", "received_at", "producer_ts", "outcome"))
    return nodes.groupBy("certname").agg(
        F.min(F.when(ok, F.col("received_at"))).alias("first_seen"), F.max(F.when(contact, F.col("received_at"))).alias("last_seen"),
        F.max(F.when(ok, F.col("producer_ts"))).alias("last_producer_ts"),
    ).withColumn("deactivated", none).withColumn("expired", none)


def volatile_table(outcomes: DataFrame) -> DataFrame:
    """(certname, volatile, volatile_key, observed_at): the last applied push's, whole."""
    last = F.max_by(F.struct("volatile", "volatile_key"), "producer_ts")
    return applied(outcomes).groupBy("certname").agg(last.alias("last"), F.max("producer_ts").alias("observed_at")).select("certname", "last.volatile", "last.volatile_key", "observed_at")


def latest_table(outcomes: DataFrame) -> DataFrame:
    """``node_table`` with the columns of ``volatile_table``: of each node the last applied push,
    with what windows say of all. The pushes are gone through once, and no map is aggregated."""
    none = F.lit(None).cast("timestamp_ntz")
    nodes, ok, contact = _contacts(outcomes)
    over = lambda x: x.over(Window.partitionBy("certname"))
    nodes = nodes.select(
        "certname", over(F.min(F.when(ok, F.col("received_at")))).alias("first_seen"), over(F.max(F.when(contact, F.col("received_at")))).alias("last_seen"),
        over(F.max(F.when(ok, F.col("producer_ts")))).alias("last_producer_ts"), none.alias("deactivated"), none.alias("expired"),
        "volatile", "volatile_key", F.col("producer_ts").alias("observed_at"), ok.alias("ok"),
    )
    # of applied pushes each is later than those before
    return nodes.filter(F.col("ok") & (F.col("observed_at") == F.col("last_producer_ts"))).drop("ok")
