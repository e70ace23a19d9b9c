"""Pushes: read from files or streams, decoded from their JSON bodies, planned into leaves."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions.classify import Policy
from factlake.functions.flatten import flat_column
from factlake.functions.times import utc
from factlake.functions.values import decode, members
from factlake.model import PUSH, REQUEST, Settings

STATUSES = {"builtin": ("ok", "error"), "external": ("ok", "error", "absent")}

BODY = "struct<bad: boolean, producer_ts: timestamp_ntz, tree: string, builtin: map<string, string>, external: map<string, string>>"

_FIELDS = ("producer_timestamp", "tree", "discovery")


def read_pushes(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(PUSH).format(kind).load(path)


def stream_pushes(spark: SparkSession, path: str, kind: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(PUSH).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def read_requests(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Pushes as they came in: identity, order, time and the body as text, one file for each span of arrivals."""
    return spark.read.schema(REQUEST).format(kind).load(path)


def stream_requests(spark: SparkSession, path: str, kind: str = "json", files_per_trigger: int = 1) -> DataFrame:
    """The same as a stream that takes files whole, so many a batch, in the order they were
    written. Which files were taken lies in the query's checkpoint, where a restart goes on."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def _body(text: str | None) -> tuple:
    """(stamp, tree, builtin, external) of a body; ValueError for what isn't one.

    Unknown fields are let through, names are taken in any case, and what follows the first JSON
    value isn't read. The tree stays the text that it is.
    """
    text = text or ""
    places = {name.lower(): place for name, place in members(text).items() if name.lower() in _FIELDS}
    read = lambda name: decode(text[slice(*places[name])]) if name in places else None
    stamp, found = read("producer_timestamp"), read("discovery")
    if stamp is not None:
        if type(stamp) is not str:
            raise ValueError("the stamp isn't text")
        stamp = utc(stamp)
    if found is None:
        found = {}
    maps = [{} if (m := found.get(kind)) is None else m for kind in STATUSES] if type(found) is dict else [None]
    if not all(type(m) is dict and all(type(v) is str for v in m.values()) for m in maps):
        raise ValueError("discovery isn't maps of text")
    return stamp, text[slice(*places["tree"])] if "tree" in places else None, *(list(m.items()) for m in maps)


def _bodies(texts: pa.Array) -> pa.StructArray:
    rows = []
    for text in texts.to_pylist():
        try:
            rows.append((False, *_body(text)))
        except ValueError:
            rows.append((True, None, None, None, None))
    kinds = {"bad": pa.bool_(), "producer_ts": pa.timestamp("us"), "tree": pa.string(), "builtin": pa.map_(pa.string(), pa.string()), "external": pa.map_(pa.string(), pa.string())}
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.StructArray.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds.values())], list(kinds))


def unread(raw: DataFrame) -> tuple[Column, Column]:
    """(reason, status) of what is answered before its body is read: a push without an identity, or one
    that was turned away (``turned_away``, where there is such a column); null for what is read."""
    nobody = F.col("certname").isNull() | (F.col("certname") == "")
    away = F.col("turned_away") if "turned_away" in raw.columns else F.lit(None).cast("string")
    reason = F.when(nobody, "no-client-cert").otherwise(away)
    return reason, F.when(nobody, 403).when(away == "rate-limited", 429).when(away.isNotNull(), 503)


def decode_bodies(raw: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pushes from (certname, seq, received_at, body): the body as JSON text.

    ``reason`` and ``status`` are set for a missing identity, a push that was turned away
    (``turned_away``, where there is such a column: see ``operators.admission``), a body over the
    cap and a body that doesn't decode, in this order. What is turned away isn't read. Stamps are RFC 3339 to the letter, and UTC whatever the
    session's zone. No body can stop the job: what Python can't read is a bad request.
    """
    body = F.arrow_udf(lambda texts: _bodies(texts), BODY)
    large = F.coalesce(F.octet_length("body") > settings.max_body_bytes, F.lit(False))
    away, code = unread(raw)
    read = raw.withColumn("away", away).withColumn("code", code).withColumn("large", large)
    read = read.withColumn("b", body(F.when(~F.col("large") & F.col("away").isNull(), F.col("body"))))
    first = lambda turned, large, bad: F.when(F.col("away").isNotNull(), F.col(turned)).when(F.col("large"), large).when(F.col("b.bad"), bad)
    return read.select(
        "certname", "seq", "received_at", "b.producer_ts", "b.tree", "b.builtin", "b.external",
        first("away", "oversized: snapshot-bytes", "bad-request").alias("reason"), first("code", 413, 400).alias("status"),
    )


def _known(statuses: Column, kind: str) -> Column:
    return F.forall(F.map_values(statuses), lambda s: F.coalesce(s.isin(*STATUSES[kind]), F.lit(False)))


def discovery_valid() -> Column:
    return F.coalesce(_known(F.col("builtin"), "builtin"), F.lit(True)) & F.coalesce(_known(F.col("external"), "external"), F.lit(True))


def discovery_clean() -> Column:
    """Valid and without an error; an absent external source isn't one."""
    none = lambda c: F.coalesce(~F.exists(F.map_values(c), lambda s: s == "error"), F.lit(True))
    return discovery_valid() & none("builtin") & none("external")


def failing_sources() -> Column:
    """Names of the sources that reported an error."""
    bad = lambda c: F.coalesce(F.map_keys(F.map_filter(c, lambda k, v: v == "error")), F.array().cast("array<string>"))
    return F.array_sort(F.concat(bad("builtin"), bad("external")))


def plan_pushes(pushes: DataFrame, policy: Policy = Policy(), settings: Settings = Settings()) -> DataFrame:
    """Pushes with their leaves split into durable and volatile, or the first reason against them.

    Only what a push says of itself is looked at here; guards that need the node's past come in
    ``factlake.operators.ingest``.
    """
    early = {"reason": "string", "status": "int"}
    given = pushes.select("*", *[F.lit(None).cast(t).alias(c) for c, t in early.items() if c not in pushes.columns])
    empty = (F.coalesce(F.size("builtin"), F.lit(0)) <= 0) & (F.coalesce(F.size("external"), F.lit(0)) <= 0)
    flat = given.withColumn("flat", flat_column(F.col("tree"), settings)).withColumn("clean", discovery_clean())
    steps = [
        (F.col("reason").isNotNull(), F.col("reason"), F.col("status")),
        (F.col("producer_ts").isNull() | (F.col("producer_ts") == F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")), F.lit("bad-request"), F.lit(400)),
        (empty | ~discovery_valid(), F.lit("bad-request"), F.lit(400)),
        (F.col("flat.reason").isNotNull(), F.col("flat.reason"), F.col("flat.status")),
        (F.col("producer_ts") > F.col("received_at") + F.lit(settings.max_skew), F.lit("skewed"), F.lit(409)),
        (F.coalesce(F.col("flat.large"), F.lit(False)), F.lit("oversized: value-bytes"), F.lit(413)),
    ]
    reason = status = None
    for test, why, code in steps:
        reason = F.when(test, why) if reason is None else reason.when(test, why)
        status = F.when(test, code) if status is None else status.when(test, code)
    flat = flat.withColumn("why", reason).withColumn("code", status)
    some = F.when(F.col("why").isNull(), F.col("flat.leaves"))
    durable = F.filter(some, lambda x: ~policy.column(x.path))
    volatile = F.filter(some, lambda x: policy.column(x.path))
    leaf = lambda x: F.struct(x.path.alias("path"), x.fact_name.alias("fact_name"), x.value.alias("value"), x.value_type.alias("value_type"), x.value_hash.alias("value_hash"))
    as_map = lambda field: F.map_from_entries(F.transform(volatile, lambda x: F.struct(x.path, x[field])))
    return flat.select(
        "certname", "seq", "received_at", "producer_ts", F.col("why").alias("reason"), F.col("code").cast("int").alias("status"), "clean",
        F.transform(durable, leaf).alias("durable"), as_map("value").alias("volatile"), as_map("equality_key").alias("volatile_key"),
    )
