"""Star-schema tables as pushes, so that the engine can be run and checked on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.sources.shared import dealt, importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: Column) -> Column:
    """``value_hash`` of a JSON string, as an expression."""
    data = F.encode(text, "UTF-8")
    return F.unhex(F.sha2(F.concat(F.lit(b"s"), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")), data), 256))


def text_leaf(path: str, text: Column) -> Column:
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    return F.when(text.isNotNull(), F.struct(F.lit(path).alias("path"), F.lit(path.split(".")[0]).alias("fact_name"), quoted.alias("value"), F.lit("string").alias("value_type"), text_hash(text).alias("value_hash")))


def whole_number_key(text: Column) -> Column:
    """``equality_key`` of a JSON number without sign, fraction or exponent, as an expression."""
    bare = F.regexp_replace(text, "0+$", "")
    return F.when(bare == "", "0").otherwise(F.concat(bare, F.lit("e"), (F.length(text) - F.length(bare)).cast("string")))


def _planned(rows: DataFrame, leaves: list[Column], volatile: Column | None, key: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("map<string, string>")
    return rows.select(
        "certname", "seq", "received_at", "producer_ts", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("status"), "clean",
        F.filter(F.array(*leaves), lambda x: x.isNotNull()).alias("durable"), (none if volatile is None else volatile).alias("volatile"), (none if key is None else key).alias("volatile_key"),
    )


def _dealt(rows: DataFrame, letter: str, number: str) -> DataFrame:
    """With ``certname``, by which the rows are dealt while they are narrow, so that windows over the
    pushes made of them need no exchange of leaves and digests."""
    return dealt(rows.withColumn("certname", F.concat(F.lit(letter), F.col(number))), "certname")


def event_pushes(events: DataFrame) -> DataFrame:
    """A node for each user, dealt by node. Every 17th event's stamp is three days late, every 23rd's ten minutes
    early; error events are dirty passes; the band is missing for other than three types."""
    id = F.col("event_id")
    late, early = F.expr("ts - INTERVAL 3 DAYS"), F.expr("ts + INTERVAL 10 MINUTES")
    rows = _dealt(events, "u", "user_id").select(
        "certname", id.alias("seq"), F.col("ts").alias("received_at"),
        F.when(id % 17 == 5, late).when(id % 23 == 7, early).otherwise(F.col("ts")).alias("producer_ts"),
        (F.col("event_type") != "error").alias("clean"), "event_type", "value", "props",
    )
    band = F.when(F.col("event_type").isin("purchase", "click", "view"), F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "mid").otherwise("high"))
    k = F.get_json_object("props", "$.k")
    return _planned(rows, [text_leaf("event.type", F.col("event_type")), text_leaf("event.band", band)], F.create_map(F.lit("props.k"), k), F.create_map(F.lit("props.k"), whole_number_key(k)))


def order_pushes(orders: DataFrame) -> DataFrame:
    """A node for each customer, dealt by node; orders of one day arrive by key, and only the first is new."""
    rows = _dealt(orders, "c", "o_custkey").select(
        "certname", (F.unix_date(F.to_date("o_orderdate")) * F.lit(86_400_000_000) + F.col("o_orderkey")).alias("seq"), F.col("o_orderdate").alias("received_at"),
        F.col("o_orderdate").alias("producer_ts"), F.lit(True).alias("clean"), "o_orderstatus", "o_orderpriority",
    )
    return _planned(rows, [text_leaf("order.status", F.col("o_orderstatus")), text_leaf("order.priority", F.col("o_orderpriority"))], None)
