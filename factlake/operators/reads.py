"""What holds now, what held at a time, and what changed between two times."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions.times import ntz
from factlake.model import NodeNotFound

FACT = ["path", "fact_name", "value", "valid_from", "valid_to", "is_open"]


def current_facts(history: DataFrame) -> DataFrame:
    return history.filter("is_open")


def facts_at(history: DataFrame, at: dt.datetime) -> DataFrame:
    """Half-open intervals that hold at ``at``; both bounds reach the scan."""
    return history.filter((F.col("valid_from") <= ntz(at)) & (F.col("valid_to") > ntz(at)))


def node_facts(history: DataFrame, certname: str, at: dt.datetime | None = None) -> DataFrame:
    """A node's facts by path, now or at a time; ``is_open`` says whether they hold still."""
    own = history.filter(F.col("certname") == certname)
    return (current_facts(own) if at is None else facts_at(own, at)).select(*FACT).orderBy("path")


def _within(time: str, start: dt.datetime, end: dt.datetime) -> Column:
    return (F.col(time) >= ntz(start)) & (F.col(time) < ntz(end))


def diff(history: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Intervals that opened or closed in [start, end), with a flag for each; none if the times are swapped."""
    opened, closed = _within("valid_from", start, end), ~F.col("is_open") & _within("valid_to", start, end)
    return history.filter(opened | closed).select("certname", *FACT, opened.alias("opened_in_window"), closed.alias("closed_in_window"))


def node_diff(history: DataFrame, certname: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    return diff(history.filter(F.col("certname") == certname), start, end).drop("certname").orderBy("path", "valid_from")


def active(nodes: DataFrame, include_inactive: bool = False) -> DataFrame:
    """By the node's status today, whatever time is asked about."""
    return nodes if include_inactive else nodes.filter("deactivated IS NULL AND expired IS NULL")


def _visible(nodes: DataFrame, certname: str, include_inactive: bool) -> None:
    if not active(nodes.filter(F.col("certname") == certname), include_inactive).limit(1).count():
        raise NodeNotFound(certname)


def state_response(history: DataFrame, nodes: DataFrame, volatile: DataFrame, certname: str, at: dt.datetime | None = None, include_inactive: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(facts, volatile row or None): volatile values exist for now only."""
    _visible(nodes, certname, include_inactive)
    return node_facts(history, certname, at), volatile.filter(F.col("certname") == certname) if at is None else None


def diff_response(history: DataFrame, nodes: DataFrame, certname: str, start: dt.datetime, end: dt.datetime, include_inactive: bool = False) -> DataFrame:
    _visible(nodes, certname, include_inactive)
    return node_diff(history, certname, start, end)


def register_views(history: DataFrame, nodes: DataFrame, volatile: DataFrame) -> None:
    """The same reads for SQL: views, and table functions that Catalyst inlines."""
    spark = history.sparkSession
    history.createOrReplaceTempView("fact_history")
    nodes.createOrReplaceTempView("nodes")
    volatile.createOrReplaceTempView("node_volatile")
    current_facts(history).createOrReplaceTempView("current_facts")
    columns = "certname STRING, path STRING, fact_name STRING, value STRING, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ, is_open BOOLEAN"
    names = "certname, path, fact_name, value, valid_from, valid_to, is_open"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION facts_at(at TIMESTAMP_NTZ) RETURNS TABLE ({columns}) RETURN SELECT {names} FROM fact_history WHERE valid_from <= at AND at < valid_to")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION node_state_at(node STRING, at TIMESTAMP_NTZ) RETURNS TABLE ({columns}) RETURN SELECT {names} FROM fact_history WHERE certname = node AND valid_from <= at AND at < valid_to")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION node_diff(node STRING, t1 TIMESTAMP_NTZ, t2 TIMESTAMP_NTZ) RETURNS TABLE ({columns}, opened_in_window BOOLEAN, closed_in_window BOOLEAN) RETURN "
        f"SELECT {names}, valid_from >= t1 AND valid_from < t2, NOT is_open AND valid_to >= t1 AND valid_to < t2 FROM fact_history "
        "WHERE certname = node AND ((valid_from >= t1 AND valid_from < t2) OR (NOT is_open AND valid_to >= t1 AND valid_to < t2))"
    )


def as_json(rows: DataFrame) -> DataFrame:
    """(body): each row as a JSON object whose facts are JSON themselves, with no literal rewritten."""
    quoted = [F.concat(F.lit(f'"{c}":'), F.col(c) if c == "value" else F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)) for c in rows.columns]
    present = [F.when(F.col(c).isNotNull(), q) for c, q in zip(rows.columns, quoted)]
    return rows.select(F.concat(F.lit("{"), F.concat_ws(",", *present), F.lit("}")).alias("body"))
