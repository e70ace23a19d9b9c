"""Queries as DataFrame plans over the fact tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.classify import Policy
from factlake.functions.values import equality_key, value_hash
from factlake.model import BadQuery, NoHistory, QueryTooLong, Settings
from factlake.operators.reads import active, current_facts, facts_at
from factlake.plans.dsl import Query, Term, parse


@dataclass
class Facts:
    """The tables that a query reads, and the policy that says which of them holds a path."""

    history: DataFrame
    nodes: DataFrame
    volatile: DataFrame
    policy: Policy = field(default_factory=Policy)

    def now(self) -> DataFrame:
        return current_facts(self.history)

    def at(self, at: dt.datetime) -> DataFrame:
        return facts_at(self.history, at)


def _check(query: Query, policy: Policy) -> None:
    if query.at is not None and (hit := next(filter(policy.is_volatile, query.paths), None)):
        raise NoHistory(f"{hit} is volatile: it has no history")


def _durable(term: Term) -> Column:
    """The literal is hashed here, once: path and hash are plain constants for the scan."""
    return (F.col("path") == term.path) & (F.col("value_hash") == F.lit(value_hash(term.value)))


def _volatile(term: Term) -> Column:
    try:
        key = equality_key(term.value)
    except ValueError as e:
        raise BadQuery(str(e)) from e
    return F.map_contains_key("volatile_key", F.lit(term.path)) & (F.element_at("volatile_key", F.lit(term.path)) == key)


def _terms(facts: Facts, query: Query) -> tuple[list[Column], DataFrame | None]:
    """(tests of the durable terms, (certname) of the nodes that the volatile ones hold for)."""
    durable = [_durable(t) for t in dict.fromkeys(query.terms) if not facts.policy.is_volatile(t.path)]
    volatile = [_volatile(t) for t in query.terms if facts.policy.is_volatile(t.path)]
    return durable, facts.volatile.filter(reduce(Column.__and__, volatile)).select("certname") if volatile else None


def members(facts: Facts, query: Query) -> DataFrame:
    """(certname) of the nodes that all terms hold for.

    All durable terms take one scan and one grouping by node; volatile ones a filter of the
    latest values. Nothing but the nodes' names meets between the two.
    """
    tests, latest = _terms(facts, query)
    if not tests:
        return latest
    source = facts.now() if query.at is None else facts.at(query.at)
    hits = source.filter(reduce(Column.__or__, tests))
    if len(tests) == 1:
        found = hits.select("certname").distinct()
    else:
        all_ = hits.groupBy("certname").agg(*[F.bool_or(t).alias(f"t{i}") for i, t in enumerate(tests)])
        found = all_.filter(reduce(Column.__and__, [F.col(f"t{i}") for i in range(len(tests))])).select("certname")
    return found if latest is None else found.join(latest, "certname", "left_semi")


def _grouped(facts: Facts, query: Query) -> DataFrame:
    """(certname, value_hash, value) of a durable path, of the nodes that all terms hold for.

    The path and the durable terms take one scan, and one window by node that needs no exchange
    where the history is dealt by node: so a history that isn't stored is computed once.
    """
    tests, latest = _terms(facts, query)
    source, asked, node = facts.now() if query.at is None else facts.at(query.at), F.col("path") == query.group_field, Window.partitionBy("certname")
    rows = source.filter(reduce(Column.__or__, tests, asked))
    rows = rows.select("certname", "path", "value_hash", "value", *[F.bool_or(t).over(node).alias(f"t{i}") for i, t in enumerate(tests)])
    rows = rows.filter(reduce(Column.__and__, [F.col(f"t{i}") for i in range(len(tests))], asked)).select("certname", "value_hash", "value")
    return rows if latest is None else rows.join(latest, "certname", "left_semi")


def plan(facts: Facts, query: Query, include_inactive: bool = False) -> DataFrame:
    """(certname) by name for a filter; (value, count), largest first, for a group."""
    _check(query, facts.policy)
    nodes = active(facts.nodes, include_inactive).select("certname")
    if query.group_field is None:
        # an order is found by a sample, which without an exchange below would compute all of it twice;
        # few partitions, as a task of the exchange opens a file for each
        few = nodes.sparkSession.sparkContext.defaultParallelism
        return nodes.join(members(facts, query), "certname", "left_semi").hint("rebalance", few, "certname").orderBy("certname")
    if facts.policy.is_volatile(query.group_field):
        name = F.lit(query.group_field)
        rows = facts.volatile.filter(F.map_contains_key("volatile_key", name)).join(nodes, "certname", "left_semi").join(members(facts, query), "certname", "left_semi")
        groups = rows.groupBy(F.element_at("volatile_key", name).alias("key")).agg(F.min(F.element_at("volatile", name)).alias("value"), F.count("*").alias("count"))
    else:
        groups = _grouped(facts, query).join(nodes, "certname", "left_semi").groupBy("value_hash", "value").agg(F.count("*").alias("count"))
    first = F.substring("value", 1, 1)
    rank = F.when(first == "n", 0).when(first == '"', 1).when(first.isin("t", "f"), 3).when(first == "[", 4).when(first == "{", 5).otherwise(2)
    number = F.when(rank == 2, F.expr("try_cast(value AS DOUBLE)"))
    return groups.orderBy(F.desc("count"), rank, number, "value").select("value", "count")


def run(facts: Facts, text: str | None, include_inactive: bool = False, settings: Settings = Settings()) -> DataFrame:
    """Parses and plans; errors are ``FactError`` with the status that HTTP would have."""
    if not text:
        raise BadQuery("missing query")
    if len(text.encode()) > settings.max_query_bytes:
        raise QueryTooLong(f"a query has {settings.max_query_bytes} bytes at most")
    return plan(facts, parse(text), include_inactive)
