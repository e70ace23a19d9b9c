import datetime as dt

import pytest

from factlake.functions.values import Number
from factlake.model import BadQuery, NoHistory, QueryTooLong, UnsupportedQuery
from factlake.plans.dsl import Term, literal, parse, stamp


def test_terms_are_typed():
    q = parse("""rack=12 slot="12" spare=false owner=null site='north hall' tier=gold note= rule=x=y""")
    assert [(t.path, t.value) for t in q.terms] == [("rack", "12"), ("slot", "12"), ("spare", False), ("owner", None), ("site", "north hall"), ("tier", "gold"), ("note", ""), ("rule", "x=y")]
    assert isinstance(q.terms[0].value, Number) and not any(isinstance(t.value, Number) for t in q.terms[1:])
    assert q.at is None and q.group_field is None


def test_group_by_and_time():
    q = parse("kernel.build where tier=gold dc=x group by kernel.build at 2026-01-01T10:30:00+02:00")
    assert q.group_field == "kernel.build" and len(q.terms) == 2 and q.at == dt.datetime(2026, 1, 1, 8, 30)
    assert parse("tier=gold at now").at is None


@pytest.mark.parametrize(
    "text", ["", " \t", "rack", "=gold", "rack where tier=gold", "rack where tier=gold group", "rack where tier=gold group by", "rack where group by rack", "rack where tier=gold group by rack slot", "tier=gold rack where tier=gold group by rack", "site='north", "tier=gold at", "at now", "tier=gold at now rack=1", "tier=gold at noon", "tier=gold at 2025-06-01", "tier=gold at 2025-02-30T00:00:00Z"],
)
def test_bad_queries(text):
    with pytest.raises(BadQuery) as e:
        parse(text)
    assert not isinstance(e.value, UnsupportedQuery) and e.value.status == 400


def test_project_must_be_the_grouped_field():
    with pytest.raises(UnsupportedQuery):
        parse("a where b=1 group by c")


@pytest.mark.parametrize("text", ["1", "-1.5", "+2", ".5", "5.", "1e3", "inf", "-Infinity", "NaN", "0x1p-2", "007"])
def test_numbers(text):
    assert isinstance(literal(text), Number) and literal(text) == text


@pytest.mark.parametrize("text", ["1e999", "0x1", "1_000", "--1", "1e", ".", "e5", "1.2.3", "True", "+nan", "web", "'", "0x1p99999"])
def test_bare_text(text):
    assert literal(text) == text and not isinstance(literal(text), Number)


def test_stamps():
    assert stamp("2026-01-01T10:00:00.1234567Z") == dt.datetime(2026, 1, 1, 10, 0, 0, 123456)
    assert stamp("2026-01-01T23:00:00-05:30") == dt.datetime(2026, 1, 2, 4, 30)


@pytest.fixture(scope="module")
def facts(spark):
    from factlake.functions.classify import Policy
    from factlake.operators import ingest, intervals
    from factlake.plans.compile import Facts
    from factlake.sources.pushes import plan_pushes
    from tests.pushes import pushes, t1, t2

    rows = [
        ("c-gold", t1, '{"tier":"gold","kernel":{"build":"elm"},"uptime":12345.0,"n":1.0}', "clean"),
        ("d-gold", t1, '{"tier":"gold","kernel":{"build":"oak"},"uptime":7,"n":1}', "clean"),
        ("a-iron", t1, '{"tier":"iron","kernel":{"build":"elm"},"n":1}', "clean"),
        ("b-old", t1, '{"tier":"old","kernel":{"build":"elm"},"uptime":null}', "clean"),
        ("b-old", t2, '{"tier":"old","kernel":{"build":"ash"},"uptime":null}', "clean"),
    ]
    policy = Policy(("uptime",))
    outcomes = ingest.push_outcomes(plan_pushes(pushes(spark, rows), policy)).cache()
    nodes = ingest.node_table(outcomes)
    from pyspark.sql import functions as F

    nodes = nodes.withColumn("expired", F.when(F.col("certname") == "a-iron", F.col("last_seen")))
    return Facts(intervals.fact_history(ingest.applied(outcomes)).cache(), nodes, ingest.volatile_table(outcomes).cache(), policy)


def ask(facts, text, **options):
    from factlake.plans.compile import run

    return [tuple(r) for r in run(facts, text, **options).collect()]


def test_filters(facts):
    assert ask(facts, "tier=gold kernel.build=elm") == [("c-gold",)]
    assert ask(facts, "kernel.build=elm") == [("c-gold",)]
    assert ask(facts, "kernel.build=elm", include_inactive=True) == [("a-iron",), ("c-gold",)]
    assert ask(facts, "kernel.build=elm at 2026-01-01T10:30:00Z") == [("b-old",), ("c-gold",)]
    assert ask(facts, "tier=gold tier=iron") == [] and ask(facts, "no.such=1") == [] and ask(facts, "tier=gold tier=gold") == [("c-gold",), ("d-gold",)]
    assert ask(facts, "n=1") == [("d-gold",)] and ask(facts, "n=1.0") == [("c-gold",)] and ask(facts, 'n="1"') == []
    assert ask(facts, "kernel.build=elm at 1999-01-01T00:00:00Z") == []


def test_volatile_terms(facts):
    assert ask(facts, "uptime=12345") == [("c-gold",)] == ask(facts, "uptime=1.2345e4 tier=gold")
    assert ask(facts, "uptime=null") == [("b-old",)] and ask(facts, "uptime='7'") == []
    for text in ("uptime=7 at 2026-01-01T10:30:00Z", "uptime where tier=gold group by uptime at 2099-01-01T00:00:00Z"):
        with pytest.raises(NoHistory):
            ask(facts, text)
    assert ask(facts, "uptime=7 at now") == [("d-gold",)]
    with pytest.raises(BadQuery):
        ask(facts, "uptime=inf")


def test_groups(facts):
    assert ask(facts, "kernel.build where tier=gold group by kernel.build") == [('"elm"', 1), ('"oak"', 1)]
    assert ask(facts, "uptime where tier=gold group by uptime") == [("7", 1), ("12345.0", 1)]
    assert ask(facts, "n where tier=gold group by n", include_inactive=True) == [("1", 1), ("1.0", 1)]
    assert ask(facts, "n where tier=old group by n") == []


def test_a_group_takes_terms_of_all_kinds(facts):
    assert ask(facts, "kernel.build where n=1.0 tier=gold uptime=12345 group by kernel.build") == [('"elm"', 1)]
    assert ask(facts, "kernel.build where uptime=7 group by kernel.build") == [('"oak"', 1)]
    assert ask(facts, "kernel.build where kernel.build=elm group by kernel.build at 2026-01-01T10:30:00Z") == [('"elm"', 2)]
    assert ask(facts, "tier where tier=gold tier=iron group by tier", include_inactive=True) == []


def test_query_limits(facts):
    for text, error in ((None, BadQuery), ("", BadQuery), ("a=" + "x" * 9000, QueryTooLong)):
        with pytest.raises(error):
            ask(facts, text)


def test_a_term_reaches_the_scan(spark, facts, tmp_path):
    from factlake.plans.compile import plan
    from factlake.sources.store import FactStore

    store = FactStore(spark, f"file://{tmp_path}")
    store.save(facts.history, facts.nodes, facts.volatile)
    stored = store.open(facts.policy)
    assert [tuple(r) for r in plan(stored, parse("tier=gold kernel.build=elm")).collect()] == [("c-gold",)]
    text = plan(stored, parse("kernel.build=elm"))._jdf.queryExecution().toString()
    assert "EqualTo(path,kernel.build)" in text and "/closed/" not in text


