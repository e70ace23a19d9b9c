import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factlake.functions.classify import Policy
from factlake.functions.state import NodeState
from factlake.model import FOREVER, PLANNED, PUSH, NodeNotFound, Settings
from factlake.operators import ingest, intervals, lifecycle, monitor, reads
from factlake.sources.pushes import decode_bodies, failing_sources, plan_pushes
from tests.pushes import pushes, t1, t2, t3

NOON = dt.datetime(2026, 6, 28, 12)
MINUTE = dt.timedelta(minutes=1)


@pytest.mark.parametrize(
    "change, limits, reason, status",
    [
        ({"producer_ts": None}, {}, "bad-request", 400),
        ({"builtin": {}, "external": {}}, {}, "bad-request", 400),
        ({"builtin": None, "external": None}, {}, "bad-request", 400),
        ({"builtin": {"os": "unknown"}}, {}, "bad-request", 400),
        ({"builtin": {"os": "absent"}}, {}, "bad-request", 400),
        ({"external": {"x": "unknown"}}, {}, "bad-request", 400),
        ({"tree": "{}"}, {}, "bad-request", 400),
        ({"tree": "null"}, {}, "bad-request", 400),
        ({"tree": None}, {}, "bad-request", 400),
        ({"tree": "{bad"}, {}, "bad-request", 400),
        ({"tree": '{"a":{"b":1},"a.b":2}'}, {}, "bad-request: colliding path a.b", 400),
        ({"tree": '{"a":1,"b":2}'}, {"max_leaves": 1}, "oversized: leaf-count", 413),
        ({"tree": '{"verylongkey":1}'}, {"max_path_bytes": 8}, "oversized: path-length", 413),
        ({"tree": '{"k":"abcdefgh"}'}, {"max_value_bytes": 4}, "oversized: value-bytes", 413),
        ({"producer_ts": NOON + 10 * MINUTE}, {}, "skewed", 409),
        ({"producer_ts": NOON + 10 * MINUTE, "tree": '{"k":"abcdefgh"}'}, {"max_value_bytes": 4}, "skewed", 409),
        ({"producer_ts": None, "tree": '{"a":1,"b":2}'}, {"max_leaves": 1}, "bad-request", 400),
        ({"external": {"x": "absent"}}, {}, None, None),
        ({}, {}, None, None),
    ],
)
def test_planning_gives_the_first_reason(spark, change, limits, reason, status):
    row = {"certname": "n", "seq": 1, "received_at": NOON, "producer_ts": NOON, "tree": '{"k":1}', "builtin": {"os": "ok"}, "external": {}} | change
    given = spark.createDataFrame([tuple(row.values())], PUSH)
    found = plan_pushes(given, settings=Settings(**({"max_leaves": 1000, "max_path_bytes": 256, "max_value_bytes": 4096} | limits))).first()
    assert (found.reason, found.status) == (reason, status)
    assert (found.durable is None) == (reason is not None)


def test_clean_and_failing(spark):
    rows = [({"os": "ok"}, {"a": "absent"}), ({"os": "error", "net": "error"}, {"b": "error"}), ({"os": "ok"}, {"a": "bad"})]
    given = spark.createDataFrame([("n", i, NOON, NOON, '{"k":1}', a, b) for i, (a, b) in enumerate(rows)], PUSH)
    assert [r.clean for r in plan_pushes(given).orderBy("seq").collect()] == [True, False, False]
    assert [r.f for r in given.select("seq", failing_sources().alias("f")).orderBy("seq").collect()] == [[], ["b", "net", "os"], []]


def test_bodies(spark):
    body = '{"producer_timestamp":"2026-06-28T11:59:00.123456789Z","tree":{"k":1.00},"discovery":{"builtin":{"os":"ok"}},"more":1} trailing'
    rows = [("a", 1, NOON, body), ("b", 2, NOON, "{bad"), ("c", 3, NOON, "x" * 200), ("", 4, NOON, body), ("e", 5, NOON, '{"tree":{"k":1}}'), ("f", 6, NOON, None), ("g", 7, NOON, '{"producer_timestamp":"nope","tree":{}}')]
    given = spark.createDataFrame(rows, "certname string, seq bigint, received_at timestamp_ntz, body string")
    found = plan_pushes(decode_bodies(given, Settings(max_body_bytes=180))).orderBy("seq").collect()
    assert [r.reason for r in found] == [None, "bad-request", "oversized: snapshot-bytes", "no-client-cert", "bad-request", "bad-request", "bad-request"]
    assert found[0].producer_ts == dt.datetime(2026, 6, 28, 11, 59, 0, 123456) and found[0].durable[0].value == "1.00"


def play(spark, rows, policy=Policy()):
    planned = plan_pushes(pushes(spark, rows), policy)
    outcomes = ingest.push_outcomes(planned).cache()
    applied = ingest.applied(outcomes)
    history = intervals.fact_history(applied)
    stats = {(r.certname, r.producer_ts): (r.opened, r.closed, r.tombstoned, r.unchanged) for r in intervals.apply_stats(applied, history).collect()}
    return outcomes, history.cache(), stats


def test_change_only_intervals(spark):
    _, history, stats = play(spark, [("n", t, '{"os":"%s"}' % os, "clean") for t, os in ((t1, "Debian"), (t2, "Ubuntu"), (t3, "Ubuntu"))])
    assert stats == {("n", t1): (1, 0, 0, 0), ("n", t2): (1, 1, 0, 0), ("n", t3): (0, 0, 0, 1)}
    assert [r.value for r in reads.node_facts(history, "n", t1 + 30 * MINUTE).collect()] == ['"Debian"']
    assert [(r.value, r.opened_in_window, r.closed_in_window) for r in reads.node_diff(history, "n", t1 + MINUTE, t3).collect()] == [('"Debian"', False, True), ('"Ubuntu"', True, False)]
    assert reads.node_diff(history, "n", t3, t1).count() == 0
    assert set(intervals.integrity(history).first()) == {0}


def test_tombstones_need_a_clean_pass_with_durable_leaves(spark):
    policy = Policy(("uptime",))
    _, clean, stats = play(spark, [("n", t1, '{"rpm":"5.1","os":"R"}', "clean"), ("n", t2, '{"os":"R"}', "clean")])
    assert stats["n", t2] == (0, 0, 1, 1) and [r.path for r in reads.current_facts(clean).collect()] == ["os"]
    _, dirty, stats = play(spark, [("n", t1, '{"rpm":"5.1","os":"R"}', "clean"), ("n", t2, '{"os":"R"}', "dirty")])
    assert stats["n", t2] == (0, 0, 0, 1) and reads.current_facts(dirty).count() == 2
    _, only, stats = play(spark, [("n", t1, '{"os":"R","uptime":1}', "clean"), ("n", t2, '{"uptime":2}', "clean")], policy)
    assert stats["n", t2] == (0, 0, 0, 0) and reads.current_facts(only).count() == 1
    _, back, stats = play(spark, [("n", t1, '{"os":"R","rpm":1}', "clean"), ("n", t2, '{"os":"R"}', "clean"), ("n", t3, '{"os":"R","rpm":1}', "clean"), ("n", t3 + MINUTE, '{"os":"R"}', "dirty")])
    assert stats["n", t2][2] == 1 and stats["n", t3 + MINUTE][2] == 0 and reads.current_facts(back).count() == 2


def outcomes_of(spark, rows):
    return [r.outcome for r in play(spark, rows)[0].orderBy("seq").collect()]


def test_guards(spark):
    one = '{"a":1}'
    assert outcomes_of(spark, [("n", t2, one, "clean"), ("n", t1, one, "clean", t2)]) == ["applied", "stale"]
    assert outcomes_of(spark, [("n", t2, one, "clean"), ("n", t2, one, "clean")]) == ["applied", "stale"]
    year = dt.timedelta(days=365)
    assert outcomes_of(spark, [("n", t1 - year, one, "clean", t1), ("n", t1 - MINUTE, one, "clean", t1)]) == ["skewed", "applied"]
    assert outcomes_of(spark, [("n", t1, one, "clean"), ("n", t2 - 50 * MINUTE, one, "clean", t2)]) == ["applied", "applied"]
    assert ingest.node_table(play(spark, [("n", t1 - year, one, "clean", t1)])[0]).count() == 0


def test_nodes_and_volatile(spark):
    rows = [("n", t1, '{"os":"R","uptime":1}', "clean"), ("n", t1, '{"os":"R","uptime":5}', "clean", t2), ("n", t3, '{"os":"R"}', "clean")]
    outcomes, history, _ = play(spark, rows, Policy(("uptime",)))
    node = ingest.node_table(outcomes).first()
    assert (node.first_seen, node.last_seen, node.last_producer_ts, node.expired) == (t1, t3, t3, None)
    assert ingest.volatile_table(outcomes.filter("seq < 2")).first().volatile == {"uptime": "1"}
    assert ingest.volatile_table(outcomes).first().volatile == {}
    nodes = lifecycle.expire_stale(ingest.node_table(outcomes), t3 + dt.timedelta(hours=48), dt.timedelta(hours=24))
    assert nodes.first().expired is not None
    with pytest.raises(NodeNotFound):
        reads.state_response(history, nodes, ingest.volatile_table(outcomes), "n")
    facts, volatile = reads.state_response(history, nodes, ingest.volatile_table(outcomes), "n", include_inactive=True)
    assert facts.count() == 1 and volatile.count() == 1
    assert reads.state_response(history, nodes, ingest.volatile_table(outcomes), "n", at=t2, include_inactive=True)[1] is None


def test_sql_views(spark):
    outcomes, history, _ = play(spark, [("n", t1, '{"os":"A"}', "clean"), ("n", t2, '{"os":"B"}', "clean")])
    reads.register_views(history, ingest.node_table(outcomes), ingest.volatile_table(outcomes))
    assert [r.value for r in spark.sql("SELECT value FROM current_facts").collect()] == ['"B"']
    assert [r.value for r in spark.sql("SELECT value FROM facts_at(TIMESTAMP_NTZ '2026-01-01 10:30:00')").collect()] == ['"A"']
    assert [r.value for r in spark.sql("SELECT value FROM node_state_at('n', TIMESTAMP_NTZ '2026-01-01 11:00:00')").collect()] == ['"B"']
    assert spark.sql("SELECT * FROM node_diff('n', TIMESTAMP_NTZ '2026-01-01 11:00:00', TIMESTAMP_NTZ '2026-01-01 12:00:00')").count() == 2


def test_json_keeps_literals(spark):
    _, history, _ = play(spark, [("n", t1, '{"k":1.00,"s":"a\\"b"}', "clean")])
    found = [r.body for r in reads.as_json(reads.node_facts(history, "n").select("path", "value", "is_open")).collect()]
    assert found == ['{"path":"k","value":1.00,"is_open":true}', '{"path":"s","value":"a\\"b","is_open":true}']


def test_rejects_before_reading_are_no_contact(spark):
    given = pushes(spark, [("n", t1, '{"k":1}', "clean"), ("n", t2, '{"k":1}', "clean"), ("n", t3, '{"k":1}', "clean")])
    limited = given.withColumn("reason", F.when(F.col("seq") == 2, "rate-limited")).withColumn("status", F.when(F.col("seq") == 2, 429))
    outcomes = ingest.push_outcomes(plan_pushes(limited))
    assert [(r.outcome, r.status) for r in outcomes.orderBy("seq").collect()] == [("applied", 200), ("applied", 200), ("rate-limited", 429)]
    assert ingest.node_table(outcomes).first().last_seen == t2


def test_deactivation_seals(spark):
    outcomes, history, _ = play(spark, [("n", t1, '{"os":"A"}', "clean"), ("m", t1, '{"os":"A"}', "clean")])
    nodes = ingest.node_table(outcomes)
    which = spark.createDataFrame([("n",), ("nobody",)], "certname string")
    nodes, sealed = lifecycle.deactivate(nodes, history, which, t1 - MINUTE)
    row = sealed.filter("certname = 'n'").first()
    assert (row.valid_to, row.is_open, row.ended_by) == (t1 + dt.timedelta(microseconds=1), False, "seal")
    again, _ = lifecycle.deactivate(nodes, sealed, which, t3)
    assert {r.certname: r.deactivated for r in again.collect()} == {"n": row.valid_to, "m": None}
    assert sealed.filter("is_open").count() == 1 and set(intervals.integrity(sealed).first()) == {0}
    late = plan_pushes(pushes(spark, [("n", t1, '{"os":"A"}', "clean"), ("n", t2, '{"os":"B"}', "clean"), ("n", t1, '{"os":"B"}', "clean")]))
    cut = ingest.push_outcomes(late, deactivations=spark.createDataFrame([("n", 0)], "certname string, seq bigint"))
    assert [(r.outcome, r.status) for r in cut.orderBy("seq").collect()] == [("applied", 200), ("deactivated", 403), ("deactivated", 403)]


def test_reset_then_older_push_is_stale_not_skewed(spark):
    planned = plan_pushes(pushes(spark, [("n", t1, '{"a":1}', "clean"), ("n", t2, '{"a":2}', "clean"), ("n", t1, '{"a":3}', "clean", t3), ("n", t3, '{"a":4}', "clean")]))
    controls = spark.createDataFrame([("n", 1, "reset", t2)], lifecycle.EVENT).withColumn("seq", F.lit(1).cast("long"))
    log = lifecycle.sequential_changes(planned, controls)
    assert [(r.seq, r.change) for r in log.orderBy("seq", "change").collect()] == [(0, "open"), (1, "close"), (1, "open"), (2, "stale"), (3, "close"), (3, "open")]
    assert set(intervals.integrity(intervals.fold_changes(log.filter("path IS NOT NULL"))).first()) == {0}


def test_monitor(spark):
    rows = [("n", t1 + i * MINUTE, '{"a":%d,"b":1,"c":1,"d":1,"e":1,"f":1}' % i, "clean") for i in range(4)]
    outcomes, history, _ = play(spark, rows)
    assert [tuple(r) for r in monitor.high_churn(history, t1 + 4 * MINUTE, dt.timedelta(hours=1), at_least=3).collect()] == [("a", 4)]
    assert [tuple(r) for r in monitor.path_cardinality(history, at_least=5).collect()] == [("n", 6)]
    kinds = ["dirty", "dirty", "dirty", "dirty", "clean", "dirty"]
    outcomes, *_ = play(spark, [("n", t1 + i * MINUTE, '{"a":1}', k) for i, k in enumerate(kinds)])
    streaks = monitor.dirty_streaks(ingest.applied(outcomes), 3).orderBy("producer_ts").collect()
    assert [(r.streak, r.crossed) for r in streaks] == [(1, False), (2, False), (3, True), (4, False), (0, False), (1, False)]
    assert monitor.dirty_nodes(ingest.applied(outcomes), 3).count() == 0
    assert monitor.dirty_nodes(ingest.applied(outcomes.filter("seq < 4")), 3).count() == 1


def random_rows(seed, nodes=12, each=30):
    rng = random.Random(seed)
    rows = []
    for step in range(nodes * each):
        name = f"n{rng.randrange(nodes)}"
        received = t1 + step * MINUTE
        ts = received + rng.choice([0, 0, 0, 0, -1, -2, -30, -200, 2, 4, 9]) * MINUTE
        tree = {p: rng.randrange(2) for p in "abcd" if rng.random() < 0.6} | ({"vol": step} if rng.random() < 0.8 else {})
        rows.append((name, ts, str(tree).replace("'", '"'), rng.choice(["clean", "clean", "dirty"]), received))
    return rows


def model(rows, planned):
    """The state machine, one push after the other."""
    states, outcomes, spans = {}, {}, []
    held = {}
    for p in planned:
        state = states.setdefault(p.certname, NodeState())
        outcome = p.reason or state.outcome(p.producer_ts, p.received_at, Settings().max_skew)
        outcomes[p.seq] = outcome
        if outcome != "applied":
            continue
        for change, leaf in state.apply(p.producer_ts, [x.asDict() for x in p.durable], p.clean):
            key = p.certname, leaf["path"]
            if change == "open":
                held[key] = leaf["value"], p.producer_ts
            else:
                spans.append((*key, *held.pop(key), p.producer_ts))
    return outcomes, sorted([*spans, *((*k, *v, FOREVER) for k, v in held.items())])


def shown(history):
    return sorted((r.certname, r.path, r.value, r.valid_from, r.valid_to) for r in history.collect())


@pytest.mark.parametrize("seed", range(6))
def test_windows_and_stream_agree_with_the_model(spark, seed, tmp_path):
    rows = random_rows(seed)
    planned = plan_pushes(pushes(spark, rows), Policy(("vol",))).cache()
    expected, spans = model(rows, sorted(planned.collect(), key=lambda r: r.seq))
    outcomes = ingest.push_outcomes(planned)
    assert {r.seq: r.outcome for r in outcomes.collect()} == expected
    history = intervals.fact_history(ingest.applied(outcomes))
    assert shown(history) == spans
    assert set(intervals.integrity(history).first()) == {0}
    if seed < 2:
        from factlake.streaming.apply import stream_changes, write_changes

        for part in range(3):  # three batches, in arrival order
            planned.filter((F.col("seq") >= part * 120) & (F.col("seq") < (part + 1) * 120)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            write_changes(stream_changes(spark.readStream.schema(PLANNED).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        folded = intervals.fold_changes(spark.read.parquet(f"{tmp_path}/out").filter("path IS NOT NULL"))
        assert shown(folded) == spans


@pytest.mark.parametrize("seed", range(3))
def test_deactivations_anywhere_agree_with_the_model(spark, seed):
    """Deactivations before a node's first push, between pushes and again; the state machine decides."""
    rows, rng = random_rows(seed, nodes=20, each=8), random.Random(seed)
    planned = plan_pushes(pushes(spark, rows), Policy(("vol",))).cache()
    orders = sorted({(f"n{rng.randrange(24)}", rng.randrange(len(rows))) for _ in range(30)})
    states, expected = {}, {}
    for p in sorted(planned.collect(), key=lambda r: r.seq):
        state = states.setdefault(p.certname, NodeState())
        expected[p.seq] = outcome = p.reason or state.outcome(p.producer_ts, p.received_at, Settings().max_skew)
        if outcome == "applied":
            state.apply(p.producer_ts, [x.asDict() for x in p.durable], p.clean)
        for name, seq in orders:
            if seq == p.seq and states.get(name, NodeState()).known:
                states[name].deactivate(p.received_at)
    found = ingest.push_outcomes(planned, deactivations=spark.createDataFrame(orders, "certname string, seq bigint"))
    assert {r.seq: r.outcome for r in found.collect()} == expected
    assert 0 < sum(x == "deactivated" for x in expected.values()) < len(rows) / 2


def test_seal_of_a_node_without_open_facts(spark):
    outcomes, history, _ = play(spark, [("n", t1, '{"os":"A"}', "clean")])
    nodes, _ = lifecycle.deactivate(ingest.node_table(outcomes), history.limit(0), spark.createDataFrame([("n",)], "certname string"), t2)
    assert nodes.first().deactivated == t2 + dt.timedelta(microseconds=1)
    state = NodeState(known=True)
    assert state.deactivate(t2) == (t2 + dt.timedelta(microseconds=1), [])


def test_empty_inputs(spark):
    planned = plan_pushes(spark.createDataFrame([], PUSH))
    outcomes = ingest.push_outcomes(planned)
    history = intervals.fact_history(ingest.applied(outcomes))
    assert history.count() == 0 and ingest.node_table(outcomes).count() == 0 and set(intervals.integrity(history).first()) == {0}


def test_history_takes_one_exchange(spark):
    planned = plan_pushes(pushes(spark, [("n", t1, '{"os":"A"}', "clean")]))
    plan = intervals.fact_history(ingest.applied(ingest.push_outcomes(planned)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1




def bodies(spark, texts):
    rows = [(f"n{i}", i, NOON, t) for i, t in enumerate(texts)]
    return decode_bodies(spark.createDataFrame(rows, "certname string, seq bigint, received_at timestamp_ntz, body string")).orderBy("seq").collect()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_stamps_are_rfc_3339_and_utc_in_any_session(spark, zone):
    stamps = {
        "2026-01-01T10:00:00Z": t1, "2026-01-01T10:00:00.9999999Z": t1 + dt.timedelta(microseconds=999999), "2026-01-01T12:30:00+02:30": t1, "2026-03-29T02:30:00Z": dt.datetime(2026, 3, 29, 2, 30),
        "2026": None, "2026-01-01": None, "2026-01-01 10:00:00": None, "2026-01-01T10:00:00": None, "2026-01-01t10:00:00z": None, "2026-01-01T10:00:00,5Z": None, "2026-01-01T24:00:00Z": None,
        "2026-02-29T10:00:00Z": None, "2026-01-01T10:00:60Z": None, "2026-01-01T10:00:00+24:00": None, "2026-01-01T1:00:00Z": None, "0001-01-01T00:00:00+01:00": None, "now": None, "": None,
    }
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = bodies(spark, [f'{{"producer_timestamp":"{s}","tree":{{"k":1}}}}' for s in stamps])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r.producer_ts for r in found] == list(stamps.values())
    assert [r.status for r in found] == [None if at else 400 for at in stamps.values()]


def test_no_body_stops_a_job(spark):
    deep = lambda n: '{"tree":{"a":' + "[" * n + "]" * n + "}}"
    texts = [deep(1500), deep(9000), deep(60_000), "[" * 100_000, '{"tree":{"a":1e99999999999999999999}}', '{"a":' * 20_000, '{"discovery":{"builtin":{"\\ud800":"ok"}}}', '{"discovery":[]}', '{"discovery":{"builtin":[]}}', '{"producer_timestamp":5}', "", None, "\x00", '{"tree":']
    found = bodies(spark, texts)
    assert [r.status for r in found] == [None, None, 400, 400, None, 400, None, 400, 400, 400, 400, 400, 400, 400]
    assert found[4].tree == '{"a":1e99999999999999999999}' and found[6].builtin == {"�": "ok"}
    planned = plan_pushes(spark.createDataFrame([(r.certname, r.seq, NOON, NOON, r.tree, {"os": "ok"}, None, r.reason, r.status) for r in found], PUSH + ", reason string, status int"))
    assert [r.reason for r in planned.orderBy("seq").collect()[:5]] == [None, None, "bad-request", "bad-request", None]


def test_a_tree_stays_the_text_that_it_is(spark):
    found = bodies(spark, ['{"Tree": {"b" : 1.00, "a":[ ]} , "producer_timestamp":null, "DISCOVERY":{"external":{"x":"ok"}}} tail'])[0]
    assert (found.tree, found.producer_ts, found.builtin, found.external, found.reason) == ('{"b" : 1.00, "a":[ ]}', None, {}, {"x": "ok"}, None)


def test_a_task_holds_as_much_over_any_input(spark):
    """Partitions go by rows, and what crosses the exchange is the table's own columns, not leaves with digests."""
    from factlake.queries import QUERIES
    from factlake.sources.shared import dealt

    rows = spark.range(90).selectExpr("id", "id % 7 AS node")
    assert dealt(rows, "id", each=20).rdd.getNumPartitions() == 5 and dealt(rows.limit(0), "id").rdd.getNumPartitions() == 1
    for name in ("orders_by_nation", "groupby_now", "groupby_at_t", "filter_mixed_now", "groupby_volatile", "deactivate_seal"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, name
        below = plan[plan.rindex("REPARTITION_BY_NUM") :]
        assert "sha2" not in below and "array(" not in below, name


def test_a_seal_takes_the_node_table_from_disk(spark):
    """No task holds the windows of the node table beside those of the history."""
    from factlake.queries import QUERIES

    plan = QUERIES["deactivate_seal"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "nodes-" in plan


def test_a_query_computes_the_history_once_and_takes_the_nodes_from_disk(spark):
    """Two exchanges of events: of the history, and of the node table before it was written."""
    from factlake.queries import QUERIES

    for name in ("groupby_at_t", "groupby_now", "groupby_volatile", "filter_mixed_now", "filter_at_t"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") == 1 and "nodes-" in plan, name


def test_a_filter_is_computed_once_for_its_order(spark):
    """The sample of an order by ranges is taken from an exchange, not from the whole job."""
    from factlake.queries import QUERIES

    for name in ("filter_mixed_now", "filter_now"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        above = plan[plan.index("rangepartitioning") : plan.index("Join")]
        assert "REBALANCE_PARTITIONS_BY_COL" in above, name


@pytest.mark.parametrize("seed", range(3))
def test_the_latest_table_is_the_node_table_with_the_volatile_one(spark, seed):
    planned = plan_pushes(pushes(spark, random_rows(seed)), Policy(("vol",)))
    outcomes = ingest.push_outcomes(planned, deactivations=spark.createDataFrame([("n1", 200), ("n2", 100)], "certname string, seq bigint")).cache()
    shown = lambda df: sorted(map(repr, df.withColumns({c: F.map_entries(c) for c in ("volatile", "volatile_key")}).collect()))
    latest = ingest.latest_table(outcomes)
    expected = ingest.node_table(outcomes).join(ingest.volatile_table(outcomes), "certname").select(latest.columns)
    assert shown(latest) == shown(expected) and latest.count() > 0


def test_intervals_take_no_grouping(spark):
    planned = plan_pushes(pushes(spark, [("n", t1, '{"os":"A"}', "clean")]))
    plan = intervals.fact_history(ingest.applied(ingest.push_outcomes(planned)))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [") <= 4
