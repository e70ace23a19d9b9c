"""The store on disk: batches, conflicts, replays, pruned reads, upgrades."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from factlake.functions.classify import Policy
from factlake.model import HISTORY
from factlake.operators import ingest, intervals, lifecycle, reads
from factlake.plans.compile import run
from factlake.sources import store as stores
from factlake.sources.pushes import plan_pushes
from factlake.sources.store import Conflict, FactStore, holding, spanned, upgrade_chain
from tests.pushes import pushes, t1, t2, t3
from tests.test_ingest import random_rows, shown

MINUTE, POLICY = dt.timedelta(minutes=1), Policy(("vol",))


def size(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet"))


def rows(table, *columns):
    return sorted(map(repr, map(tuple, table.select(*columns).collect())))


@pytest.mark.parametrize("seed", [3])
def test_batches_one_after_the_other_equal_one_rebuild(spark, seed, tmp_path):
    given = pushes(spark, random_rows(seed, nodes=10, each=18))
    planned = plan_pushes(given, POLICY).cache()
    store = FactStore(spark, f"file://{tmp_path}/store", buckets=4)
    for a, b in ((0, 60), (60, 61), (61, 180)):
        store.apply(planned.filter((F.col("seq") >= a) & (F.col("seq") < b)))
    outcomes = ingest.push_outcomes(planned).cache()
    history = intervals.fact_history(ingest.applied(outcomes)).cache()
    found = store.open(POLICY)
    assert store.version() == 3 and shown(found.history) == shown(history)
    assert rows(found.history, "certname", "path", "ended_by", F.hex("value_hash"), "is_open") == rows(history, "certname", "path", "ended_by", F.hex("value_hash"), "is_open")
    assert set(intervals.integrity(found.history).first()) == {0}
    columns = ["certname", "first_seen", "last_seen", "last_producer_ts", "expired", "deactivated"]
    assert rows(found.nodes, *columns) == rows(ingest.node_table(outcomes), *columns)
    assert rows(found.volatile, "certname", F.map_entries("volatile"), "observed_at") == rows(ingest.volatile_table(outcomes), "certname", F.map_entries("volatile"), "observed_at")
    assert rows(store.paths(), "path", "fact_name") == rows(intervals.fact_paths(history), "path", "fact_name")
    applied = ingest.applied(outcomes)
    streaks = {}
    for r in applied.orderBy("producer_ts").collect():
        streaks[r.certname] = 0 if r.clean else streaks.get(r.certname, 0) + 1
    assert {r.certname: r.streak for r in found.nodes.collect()} == streaks
    for at in (t1 + 30 * MINUTE, t1 + 100 * MINUTE):
        assert shown(found.at(at)) == shown(reads.facts_at(history, at))
    assert rows(run(found, "a=1"), "certname") == rows(found.now().filter("path = 'a' AND value = '1'"), "certname")


def test_a_batch_rewrites_the_buckets_of_its_nodes_alone(spark, tmp_path):
    tree = "{" + ",".join(f'"p{i}":{i}' for i in range(200)) + "}"
    store = FactStore(spark, f"file://{tmp_path}/store", buckets=32)
    store.apply(plan_pushes(pushes(spark, [(f"n{i}", t1, tree, "clean") for i in range(60)])))
    first = size(tmp_path)
    for day in range(1, 4):  # a long history elsewhere
        store.apply(plan_pushes(pushes(spark, [(f"n{i}", t1 + day * 60 * MINUTE, tree.replace(":", f":{day}"), "clean") for i in range(60)])))
    before = size(tmp_path)
    store.apply(plan_pushes(pushes(spark, [("n7", t1 + 300 * MINUTE, tree, "clean")])))
    assert size(tmp_path) - before < first / 6 and before > 3 * first
    entries = store.log().filter(F.col("number") == 5).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in entries if r.kind in stores.REPLACED} == {"open": 1, "nodes": 1, "volatile": 1}


def test_a_second_writer_is_refused(spark, tmp_path, monkeypatch):
    store, other = (FactStore(spark, f"file://{tmp_path}/store", buckets=2) for _ in range(2))
    store.apply(plan_pushes(pushes(spark, [("n", t1, '{"a":1}', "clean")])))
    read = stores.apply_batch

    def meanwhile(*args):
        monkeypatch.setattr(stores, "apply_batch", read)
        other.apply(plan_pushes(pushes(spark, [("n", t2, '{"a":2}', "clean")])))
        return read(*args)

    monkeypatch.setattr(stores, "apply_batch", meanwhile)
    with pytest.raises(Conflict):
        store.apply(plan_pushes(pushes(spark, [("n", t3, '{"a":3}', "clean")])))
    assert store.version() == 2 and [r.value for r in store.open().now().collect()] == ["2"]
    assert not [f for f in os.listdir(f"{tmp_path}/store/log") if not f.startswith((".0", "0"))]
    store.apply(plan_pushes(pushes(spark, [("n", t3, '{"a":3}', "clean")])))
    assert [r.value for r in store.open().now().collect()] == ["3"] and [r.value for r in store.open(number=1).now().collect()] == ["1"]


def test_a_batch_that_was_committed_changes_nothing(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store", buckets=2)
    batch = plan_pushes(pushes(spark, [("n", t1, '{"a":1}', "clean")]))
    assert store.apply(batch, "b1") is not None and store.apply(batch, "b1") is None and store.version() == 1
    again = store.apply(batch, "b2")  # the same pushes under another name are stale
    assert [r.outcome for r in again.outcomes.collect()] == ["stale"] and store.open().history.count() == 1


def test_the_dictionary_grows_by_what_is_applied(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store", buckets=2)
    store.apply(plan_pushes(pushes(spark, [("n", t2, '{"a":{"b":1},"vol":2}', "clean"), ("n", t1, '{"late":1}', "clean", t2)]), POLICY))
    assert rows(store.paths(), "path", "fact_name") == ["('a.b', 'a')"]
    store.apply(plan_pushes(pushes(spark, [("n", t3, '{"a":{"b":2},"c":1}', "clean")])))
    assert run(store.open(), "no.such=1").count() == 0
    assert rows(store.paths(), "path") == ["('a.b',)", "('c',)"]
    assert store.log().filter("kind = 'paths'").count() == 2
    store.apply(plan_pushes(pushes(spark, [("n", t3 + MINUTE, '{"a":{"b":2},"c":1}', "clean")])))
    assert store.log().filter("kind = 'paths'").count() == 2


def test_the_past_is_read_from_few_files(spark, tmp_path):
    """As many files for a time whether the history goes on for two weeks or for three weeks after it."""
    day = dt.timedelta(days=1)
    store, asked = FactStore(spark, f"file://{tmp_path}/store", buckets=2), t1 + 3 * day
    opened = {}
    for k in range(7):
        store.apply(plan_pushes(pushes(spark, [(f"n{i}", t1 + 4 * k * day, '{"a":%d}' % k, "clean") for i in range(3)])))
        opened[k] = len(store.files("closed", store.version(), holding(asked))), len(store.files("closed", store.version()))
    assert opened[4][0] == opened[6][0] and opened[6][1] > 1.3 * opened[4][1]
    found = store.open()
    assert shown(found.at(asked)) == shown(reads.facts_at(found.history, asked)) and found.at(asked).count() == 3


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_spans_hold_their_intervals_in_any_zone(spark, zone):
    import random

    rng = random.Random(3)
    made = []
    for i in range(400):
        start = dt.datetime(2026, 3, 7) + dt.timedelta(seconds=rng.randrange(4 * 86400))
        made.append((i, start, start + dt.timedelta(microseconds=rng.choice([1, 10**6, 59 * 10**6, 60 * 10**6, rng.randrange(1, 10**13)]))))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        table = spanned(spark.createDataFrame(made, "i int, valid_from timestamp_ntz, valid_to timestamp_ntz")).cache()
        for k in range(12):
            at = dt.datetime(2026, 3, 7, 1) + dt.timedelta(minutes=rng.randrange(5 * 1440), seconds=rng.randrange(60))
            inside = {i for i, a, b in made if a <= at < b}
            assert inside <= {r.i for r in table.filter(holding(at)).collect()}
            assert {r.i for r in reads.facts_at(table, at).collect()} == inside
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert table.groupBy("level", "slot").count().count() < 400


def test_nodes_are_sealed_reset_and_expired_in_place(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store", buckets=4)
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "certname string")
    store.apply(plan_pushes(pushes(spark, [(n, t1, '{"a":1}', "clean") for n in "xyz"])))
    store.deactivate(names("x", "nobody"), t2)
    store.deactivate(names("x"), t3)
    found = store.open()
    assert {r.certname: r.deactivated for r in found.nodes.collect()} == {"x": t2, "y": None, "z": None}
    assert [(r.valid_to, r.ended_by) for r in found.history.filter("NOT is_open").collect()] == [(t2, "seal")]
    late = store.apply(plan_pushes(pushes(spark, [("x", t3, '{"a":2}', "clean"), ("y", t1 - MINUTE, '{"a":2}', "clean", t1)])))
    assert rows(late.outcomes, "certname", "outcome") == ["('x', 'deactivated')", "('y', 'stale')"]
    store.reset(names("y"))
    # no watermark, but its fact opened at t1; and a first contact it isn't
    after = store.apply(plan_pushes(pushes(spark, [("y", t1, '{"a":2}', "clean"), ("y", t1 + MINUTE, '{"a":2}', "clean", t3)])))
    assert sorted((r.seq, r.outcome) for r in after.outcomes.collect()) == [(0, "stale"), (1, "applied")]
    store.expire(t3 + 60 * MINUTE, 30 * MINUTE)
    assert rows(store.open().nodes.filter("expired IS NOT NULL"), "certname") == ["('y',)", "('z',)"]
    store.apply(plan_pushes(pushes(spark, [("y", t3 + MINUTE, '{"a":2}', "clean")])))
    assert rows(store.open().nodes.filter("expired IS NOT NULL"), "certname") == ["('z',)"]
    assert set(intervals.integrity(store.open().history).first()) == {0}


def layout_one(spark, root, history, nodes, volatile):
    """As this engine's first layout had it."""
    history.write.partitionBy("is_open").parquet(f"{root}/v1-x/history")
    nodes.write.parquet(f"{root}/v1-x/nodes")
    volatile.write.parquet(f"{root}/v1-x/volatile")
    spark.createDataFrame([(1, 1, "v1-x")], "layout int, number long, version string").coalesce(1).write.mode("append").parquet(f"{root}/current")


def test_an_old_store_opens_after_an_upgrade(spark, tmp_path):
    planned = plan_pushes(pushes(spark, random_rows(5, nodes=4, each=8)), POLICY).cache()
    outcomes = ingest.push_outcomes(planned.filter("seq < 20")).cache()
    history = intervals.fact_history(ingest.applied(outcomes)).cache()
    root = f"file://{tmp_path}/old"
    layout_one(spark, root, history, ingest.node_table(outcomes), ingest.volatile_table(outcomes))
    store = FactStore(spark, root, buckets=2)
    with pytest.raises(ValueError, match="upgrade"):
        store.version()
    assert store.upgrade() == [2] and store.upgrade() == [] and store.version() == 1
    assert shown(store.open().history) == shown(history)
    store.apply(planned.filter("seq >= 20"))
    whole = ingest.push_outcomes(planned)
    assert shown(store.open().history) == shown(intervals.fact_history(ingest.applied(whole)))


def test_upgrades_go_by_number(spark, tmp_path):
    step = lambda store: None
    assert [n for n, _ in upgrade_chain([(3, step), (2, step)])] == [2, 3]
    with pytest.raises(ValueError, match="twice"):
        upgrade_chain([(2, step), (2, step)])
    with pytest.raises(ValueError, match="no store"):
        FactStore(spark, f"file://{tmp_path}/none").upgrade()


def test_a_whole_save_takes_the_place_of_all(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store", buckets=2)
    with pytest.raises(ValueError, match="no store"):
        store.version()
    store.apply(plan_pushes(pushes(spark, [("n", t1, '{"a":1}', "clean"), ("n", t2, '{"a":2}', "clean")])))
    nodes = spark.createDataFrame([("n",)], "certname string")
    assert store.save(spark.createDataFrame([], HISTORY), nodes, nodes) == 2 == store.version()
    assert store.open().history.count() == 0 and store.open().nodes.count() == 1 and store.open(number=1).history.count() == 2
    os.makedirs(f"{tmp_path}/store/data/unfinished/nodes/bucket=0")
    assert store.version() == 2


def test_a_saved_history_is_computed_once(spark, tmp_path):
    from factlake.model import FOREVER, HISTORY
    from factlake.operators.carry import NODES, VOLATILE

    times = [dt.datetime(2026, 1, 1, h) for h in range(6)]
    rows = [("n", f"p{i}", "p", "1", "number", bytes(32), times[i], times[i + 1] if i < 3 else FOREVER, i >= 3, "change" if i < 3 else None) for i in range(5)]
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    history = spark.createDataFrame(rows, HISTORY).mapInArrow(count, HISTORY)
    store = FactStore(spark, f"file://{tmp_path}/s", buckets=2)
    store.save(history, spark.createDataFrame([("n", None, None, times[4], None, None, None, None, 0)], NODES), spark.createDataFrame([], VOLATILE))
    assert made.value == len(rows) and store.open().history.count() == len(rows) and store.paths().count() == len(rows)
