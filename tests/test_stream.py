"""The stream with state by path, against the batch results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factlake.functions.classify import Policy
from factlake.model import PLANNED, Settings
from factlake.operators import ingest, intervals, metrics, monitor
from factlake.sources.pushes import plan_pushes
from factlake.sources.store import FactStore
from factlake.streaming.nodes import read_tables, state_entries, store_stream, stream_nodes, write_tables
from tests.pushes import pushes, t1, t2, t3
from tests.test_ingest import random_rows, shown
from tests.test_store import rows

POLICY = Policy(("vol",))


def ended(query):
    assert query.awaitTermination(120), "the stream goes on"


def feed(spark, at, planned):
    """One more file, and all batches that it takes."""
    planned.coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(PLANNED).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    ended(write_tables(stream_nodes(stream), f"file://{at}/out", f"file://{at}/state"))
    return read_tables(spark, f"file://{at}/out")


def test_tables_of_the_stream_equal_those_of_the_batch(spark, tmp_path):
    planned = plan_pushes(pushes(spark, random_rows(8, nodes=6, each=20)), POLICY).cache()
    for k in range(3):  # each a restart from the checkpoint
        history, nodes, volatile, rejects = feed(spark, tmp_path, planned.filter(F.col("seq").between(40 * k, 40 * k + 39)))
    outcomes = ingest.push_outcomes(planned).cache()
    applied = ingest.applied(outcomes)
    assert shown(history) == shown(intervals.fact_history(applied))
    columns = ["certname", "first_seen", "last_seen", "last_producer_ts", "expired", "deactivated"]
    assert rows(nodes, *columns) == rows(ingest.node_table(outcomes), *columns)
    assert rows(volatile, "certname", F.map_entries("volatile"), F.map_entries("volatile_key"), "observed_at") == rows(ingest.volatile_table(outcomes), "certname", F.map_entries("volatile"), F.map_entries("volatile_key"), "observed_at")
    assert rows(nodes, "certname", "streak") == rows(monitor.dirty_streaks(applied).groupBy("certname").agg(F.max_by("streak", "producer_ts").alias("streak")), "certname", "streak")
    assert rows(rejects, "seq", "change") == rows(outcomes.filter("outcome <> 'applied'"), "seq", "outcome")
    # the state is the open facts
    assert state_entries(spark, f"file://{tmp_path}/state").count() == history.filter("is_open").count()


def test_a_changed_leaf_writes_one_entry(spark, tmp_path):
    tree = lambda v: "{" + ",".join(f'"p{i}":{i}' for i in range(2000)) + f',"q":{v}}}'
    feed(spark, tmp_path, plan_pushes(pushes(spark, [("n", t1, tree(1), "clean")])))
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    history, *_ = feed(spark, tmp_path, plan_pushes(pushes(spark, [("n", t2, tree(2), "clean")])))
    assert history.count() == 2002 and state_entries(spark, f"file://{tmp_path}/state", changed_in=1).count() == 1


def test_timers_expire_silent_nodes(spark, tmp_path):
    """By the server's clock: a node of long ago is marked after its batch, one of now isn't, and a push clears the mark."""
    import time

    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    put = lambda *rows_: plan_pushes(pushes(spark, list(rows_))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(("old", t1, '{"a":1}', "clean"), ("new", now, '{"a":1}', "clean"))
    stream = spark.readStream.schema(PLANNED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = write_tables(stream_nodes(stream, Settings(expire_after=dt.timedelta(hours=1)), timers=True), f"file://{tmp_path}/out", f"file://{tmp_path}/state", every="1 second")

    def until(test):
        for _ in range(60):
            time.sleep(1)
            assert query.exception() is None
            if query.lastProgress and query.lastProgress["batchId"] >= 1:
                found = {r.certname: r.expired for r in read_tables(spark, f"file://{tmp_path}/out")[1].collect()}
                if test(found):
                    return found
        raise AssertionError(found)

    try:
        found = until(lambda f: f.get("old") is not None)
        assert found["new"] is None and found["old"] >= now
        put(("old", now, '{"a":2}', "clean"))
        until(lambda f: f["old"] is None)
    finally:
        query.stop()


def test_control_events_come_in_the_stream(spark, tmp_path):
    planned = plan_pushes(pushes(spark, [("n", t1, '{"a":1}', "clean"), ("n", t2, '{"a":2}', "clean"), ("n", t3, '{"a":3}', "clean")]))
    order = spark.createDataFrame([("n", 1, t2 + dt.timedelta(minutes=1))], "certname string, seq bigint, received_at timestamp_ntz").withColumn("kind", F.lit("reset"))
    seal = spark.createDataFrame([("n", 2, t3 + dt.timedelta(minutes=1))], "certname string, seq bigint, received_at timestamp_ntz").withColumn("kind", F.lit("deactivate"))
    log = planned.withColumn("kind", F.lit("push")).unionByName(order, allowMissingColumns=True).unionByName(seal.withColumn("seq", F.lit(3).cast("long")), allowMissingColumns=True)
    log.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(f"{PLANNED}, kind string").parquet(f"{tmp_path}/in")
    ended(write_tables(stream_nodes(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/state"))
    history, nodes, _, _ = read_tables(spark, f"file://{tmp_path}/out")
    assert [r.ended_by for r in history.orderBy("valid_from").collect()] == ["change", "change", "seal"]
    assert nodes.first().deactivated == t3 + dt.timedelta(minutes=1)


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    import shutil

    planned = plan_pushes(pushes(spark, random_rows(4, nodes=4, each=10)), POLICY)
    history, nodes, volatile, rejects = feed(spark, tmp_path, planned)
    before = shown(history), rows(nodes, *nodes.columns), rows(rejects, "seq", "change")
    shutil.rmtree(f"{tmp_path}/state")  # the batch ran, but its end was never noted
    stream = spark.readStream.schema(PLANNED).parquet(f"{tmp_path}/in")
    ended(write_tables(stream_nodes(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/state"))
    history, nodes, volatile, rejects = read_tables(spark, f"file://{tmp_path}/out")
    assert (shown(history), rows(nodes, *nodes.columns), rows(rejects, "seq", "change")) == before


def test_a_stream_into_a_store(spark, tmp_path):
    import shutil

    planned = plan_pushes(pushes(spark, random_rows(6, nodes=4, each=10)), POLICY).cache()
    store = FactStore(spark, f"file://{tmp_path}/store", buckets=2)
    for k in range(2):
        planned.filter(F.col("seq").between(20 * k, 20 * k + 19)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ended(store_stream(spark.readStream.schema(PLANNED).parquet(f"{tmp_path}/in"), store, f"file://{tmp_path}/state"))
    assert shown(store.open(POLICY).history) == shown(intervals.fact_history(ingest.applied(ingest.push_outcomes(planned)))) and store.version() == 2
    shutil.rmtree(f"{tmp_path}/state")
    ended(store_stream(spark.readStream.schema(PLANNED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), store, f"file://{tmp_path}/state"))
    assert store.version() == 2


def test_metrics_of_batch_and_stream(spark, tmp_path):
    from pyspark.sql import Observation

    planned = plan_pushes(pushes(spark, random_rows(9, nodes=4, each=10)), POLICY).cache()
    outcomes = ingest.push_outcomes(planned).cache()
    expected = {(r.metric, r.label): r.value for r in metrics.push_metrics(outcomes).collect()}
    seen = Observation("ingest")
    metrics.observed(outcomes, seen).write.format("noop").mode("overwrite").save()
    assert seen.get["applied"] == expected["pushes_total", "applied"] and seen.get["lag_le_300"] == expected["lag_seconds_bucket", "300"] and seen.get["lag_sum"] == expected["lag_seconds_sum", ""]
    times = metrics.ApplyTimes("ingest")
    spark.streams.addListener(times)
    try:
        outcomes.select("outcome", "received_at", "producer_ts").coalesce(1).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("outcome string, received_at timestamp_ntz, producer_ts timestamp_ntz").parquet(f"{tmp_path}/in")
        metrics.observed(stream, "ingest").writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        import time

        for _ in range(100):
            if times.seen:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(times)
    assert times.seen == dict(seen.get) and times.seconds["apply_le_+Inf"] == 1 and times.seconds["apply_sum"] > 0


@pytest.mark.parametrize("seconds, expected", [([0.5, 1, 1.5, 100], {"1": 2, "5": 3, "60": 3, "300": 4, "+Inf": 4})])
def test_lag_is_counted_up_to_each_bound(spark, seconds, expected):
    rows_ = [("applied", t1 + dt.timedelta(seconds=s), t1) for s in seconds] + [("stale", t2, t1)]
    found = {(r.metric, r.label): r.value for r in metrics.push_metrics(spark.createDataFrame([(f"n{i}", True, *r) for i, r in enumerate(rows_)], "certname string, clean boolean, outcome string, received_at timestamp_ntz, producer_ts timestamp_ntz")).collect()}
    assert all(found["lag_seconds_bucket", k] == v for k, v in expected.items()) and found["lag_seconds_sum", ""] == sum(seconds) and found["rejects_total", "stale"] == 1
