"""Which pushes are read, against buckets counted in fractions."""

import datetime as dt
import random
from fractions import Fraction

from pyspark.sql import functions as F

from factlake.model import REQUEST, Settings
from factlake.operators.admission import TURNED_AWAY, admit, admit_stream, rate_limited
from factlake.sources.pushes import decode_bodies, read_requests, stream_requests
from factlake.streaming.nodes import PROVIDER, ROCKSDB

T = dt.datetime(2026, 1, 1, 10)
LIMITS = Settings(pushes_per_minute=3)


def arrivals(seed, n=400):
    """Bursts, lulls, ties in time, gaps of just a minute, and pushes of nobody."""
    rng, at, out = random.Random(seed), T, []
    for seq in range(n):
        at += dt.timedelta(microseconds=rng.choice([0, 1, 7_000_000, 19_999_999, 20_000_000, 60_000_000, 59_999_999]) // rng.choice([1, 2, 5, 10]))
        out.append((rng.choice(["a", "a", "a", "b", "c", "", None]), seq, at, '{"tree":{}}'))
    return out


def refused(rows, size):
    """By the rule itself: a bucket that fills evenly, in fractions of a token."""
    held, out = {}, set()
    for name, seq, at, _ in sorted((r for r in rows if r[0] and r[2]), key=lambda r: (r[2], r[1])):
        level, last = held.get(name, (Fraction(size), at))
        level = min(Fraction(size), level + Fraction((at - last) // dt.timedelta(microseconds=1) * size, 60_000_000))
        if level < 1:
            out.add((name, seq))
        held[name] = (level - 1 if level >= 1 else level, at)
    return out


def pairs(df):
    return {(r.certname, r.seq) for r in df.collect()}


def test_buckets_by_brute_force(spark):
    for seed in (1, 2):
        rows = arrivals(seed) + [("late", 1000, None, "")]
        expected = refused(rows, 3)
        df = spark.createDataFrame(rows, REQUEST).repartition(5)
        assert pairs(rate_limited(df, LIMITS)) == expected and len(expected) > 30
        kept = admit(df.withColumn("turned_away", F.when(F.col("seq") == 1000, "backpressure")).withColumn("run", F.lit(1)), LIMITS)
        assert kept.count() == len(rows) and "run" in kept.columns
        assert pairs(kept.filter("turned_away = 'rate-limited'")) == expected and pairs(kept.filter("turned_away = 'backpressure'")) == {("late", 1000)}


def test_few_pushes_are_admitted_whole(spark):
    rows = [("n", i, T + dt.timedelta(seconds=25 * i), "") for i in range(50)]
    df = spark.createDataFrame(rows, REQUEST)
    assert pairs(rate_limited(df, LIMITS)) == refused(rows, 3) == set()
    assert rate_limited(df.limit(0), LIMITS).count() == 0 and admit(df.limit(0), LIMITS).count() == 0


def test_a_repeated_push_is_refused_as_one(spark):
    rows = [("n", min(i, 4), T, "") for i in range(6)]
    found = admit(spark.createDataFrame(rows, REQUEST), LIMITS)
    assert sorted((r.seq, r.turned_away) for r in found.collect()) == [(0, None), (1, None), (2, None), (3, "rate-limited"), (4, "rate-limited"), (4, "rate-limited")]


def test_the_first_reason_stands(spark):
    rows = [("", 0, T, "{bad", "rate-limited"), ("n", 1, T, "x" * 50, "rate-limited"), ("n", 2, T, "{bad", "backpressure"), ("n", 3, T, "x" * 50, None), ("n", 4, T, "{bad", None), ("n", 5, T, '{"tree":{"a":1}}', None)]
    found = decode_bodies(spark.createDataFrame(rows, REQUEST + ", turned_away string"), Settings(max_body_bytes=40))
    assert [(r.reason, r.status) for r in found.orderBy("seq").collect()] == [("no-client-cert", 403), ("rate-limited", 429), ("backpressure", 503), ("oversized: snapshot-bytes", 413), ("bad-request", 400), (None, None)]
    assert [r.tree for r in found.orderBy("seq").collect()] == [None] * 5 + ['{"a":1}']


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    spark.conf.set(PROVIDER, ROCKSDB)
    rows = arrivals(3, 200)

    def feed(part):
        spark.createDataFrame(part, REQUEST).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = admit_stream(stream_requests(spark, f"{tmp_path}/in"), LIMITS)
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    for k in range(3):
        feed(rows[70 * k : 70 * k + 70])
    found, batch = spark.read.parquet(f"{tmp_path}/out"), admit(read_requests(spark, f"{tmp_path}/in"), LIMITS)
    shown = lambda df: sorted((r.seq, r.certname or "", r.received_at, r[TURNED_AWAY] or "") for r in df.collect())
    assert shown(found) == shown(batch) and found.count() == len(rows)
    assert pairs(batch.filter("turned_away IS NOT NULL")) == refused(rows, 3) != set()


def test_what_is_admitted_takes_no_body(spark):
    from factlake.queries import QUERIES

    plan = QUERIES["admitted_pushes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "replace(" not in plan  # bodies are neither decoded nor made


def test_events_are_dealt_out_before_they_are_bodies(spark):
    from factlake.queries import QUERIES

    plan = QUERIES["push_reasons"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
