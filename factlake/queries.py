"""Registered queries of the fact engine over the driver's tables, each with its SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions.classify import Policy
from factlake.model import PLANNED, NodeNotFound, Settings
from factlake.operators import admission, carry, ingest, intervals, lifecycle, metrics, monitor, reads
from factlake.plans.compile import Facts, run
from factlake.plans.dsl import parse
from factlake.sources.adapters import event_pushes, order_pushes, table
from factlake.sources.pushes import decode_bodies, plan_pushes, unread
from factlake.sources.pushes import failing_sources as found_failing
from factlake.sources.shared import dealt, fresh_path, kept
from factlake.sources.store import FactStore
from factlake.streaming.apply import stream_changes, write_changes
from factlake.streaming.nodes import read_tables, stream_nodes, write_tables

AT = dt.datetime(2024, 1, 15, 12)
START, END = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12)
AS_OF = dt.datetime(2024, 1, 31)
SILENT = dt.timedelta(hours=36)
NODE = "u7"
POLICY = Policy(("props.*",))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.push_outcomes(event_pushes(table(spark, sf_dir, "events")))


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.applied(_outcomes(spark, sf_dir))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.fact_history(_applied(spark, sf_dir))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.expire_stale(ingest.node_table(_outcomes(spark, sf_dir)), AS_OF, SILENT)


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    return Facts(_history(spark, sf_dir), _nodes(spark, sf_dir), ingest.volatile_table(_outcomes(spark, sf_dir)), POLICY)


def _answer(spark: SparkSession, sf_dir: str, text: str, include_inactive: bool = False) -> DataFrame:
    """Of a query over these facts. What is latest of each node, a row, is written and read, so that
    no task holds its windows beside those of the history."""
    latest = ingest.latest_table if any(map(POLICY.is_volatile, parse(text).paths)) else ingest.node_table
    nodes = kept(lifecycle.expire_stale(latest(_outcomes(spark, sf_dir)), AS_OF, SILENT), "nodes")
    return run(Facts(_history(spark, sf_dir), nodes, nodes, POLICY), text, include_inactive)


def _shown(history: DataFrame, *more: str) -> DataFrame:
    end = F.when(~F.col("is_open"), F.col("valid_to")).alias("valid_to")
    return history.select("certname", "path", "fact_name", "value", "valid_from", end, "is_open", *more)


# The same pushes and state machine, in DuckDB's SQL.
_PUSHES = """
pushes AS (
  SELECT 'u' || user_id AS certname, event_id AS seq, ts AS received_at, event_type, event_type <> 'error' AS clean,
         CASE WHEN event_id % 17 = 5 THEN ts - INTERVAL 3 DAY WHEN event_id % 23 = 7 THEN ts + INTERVAL 10 MINUTE ELSE ts END AS producer_ts,
         CASE WHEN event_type IN ('purchase', 'click', 'view') THEN CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END END AS band,
         json_extract_string(props, '$.k') AS k
  FROM events)"""
_OUTCOMES = """,
ahead AS (SELECT *, producer_ts > received_at + INTERVAL 5 MINUTE AS fut FROM pushes),
firsts AS (SELECT *, min(CASE WHEN NOT fut AND producer_ts >= received_at - INTERVAL 5 MINUTE THEN seq END) OVER (PARTITION BY certname) AS first_seq FROM ahead),
marks AS (SELECT *, max(CASE WHEN NOT fut AND seq >= first_seq THEN producer_ts END) OVER (PARTITION BY certname ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM firsts),
outcomes AS (SELECT *, CASE WHEN fut OR first_seq IS NULL OR seq < first_seq THEN 'skewed' WHEN producer_ts <= mark THEN 'stale' ELSE 'applied' END AS outcome FROM marks),
applied AS (SELECT *, min(CASE WHEN clean THEN producer_ts END) OVER (PARTITION BY certname ORDER BY producer_ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_clean
            FROM outcomes WHERE outcome = 'applied')"""
_LEAVES = """,
leaves AS (SELECT certname, producer_ts AS ts, next_clean, 'event.type' AS path, 'event' AS fact_name, event_type AS v FROM applied
           UNION ALL SELECT certname, producer_ts, next_clean, 'event.band', 'event', band FROM applied WHERE band IS NOT NULL)"""
_HISTORY = """,
seen AS (SELECT *, lead(ts) OVER w AS next_seen, lag(v) OVER w AS before_v, lag(next_clean) OVER w AS before_clean, row_number() OVER w AS rn
         FROM leaves WINDOW w AS (PARTITION BY certname, path ORDER BY ts)),
islands AS (SELECT *, sum(CASE WHEN rn = 1 OR before_v <> v OR before_clean < ts THEN 1 ELSE 0 END) OVER (PARTITION BY certname, path ORDER BY ts) AS g FROM seen),
spans AS (SELECT certname, path, any_value(fact_name) AS fact_name, any_value(v) AS v, min(ts) AS valid_from,
                 arg_max_null(next_seen, ts) AS next_seen, arg_max_null(next_clean, ts) AS next_clean FROM islands GROUP BY certname, path, g),
history AS (SELECT certname, path, fact_name, '"' || v || '"' AS value, valid_from, least(next_seen, next_clean) AS valid_to, least(next_seen, next_clean) IS NULL AS is_open,
                   CASE WHEN next_clean < coalesce(next_seen, TIMESTAMP '9999-12-31') THEN 'tombstone' WHEN next_seen IS NOT NULL THEN 'change' END AS ended_by, v FROM spans)"""
_NODES = f""",
node_first AS (SELECT *, min(CASE WHEN outcome = 'applied' THEN seq END) OVER (PARTITION BY certname) AS applied_seq FROM outcomes),
nodes AS (SELECT certname, min(CASE WHEN outcome = 'applied' THEN received_at END) AS first_seen, max(CASE WHEN seq >= applied_seq THEN received_at END) AS last_seen,
                 max(CASE WHEN outcome = 'applied' THEN producer_ts END) AS last_producer_ts,
                 CASE WHEN max(CASE WHEN seq >= applied_seq THEN received_at END) < TIMESTAMP '{AS_OF}' - INTERVAL {int(SILENT.total_seconds())} SECOND THEN TIMESTAMP '{AS_OF}' END AS expired
          FROM node_first WHERE applied_seq IS NOT NULL GROUP BY certname),
volatile AS (SELECT certname, arg_max_null(k, producer_ts) AS k, max(producer_ts) AS observed_at FROM applied GROUP BY certname)"""
_BASE = "WITH" + _PUSHES + _OUTCOMES
_FACTS = _BASE + _LEAVES + _HISTORY
_ALL = _FACTS + _NODES
_COLUMNS = "certname, path, fact_name, value, valid_from, valid_to, is_open"


@registered(_BASE + " SELECT certname, seq, producer_ts, outcome, CAST(CASE outcome WHEN 'applied' THEN 200 ELSE 409 END AS INTEGER) AS status FROM outcomes")
def push_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("certname", "seq", "producer_ts", "outcome", "status")


@registered(_BASE + " SELECT outcome, CAST(CASE outcome WHEN 'applied' THEN 200 ELSE 409 END AS INTEGER) AS status, count(*) AS pushes FROM outcomes GROUP BY outcome")
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest_counts(_outcomes(spark, sf_dir))


_HISTORY_SQL = _FACTS + f" SELECT {_COLUMNS}, ended_by, sha256('s'::BLOB || unhex(printf('%016x', octet_length(encode(v)))) || encode(v)) AS value_hash FROM history"


@registered(_HISTORY_SQL)
def fact_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_history(spark, sf_dir).withColumn("value_hash", F.lower(F.hex("value_hash"))), "ended_by", "value_hash")


@registered(_HISTORY_SQL)
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same history by way of a stream: keyed state, a log of changes, and its fold."""
    at = fresh_path(spark, "stream")
    event_pushes(table(spark, sf_dir, "events")).write.parquet(f"{at}/in")
    changes = stream_changes(spark.readStream.schema(PLANNED).parquet(f"{at}/in"))
    write_changes(changes, f"{at}/changes", f"{at}/state").awaitTermination()
    folded = intervals.fold_changes(spark.read.schema(changes.schema).parquet(f"{at}/changes").filter("path IS NOT NULL"))
    return _shown(folded.withColumn("value_hash", F.lower(F.hex("value_hash"))), "ended_by", "value_hash")


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """(history, nodes, volatile, rejects) of a stream over the events with state by path."""
    at = fresh_path(spark, "stream-by-path")
    event_pushes(table(spark, sf_dir, "events")).write.parquet(f"{at}/in")
    write_tables(stream_nodes(spark.readStream.schema(PLANNED).parquet(f"{at}/in")), f"{at}/out", f"{at}/state").awaitTermination()
    return read_tables(spark, f"{at}/out")


@registered(_HISTORY_SQL)
def stream_history_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same history by a stream whose state has an entry for each open fact."""
    return _shown(_streamed(spark, sf_dir)[0].withColumn("value_hash", F.lower(F.hex("value_hash"))), "ended_by", "value_hash")


_STREAKS = """, runs AS (SELECT certname, producer_ts, clean, max(CASE WHEN clean THEN producer_ts END) OVER (PARTITION BY certname) AS last_clean FROM applied),
streaks AS (SELECT certname, count(*) FILTER (WHERE last_clean IS NULL OR producer_ts > last_clean) AS streak FROM runs GROUP BY certname)
SELECT certname, first_seen, last_seen, last_producer_ts, streak, k, observed_at FROM nodes JOIN streaks USING (certname) JOIN volatile USING (certname)"""


@registered(_ALL + _STREAKS)
def stream_node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, dirty streaks and volatile values as the stream leaves them."""
    _, nodes, volatile, _ = _streamed(spark, sf_dir)
    latest = volatile.select("certname", F.element_at("volatile", "props.k").alias("k"), "observed_at")
    return nodes.select("certname", "first_seen", "last_seen", "last_producer_ts", "streak").join(latest, "certname")


def _batched(spark: SparkSession, sf_dir: str) -> FactStore:
    """The events taken by a store in three batches, by arrival."""
    events = table(spark, sf_dir, "events")
    first, last = events.agg(F.min("event_id"), F.max("event_id")).first()
    store = FactStore(spark, fresh_path(spark, "store"), buckets=16)
    for k in range(3):
        arrived = F.col("event_id").between(first + (last - first + 1) * k // 3, first + (last - first + 1) * (k + 1) // 3 - 1)
        store.apply(event_pushes(events.filter(arrived)), f"part-{k}")
    return store


@registered(_HISTORY_SQL)
def store_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same history from a store that took the pushes in batches."""
    return _shown(_batched(spark, sf_dir).open().history.withColumn("value_hash", F.lower(F.hex("value_hash"))), "ended_by", "value_hash")


@registered(_FACTS + f" SELECT {_COLUMNS} FROM history WHERE valid_from <= TIMESTAMP '{AT}' AND (is_open OR valid_to > TIMESTAMP '{AT}')")
def store_facts_at_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The past from a store, of whose closed files only those are opened whose span holds the time."""
    return _shown(_batched(spark, sf_dir).open().at(AT))


@registered(_ALL + _STREAKS)
def store_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, their dirty streaks and volatile values after three batches."""
    found = _batched(spark, sf_dir).open()
    volatile = found.volatile.select("certname", F.element_at("volatile", "props.k").alias("k"), "observed_at")
    return found.nodes.select("certname", "first_seen", "last_seen", "last_producer_ts", "streak").join(volatile, "certname")


@registered(_FACTS + " SELECT DISTINCT path, fact_name FROM history")
def store_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(spark, sf_dir).paths()


@registered(_FACTS + f" SELECT {_COLUMNS} FROM history WHERE is_open")
def current_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(reads.current_facts(_history(spark, sf_dir)))


@registered(_FACTS + f" SELECT {_COLUMNS} FROM history WHERE valid_from <= TIMESTAMP '{AT}' AND (is_open OR valid_to > TIMESTAMP '{AT}')")
def facts_at_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(reads.facts_at(_history(spark, sf_dir), AT))


@registered(_FACTS + f" SELECT {_COLUMNS} FROM history WHERE certname = '{NODE}' AND is_open")
def node_state_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(reads.node_facts(_history(spark, sf_dir), NODE).withColumn("certname", F.lit(NODE)))


@registered(_FACTS + f" SELECT {_COLUMNS} FROM history WHERE certname = '{NODE}' AND valid_from <= TIMESTAMP '{AT}' AND (is_open OR valid_to > TIMESTAMP '{AT}')")
def node_state_at_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(reads.node_facts(_history(spark, sf_dir), NODE, AT).withColumn("certname", F.lit(NODE)))


_WINDOW = "coalesce({0} >= TIMESTAMP '%s' AND {0} < TIMESTAMP '%s', FALSE)" % (START, END)
_DIFF = f" SELECT {_COLUMNS}, {_WINDOW.format('valid_from')} AS opened_in_window, {_WINDOW.format('valid_to')} AS closed_in_window FROM history WHERE ({_WINDOW.format('valid_from')} OR {_WINDOW.format('valid_to')})"


@registered(_FACTS + _DIFF + f" AND certname = '{NODE}'")
def node_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.node_diff(_history(spark, sf_dir), NODE, START, END).withColumn("certname", F.lit(NODE))
    return _shown(found, "opened_in_window", "closed_in_window")


@registered(_FACTS + _DIFF)
def fleet_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(reads.diff(_history(spark, sf_dir), START, END), "opened_in_window", "closed_in_window")


@registered(
    _FACTS + """, counts AS (
  SELECT certname, valid_from AS producer_ts, 1 AS opened, 0 AS closed, 0 AS tombstoned, 0 AS shown FROM history
  UNION ALL SELECT certname, valid_to, 0, CASE WHEN ended_by = 'change' THEN 1 ELSE 0 END, CASE WHEN ended_by = 'tombstone' THEN 1 ELSE 0 END, 0 FROM history WHERE NOT is_open
  UNION ALL SELECT certname, producer_ts, 0, 0, 0, CASE WHEN band IS NULL THEN 1 ELSE 2 END FROM applied)
SELECT certname, producer_ts, CAST(sum(opened) AS BIGINT) AS opened, CAST(sum(closed) AS BIGINT) AS closed, CAST(sum(tombstoned) AS BIGINT) AS tombstoned,
       CAST(sum(shown) - sum(opened) AS BIGINT) AS unchanged FROM counts GROUP BY certname, producer_ts"""
)
def apply_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pushes = _applied(spark, sf_dir)
    return intervals.apply_stats(pushes, intervals.fact_history(pushes))


def _views(spark: SparkSession, sf_dir: str) -> None:
    """Saved first, so that a view's plan is a scan."""
    found = facts(spark, sf_dir)
    store = FactStore(spark, fresh_path(spark, "views"), buckets=16)
    store.save(found.history, found.nodes, found.volatile)
    reads.register_views(store.open().history, store.open().nodes, store.open().volatile)


@registered(_FACTS + f" SELECT {_COLUMNS} FROM history WHERE valid_from <= TIMESTAMP '{AT}' AND (is_open OR valid_to > TIMESTAMP '{AT}')")
def sql_facts_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function, in SQL."""
    _views(spark, sf_dir)
    return _shown(spark.sql(f"SELECT * FROM facts_at(TIMESTAMP_NTZ '{AT}')"))


@registered(_FACTS + f" SELECT {_COLUMNS} FROM history WHERE certname = '{NODE}' AND valid_from <= TIMESTAMP '{AT}' AND (is_open OR valid_to > TIMESTAMP '{AT}')")
def sql_node_state_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir)
    return _shown(spark.sql(f"SELECT * FROM node_state_at('{NODE}', TIMESTAMP_NTZ '{AT}')"))


@registered(_FACTS + _DIFF + f" AND certname = '{NODE}'")
def sql_node_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir)
    return _shown(spark.sql(f"SELECT * FROM node_diff('{NODE}', TIMESTAMP_NTZ '{START}', TIMESTAMP_NTZ '{END}')"), "opened_in_window", "closed_in_window")


@registered(
    _ALL + f""", shown AS (SELECT certname FROM nodes WHERE expired IS NULL AND certname = '{NODE}')
SELECT 'fact' AS kind, path, value FROM history JOIN shown USING (certname) WHERE is_open
UNION ALL SELECT 'volatile', 'props.k', k FROM volatile JOIN shown USING (certname)"""
)
def state_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a node's state is answered with now: its facts and its volatile values."""
    found = facts(spark, sf_dir)
    held, volatile = reads.state_response(found.history, found.nodes, found.volatile, NODE)
    return held.select(F.lit("fact").alias("kind"), "path", "value").unionAll(volatile.select(F.lit("volatile"), F.explode("volatile")))


@registered(_ALL + f", hidden AS (SELECT min(certname) AS certname FROM nodes WHERE expired IS NOT NULL) " + _DIFF.replace("FROM history", "FROM history JOIN hidden USING (certname)"))
def diff_response_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed on a node that has gone silent, which is shown only if inactive nodes are asked for."""
    found = facts(spark, sf_dir)
    name = found.nodes.filter("expired IS NOT NULL").agg(F.min("certname")).first()[0]
    try:
        reads.diff_response(found.history, found.nodes, name, START, END)
        raise AssertionError(f"{name} isn't hidden")
    except NodeNotFound:
        answer = reads.diff_response(found.history, found.nodes, name, START, END, include_inactive=True)
    return _shown(answer.withColumn("certname", F.lit(name)), "opened_in_window", "closed_in_window")


@registered(_FACTS + """ SELECT '{"certname":' || to_json(certname) || ',"path":' || to_json(path) || ',"value":' || value || ',"is_open":' || CASE WHEN is_open THEN 'true' ELSE 'false' END || '}' AS body FROM history""")
def facts_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.as_json(_history(spark, sf_dir).select("certname", "path", "value", "is_open"))


@registered(
    _PUSHES.join(["WITH", ""]) + """, orders AS (SELECT certname, CAST(floor((min(seq) + max(seq)) / 2) AS BIGINT) AS order_seq FROM pushes WHERE CAST(substr(certname, 2) AS BIGINT) % 4 = 0 GROUP BY certname),
ahead AS (SELECT *, producer_ts > received_at + INTERVAL 5 MINUTE AS fut FROM pushes LEFT JOIN orders USING (certname)),
firsts AS (SELECT *, min(CASE WHEN NOT fut AND producer_ts >= received_at - INTERVAL 5 MINUTE THEN seq END) OVER (PARTITION BY certname) AS first_seq FROM ahead),
seals AS (SELECT *, coalesce(order_seq >= first_seq AND seq > order_seq, FALSE) AS shut FROM firsts),
marks AS (SELECT *, max(CASE WHEN NOT fut AND NOT shut AND seq >= first_seq THEN producer_ts END) OVER (PARTITION BY certname ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM seals)
SELECT certname, seq, CASE WHEN fut THEN 'skewed' WHEN shut THEN 'deactivated' WHEN first_seq IS NULL OR seq < first_seq THEN 'skewed' WHEN producer_ts <= mark THEN 'stale' ELSE 'applied' END AS outcome FROM marks"""
)
def sealed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushes of a fleet of which every fourth node is deactivated halfway."""
    pushes = event_pushes(table(spark, sf_dir, "events"))
    some = pushes.filter(F.substring("certname", F.lit(2), F.length("certname")).cast("long") % 4 == 0)
    orders = some.groupBy("certname").agg(F.floor((F.min("seq") + F.max("seq")) / 2).cast("long").alias("seq"))
    return ingest.push_outcomes(pushes, deactivations=orders).select("certname", "seq", "outcome")


@registered(
    """SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'disk,net' WHEN 'click' THEN 'disk' WHEN 'view' THEN 'x.sh' ELSE '' END AS failing,
       event_type NOT IN ('error', 'click', 'view') AS clean FROM events"""
)
def failing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources failed, and whether a pass was clean, by the events' types."""
    status = lambda *types: F.when(F.col("event_type").isin(*types), "error").otherwise("ok")
    rows = table(spark, sf_dir, "events").select(
        F.lit("n").alias("certname"), F.col("event_id").alias("seq"), F.col("ts").alias("received_at"), F.col("ts").alias("producer_ts"), F.lit('{"k":1}').alias("tree"),
        F.create_map(F.lit("net"), status("error"), F.lit("disk"), status("error", "click"), F.lit("os"), F.lit("ok")).alias("builtin"),
        F.create_map(F.lit("x.sh"), status("view"), F.lit("y.sh"), F.lit("absent")).alias("external"),
    )
    named = rows.select("seq", F.array_join(found_failing(), ",").alias("failing"))
    return named.join(plan_pushes(rows).select("seq", "clean"), "seq")


@registered(
    _BASE + """, runs AS (SELECT certname, producer_ts, clean, max(CASE WHEN clean THEN producer_ts END) OVER (PARTITION BY certname) AS last_clean FROM applied)
SELECT certname, count(*) AS streak FROM runs WHERE last_clean IS NULL OR producer_ts > last_clean GROUP BY certname HAVING count(*) >= 1"""
)
def dirty_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.dirty_nodes(_applied(spark, sf_dir), threshold=1)


_LAG = "epoch(received_at - producer_ts)"


@registered(
    _BASE + f""", lags AS (SELECT {_LAG} AS lag FROM applied), bounds AS (SELECT unnest([{', '.join(map(str, metrics.LAG_SECONDS))}]) AS b),
runs AS (SELECT certname, producer_ts, max(CASE WHEN clean THEN producer_ts END) OVER (PARTITION BY certname) AS last_clean FROM applied),
dirty AS (SELECT certname FROM runs WHERE last_clean IS NULL OR producer_ts > last_clean GROUP BY certname HAVING count(*) >= 2)
SELECT 'pushes_total' AS metric, CASE outcome WHEN 'applied' THEN 'applied' ELSE 'rejected' END AS label, CAST(count(*) AS DOUBLE) AS value FROM outcomes GROUP BY 2
UNION ALL SELECT 'rejects_total', outcome, count(*) FROM outcomes WHERE outcome <> 'applied' GROUP BY 2
UNION ALL SELECT 'lag_seconds_bucket', CAST(b AS VARCHAR), count(*) FILTER (WHERE lag <= b) FROM lags, bounds GROUP BY b
UNION ALL SELECT 'lag_seconds_bucket', '+Inf', count(*) FROM lags
UNION ALL SELECT 'lag_seconds_sum', '', sum(lag) FROM lags
UNION ALL SELECT 'dirty_streak_nodes', '', count(*) FROM dirty"""
)
def ingest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four of the service's five collectors; the fifth, the time that batches take, is a stream's (``metrics.ApplyTimes``)."""
    return metrics.push_metrics(_outcomes(spark, sf_dir), Settings(dirty_streak=2))


@registered(_FACTS + " SELECT DISTINCT path, fact_name FROM history")
def fact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.fact_paths(_history(spark, sf_dir))


def _has(path: str, value: str, when: str = "is_open") -> str:
    return f"SELECT certname FROM history WHERE path = '{path}' AND value = '\"{value}\"' AND {when}"


_THEN = f"valid_from <= TIMESTAMP '{AT}' AND (is_open OR valid_to > TIMESTAMP '{AT}')"
_ACTIVE = " SELECT certname FROM nodes WHERE expired IS NULL AND certname IN ({})"


@registered(_ALL + _ACTIVE.format(_has("event.type", "click")))
def filter_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, "event.type=click")


@registered(_ALL + _ACTIVE.format(_has("event.type", "purchase") + " INTERSECT " + _has("event.band", "mid")))
def filter_and_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, "event.type='purchase' event.band=mid")


@registered(_ALL + _ACTIVE.format(_has("event.type", "view", _THEN)))
def filter_at_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, f"event.type=view at {AT.isoformat()}Z")


@registered(_ALL + " SELECT certname FROM nodes WHERE certname IN (" + _has("event.type", "click") + ")")
def filter_include_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, "event.type=click", include_inactive=True)


@registered(_ALL + _ACTIVE.format(_has("no.such.path", "x")))
def filter_unknown_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, "no.such.path=x")


@registered(_ALL + _ACTIVE.format("SELECT certname FROM volatile WHERE CAST(k AS DOUBLE) = 42"))
def filter_volatile_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, "props.k=42.0")


@registered(_ALL + _ACTIVE.format("SELECT certname FROM volatile WHERE CAST(k AS DOUBLE) = 69 INTERSECT " + _has("event.type", "error")))
def filter_mixed_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, "event.type=error props.k=69.0")


def _group(path: str, where: str, when: str) -> str:
    return f" SELECT value, count(*) AS count FROM history JOIN nodes USING (certname) WHERE expired IS NULL AND path = '{path}' AND {when} AND certname IN ({where}) GROUP BY value"


@registered(_ALL + _group("event.band", _has("event.type", "click"), "is_open"))
def groupby_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, "event.band where event.type=click group by event.band")


@registered(_ALL + _group("event.type", _has("event.band", "high", _THEN), _THEN))
def groupby_at_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, f"event.type where event.band=high group by event.type at {AT.isoformat()}+00:00")


@registered(_ALL + " SELECT k AS value, count(*) AS count FROM volatile JOIN nodes USING (certname) WHERE expired IS NULL AND certname IN (" + _has("event.type", "view") + ") GROUP BY k")
def groupby_volatile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, "props.k where event.type=view group by props.k")


@registered(_ALL + " SELECT certname, k, observed_at FROM volatile")
def volatile_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.volatile_table(_outcomes(spark, sf_dir)).select("certname", F.element_at("volatile", "props.k").alias("k"), "observed_at")


@registered(_ALL + " SELECT certname, first_seen, last_seen, last_producer_ts FROM nodes")
def node_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.node_table(_outcomes(spark, sf_dir)).select("certname", "first_seen", "last_seen", "last_producer_ts")


@registered(_ALL + " SELECT certname, last_seen, expired FROM nodes")
def expire_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("certname", "last_seen", "expired")


@registered(
    _ALL + f""", latest AS (SELECT certname, max(valid_from) AS m FROM history JOIN nodes USING (certname) WHERE is_open AND expired IS NOT NULL GROUP BY certname),
seals AS (SELECT certname, greatest(TIMESTAMP '{AT}', m + INTERVAL 1 MICROSECOND) AS seal FROM latest)
SELECT history.certname, path, value, valid_from, coalesce(valid_to, seal) AS valid_to, is_open AND seal IS NULL AS is_open,
       coalesce(ended_by, CASE WHEN seal IS NOT NULL THEN 'seal' END) AS ended_by FROM history LEFT JOIN seals USING (certname)"""
)
def deactivate_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that have gone silent are sunset for good."""
    nodes = kept(_nodes(spark, sf_dir), "nodes")
    _, sealed = lifecycle.deactivate(nodes, _history(spark, sf_dir), nodes.filter("expired IS NOT NULL"), AT)
    return sealed.select("certname", "path", "value", "valid_from", F.when(~F.col("is_open"), F.col("valid_to")).alias("valid_to"), "is_open", "ended_by")


def _reset_events(pushes: DataFrame) -> DataFrame:
    """Of every third node a reset halfway through its pushes, of every fifth one at three quarters."""
    number = F.substring("certname", F.lit(2), F.length("certname")).cast("long")
    ends = pushes.groupBy("certname").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.max("received_at").alias("at"))
    halfway, late = F.floor((F.col("a") + F.col("b")) / 2).cast("long"), F.floor((F.col("a") + 3 * F.col("b")) / 4).cast("long")
    at = F.array_compact(F.array(F.when(number % 3 == 0, halfway), F.when(number % 5 == 0, late)))
    return ends.select("certname", F.explode(at).alias("seq"), F.lit("reset").alias("kind"), "at")


# One push or reset of each node a step: the state is its watermark, its two open facts with their
# starts, and its latest end.
_RESETS = (
    "WITH RECURSIVE" + _PUSHES + """,
ends AS (SELECT certname, CAST(substr(certname, 2) AS BIGINT) AS number, min(seq) AS a, max(seq) AS b FROM pushes GROUP BY certname),
resets AS (SELECT certname, CAST(floor((a + b) / 2) AS BIGINT) AS seq FROM ends WHERE number % 3 = 0 UNION ALL SELECT certname, CAST(floor((a + 3 * b) / 4) AS BIGINT) FROM ends WHERE number % 5 = 0),
log AS (SELECT *, row_number() OVER (PARTITION BY certname ORDER BY seq, kind) AS n FROM (
  SELECT certname, seq, 'push' AS kind, producer_ts AS ts, received_at, clean, event_type, band FROM pushes UNION ALL SELECT certname, seq, 'reset', NULL, NULL, NULL, NULL, NULL FROM resets)),
run AS (
  SELECT certname, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS outcome, FALSE AS known, NULL::TIMESTAMP AS mark, NULL::TIMESTAMP AS closed,
         NULL::VARCHAR AS t, NULL::TIMESTAMP AS t_from, NULL::VARCHAR AS b, NULL::TIMESTAMP AS b_from, NULL::VARCHAR AS old_t, NULL::VARCHAR AS old_b FROM ends
  UNION ALL
  SELECT certname, n, seq, ts, outcome, known OR outcome = 'applied', CASE WHEN outcome = 'applied' THEN ts WHEN outcome = 'reset' THEN NULL ELSE mark END,
         CASE WHEN outcome = 'applied' AND (t <> event_type OR b <> band OR (band IS NULL AND clean AND b IS NOT NULL)) THEN ts ELSE closed END,
         CASE WHEN outcome = 'applied' THEN event_type ELSE t END, CASE WHEN outcome = 'applied' AND t IS DISTINCT FROM event_type THEN ts ELSE t_from END,
         CASE WHEN outcome <> 'applied' OR (band IS NULL AND NOT clean) THEN b ELSE band END,
         CASE WHEN outcome <> 'applied' OR b IS NOT DISTINCT FROM band OR (band IS NULL AND NOT clean) THEN b_from WHEN band IS NULL THEN NULL ELSE ts END, t, b
  FROM (SELECT run.certname, log.n, log.seq, log.ts, known, mark, closed, t, t_from, b, b_from, event_type, band, clean,
               CASE WHEN kind = 'reset' THEN 'reset' WHEN log.ts > received_at + INTERVAL 5 MINUTE THEN 'skewed' WHEN log.ts <= mark THEN 'stale' WHEN NOT known AND log.ts < received_at - INTERVAL 5 MINUTE THEN 'skewed'
                    WHEN log.ts <= greatest(t_from, b_from) OR log.ts < closed THEN 'stale' ELSE 'applied' END AS outcome
        FROM run JOIN log ON log.certname = run.certname AND log.n = run.n + 1))
SELECT certname, seq, ts, outcome AS change, NULL AS path, NULL AS value FROM run WHERE outcome IN ('skewed', 'stale')
UNION ALL SELECT certname, seq, ts, 'close', 'event.type', NULL FROM run WHERE outcome = 'applied' AND old_t <> t
UNION ALL SELECT certname, seq, ts, 'open', 'event.type', '"' || t || '"' FROM run WHERE outcome = 'applied' AND old_t IS DISTINCT FROM t
UNION ALL SELECT certname, seq, ts, CASE WHEN b IS NULL THEN 'tombstone' ELSE 'close' END, 'event.band', NULL FROM run WHERE outcome = 'applied' AND old_b IS NOT NULL AND old_b IS DISTINCT FROM b
UNION ALL SELECT certname, seq, ts, 'open', 'event.band', '"' || b || '"' FROM run WHERE outcome = 'applied' AND b IS NOT NULL AND old_b IS DISTINCT FROM b"""
)


@registered(_RESETS)
def reset_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes and rejects where some nodes' watermarks are reset: windows over the segments between resets."""
    pushes = event_pushes(table(spark, sf_dir, "events"))
    changes = carry.segmented_changes(pushes, _reset_events(pushes))
    return changes.select("certname", "seq", "ts", "change", "path", "value")


@registered(_FACTS + f" SELECT path, count(*) AS changes FROM history WHERE valid_from > TIMESTAMP '{AT}' - INTERVAL 1 DAY GROUP BY path HAVING count(*) >= 5 ORDER BY changes DESC, path LIMIT 20")
def high_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.high_churn(_history(spark, sf_dir), AT, at_least=5)


@registered(_FACTS + " SELECT certname, count(DISTINCT path) AS paths FROM history GROUP BY certname HAVING count(DISTINCT path) >= 2 ORDER BY paths DESC, certname LIMIT 20")
def path_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.path_cardinality(_history(spark, sf_dir), at_least=2)


@registered(
    _BASE + """, runs AS (SELECT certname, producer_ts, clean, sum(CASE WHEN clean THEN 1 ELSE 0 END) OVER (PARTITION BY certname ORDER BY producer_ts) AS run FROM applied),
streaks AS (SELECT certname, producer_ts, CAST(sum(CASE WHEN clean THEN 0 ELSE 1 END) OVER (PARTITION BY certname, run ORDER BY producer_ts) AS BIGINT) AS streak FROM runs)
SELECT certname, producer_ts, streak, streak = 2 AS crossed FROM streaks"""
)
def dirty_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.dirty_streaks(_applied(spark, sf_dir), threshold=2)


@registered(
    _FACTS + """, ends AS (SELECT *, coalesce(valid_to, TIMESTAMP '9999-12-31') AS until, lead(valid_from) OVER (PARTITION BY certname, path ORDER BY valid_from, valid_to) AS next_from FROM history),
keys AS (SELECT greatest(count(*) FILTER (WHERE is_open) - 1, 0) AS extra_open, count(*) FILTER (WHERE valid_from >= until) AS empty, count(*) FILTER (WHERE next_from = valid_from) AS same_start,
                count(*) FILTER (WHERE next_from < until) AS "overlaps", count(*) FILTER (WHERE v IS NULL) AS bad_hash, count(*) FILTER (WHERE is_open <> (valid_to IS NULL)) AS bad_flag FROM ends GROUP BY certname, path)
SELECT """ + ", ".join(f'CAST(coalesce(sum("{c}"), 0) AS BIGINT) AS "{c}"' for c in ("extra_open", "empty", "same_start", "overlaps", "bad_hash", "bad_flag")) + " FROM keys"
)
def history_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.integrity(_history(spark, sf_dir))


@registered(
    """SELECT 'u' || user_id AS certname, event_id AS seq, 'k' AS path, json_extract_string(props, '$.k') AS value, 'number' AS value_type,
       sha256('#'::BLOB || unhex(printf('%016x', length(json_extract_string(props, '$.k')))) || encode(json_extract_string(props, '$.k'))) AS value_hash FROM events"""
)
def flatten_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' JSON as snapshot trees, through the whole planning path."""
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("certname"), F.col("event_id").alias("seq"), F.col("ts").alias("received_at"), F.col("ts").alias("producer_ts"),
        F.col("props").alias("tree"), F.create_map(F.lit("os"), F.lit("ok")).alias("builtin"), F.create_map().cast("map<string, string>").alias("external"),
    )
    leaves = plan_pushes(events).select("certname", "seq", F.inline("durable"))
    return leaves.select("certname", "seq", "path", "value", "value_type", F.lower(F.hex("value_hash")).alias("value_hash"))


def _body(tree: str, stamp: str = "@Z", discovery: str = '{"builtin":{"os":"ok"}}') -> str:
    """``@`` stands for the event's time, ``#`` for ten minutes later."""
    return f'{{"producer_timestamp":"{stamp}","discovery":{discovery},"tree":{tree}}}'


#: A push's body by event_id modulo their number, with the reason and status against it; of a sound
#: one whether it is clean and its durable and volatile leaves (paths up and up.*).
_BODIES = [
    (_body('{"k":1.50,"up":{"secs":10}}'), (True, 1, 1)),
    ("", ("no-client-cert", 403)),
    ("{bad", ("bad-request", 400)),
    ("[1,2]", ("bad-request", 400)),
    ('{"discovery":{"builtin":{"os":"ok"}},"tree":{"k":1}}', ("bad-request", 400)),
    (_body('{"k":1}', "2024-01-05"), ("bad-request", 400)),
    (_body('{"k":1}', "2024-01-05 10:00:00Z"), ("bad-request", 400)),
    (_body('{"k":1}', "@,5Z"), ("bad-request", 400)),
    (_body('{"k":1}', "@.1234567890Z", '{"external":{"x":"absent"}}'), (True, 1, 0)),
    (_body('{"k":1}', discovery='{"builtin":{},"external":null}'), ("bad-request", 400)),
    (_body('{"k":1}', discovery='{"builtin":{"os":"fine"}}'), ("bad-request", 400)),
    (_body('{"k":1}', discovery='{"builtin":{"os":"absent"}}'), ("bad-request", 400)),
    (_body('{"k":1}', discovery='{"builtin":{"os":7}}'), ("bad-request", 400)),
    (_body('{"k":1,"up":2}', discovery='{"builtin":{"os":"error"}}'), (False, 1, 1)),
    (_body('{"k":' + "[" * 9000 + "]" * 9000 + "}"), (True, 1, 0)),
    (_body('{"k":' + "[" * 10_001 + "]" * 10_001 + "}"), ("bad-request", 400)),
    (_body('{"k":1e99999999999999999999,"up":-0.0e5}'), (True, 1, 1)),
    (_body('{"a":{"b":1},"a.b":2}'), ("bad-request: colliding path a.b", 400)),
    (_body('{"a":1,"b":{"c":2,"d":3},"e":4}'), ("oversized: leaf-count", 413)),
    (_body('{"a":1,"b":2,"c":3,"d":{"' + "x" * 70 + '":4}}'), ("oversized: path-length", 413)),
    (_body('{"' + "é" * 40 + '":{"x":1}}'), ("oversized: path-length", 413)),
    (_body('{"k":"' + "<" * 10_000 + '"}'), ("oversized: value-bytes", 413)),
    (_body('{"k":"' + "x" * 60_000 + '"}'), ("oversized: snapshot-bytes", 413)),
    (_body("null"), ("bad-request", 400)),
    (_body("{}"), ("bad-request", 400)),
    (_body("[1]"), ("bad-request", 400)),
    (_body('{"k":1}', "#Z"), ("skewed", 409)),
    (_body('{"k":"' + "<" * 10_000 + '"}', "#Z"), ("skewed", 409)),
    (_body('{"a":{"b":1},"a.b":2}', "#Z"), ("bad-request: colliding path a.b", 400)),
    ('{"more":[1,{}],"TREE":{"k":1,"k":2},' + _body("{}")[1:-11] + "} {bad", (True, 1, 0)),
    (_body('{"up":{"a":1},"update":2}', "@+00:00"), (True, 1, 1)),
]
_WRONG = [list(found) if len(found) == 2 else [None, None] for _, found in _BODIES]
_SOUND = [list(found) if len(found) == 3 else [None] * 3 for _, found in _BODIES]


def push_bodies(events: DataFrame) -> DataFrame:
    """(certname, seq, received_at, body): a push's JSON for each event, most with a fault."""
    kind = F.col("event_id") % len(_BODIES)
    iso = lambda ts: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    bodies = F.element_at(F.create_map(*[x for i, (text, _) in enumerate(_BODIES) for x in (F.lit(i), F.lit(text))]), kind.cast("int"))
    body = F.replace(F.replace(bodies, F.lit("@"), iso(F.col("ts"))), F.lit("#"), iso(F.expr("ts + INTERVAL 10 MINUTES")))
    return events.select(F.when(kind == 1, "").otherwise(F.concat(F.lit("u"), F.col("user_id"))).alias("certname"), F.col("event_id").alias("seq"), F.col("ts").alias("received_at"), body.alias("body"))


def _by_kind(values: list) -> str:
    return "CASE " + " ".join(f"WHEN event_id % {len(_BODIES)} = {i} THEN {v}" for i, v in enumerate(values) if v is not None) + " END"


def _quoted(value) -> str | None:
    return None if value is None else f"'{value}'"


@registered(
    f"""SELECT event_id AS seq, CASE WHEN event_id % {len(_BODIES)} = 1 THEN '' ELSE 'u' || user_id END AS certname,
       {_by_kind([_quoted(r) for r, _ in _WRONG])} AS reason, CAST({_by_kind([c for _, c in _WRONG])} AS INTEGER) AS status,
       {_by_kind([c for c, _, _ in _SOUND])} AS clean, CAST({_by_kind([d for _, d, _ in _SOUND])} AS INTEGER) AS durable, CAST({_by_kind([v for _, _, v in _SOUND])} AS INTEGER) AS volatile,
       CASE WHEN event_id % {len(_BODIES)} IN ({', '.join(str(i) for i, x in enumerate(_SOUND) if x[1])})
            THEN date_trunc('second', ts) + CASE WHEN event_id % {len(_BODIES)} = 8 THEN INTERVAL 123456 MICROSECOND ELSE INTERVAL 0 SECOND END END AS producer_ts FROM events"""
)
def push_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason against each of many kinds of JSON bodies, by decoding, caps, flattening, discovery and classification."""
    limits = Settings(max_body_bytes=60_000, max_leaves=3, max_path_bytes=64, max_value_bytes=50_000)
    # a body is a hundred times an event, and events may lie in one row group
    bodies = push_bodies(dealt(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "event_id", each=4_000))
    planned = plan_pushes(decode_bodies(bodies, limits), Policy(("up", "up.*")), limits)
    sound = lambda c: F.when(F.col("reason").isNull(), c)
    return planned.select(
        "seq", "certname", "reason", "status", sound(F.col("clean")).alias("clean"), sound(F.size("durable")).alias("durable"), sound(F.size("volatile")).alias("volatile"), sound(F.col("producer_ts")).alias("producer_ts"),
    )


# A bucket of four tokens a day for each node, one push a step; 345.6 thousand million units fill it.
_BUCKETS = (
    f"""WITH RECURSIVE pushes AS (SELECT 'u' || user_id AS certname, event_id AS seq, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_id % {len(_BODIES)} <> 1),
run AS (SELECT certname, seq, n, t, CAST(345600000000 - 86400000000 AS BIGINT) AS level, TRUE AS admitted FROM pushes WHERE n = 1
  UNION ALL
  SELECT certname, seq, n, t, CAST(CASE WHEN filled >= 86400000000 THEN filled - 86400000000 ELSE filled END AS BIGINT), filled >= 86400000000
  FROM (SELECT p.certname, p.seq, p.n, p.t, least(345600000000, level + 4 * least(p.t - run.t, 86400000000)) AS filled FROM run JOIN pushes p ON p.certname = run.certname AND p.n = run.n + 1))
SELECT seq, certname, CASE WHEN admitted THEN 'read' ELSE 'rate-limited' END AS admission, CAST(CASE WHEN NOT admitted THEN 429 END AS INTEGER) AS status FROM run
UNION ALL SELECT event_id, '', 'no-client-cert', 403 FROM events WHERE event_id % {len(_BODIES)} = 1"""
)


@registered(_BUCKETS)
def admitted_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pushes are read where a node has four a day, and how the others are answered."""
    raw = admission.admit(push_bodies(table(spark, sf_dir, "events")), Settings(pushes_per_minute=4), dt.timedelta(days=1))
    reason, status = unread(raw)  # this much is settled before any body is
    return raw.select("seq", "certname", F.coalesce(reason, F.lit("read")).alias("admission"), status.alias("status"))


@registered(
    """WITH pushes AS (SELECT 'c' || o_custkey AS certname, o_orderdate AS ts, o_orderkey, o_orderstatus, o_orderpriority FROM orders),
applied AS (SELECT certname, ts, arg_min(o_orderstatus, o_orderkey) AS s, arg_min(o_orderpriority, o_orderkey) AS p FROM pushes GROUP BY certname, ts),
leaves AS (SELECT certname, ts, 'order.status' AS path, s AS v FROM applied UNION ALL SELECT certname, ts, 'order.priority', p FROM applied),
marked AS (SELECT *, coalesce(lag(v) OVER w <> v, TRUE) AS starts FROM leaves WINDOW w AS (PARTITION BY certname, path ORDER BY ts)),
spans AS (SELECT certname, path, v, ts AS valid_from, lead(ts) OVER (PARTITION BY certname, path ORDER BY ts) AS valid_to FROM marked WHERE starts)
SELECT n_name, path, '"' || v || '"' AS value, count(*) AS intervals, count(*) FILTER (WHERE valid_to IS NULL) AS open_now
FROM spans JOIN customer ON certname = 'c' || c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, path, v"""
)
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order facts by customer, joined with what is known of the customer's nation."""
    history = intervals.fact_history(ingest.applied(ingest.push_outcomes(order_pushes(table(spark, sf_dir, "orders")))))
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("certname"), F.col("c_nationkey").alias("n_nationkey"))
    per = history.groupBy("certname", "path", "value").agg(F.count("*").alias("i"), F.count_if("is_open").alias("o"))
    joined = per.join(customers, "certname").join(table(spark, sf_dir, "nation"), "n_nationkey")
    return joined.groupBy("n_name", "path", "value").agg(F.sum("i").alias("intervals"), F.sum("o").alias("open_now"))
