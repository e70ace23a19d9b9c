"""What a service would export of an ingest, as rows (metric, label, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from factlake.model import Settings
from factlake.operators.monitor import dirty_nodes

# Upper bounds of the histograms, in seconds.
LAG_SECONDS = (1, 5, 15, 60, 300, 1800, 7200, 86400)
APPLY_SECONDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)

METRIC = "metric string, label string, value double"


def lag_seconds() -> Column:
    """How late an applied push arrived, in seconds; times without a zone differ the same in any."""
    micros = lambda c: F.unix_date(F.to_date(c)) * F.lit(86_400_000_000) + (F.hour(c) * 3600 + F.minute(c) * 60) * F.lit(1_000_000).cast("long") + F.expr(f"CAST(extract(SECOND FROM {c}) * 1000000 AS BIGINT)")
    return (micros("received_at") - micros("producer_ts")) / 1e6


def buckets(value: Column, bounds: tuple, name: str) -> list[Column]:
    """Counts of a histogram: how many are no larger than each bound, and how many there are; with their sum."""
    at_most = [F.count_if(value <= b).cast("double").alias(f"{name}_le_{b:g}") for b in bounds]
    return [*at_most, F.count(value).cast("double").alias(f"{name}_le_+Inf"), F.coalesce(F.sum(value), F.lit(0.0)).alias(f"{name}_sum")]


def push_metrics(outcomes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(metric, label, value): pushes by result, rejects by reason (a reason with details counts
    under its first part), the histogram of lag over applied pushes, and the nodes whose dirty
    streak is at the alarm. All but the last come from one pass."""
    ok = F.col("outcome") == "applied"
    row = lambda metric, label, value: F.struct(F.lit(metric).alias("metric"), label.alias("label"), value.cast("double").alias("value"))
    results = outcomes.groupBy(F.when(ok, "applied").otherwise("rejected").alias("label")).agg(F.count("*").alias("n")).select(F.inline(F.array(row("pushes_total", F.col("label"), F.col("n")))))
    rejects = outcomes.filter(~ok).groupBy(F.split("outcome", ":")[0].alias("label")).agg(F.count("*").alias("n")).select(F.inline(F.array(row("rejects_total", F.col("label"), F.col("n")))))
    lag = F.when(ok, lag_seconds())
    counts = outcomes.agg(*buckets(lag, LAG_SECONDS, "lag"))
    spread = counts.select(F.inline(F.array(*[row("lag_seconds_sum" if c == "lag_sum" else "lag_seconds_bucket", F.lit("" if c == "lag_sum" else c.removeprefix("lag_le_")), F.col(c)) for c in counts.columns])))
    dirty = dirty_nodes(outcomes.filter(ok), settings.dirty_streak).agg(F.count("*").alias("n")).select(F.inline(F.array(row("dirty_streak_nodes", F.lit(""), F.col("n")))))
    return results.unionAll(rejects).unionAll(spread).unionAll(dirty)


def observed(outcomes: DataFrame, observation: Observation | str) -> DataFrame:
    """``outcomes`` with the counters and the lag's histogram observed as it is written; nothing is read twice.

    On a stream the observation is a name, and ``ApplyTimes`` gets its values with each batch.
    """
    ok = F.col("outcome") == "applied"
    return outcomes.observe(observation, F.count_if(ok).cast("double").alias("applied"), F.count_if(~ok).cast("double").alias("rejected"), *buckets(F.when(ok, lag_seconds()), LAG_SECONDS, "lag"))


class ApplyTimes(StreamingQueryListener):
    """Counts of a stream: what its observation ``name`` saw, and its batches by the time they took."""

    def __init__(self, name: str) -> None:
        self.name = name
        self.seen: dict[str, float] = {}
        self.seconds: dict[str, float] = {f"apply_le_{b:g}": 0.0 for b in APPLY_SECONDS} | {"apply_le_+Inf": 0.0, "apply_sum": 0.0}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = (event.progress.observedMetrics or {}).get(self.name)
        if row is None:
            return
        for key, value in row.asDict().items():
            self.seen[key] = self.seen.get(key, 0.0) + value
        took = event.progress.batchDuration / 1000
        for b in APPLY_SECONDS:
            self.seconds[f"apply_le_{b:g}"] += took <= b
        self.seconds["apply_le_+Inf"] += 1
        self.seconds["apply_sum"] += took
