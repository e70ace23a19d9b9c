"""Scans for runaway churn, cardinality and dirty passes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.times import ntz
from factlake.model import Settings


def high_churn(history: DataFrame, as_of: dt.datetime, window: dt.timedelta = dt.timedelta(hours=24), at_least: int = 5000, top: int | None = 20) -> DataFrame:
    """Paths with most intervals that opened after ``as_of - window``; ties go by path."""
    counts = history.filter(F.col("valid_from") > ntz(as_of - window)).groupBy("path").agg(F.count("*").alias("changes")).filter(F.col("changes") >= at_least).orderBy(F.desc("changes"), "path")
    return counts if top is None else counts.limit(top)


def path_cardinality(history: DataFrame, at_least: int = 5000, top: int | None = 20) -> DataFrame:
    """Nodes with most distinct paths over their whole history; ties go by name."""
    counts = history.groupBy("certname").agg(F.countDistinct("path").alias("paths")).filter(F.col("paths") >= at_least).orderBy(F.desc("paths"), "certname")
    return counts if top is None else counts.limit(top)


def dirty_streaks(applied: DataFrame, threshold: int = Settings().dirty_streak) -> DataFrame:
    """Each applied push's run of dirty passes so far; ``crossed`` where it reaches the threshold.

    This goes by discovery alone: a clean pass without durable leaves ends a streak.
    """
    by = Window.partitionBy("certname").orderBy("producer_ts")
    runs = applied.select("certname", "producer_ts", "clean", F.sum(F.col("clean").cast("int")).over(by).alias("run"))
    streak = F.sum((~F.col("clean")).cast("long")).over(Window.partitionBy("certname", "run").orderBy("producer_ts"))
    return runs.select("certname", "producer_ts", F.when(F.col("clean"), 0).otherwise(streak).cast("long").alias("streak")).withColumn("crossed", F.col("streak") == threshold)


def dirty_nodes(applied: DataFrame, threshold: int = Settings().dirty_streak) -> DataFrame:
    """Nodes whose streak is at or over the threshold now."""
    latest = F.max_by("streak", "producer_ts")
    return dirty_streaks(applied, threshold).groupBy("certname").agg(latest.alias("streak")).filter(F.col("streak") >= threshold)
