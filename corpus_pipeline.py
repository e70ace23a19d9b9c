"""From raw documents to token ids: each stage applies one corpus operator to what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.bpe import bpe_round_trip
from factlake.llm.common import stored, table
from factlake.llm.decontaminate import decontaminate
from factlake.llm.lines import line_dedup
from factlake.llm.near import near_dedup
from factlake.llm.quality import quality_scores
from factlake.llm.queries import held_out, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    scored = quality_scores(docs, table(spark, sf_dir, "labels"), usable=lambda id: ~held_out(id))
    return scored.filter("predicted = 1").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more have; a text that has no other is empty."""
    kept = line_dedup(docs, min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), whole=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the text decoded from them."""
    return bpe_round_trip(docs, tokenizer_path(), ids=True)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-dedup", near_copies), ("decontamination", benchmark_leaks), ("BPE", encode)]

#: The classifier and the near-duplicate classes can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
