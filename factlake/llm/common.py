"""Helpers shared by the corpus operators: tables, the shared folder, row keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.sources.shared import fresh_path, importable


#: Rows that go to Python at once: texts are long, and a batch lies in the JVM and in the worker.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    if spark.conf.get(BATCH) == "10000":  # Spark's own default; what a user has set stays
        spark.conf.set(BATCH, "2000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, so a lost
    executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns: str):
    """A 128-bit key of a row by content, 16 bytes. Repeated rows have the same key, and are one
    document; others differ but for a chance of one in 10^18 over 10^10 rows."""
    half = lambda *first: F.lpad(F.hex(F.xxhash64(*first, *[F.col(c) for c in columns])), 16, "0")
    return F.unhex(F.concat(half(), half(F.lit("second"))))


#: Bits of the filter of ``maybe_in``: 1024 rows of 4 KB, at any input size.
FILTER_BITS = 1 << 25


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame, inverse: bool = False) -> DataFrame:
    """The ``rows`` whose ``key`` may be one of ``wanted``'s.

    A filter before an exact join: no wanted row is lost, and most others stay out of the
    exchange. What is broadcast has 4 MB at most; where very many keys are wanted it lets more
    through. ``inverse``: all other rows.
    """
    part, bits, byte, at = (free_name(rows, c) for c in ("part", "bits", "byte", "at"))
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    which, position = F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)
    filters = wanted.select(key).groupBy(which.alias(part)).agg(F.bitmap_construct_agg(position).alias(bits))
    held = rows.withColumn(part, which).join(F.broadcast(filters), part, "left" if inverse else "inner")
    held = held.withColumn(byte, F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, 1)), 16, 10).cast("int")).withColumn(at, (position % 8).cast("int"))
    return held.filter(f"coalesce(shiftright({byte}, {at}) & 1, 0) = {0 if inverse else 1}").drop(part, bits, byte, at)


def join_weighted(rows: DataFrame, values: DataFrame, keys: list[str], weight: str, common: int) -> DataFrame:
    """``rows`` joined with the one row that ``values`` has for each key; nulls are equal.

    ``weight`` is the number of rows that have a key. Keys with more than ``common`` of them, at
    most (all rows / ``common``) keys, are looked up in a broadcast table, and only rows of other
    keys are exchanged: no task gets more than ``common`` rows of one key. ``rows`` are read
    twice, so they should be a stored table or cheap.
    """
    renamed = {k: free_name(rows, f"with_{i}") for i, k in enumerate(keys)}
    other = values.withColumnsRenamed(renamed)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(renamed[k])) for k in keys])
    hot, rest = F.broadcast(other.filter(F.col(weight) > common)), other.filter(F.col(weight) <= common)
    met = rows.join(hot, same)
    others = rows.join(hot.select(*renamed.values()), same, "left_anti").join(rest, same)
    return met.unionByName(others).drop(weight, *renamed.values())


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have, so that extra columns can't clash."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
