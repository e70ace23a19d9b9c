"""Sharding by histogram sort: exact byte counts below probes, refined until splitters fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm.common import free_name, stored

GROUP_BITS, PROBE_BITS = 40, 12


def sort_key(text: str, id: str) -> Column:
    """A non-negative 62-bit key: 40 bits of the text's hash, so that copies stand together,
    then 22 bits of the row's, so that a splitter can pass between copies."""
    low = 62 - GROUP_BITS
    group = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 64 - GROUP_BITS)
    return F.shiftleft(group, low).bitwiseOR(F.shiftrightunsigned(F.xxhash64(id, text), 64 - low))


def splitters(keyed: DataFrame, shards: int, tolerance: float, key: str = "key", size: str = "size") -> list[int]:
    """Keys at which shards 1, 2, ... begin.

    Each round counts the exact bytes below ``2**PROBE_BITS`` even probes over the whole range,
    then between those probes only where a splitter's interval still holds more than the
    tolerated bytes. What comes back is at most shards * 2**PROBE_BITS sums, whatever the input.
    A group of copies is gone into only where it has more bytes than the largest row: others
    are no less even than rows are, and the splitter takes the nearer of their edges.
    """
    total, largest = (x or 0 for x in keyed.agg(F.sum(size), F.max(size)).first())
    allowed = max(1.0, tolerance * total / shards)
    edge = 62 - GROUP_BITS
    open_ = {i: (0, 62, 0) for i in range(1, shards)}  # low end and bits of its interval, bytes below it
    found: dict[int, int] = {}
    while open_:
        by_bits: dict[int, tuple[int, list[int]]] = {}
        for low, bits in {(low, bits) for low, bits, _ in open_.values()}:
            by_bits.setdefault(bits, (max(edge if bits > edge else 0, bits - PROBE_BITS), []))[1].append(low)
        counts: dict[tuple[int, int], int] = {}
        for bits, (step, lows) in by_bits.items():
            wanted = keyed if bits == 62 else keyed.filter(F.shiftright(key, bits).isin([low >> bits for low in lows]))
            for probe, bytes_ in wanted.groupBy(F.shiftright(key, step).alias("probe")).agg(F.sum(size).alias("bytes")).collect():
                counts[step, probe] = bytes_
        for i, (low, bits, before) in list(open_.items()):
            step, goal = by_bits[bits][0], total * i / shards
            ends = sorted(p for s, p in counts if s == step and low >> step <= p < (low + (1 << bits)) >> step)
            for probe in ends:
                bytes_ = counts[step, probe]
                if before + bytes_ >= goal:
                    near_low, near_high = goal - before, before + bytes_ - goal
                    if min(near_low, near_high) <= allowed or step == edge and bytes_ <= largest or step == 0:
                        found[i] = (probe if near_low <= near_high else probe + 1) << step
                        del open_[i]
                    else:
                        open_[i] = probe << step, step, before
                    break
                before += bytes_
            else:  # no rows at or past the goal
                found[i] = (low + (1 << bits))
                del open_[i]
    return [found[i] for i in sorted(found)]


def histogram_shards(docs: DataFrame, shards: int = 40, tolerance: float = 0.002, text: str = "text", id: str = "doc_id", overhead: int = 16, blocks: int = 64) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text and ``overhead``), ``shard`` (0 to
    shards - 1) and ``slot`` (gapless from 0 in each shard), laid out by shard in one exchange.

    Law: bytes. A shard's bytes are within ``tolerance`` of even, or within one row where a row
    is larger. Copies of a text stand together, and a splitter passes between copies only where
    they have more bytes than the largest row together and an edge of theirs would miss the law. A null text has no bytes. Rows that repeat id and text share a key and so
    a shard; null ids are ids like others. Columns named like a result are replaced. An empty
    table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    base = docs.select(*kept)
    key, block, rank, before = (free_name(base, c) for c in ("key", "block", "rank", "before"))
    sized = base.withColumn("size", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).withColumn(key, sort_key(text, id))
    keys = stored(sized.select(F.col(key).alias("key"), "size"), "shard-keys")
    begin = splitters(keys, shards, tolerance)
    # the sum of comparisons with a fixed number of splitters stays in generated code
    shard = reduce(lambda a, b: a + b, [(F.col(key) >= s).cast("int") for s in begin], F.lit(0))
    placed = sized.withColumn("shard", shard).withColumn(block, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    counts = keys.withColumnRenamed("key", key).withColumn("shard", shard).groupBy("shard", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(block)).agg(F.count("*").alias("n"))
    # at most shards * blocks rows
    offsets = counts.select("shard", block, (F.sum("n").over(Window.partitionBy("shard").orderBy(block)) - F.col("n")).alias(before))
    ranked = placed.withColumn(rank, F.row_number().over(Window.partitionBy("shard", block).orderBy(key, id)))
    return ranked.join(F.broadcast(offsets), ["shard", block]).withColumn("slot", F.col(before) + F.col(rank) - 1).select(*kept, "size", "shard", F.col("slot").cast("long").alias("slot"))
