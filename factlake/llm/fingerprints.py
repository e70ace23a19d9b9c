"""Canonical exact digests: normalised, folded text under a wide hash, its buckets compared byte by byte.

SQL functions only. Unicode normalisation and case folding are calls of the ICU library that
Spark carries, through the SQL function ``reflect``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm.common import free_name, maybe_in, row_key, stored

def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, and each run of Unicode white space one space, none at the ends."""
    icu = lambda kind, name, x: F.reflect(F.lit(f"com.ibm.icu.{kind}"), F.lit(name), x, F.lit(True))
    folded = icu("text.Normalizer", "compose", icu("lang.UCharacter", "foldCase", icu("text.Normalizer", "compose", F.coalesce(text, F.lit("")))))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits of xxHash, as 32 hex digits: the second half is seeded by another prefix."""
    half = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(half(F.xxhash64(canon)), half(F.xxhash64(F.lit("wide"), canon)))


def collisions(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """(print, canon, rank) for each canonical text but the least of a bucket that holds several.

    Only buckets with two rows or more are compared. A filter of fixed size keeps other rows'
    texts out of the exchange; copies meet within a task first, as least and greatest text.
    """
    shared = prints.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print")
    maybe = maybe_in(rows, "print", shared)
    compared = stored(maybe.groupBy("print").agg(F.min("canon").alias("least"), F.max("canon").alias("greatest")).filter("least <> greatest").select("print"), "collided")
    if not compared.limit(1).count():
        return rows.sparkSession.createDataFrame([], "print string, canon string, rank int")
    several = maybe.join(compared, "print", "left_semi").groupBy("print", "canon").agg(F.lit(1).alias("one"))
    return several.select("print", "canon", (F.dense_rank().over(Window.partitionBy("print").orderBy("canon")) - 1).alias("rank")).filter("rank > 0")


def document_fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """((row, doc, n_chars, fingerprint) of each distinct row, the collisions that were resolved).

    ``row`` is ``row_key(id, text)``. Texts have equal fingerprints exactly if their canonical
    forms have equal bytes: where different ones share the 128-bit hash, all but the least get
    their rank in the bucket as a suffix. A null text counts as empty; null ids are ids like
    others; repeated rows are one row here; an empty table gives none.
    """
    hashed = docs.select(row_key(id, text).alias("row"), F.col(id).alias("doc"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"), canonical(F.col(text)).alias("canon"))
    rows = hashed.withColumn("print", wide_hash(F.col("canon")))
    prints = stored(rows.select("row", "doc", "n_chars", "print"), "prints")
    resolved = stored(collisions(rows.select("row", "print", "canon"), prints), "collisions")
    ranks = rows.join(resolved, ["print", "canon"]).select("row", "rank") if resolved.limit(1).count() else None
    found = prints.dropDuplicates(["row"])
    if ranks is None:
        return found.withColumnRenamed("print", "fingerprint"), resolved
    return found.join(ranks.dropDuplicates(["row"]), "row", "left").select("row", "doc", "n_chars", suffixed("print", "rank").alias("fingerprint")), resolved


def suffixed(print_: str, rank: str) -> Column:
    return F.when(F.col(rank).isNull(), F.col(print_)).otherwise(F.concat_ws("-", print_, F.col(rank).cast("string")))


def neighbours(rows: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """``rows`` with ``next``, a struct of the next row's ``columns``; the first follows the last.

    Rows are range-partitioned in this order and looked up within partitions; what joins the
    partitions is one row from each.
    """
    placed = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy(*order)
    placed = stored(placed.select("*", F.lead(F.struct(*columns)).over(inside).alias("next"), F.row_number().over(inside).alias("at")), "neighbours")
    heads = placed.filter("at = 1").select("part", F.struct(*columns).alias("head"))
    ring = Window.partitionBy(F.lit(1)).orderBy("part")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = heads.select("part", F.coalesce(F.lead("head").over(ring), F.first("head").over(whole)).alias("head"))
    return placed.join(F.broadcast(follow), "part").select(*rows.columns, F.coalesce("next", "head").alias("next"))


def edited_fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Fingerprints of ``docs`` and of their edited texts: the last third of the code points is
    replaced by as many from the start of the next document, descending id, nulls last.

    An edited text is compared byte by byte with the originals only where these collide, and not
    with other edited texts: there 128 bits of hash decide.

    A null text counts as empty; null ids come last, in an order by content; rows that repeat id
    and text have one place in the order, and each gives its row. Texts are edited whole, however
    long. An empty table gives an empty one. Other columns are kept, those named like a result
    are replaced.

    Returns ``docs`` without ``text`` with n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next: 1.0 for equal fingerprints, else 0.0.
    """
    prints, resolved = document_fingerprints(docs, text, id)
    linked = neighbours(prints, [F.col("doc").desc_nulls_last(), F.col("row")], ["row", "fingerprint"])
    linked = linked.withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
    base = docs.select(row_key(id, text).alias("row"), F.coalesce(text, F.lit("")).alias("own"))
    heads = base.withColumnRenamed("row", "next_row").join(linked.select(F.col("next.row").alias("next_row"), "cut", F.col("row").alias("to")), "next_row")
    heads = heads.select(F.col("to").alias("row"), F.substring("own", F.lit(1), F.col("cut")).alias("head")).groupBy("row").agg(F.first("head").alias("head"))
    # with no columns but the id, both joins read one and the same exchange of the texts
    kept = [c for c in docs.columns if c not in (text, id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")]
    names = {c: free_name(docs, f"k{i}") for i, c in enumerate(kept)}
    base = docs.select(row_key(id, text).alias("row"), F.coalesce(text, F.lit("")).alias("own"), *[F.col(c).alias(names[c]) for c in kept])
    joined = base.join(linked, "row").join(heads, "row")
    edited = F.concat(F.substring("own", F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")), F.col("head"))
    out = joined.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("canon", canonical(F.col("edited"))).withColumn("print", wide_hash(F.col("canon")))
    if resolved.limit(1).count():
        out = out.join(resolved, ["print", "canon"], "left")
        out = out.withColumn("print", suffixed("print", "rank"))
    same = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return out.select(
        F.col("doc").alias(id), *[F.col(names[c]).alias(c) for c in kept], "n_chars", "edited_sha256", "fingerprint", F.col("print").alias("edited_fingerprint"),
        same("fingerprint", "print").alias("near_edited"), same("fingerprint", "next.fingerprint").alias("near_next"),
    )
