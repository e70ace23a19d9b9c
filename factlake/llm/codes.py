"""Vector code compression: product codes whose codebooks come from weighted Lloyd rounds over distinct integer parts."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import free_name, join_weighted, stored

#: Integers beyond it count as it, so that all sums of squares fit a long: 262,144 in units of a component.
LARGEST = 1 << 26


def integer_vector(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or empty or holds a null, NaN or infinity."""
    x = F.transform(vector, lambda x: x.cast("double"))
    sound = F.coalesce(F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(x) > 0)
    whole = F.transform(x, lambda x: F.least(F.greatest(F.floor(x * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    return F.when(sound, whole)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each part; of equal distances the lower index."""
    code, least = np.zeros(len(parts), np.int32), np.zeros(len(parts), np.int64)
    for a in range(0, len(parts), 4096):  # bounded memory, whatever the batch
        away = ((parts[a : a + 4096, None, :] - entries[None]) ** 2).sum(axis=2)
        code[a : a + 4096] = away.argmin(axis=1)
        least[a : a + 4096] = away.min(axis=1)
    return code, least


def assigned(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """``distinct`` (position, part, weight) with ``code`` and ``away``, by the codebooks (position, entry, component)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            position = batch.column("position").to_numpy()
            parts = batch.column("part").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
            code, away = np.zeros(len(position), np.int32), np.zeros(len(position), np.int64)
            for p in np.unique(position):
                own = np.flatnonzero(position == p)
                code[own], away[own] = nearest(parts[own], books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(away)], names=[*batch.schema.names, "code", "away"])

    return distinct.mapInArrow(run, "position int, part array<int>, weight long, code int, away long")


def lloyd_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry becomes floor(sum / count) of the parts that it is nearest to, each part by its
    weight; an unused entry stays. What comes back is a row for each entry."""
    width = books.shape[2]
    sums = [F.sum(F.col("weight") * F.col("part")[j]).alias(f"s{j}") for j in range(width)]
    moved = books.copy()
    for r in assigned(distinct, books).groupBy("position", "code").agg(F.sum("weight").alias("n"), *sums).collect():
        moved[r["position"], r["code"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return moved


def seed_vectors(kept: DataFrame, id: str, entries: int) -> list[list[int]]:
    """The integer vectors of the ``entries`` smallest ids, ascending, null last; of an id's several vectors the least."""
    ids = [r[0] for r in kept.select(id).distinct().orderBy(F.col(id).asc_nulls_last()).limit(entries).collect()]
    if not ids:
        return []
    named = F.col(id).isin([i for i in ids if i is not None])
    wanted = F.coalesce(named, F.lit(False)) | F.col(id).isNull() if None in ids else named
    found = {r[0]: r[1] for r in kept.filter(wanted).groupBy(id).agg(F.min("whole")).collect()}
    return [found[i] for i in ids]


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(``vectors`` without ``vector`` with ``code``, ``error`` and ``label_error``, the codebooks).

    A component x is the integer floor(scale * x), a vector ``parts`` consecutive parts of equal
    length. Equal parts of a position become one row with a weight, and all distances and sums
    are taken over these distinct rows: ``rounds`` rounds of Lloyd's algorithm, then a last
    assignment, whose codes and errors are joined back to the vectors. Parts and labels that
    more than a thousandth of all rows have (a few thousand at most) are joined by broadcast, all
    others by exchange, so no task gathers the rows of a common one.

    Rows go whose vector is null or empty, holds nulls, NaN or infinities, or hasn't the length of
    the vector of the least id, a multiple of ``parts``. Integers beyond ``LARGEST`` count as it.
    The codebooks start with the ``entries`` (at most 256) least ids, of which a null one is the
    last; where fewer are kept there are fewer entries. Repeated rows each give their row and
    count each; null labels are one label; a sum of errors that no long holds is null. An empty
    table gives an empty one. Other columns are kept, those named like a result are replaced.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for a part: 1 to 256 entries")
    results = ("code", "error", "label_error")
    kept_names = [c for c in vectors.columns if c not in (vector, *results)]
    names = {c: f"k{i}" for i, c in enumerate(kept_names)}
    whole = vectors.select(*[F.col(c).alias(names[c]) for c in kept_names], integer_vector(vector, scale).alias("whole")).filter("whole IS NOT NULL")
    rows = stored(whole.withColumn("row", F.monotonically_increasing_id()), "integer-vectors")
    width = next((len(v) for v in seed_vectors(rows, names[id], 1)), 0) // parts
    rows = rows.filter(F.size("whole") == max(1, width) * parts)
    seeds = seed_vectors(rows, names[id], entries)
    if not seeds:
        books = np.zeros((parts, 0, max(1, width)), np.int64)
        none = [F.lit(None).cast(t).alias(c) for c, t in zip(results, ("string", "long", "long"))]
        return rows.filter("false").select(*[F.col(names[c]).alias(c) for c in kept_names], *none), books
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2)
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("whole", p * width + 1, width))
    each = rows.select("row", F.posexplode(cut).alias("position", "part"))
    distinct = stored(each.groupBy("position", "part").agg(F.count("*").alias("weight")), "distinct-parts")
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    coded = stored(assigned(distinct, books), "coded-parts")
    common = max(1000, rows.count() // 1000)
    found = join_weighted(each, coded, ["position", "part"], "weight", common)
    digits = F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda x: F.lpad(F.lower(F.hex(x.code)), 2, "0"))
    by_row = found.groupBy("row").agg(F.array_join(digits, "").alias("code"), F.try_sum("away").alias("error"))
    done = stored(rows.drop("whole").join(by_row, "row"), "coded-vectors")
    labels = done.groupBy(names[label]).agg(F.try_sum("error").alias("label_error"), F.count("*").alias("weight"))
    out = join_weighted(done, labels, [names[label]], "weight", common)
    return out.select(*[F.col(names[c]).alias(c) for c in kept_names], *results), books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and component, in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decoded(codes: DataFrame, books: np.ndarray, code: str = "code", scale: int = 256) -> DataFrame:
    """``codes`` with ``vector``: the entries that a code names, as components again."""
    parts, _, width = books.shape
    entries = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in entry]) for entry in book]) for book in books])
    at = [F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") for p in range(parts)]
    return codes.withColumn("vector", reduce(F.concat, [entries[p][at[p]] for p in range(parts)]))
