"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

WORD_BITS, FACTORS, BINS = 15, 4, 16
MAX_TRAIN_ROWS = 6000

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_DIGIT = bytes(range(ord("0"), ord("9") + 1))
_COMMON = b".,;:'\"()-?"
_MARK = b"%$#&*!|^~@<>{}[]=+_\\/"
_HIGH = bytes(range(128, 256))
_STATS = 13


def _log_bin(x: float) -> int:
    return min(BINS - 1, int(np.log2(x + 1)))


def structure(text: str, words: list[str], distinct: int) -> list[int]:
    """A bin for each structure statistic; all are 0 for an empty text, but for what it lacks."""
    data = text.encode()
    n, w = max(1, len(data)), max(1, len(words))
    share = lambda chars: (n - len(data.translate(None, chars))) / n
    fine = lambda x: min(BINS - 1, int(BINS * x**0.5))
    lines = text.split("\n")
    return [
        _log_bin(len(words)),
        fine(share(_UPPER)),
        fine(share(_DIGIT)),
        fine(share(_COMMON)),
        fine(share(_MARK)),
        fine(share(_HIGH)),
        min(BINS - 1, int(2 * len(text) / w)),
        min(BINS - 1, int(BINS * distinct / w)),
        fine(min(1.0, len(lines) / w)),
        min(BINS - 1, int(BINS * len(set(lines)) / len(lines) * 0.999)),
        min(BINS - 1, max(map(len, words), default=0) // 4),
        fine(min(1.0, text.count(" | ") / w)),
        fine(min(1.0, sum(map(str.isupper, words)) / w)),
    ]


class Features:
    """Rows of a sparse matrix. Word buckets come first, then the bins of statistics, then the
    metadata's. Words weigh 1/sqrt(distinct words), so that long texts weigh no more."""

    def __init__(self, metadata: int, max_words: int = 80_000) -> None:
        self.metadata, self.max_words = metadata, max_words
        self.size = (1 << WORD_BITS) + BINS * (_STATS + metadata)
        self.known: dict[str, int] = {}

    def buckets(self, text: str) -> tuple[list[int], list[int]]:
        """(distinct buckets of the text's words, bins of its statistics)."""
        if len(self.known) > self.max_words:
            self.known.clear()
        known, mask = self.known, (1 << WORD_BITS) - 1
        words = text.split()
        distinct = set(words)
        for word in distinct.difference(known):
            known[word] = zlib.crc32(word.encode()) & mask
        return list(set(map(known.__getitem__, distinct))), structure(text, words, len(distinct))

    def rows(self, found: list[tuple[list[int], list[int]]], metadata: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, value, start of each row) of ``buckets`` and columns of metadata."""
        first, fixed = 1 << WORD_BITS, _STATS + self.metadata
        index: list[int] = []
        weight, counts = [], []
        for i, (words, stats) in enumerate(found):
            index.extend(words)
            bins = stats + [0 if (m := column[i]) is None or m < 0 else 1 + min(BINS - 2, _log_bin(m)) for column in metadata]
            index.extend(first + BINS * k + b for k, b in enumerate(bins))
            counts.append((len(words), fixed))
            weight.append(1 / np.sqrt(max(1, len(words))))
        sizes = np.array(counts, np.int64).reshape(-1, 2)
        value = np.repeat(np.column_stack([weight, np.full(len(found), fixed**-0.5)]).ravel(), sizes.ravel()).astype(np.float32)
        starts = np.zeros(len(found), np.int64)
        np.cumsum(sizes.sum(axis=1)[:-1], out=starts[1:])
        return np.array(index, np.int64), value, starts


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def sums(self, index, value, starts):
        v = self.factors[index] * value[:, None]
        return v, np.add.reduceat(v, starts, axis=0)

    def margin(self, index, value, starts) -> np.ndarray:
        """Linear part and pairwise part: the sum over pairs <v_i, v_j> x_i x_j is half of
        (sum v x)^2 - sum (v x)^2 by factor, so a row takes time linear in its features."""
        v, s = self.sums(index, value, starts)
        pairs = 0.5 * (s**2 - np.add.reduceat(v**2, starts, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + pairs

    def score(self, index, value, starts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(index, value, starts), -30, 30)))


def fit(found: list[tuple[list[int], list[int]]], metadata: list[list], labels: list[int], epochs: int = 12, step: float = 0.15, decay: float = 1e-5, seed: int = 7) -> Machine:
    features = Features(len(metadata))
    index, value, starts = features.rows(found, metadata)
    ends = np.append(starts[1:], len(index))
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    base = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
    model = Machine(float(np.log(base / (1 - base))), np.zeros(features.size), rng.normal(0, 0.05, (features.size, FACTORS)))
    g_linear, g_factors, g_bias = np.full(features.size, 1e-6), np.full((features.size, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
            if not len(rows):
                continue
            at = np.concatenate([np.arange(starts[r], ends[r]) for r in rows])
            sizes = ends[rows] - starts[rows]
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            i, x = index[at], value[at].astype(np.float64)
            error = model.score(i, x, begin) - y[rows]
            v, s = model.sums(i, x, begin)
            each = np.repeat(error, sizes)
            d_linear = np.bincount(i, each * x, features.size) / len(rows)
            d_factors = (each * x)[:, None] * (np.repeat(s, sizes, axis=0) - v)
            d_factors = np.column_stack([np.bincount(i, d_factors[:, f], features.size) for f in range(FACTORS)]) / len(rows)
            d_linear += decay * model.linear
            d_factors += decay * model.factors
            g_linear += d_linear**2
            g_factors += d_factors**2
            g_bias += error.mean() ** 2
            model.linear -= step * d_linear / np.sqrt(g_linear)
            model.factors -= step * d_factors / np.sqrt(g_factors)
            model.bias -= step * error.mean() / np.sqrt(g_bias)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, metadata: tuple[str, ...], usable, limit: int):
    """(id, label, buckets, bins, metadata) of at most ``limit`` labelled documents, chosen by a
    hash of the id alone; of several texts of one id the least by its digest.

    Only the ids are sent to the scan of ``docs``, so its text isn't shuffled, and what comes
    back is a text's distinct buckets: ``2**WORD_BITS`` numbers at most, however long it is.
    """
    chosen = (
        labels.filter(F.col(id).isNotNull() & F.col(label).isin(0, 1) & usable(F.col(id)))
        .groupBy(id).agg(F.min(label).alias("label"))
        .orderBy(F.xxhash64(id), id).limit(limit).select(F.col(id).alias("id"), "label")
    )
    found = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"), F.array(*[F.col(m).cast("double") for m in metadata]).cast("array<double>").alias("metadata"))
    met = found.join(F.broadcast(chosen), "id")

    def run(batches):
        features = Features(0)
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                texts = part.column(1).to_pylist()
                words, stats = zip(*map(features.buckets, texts))
                digests = [hashlib.sha256(t.encode()).digest() for t in texts]
                columns = [part.column(0), part.column(3), part.column(2), pa.array(digests, pa.binary()), pa.array(words, pa.list_(pa.int32())), pa.array(stats, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "metadata", "digest", "words", "stats"])

    kinds = f"id {docs.schema[id].dataType.simpleString()}, label {chosen.schema['label'].dataType.simpleString()}"
    rows = met.select("id", "text", "metadata", "label").mapInArrow(run, f"{kinds}, metadata array<double>, digest binary, words array<int>, stats array<int>")
    return rows.groupBy("id").agg(F.min(F.struct("digest", "metadata", "label", "words", "stats")).alias("row")).select("id", "row.*").collect()


def quality_scores(docs: DataFrame, labels: DataFrame, usable=lambda id: F.lit(True), id: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = ("n_chars",), max_train_rows: int = MAX_TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (score >= threshold).

    The machine is fitted on at most ``max_train_rows`` labelled rows that ``usable`` lets
    through, of which only buckets of words come to the driver; every row of ``docs`` is scored whole, in one pass without an exchange. A null
    text counts as empty and is scored by its structure; null metadata has a bin of its own;
    labels other than 0 and 1 and ids that ``docs`` lacks teach nothing; of several labels of
    an id the lower counts. Without any labels all scores are 0.5. Equal texts with equal
    metadata have equal scores. Columns named like a result are replaced.
    """
    taught = sorted(training_rows(docs, labels, id, text, label, metadata, usable, max_train_rows), key=lambda r: str(r["id"]))
    model = fit([(sorted(r["words"]), r["stats"]) for r in taught], [[r["metadata"][i] for r in taught] for i in range(len(metadata))], [r["label"] for r in taught]) if taught else None
    if model is not None:
        model = Machine(model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32))
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = StructType([docs.schema[c] for c in kept]).add("score", DoubleType()).add("predicted", IntegerType())
    position, of_meta = kept.index(text), [kept.index(m) for m in metadata]

    def run(batches):
        features = Features(len(of_meta))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [t or "" for t in part.column(position).to_pylist()]
                if model is None:
                    score = np.full(len(texts), 0.5)
                else:
                    score = model.score(*features.rows(list(map(features.buckets, texts)), [part.column(m).to_pylist() for m in of_meta])).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return docs.select(*kept).mapInArrow(run, schema)
