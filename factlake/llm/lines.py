"""Line dedup by range-partitioned, sorted line hashes and per-document keep bitmaps."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from factlake.llm.common import free_name, row_key, stored

_STRIP = b" \t\n\x0b\x0c\r"
LINES = "h1 long, h2 long, row binary, position int"
FOUND = "h1 long, h2 long, documents long, row binary, position int, part int, kind int"
DROP, OPEN, TALLY = 0, 1, 2


def line_keys(text: str) -> list[bytes]:
    """Each line stripped of ASCII white space, with A-Z lower-cased."""
    return [x.strip(_STRIP) for x in text.encode().lower().split(b"\n")]


def _hashes(min_chars: int):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                rows, position, digests = [], [], []
                for row, text in zip(batch.column(0).slice(a, 1000).to_pylist(), batch.column(1).slice(a, 1000).to_pylist()):
                    for i, key in enumerate(line_keys(text or "")):
                        if len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars):
                            rows.append(row)
                            position.append(i)
                            digests.append(xxhash.xxh3_128_digest(key))
                two = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.array(rows, pa.binary()), pa.array(position, pa.int32())], names=["h1", "h2", "row", "position"])

    return run


def _streamed(min_docs: int):
    """Walks a sorted partition once. Groups that end inside it are decided here. Its first and
    last group may go on in a neighbour: they leave a tally, and lines only while the group has
    fewer than ``min_docs`` documents here, so what stays open is small."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        key, documents, last_row, held, first = None, 0, None, [], True
        out: list[tuple] = []

        def close(at_edge: bool) -> None:
            if key is not None and at_edge:
                out.append((*key, documents, None, None, part, TALLY))
                out.extend((*key, None, *x, part, OPEN) for x in held)

        def flush():
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int32()] * 3
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["h1", "h2", "documents", "row", "position", "part", "kind"])
            out.clear()
            return batch

        for batch in batches:
            h1, h2, position = (batch.column(c).to_numpy() for c in (0, 1, 3))
            # lines that differ from both neighbours are decided at once, unless at an edge
            same = np.zeros(len(h1) + 1, bool)
            same[1:-1] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            alone = ~same[:-1] & ~same[1:] & (min_docs > 1)
            if len(alone):
                alone[[0, -1]] = False
            seen = np.flatnonzero(~alone)
            for i, r in zip(seen.tolist(), batch.column(2).take(pa.array(seen)).to_pylist()):
                now = (int(h1[i]), int(h2[i]))
                if now != key:
                    close(first)
                    first = key is None
                    key, documents, last_row, held = now, 0, None, []
                if r != last_row:
                    documents, last_row = documents + 1, r
                    if documents == min_docs:
                        out.extend((None, None, None, *x, part, DROP) for x in held)
                        held = []
                if documents < min_docs:
                    held.append((r, int(position[i])))
                else:
                    out.append((None, None, None, r, int(position[i]), part, DROP))
                if len(out) >= 50_000:
                    yield flush()
        close(True)
        yield flush()

    return run


def keep_bitmap(n_lines: int, dropped) -> bytes:
    """Bit i of the packed, zlib-compressed bytes: line i stays."""
    keep = np.ones(n_lines, np.uint8)
    keep[list(dropped)] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def read_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def line_keep_bitmaps(docs: DataFrame, text: str = "text", id: str = "doc_id", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(row, covered, n_dropped, keep): which lines of each document stay; ``row`` is
    ``row_key(id, text)``, ``keep`` a compressed bitmap of the first ``covered`` lines.

    A line goes if its key has ``min_chars`` code points and is found in ``min_docs`` documents.
    Line hashes of 128 bits are range-partitioned with the document, sorted by hash, document
    and position, and streamed; a hot line is spread over as many partitions as it fills.
    A null text is one empty line. A document is an id with a text, so repeated rows count once
    and share a bitmap; null ids are documents like others. Only documents that lose lines
    have rows here; other documents, and lines past ``covered``, stay whole. An empty table gives no rows.
    """
    named = docs.select(row_key(id, text).alias("row"), F.col(text).alias("text"))
    lines = named.mapInArrow(_hashes(min_chars), LINES)
    placed = lines.repartitionByRange("h1", "h2", "row").sortWithinPartitions("h1", "h2", "row", "position")
    found = stored(placed.mapInArrow(_streamed(min_docs), FOUND), "line-groups")
    tallies = found.filter(F.col("kind") == TALLY).groupBy("h1", "h2").agg(F.sum("documents").alias("total")).filter(F.col("total") >= min_docs)
    dropped = found.filter(F.col("kind") == DROP).select("row", "position")
    edge = found.filter(F.col("kind") == OPEN).join(tallies, ["h1", "h2"]).select("row", "position")
    gone = dropped.unionAll(edge).groupBy("row").agg(F.collect_set("position").alias("gone"))

    def run(batches):
        for batch in batches:
            gone = batch.column(1).to_pylist()
            sizes = [max(g) + 1 for g in gone]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(map(len, gone), pa.int64()), pa.array(map(keep_bitmap, sizes, gone), pa.binary())], names=["row", "covered", "n_dropped", "keep"])

    return gone.mapInArrow(run, "row binary, covered int, n_dropped long, keep binary")


def line_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` less its dropped lines (see ``line_keep_bitmaps``), and ``n_lines``
    (before), ``n_dropped`` and ``kept_sha256``. A text that loses all lines is empty; a null
    text stays null with one line and the digest of the empty string."""
    results = {"n_lines": LongType(), "n_dropped": LongType(), "kept_sha256": StringType()}
    row, covered, keep = (free_name(docs, c) for c in ("row", "covered", "keep"))
    bitmaps = line_keep_bitmaps(docs, text, id, min_docs, min_chars).select(F.col("row").alias(row), F.col("covered").alias(covered), F.col("keep").alias(keep))
    kept = [c for c in docs.columns if c not in results]
    joined = docs.select(*kept, row_key(id, text).alias(row)).join(bitmaps, row, "left").select(*kept, covered, keep)
    schema = StructType([docs.schema[c] for c in kept])
    for name, kind in results.items():
        schema = schema.add(name, kind)
    at = kept.index(text)

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                texts, n_lines, n_dropped, digests = [], [], [], []
                for t, covered, keep in zip(batch.column(at).to_pylist(), *(batch.column(len(kept) + i).to_pylist() for i in (0, 1))):
                    lines = (t or "").split("\n")
                    n_lines.append(len(lines))
                    if keep is not None:
                        stays = read_bitmap(keep, covered)
                        lines = [x for x, k in zip(lines, stays) if k] + lines[covered:]
                        t = None if t is None else "\n".join(lines)
                    n_dropped.append(n_lines[-1] - len(lines))
                    texts.append(t)
                    digests.append(hashlib.sha256((t or "").encode()).hexdigest())
                columns = batch.columns[: len(kept)]
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())], names=schema.names)

    return joined.mapInArrow(run, schema)
