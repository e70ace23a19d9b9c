"""Substring dedup: FM-indexes of shards, matching statistics of streamed documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from factlake.llm.common import free_name, maybe_in, stored
from factlake.llm.fm import FmIndex
from factlake.llm.near import _MIX, _mix

GRAM, WORD_BYTES = 3, 6
#: Bits of the filter of wanted anchors (8 MB), the most keys it takes, and the documents from
#: which on an anchor's windows stand for themselves.
FILTER_BITS, FILTER_KEYS, HOT = 1 << 26, 1 << 24, 2000
#: Bytes of text that are taken at once, and bytes of them that are hashed at once.
SLICE, PIECE = 1 << 21, 1 << 17

#: An odd base of a polynomial hash modulo 2**64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class Powers:
    """Powers of the base and of its inverse, as many as were ever asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << int(n - 1).bit_length()
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return self.up[:n], self.down[:n]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of the texts with ``SLICE`` bytes or one text."""
    offsets = utf8(texts)[0]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, min(end, len(texts))
        at = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where each text begins and the last one ends, bytes of all) without a copy."""
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


class Anchored:
    """Words of documents and their windows' anchors, for many documents at once.

    A window's anchor is one of its word triples: that with the longest words, then the least
    hash. Equal windows have equal anchors, so windows need only be sought among those of their
    anchor. Neighbouring windows mostly share one, and make a run.
    """

    def __init__(self, window: int) -> None:
        self.window, self.powers = window, Powers()

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words, number of words of each text). A word is 56 bits of its hash, then 8 of its
        length; words are what stands between space, tab, line feed, vertical tab, form feed
        and carriage return. They are hashed where they lie, by differences of running sums."""
        offsets, data = utf8(texts)
        n = len(data)
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        gap = _SPACE[data]
        first = ~gap
        first[1:] &= gap[:-1] | begins[1:n]
        last = ~gap
        last[:-1] &= gap[1:] | begins[1:n]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            a = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, a + PIECE, side="right")))
            b = ends[to - 1]
            if b - a > PIECE:
                hashes[at] = xxhash.xxh3_64_intdigest(data[a:b])
            else:
                up, down = self.powers(PIECE)
                sums = np.zeros(b - a + 1, np.uint64)
                np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
                hashes[at:to] = (sums[ends[at:to] - a] - sums[starts[at:to] - a]) * down[starts[at:to] - a]
            at = to
        size = ends - starts
        words = _mix(hashes + size.astype(np.uint64) * _MIX[0]) >> np.uint64(8) << np.uint64(8)
        return words | np.minimum(size, 255).astype(np.uint64), np.diff(np.searchsorted(starts, offsets))

    def runs(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, document, first word, windows) of each run of windows within a document."""
        n = len(words) - self.window + 1
        if n < 1:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        gram = min(GRAM, self.window)
        m = len(words) - gram + 1
        h, size = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        for i in range(gram):
            h = _mix(h + _MIX[0]) ^ words[i : i + m]
            size += words[i : i + m] & np.uint64(255)
        least = ((np.uint64(255) - np.minimum(size, np.uint64(255))) << np.uint64(56)) | (_mix(h) >> np.uint64(8))
        width, over = 1, self.window - gram + 1
        while width < over:  # minima of twice the width, and at last of the whole window
            step = min(width, over - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        doc = np.repeat(np.arange(len(sizes)), sizes)
        inside = doc[:n] == doc[self.window - 1 :]
        starts = np.flatnonzero(inside & np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:n] != doc[: n - 1]))))
        # windows that cross into the next document end a run too
        after = np.cumsum(np.concatenate(([0], inside)))
        ends = np.append(starts[1:], n)
        return least[starts], doc[starts], starts, after[ends] - after[starts]


def _anchors(window: int, with_row: bool = False):
    """The anchors of each document, once each: (anchor, id), and its row."""

    def run(batches):
        tool = Anchored(window)
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                anchor, doc, _, _ = tool.runs(*tool.words(part.column(2)))
                order = np.lexsort((anchor, doc))
                anchor, doc = anchor[order], doc[order]
                new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, bool)
                at = pa.array(doc[new])
                columns = [pa.array(anchor[new].view(np.int64)), part.column(0).take(at)] + ([part.column(1).take(at)] if with_row else [])
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "id", "row"][: len(columns)])

    return run


class Wanted:
    """Which anchors are wanted, and which are hot: by filters for all documents or by lists."""

    def __init__(self, wanted: bytes | None, hot: bytes | None) -> None:
        self.wanted, self.hot = (None if x is None else np.frombuffer(x, np.uint8) for x in (wanted, hot))

    @staticmethod
    def _in(bits: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        at = (anchors & np.uint64(FILTER_BITS - 1)).astype(np.int64)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def __call__(self, anchors: np.ndarray, doc: np.ndarray, lists) -> tuple[np.ndarray, np.ndarray]:
        """Of each anchor of each document: is it wanted, is it hot."""
        if lists is None:
            return self._in(self.wanted, anchors), self._in(self.hot, anchors)
        out = []
        for column in lists:
            hit = np.zeros(len(anchors), bool)
            for d, wanted in enumerate(column):
                if wanted:
                    own = slice(*np.searchsorted(doc, [d, d + 1]))
                    hit[own] = np.isin(anchors[own], np.array(wanted, np.int64).view(np.uint64))
            out.append(hit)
        return out[0], out[1]


def told(keyed: DataFrame, anchors: DataFrame, window: int, filter_keys: int) -> tuple[DataFrame, Broadcast]:
    """``keyed`` and filters of the ``anchors`` (anchor, hot): 16 MB to all; where these are too
    many for a filter, each document is told its own by a join instead."""
    context = keyed.sparkSession.sparkContext
    if anchors.limit(filter_keys + 1).count() <= filter_keys:
        return keyed, context.broadcast((filter_bytes(anchors), filter_bytes(anchors.filter("hot"))))
    pairs = keyed.mapInArrow(_anchors(window, True), "anchor long, id long, row long").join(anchors, "anchor")
    lists = pairs.groupBy("id", "row").agg(F.collect_set("anchor").alias("wanted"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    return keyed.join(lists, ["id", "row"]).select("id", "row", "text", "wanted", "hot"), context.broadcast((None, None))


PLACES = "key long, content long, id long, row long, start int, windows int"
PASSAGES = "key long, content long, id long, words binary"


def _passages(window: int, filters, with_words: bool):
    """The runs of wanted anchors, as ``PLACES`` or with their words as ``PASSAGES``. A hot
    anchor's windows come one by one under their own hash, so that no shard gathers them."""

    def run(batches):
        tool, wanted = Anchored(window), Wanted(*filters.value)
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                lists = [part.column(i).to_pylist() for i in (3, 4)] if part.num_columns > 3 else None
                words, sizes = tool.words(part.column(2))
                anchor, doc, start, count = tool.runs(words, sizes)
                chosen, hot = wanted(anchor, doc, lists)
                anchor, doc, start, count, hot = (x[chosen] for x in (anchor, doc, start, count, hot))
                pieces = np.where(hot, count, 1)
                nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                anchor, doc, hot = (np.repeat(x, pieces) for x in (anchor, doc, hot))
                start = np.repeat(start, pieces) + nth
                count = np.where(hot, 1, np.repeat(count, pieces))
                length = count + window - 1
                up, down = tool.powers(len(words) + 1)
                sums = np.zeros(len(words) + 1, np.uint64)
                np.cumsum((words >> np.uint64(16)) * up[: len(words)], out=sums[1:])
                content = _mix((sums[start + length] - sums[start]) * down[start] + length.astype(np.uint64))
                key = np.where(hot, content, anchor)
                at = pa.array(doc)
                columns = [pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), part.column(0).take(at)]
                if with_words:
                    packed = (words >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
                    index = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length - start, length)
                    ends = np.concatenate([[0], np.cumsum(length * WORD_BYTES)]).astype(np.int32)
                    columns.append(pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(packed[index]))]))
                else:
                    first = np.cumsum(sizes) - sizes
                    columns += [part.column(1).take(at), pa.array((start - first[doc]).astype(np.int32)), pa.array(count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in (PASSAGES if with_words else PLACES).split(", ")])

    return run


def _symbols(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words, number of words of each passage)."""
    raw = np.frombuffer(b"".join(contents), np.uint8).reshape(-1, WORD_BYTES)
    words = np.zeros((len(raw), 8), np.uint8)
    words[:, :WORD_BYTES] = raw
    return words.view(np.uint64).ravel(), np.array([len(c) // WORD_BYTES for c in contents], np.int64)


def earlier_ids(held: list[bytes], ids: np.ndarray, streamed: list[bytes], own: np.ndarray, window: int) -> list[np.ndarray]:
    """For each window of the ``streamed`` passages: the least id of a passage ``held`` in the
    index that has it, or the streamed passage's own, if that is less.

    The held passages are indexed and the others are matched against them by backward search:
    a window is found where the match from its first word on is ``window`` words long, and the
    interval of that match names the least id.
    """
    index = FmIndex(*_symbols(held), window, ids)
    words, lengths = _symbols(streamed)
    size, where = index.matching_statistics(words, lengths)
    out = np.repeat(own, lengths)
    found = size >= window
    out[found] = np.minimum(out[found], index.least(where[found]))
    return [part[: 1 - window] for part in np.split(out, np.cumsum(lengths)[:-1])]


def _searched(window: int, shard_words: int = 200_000):
    """(key, content, low, least) of a partition's shards: rows come sorted by key and least id,
    and a shard ends between two keys.

    Of the passages of a key, the one with the least id comes first and loses nothing to the
    others, so it isn't streamed; the last one takes nothing from others, so it isn't held.
    ``least`` is null where no window has a lesser id than the whole passage.
    """

    def run(batches):
        rows: list[tuple] = []
        size = 0

        def search():
            keys, contents, low, high, blobs = zip(*rows)
            low = np.array(low, np.int64)
            first = np.array([i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))])
            last = np.append(first[1:], True)
            held, streamed = np.flatnonzero(~last), np.flatnonzero(~first)
            least = [None] * len(keys)
            if len(streamed):
                for i, ids in zip(streamed.tolist(), earlier_ids([blobs[i] for i in held], low[held], [blobs[i] for i in streamed], low[streamed], window)):
                    if ids.min() < low[i]:
                        least[i] = ids
            use = [i for i in range(len(keys)) if not (first[i] and last[i]) and (low[i] < high[i] or least[i] is not None)]
            return pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i in use], pa.int64()), pa.array([contents[i] for i in use], pa.int64()), pa.array(low[use]), pa.array([least[i] for i in use], pa.list_(pa.int64()))],
                names=["key", "content", "low", "least"],
            )

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= shard_words and x[0] != rows[-1][0]:
                    yield search()
                    rows, size = [], 0
                rows.append(x)
                size += len(x[4]) // WORD_BYTES
        if rows:
            yield search()

    return run


def text_row(id: str, text: str):
    """(id, row): what tells a document from others, apart from repeated rows."""
    return F.col(id).cast("long"), F.xxhash64(text)


def removed_windows(docs: DataFrame, window: int = 13, text: str = "text", id: str = "doc_id", filter_keys: int = FILTER_KEYS, hot: int = HOT) -> DataFrame:
    """(id, row, starts): the windows of each document that a document with a smaller id has too,
    as lists of their first words.

    Anchors of runs of windows are counted first; only runs whose anchor two ids share go on.
    Where all runs of an anchor have the same words, the least id decides. Where they differ,
    each distinct passage reaches its anchor's shard once, with its least and greatest id, and
    is searched in the FM-index over the shard's earlier passages.
    """
    own, row = text_row(id, text)
    keyed = docs.filter(F.col(id).isNotNull() & F.col(text).isNotNull()).select(own.alias("id"), row.alias("row"), F.col(text).alias("text"))
    counted = keyed.mapInArrow(_anchors(window), "anchor long, id long").groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    shared = stored(counted.filter("low < high").select("anchor", (F.col("n") > hot).alias("hot")), "anchors")
    source, filters = told(keyed, shared, window, filter_keys)
    places = stored(source.mapInArrow(_passages(window, filters, False), PLACES), "places")

    contents = stored(places.groupBy("key", "content").agg(F.min("id").alias("low"), F.max("id").alias("high")), "contents")
    several = stored(contents.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("anchor"), F.lit(False).alias("hot")), "several")
    alone = contents.filter("low < high").join(several.select(F.col("anchor").alias("key")), "key", "left_anti").select("key", "content", "low", F.lit(None).cast("array<bigint>").alias("least"))
    source, filters = told(keyed, several, window, filter_keys)
    distinct = source.mapInArrow(_passages(window, filters, True), PASSAGES).groupBy("key", "content", "words").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    sorted_ = distinct.select("key", "content", "low", "high", "words").repartition("key").sortWithinPartitions("key", "low", "content")
    searched = sorted_.mapInArrow(_searched(window), "key long, content long, low long, least array<long>")
    decided = stored(alone.unionAll(searched), "decided")

    hits = maybe_in(places, "content", decided).join(decided, ["key", "content"]).filter("least IS NOT NULL OR low < id")
    nth = F.filter(F.transform("least", lambda low, k: F.when(low < F.col("id"), F.col("start") + k)), lambda at: at.isNotNull())
    starts = F.when(F.col("least").isNull(), F.sequence("start", F.col("start") + F.col("windows") - 1)).otherwise(nth)
    return hits.select("id", "row", starts.alias("starts")).filter(F.size("starts") > 0).groupBy("id", "row").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def filter_bytes(anchors: DataFrame) -> bytes:
    """A filter of ``FILTER_BITS`` bits of the anchors, whatever their number."""
    bit = F.col("anchor").bitwiseAND(FILTER_BITS - 1) + 1  # Spark's bitmaps count from 1
    parts = anchors.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8)
    for part, bits in parts:
        out[(part - 1) * 4096 : part * 4096] = bits
    return bytes(out)


def substring_dedup(docs: DataFrame, window: int = 13, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with ``text`` as its kept words joined by one space, and ``n_words`` (before),
    ``n_removed`` and ``kept_sha256``.

    A word goes if a window of ``window`` consecutive words covers it whose words also begin in
    a document with a smaller id; all is judged on the input. Words hash to 48 bits, so two
    windows that differ in one word are taken for equal once in 2**48 such pairs. A null text
    has no words and stays null; null ids neither lose words nor take any; repeated rows (and
    other texts of one id) take nothing from each other. Ids are integers. Columns named like a
    result are replaced; an empty table gives an empty one.
    """
    results = {"n_words": LongType(), "n_removed": LongType(), "kept_sha256": StringType()}
    removed = stored(removed_windows(docs, window, text, id, **options), "removed-windows")
    kept = [c for c in docs.columns if c not in results]
    own, row, both, starts = (free_name(docs, c) for c in ("own", "row", "both", "starts"))
    of_id, of_text = text_row(id, text)
    keyed = docs.select(*kept, of_id.alias(own), of_text.alias(row)).withColumn(both, F.xxhash64(own, row))
    wanted = removed.select(F.col("id").alias(own), F.col("row").alias(row), F.col("starts").alias(starts), F.xxhash64("id", "row").alias(both))
    # documents that lose nothing stay where they are; the filter tells them, all but a few
    touched = maybe_in(keyed, both, wanted).join(wanted.drop(both), [own, row], "left").select(*kept, starts)
    whole = maybe_in(keyed, both, wanted, inverse=True).select(*kept, F.lit(None).cast("array<int>").alias(starts))
    schema = StructType([docs.schema[c] for c in kept])
    for name, kind in results.items():
        schema = schema.add(name, kind)
    at = kept.index(text)

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                texts, counts, gone, digests = [], [], [], []
                for t, starts in zip(batch.column(at).to_pylist(), batch.column(len(kept)).to_pylist()):
                    words = (t or "").encode().split()
                    n = len(words)
                    if starts:
                        cover = np.zeros(n + 1, np.int64)
                        np.add.at(cover, np.array(starts), 1)
                        np.add.at(cover, np.array(starts) + window, -1)
                        words = [w for w, c in zip(words, np.cumsum(cover).tolist()) if not c]
                    joined = b" ".join(words)
                    counts.append(n)
                    gone.append(n - len(words))
                    digests.append(hashlib.sha256(joined).hexdigest())
                    texts.append(None if t is None else joined.decode())
                columns = batch.columns[: len(kept)]
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], names=schema.names)

    return touched.unionAll(whole).mapInArrow(run, schema)
