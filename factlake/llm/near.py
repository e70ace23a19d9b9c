"""Near-duplicates by Order MinHash, verified by banded alignment of words."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm.common import free_name, maybe_in, row_key, stored

K, SKETCHES, PICKS, THRESHOLD = 5, 24, 2, 0.8
#: Texts of up to SHORT shingles also meet by each of their shingles. Texts of up to 24 are
#: aligned at the threshold with none of more than 30.
SHORT = 30
#: Rows of a sketch group that are held at once; larger groups are dealt into blocks of so many.
BLOCK = 1024
#: Keys of 16 bytes that are broadcast at most.
BROADCAST_KEYS = 500_000
#: Counters of a text's words. Two texts' counters differ by no more than their words do.
BINS = 256

_WORDS = re.compile(r"\w+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Words of texts and their occurrence-labelled k-mers, as 64-bit numbers in text order."""

    def __init__(self, k: int = K, max_words: int = 60_000) -> None:
        self.k, self.max_words, self.known = k, max_words, {}

    def words(self, text: str) -> np.ndarray:
        words = _WORDS(text.lower())
        if len(self.known) > self.max_words:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def of(self, w: np.ndarray) -> np.ndarray:
        """The i-th occurrence of a k-mer differs from the others. A text with fewer than k
        words is one k-mer of all its words; one without words has none."""
        if not len(w):
            return w
        n = max(1, len(w) - self.k + 1)
        h = np.zeros(n, np.uint64)
        for i in range(min(self.k, len(w))):
            h = _mix(h + _MIX[0]) ^ w[i : i + n]
        h = _mix(h)
        order = np.argsort(h, kind="stable")
        s = h[order]
        starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        if len(starts) < n:
            nth = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            label = np.empty(n, np.uint64)
            label[order] = nth.astype(np.uint64)
            h = np.where(label > 0, _mix(h + label * _MIX[0]), h)
        return h


def order_sketches(shingles: np.ndarray, sketches: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """For each of ``sketches`` hash functions: the ``picks`` least k-mers, put back into text
    order and hashed together. Texts with fewer k-mers take all they have."""
    n = min(picks, len(shingles))
    at = np.empty((sketches, n), np.int64)
    seeds = (np.arange(1, sketches + 1, dtype=np.uint64) * _MIX[0])[:, None]
    block = max(1, 200_000 // len(shingles))
    for i in range(0, sketches, block):
        x = _mix(shingles[None, :] ^ seeds[i : i + block])
        lane = np.arange(len(x))
        for k in range(n):
            at[i : i + block, k] = least = x.argmin(axis=1)
            x[lane, least] = np.iinfo(np.uint64).max
    at.sort(axis=1)
    h = np.arange(sketches, dtype=np.uint64)
    for k in range(n):
        h = _mix(h + _MIX[0]) ^ shingles[at[:, k]]
    return h


def word_counts(words: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.bincount((words % np.uint64(BINS)).astype(np.int64), minlength=BINS)).astype(np.uint8)


def least_kept(longer: int, threshold: float = THRESHOLD) -> int:
    """Words that an alignment must keep where the longer text has ``longer``."""
    return int(np.ceil(longer * threshold - 1e-9))


def kept_words(a: list[int], b: list[int], least: int) -> int:
    """Most words that an alignment keeps in order, if these are ``least`` or more; else -1.

    The alignment stays within the band that ``least`` kept words can't leave: a word is kept
    at positions that differ by no more than the words lost before it. A row of the band is one
    integer, in which a bit is 0 where one more word is kept (the longest common subsequence by
    additions on bits); the band moves on by a bit for each word of ``a``.
    """
    n, m = len(a), len(b)
    before, after = n - least, m - least
    if before < 0 or after < 0:
        return -1
    places: dict[int, int] = {}
    for j, word in enumerate(b):
        places[word] = places.get(word, 0) | 1 << j
    width = before + after + 1
    top, full = 1 << width - 1, (1 << width) - 1
    row, kept = full, 0  # kept: those that have left the band
    for i, word in enumerate(a):
        if (met := places.get(word, 0)) and (met := row & (met >> i - before if i > before else met << before - i)):
            row = (row + met | row - met) & full
        if not row & 1:
            kept += 1
        row = row >> 1 | top
        if not i & 63 and kept + width - row.bit_count() + n - 1 - i < least:
            return -1
    kept += width - row.bit_count()
    return kept if kept >= least else -1


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Words that an alignment keeps, as a share of the longer text's; 0 below the threshold."""
    longer = max(len(a), len(b))
    return max(0, kept_words(a.tolist(), b.tolist(), least_kept(longer, threshold))) / longer if longer else 0.0


def _sketched(batches):
    shingles = Shingles()
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            row, texts = (batch.column(c).slice(a, 500) for c in (0, 1))
            lengths, sketches, singles, counts = [], [], [], []
            for text in texts.to_pylist():
                w = shingles.words(text)
                s = shingles.of(w)
                lengths.append(len(w))
                sketches.append((order_sketches(s) if len(s) else s).view(np.int64))
                singles.append((_mix(s ^ _MIX[2]) if len(s) <= SHORT else s[:0]).view(np.int64))
                counts.append(word_counts(w).tobytes())
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(lengths, pa.int32()), pa.array(sketches, pa.list_(pa.int64())), pa.array(singles, pa.list_(pa.int64())), pa.array(counts, pa.binary())],
                names=["row", "length", "sketches", "singles", "counts"],
            )


def _tokenised(batches):
    shingles = Shingles()
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            row, texts = (batch.column(c).slice(a, 500) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([row, pa.array([shingles.words(t).astype(np.uint32).tobytes() for t in texts.to_pylist()], pa.binary())], names=["row", "words"])


def _verified(batches):
    """The pairs (x, y) whose words align."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            x, y, wx, wy = (c.slice(at, 200) for c in batch.columns)
            good = []
            for a, b in zip(wx, wy):
                a, b = (np.frombuffer(w.as_buffer(), np.uint32).tolist() for w in (a, b))
                good.append(kept_words(a, b, least_kept(max(len(a), len(b)))) >= 0)
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.filter(good), y.filter(good)], names=["x", "y"])


class Cell:
    """Rows of one block, or of two, of one sketch group: which pairs may be similar.

    A pair is left out only for what rules it out: its texts are in one class, or the longer has
    too many words, or their words' counts differ by more than an alignment may lose, or another
    key of both is the one that gives this pair.
    """

    def __init__(self, key: int, split: bool, columns: dict[str, list]) -> None:
        self.key, self.split = key, split
        self.rows, self.block = columns["row"], np.array(columns["block"])
        classes: dict[bytes, int] = {}
        self.root = np.array([classes.setdefault(r, len(classes)) for r in columns["root"]])
        self.length = np.array(columns["length"], np.int64)
        self.sketches = np.array(columns["sketches"], np.int64)
        self.singles = columns["singles"]
        self.counts = np.frombuffer(b"".join(columns["counts"]), np.uint8).reshape(-1, BINS)

    def pairs(self, lo: int, hi: int):
        if not self.split:
            ends = np.arange(len(self.rows)), np.arange(len(self.rows))
        else:
            ends = np.flatnonzero(self.block == lo), np.flatnonzero(self.block == hi)
        least = np.ceil(self.length * THRESHOLD - 1e-9).astype(np.int64)
        for a in range(0, len(ends[0]), 256):
            i, j = ends[0][a : a + 256, None], ends[1][None, :]
            able = (self.root[i] != self.root[j]) & (self.length[i] >= least[j]) & (self.length[j] >= least[i])
            if lo == hi:
                able &= i < j
            x, y = np.nonzero(able)
            x, y = ends[0][a + x], ends[1][y]
            for at in range(0, len(x), 20_000):
                yield from self.ruled(x[at : at + 20_000], y[at : at + 20_000], least)

    def ruled(self, x: np.ndarray, y: np.ndarray, least: np.ndarray):
        lost = self.length[x] + self.length[y] - 2 * np.maximum(least[x], least[y])
        apart = np.abs(self.counts[x].astype(np.int16) - self.counts[y]).sum(axis=1, dtype=np.int64)
        x, y = x[apart <= lost], y[apart <= lost]
        same = self.sketches[x] == self.sketches[y]
        first = same.argmax(axis=1)
        shared = same.any(axis=1)
        for a, b, s, j in zip(x.tolist(), y.tolist(), shared.tolist(), first.tolist()):
            if (self.sketches[a, j] if s else min(set(self.singles[a]).intersection(self.singles[b]))) == self.key:
                yield self.rows[a], self.rows[b]


CELL = "sketch, lo, hi, row, root, block, length, sketches, singles, counts".split(", ")


def _met(batches):
    """(x, y) of the pairs of each cell. Rows come sorted by cell, and one cell is held at a time."""
    held: dict[str, list] = {c: [] for c in CELL[3:]}
    cell = None

    def out():
        if cell is None or len(held["row"]) < 2:
            return
        made = Cell(cell[0], cell[1] >= 0, held).pairs(max(cell[1], 0), max(cell[2], 0))
        while part := [p for _, p in zip(range(20_000), made)]:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in zip(*part)], names=["x", "y"])

    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            keys = list(zip(*(part.column(c).to_pylist() for c in range(3))))
            columns = {c: part.column(k).to_pylist() for k, c in enumerate(CELL) if k > 2}
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != cell:
                    yield from out()
                    cell, held = keys[at], {c: [] for c in CELL[3:]}
                for c in held:
                    held[c] += columns[c][at:end]
                at = end
    yield from out()


class Held:
    """Small tables that a few steps read, on the executors' disks until they are released. What
    a lost executor had of them is made again; large ones and those of loops are written to the
    shared folder instead."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.frames.append(df.persist(StorageLevel.DISK_ONLY))
        return df

    def release(self) -> None:
        for df in self.frames:
            df.unpersist()


def components(edges: DataFrame) -> DataFrame:
    """(row, root) of the rows in ``edges`` (a, b), root the least row linked to it.

    Each round points every row to the least row beside it, follows the pointers once more and
    puts the rows' pointers for the rows in the edges, of which fewer than half stay between
    different ones; all of it are joins and grouped minima, written out between rounds. What a
    join by root reads is written before it, so that Spark can split a large class.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, roots = stored(both.distinct(), "edges"), None
    while True:
        pointers = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("row"), F.least("a", "b").alias("root"))
        pointers = stored(pointers.join(pointers.select(F.col("row").alias("root"), F.col("root").alias("up")), "root").select("row", F.col("up").alias("root")), "pointers")
        at = {end: pointers.select(F.col("row").alias(end), F.col("root").alias(f"{end}_root")) for end in ("a", "b")}
        roots = pointers if roots is None else stored(roots.join(at["a"].withColumnRenamed("a", "root"), "root", "left").select("row", F.coalesce("a_root", "root").alias("root")), "roots")
        edges = edges.join(at["a"], "a").join(at["b"], "b").filter("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        edges = stored(edges.distinct(), "edges")
        if not edges.limit(1).count():
            return roots


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` after more ``edges``: only the classes that these join are worked on."""
    for end in ("a", "b"):
        edges = edges.join(roots.select(F.col("row").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    edges = stored(edges.filter("a <> b").distinct(), "crossing")
    if not edges.limit(1).count():
        return roots
    over = components(edges)
    old = roots.join(over.select(F.col("row").alias("root"), F.col("root").alias("top")), "root", "left").select("row", F.coalesce("top", "root").alias("root"))
    return stored(old.unionAll(over.join(roots, "row", "left_anti").select("row", "root")), "roots")


def neighbours(members: DataFrame) -> DataFrame:
    """(x, y): each row of a sketch group with the one before it, by length and then by hash.

    Similar texts share several sketches, in whose groups others stand between them or don't, so
    each has several neighbours: these few pairs join nearly all of a class, however large.
    Groups are dealt into blocks first, which differ from sketch to sketch.
    """
    block = F.pmod(F.xxhash64("row", "sketch"), F.ceil(F.col("n") / BLOCK))
    order = Window.partitionBy("sketch", "block").orderBy("length", F.xxhash64("row"), "row")
    beside = members.withColumn("block", block).select("row", "length", F.lag("row").over(order).alias("y"), F.lag("length").over(order).alias("y_length"))
    near = beside.filter(F.col("y").isNotNull() & (F.least("length", "y_length") >= F.lit(THRESHOLD) * F.greatest("length", "y_length") - 1e-9))
    return near.select(F.least("row", "y").alias("x"), F.greatest("row", "y").alias("y")).distinct()


def crossing_pairs(members: DataFrame, nodes: DataFrame, roots: DataFrame, held: Held) -> DataFrame:
    """(x, y): every pair of rows that share a sketch and aren't in one class, but for those that
    lengths or word counts rule out.

    Rows meet in the cells of their group: a group of up to BLOCK rows is one cell, a larger one
    is dealt into blocks, each two of which are a cell. So a large group whose texts are
    dissimilar takes time with its square, by vector comparisons of about 0.1 microseconds a
    pair, in as many tasks as it has cells, each of which holds two blocks at most.
    """
    rooted = stored(members.join(roots, "row", "left").select("sketch", "row", "n", F.coalesce("root", "row").alias("root")), "rooted")
    several = held(rooted.groupBy("sketch").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("sketch"))
    open_ = rooted.join(several, "sketch", "left_semi")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = open_.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("row", "sketch"), F.col("blocks")).cast("int"))
    of_row = nodes.select("row", "length", "sketches", "singles", "counts")
    one = placed.filter("blocks = 1").select("sketch", F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), "row", "root", "block")
    each = placed.filter("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("sketch", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "row", "root", "block")
    cells = one.unionAll(each).join(of_row, "row").select(*CELL)
    return held(cells.repartition("sketch", "lo", "hi").sortWithinPartitions("sketch", "lo", "hi").mapInArrow(_met, "x binary, y binary"))


def linked(keyed: DataFrame, pairs: DataFrame, held: Held) -> DataFrame:
    """(a, b) of the ``pairs`` whose texts align; only texts of such rows are tokenised."""
    wanted = pairs.select(F.col("x").alias("row")).unionAll(pairs.select(F.col("y").alias("row"))).distinct()
    words = maybe_in(keyed, "row", wanted).select("row", "text").mapInArrow(_tokenised, "row binary, words binary").dropDuplicates(["row"])
    met = pairs.join(words.select(F.col("row").alias("x"), F.col("words").alias("wx")), "x").join(words.select(F.col("row").alias("y"), F.col("words").alias("wy")), "y")
    return held(met.select("x", "y", "wx", "wy").mapInArrow(_verified, "x binary, y binary")).select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(row, id, class_id, class_size, first): the near-duplicate class of each distinct row, named by its least id.

    Two texts are linked if an alignment keeps, in order, 0.8 or more of the longer one's words
    (in lower case, without punctuation) and they share a sketch; classes are what links connect.
    A sketch is a pair of occurrence-labelled five-word k-mers in text order, the least by one of
    24 hash functions. Texts of up to 30 k-mers also meet by each k-mer. Equal texts are one text
    from the start.

    First each row is aligned with its neighbours in its sketch groups, which joins nearly all of
    a class; then every pair that shares a sketch and isn't in one class yet, unless its lengths
    or word counts show that it can't align. No pair is left out for the size of its group.

    Texts without words are linked to equal texts alone; a null text counts as empty, so all
    null and empty texts are one class. Null ids are ids like others (a class of nulls alone
    has a null id); repeated rows are one row here. Very long texts are compared whole. Columns
    of other names than ``text`` and ``id`` aren't read. An empty table gives no rows.
    """
    held = Held()
    keyed = docs.select(row_key(id, text).alias("row"), F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    copies = stored(keyed.select("row", "id", row_key("text").alias("digest")).dropDuplicates(["row"]), "copies")
    texts = copies.groupBy("digest").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    texts = stored(texts, "texts")
    sketched = maybe_in(keyed, "row", texts).select("row", "text").mapInArrow(_sketched, "row binary, length int, sketches array<bigint>, singles array<bigint>, counts binary")
    nodes = stored(sketched.join(texts.select("row"), "row", "left_semi").dropDuplicates(["row"]), "nodes")

    sketches = nodes.select("row", "length", F.explode(F.concat("sketches", "singles")).alias("sketch"))
    common = held(sketches.groupBy("sketch").agg(F.count("*").alias("n")).filter("n > 1"))
    # most sketches are one row's alone: those stay out of all that follows
    members = stored(maybe_in(sketches, "sketch", common).join(common, "sketch").select("sketch", "row", "length", "n"), "members")
    roots = components(linked(keyed, held(neighbours(members)), held))
    roots = merged(roots, linked(keyed, crossing_pairs(members, nodes, roots, held), held))

    of_text = held(texts.join(roots, "row", "left").select("digest", F.coalesce("root", "row").alias("class"), "copies", "least", "first"))
    named = of_text.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.min("first").alias("first"))
    named = held(named.select("class", "class_id", "class_size", F.col("first.row").alias("first_row")))
    found = stored(of_text.select("digest", "class").join(named, "class").select("digest", "class_id", "class_size", "first_row"), "found")
    held.release()
    return copies.join(found, "digest").select("row", "id", "class_id", "class_size", (F.col("row") == F.col("first_row")).alias("first"))


def near_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each class, that with the least id, nulls last.

    Rows that repeat id and text are one document, so one of them stays. Null and empty texts
    are one class. All columns are kept, whatever their names; an empty table gives an empty one.
    Texts stay where they are: the keys of what goes are broadcast, if they are few, and else
    only texts that a filter of fixed size doesn't clear are exchanged, as are repeated rows.
    """
    row = free_name(docs, "row")
    keyed = docs.withColumn(row, row_key(id, text))
    gone = stored(near_duplicates(docs, text, id).filter(~F.col("first")).select(F.col("row").alias(row)), "gone")
    if gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        left = keyed.join(F.broadcast(gone), row, "left_anti").select(keyed.columns)
    else:
        left = maybe_in(keyed, row, gone, inverse=True).unionByName(maybe_in(keyed, row, gone).join(gone, row, "left_anti"))
    twice = stored(keyed.groupBy(row).agg(F.count("*").alias("n")).filter("n > 1").select(row), "twice")
    if twice.limit(1).count():
        left = maybe_in(left, row, twice, inverse=True).unionByName(maybe_in(left, row, twice).dropDuplicates([row]))
    return left.select(docs.columns)
