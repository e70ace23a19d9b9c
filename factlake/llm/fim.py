"""Fill-in-middle transformation: texts cut at two random units, found by counting units in overlapping chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import free_name

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes in a chunk, and in the stretch of chunks that is looked at at once.
CHUNK, STRETCH = 1 << 12, 1 << 20

_LETTER, _INNER = 1, 2  # an ASCII letter; a byte inside a code point
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = _LETTER
_KIND[0x80:0xC0] = _INNER


def starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which bytes of ``data[1:]`` start a unit (a run of letters, or any other code point): each
    but the letters after letters and the bytes inside a code point. ``data[0]`` is the byte
    before, and ``first`` tells which bytes begin a text."""
    kind = _KIND[data]
    here, before = kind[1:], kind[:-1]
    return (here != _INNER) & ((here != _LETTER) | (before != _LETTER) | first)


class Chunks:
    """The texts of a batch, laid end to end, in chunks that each see the byte before them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK, stretch: int = STRETCH) -> None:
        self.data, self.offsets = data, offsets
        per_text = -(-np.diff(offsets) // chunk)
        self.first = np.concatenate([[0], np.cumsum(per_text)])  # a text's first chunk
        inside = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per_text)
        self.text = np.repeat(np.arange(len(per_text)), per_text)
        self.begin = offsets[self.text] + inside * chunk
        self.end = np.minimum(self.begin + chunk, offsets[self.text + 1])
        self.opens = inside == 0
        self.count(stretch)

    def marks(self, a: int, b: int) -> np.ndarray:
        """``starts`` of the chunks a to b - 1."""
        low, high = self.begin[a], self.end[b - 1]
        seen = self.data[low - 1 : high] if low else np.concatenate([[0], self.data[:high]]).astype(np.uint8)
        first = np.zeros(high - low, bool)
        first[(self.begin[a:b] - low)[self.opens[a:b]]] = True
        return starts(seen, first)

    def count(self, stretch: int) -> None:
        """Units and code points of each chunk, then their sums before each."""
        units, points = np.zeros(len(self.begin), np.int64), np.zeros(len(self.begin), np.int64)
        a = 0
        while a < len(self.begin):
            b = max(a + 1, int(np.searchsorted(self.end, self.begin[a] + stretch, "right")))
            low, high = self.begin[a], self.end[b - 1]
            units[a:b] = np.add.reduceat(self.marks(a, b), self.begin[a:b] - low, dtype=np.int64)
            points[a:b] = np.add.reduceat(_KIND[self.data[low:high]] != _INNER, self.begin[a:b] - low, dtype=np.int64)
            a = b
        self.units, self.points = np.concatenate([[0], np.cumsum(units)]), np.concatenate([[0], np.cumsum(points)])

    def totals(self) -> np.ndarray:
        return np.diff(self.units[self.first])

    def cut(self, text: int, rank: int) -> int:
        """Code points before the unit of this rank; all, past the last. The sums name the chunk
        that holds the unit, and only it is looked at again."""
        own, end = self.first[text], self.first[text + 1]
        before = self.points[own]
        if self.units[own] + rank >= self.units[end]:
            return int(self.points[end] - before)
        c = int(np.searchsorted(self.units, self.units[own] + rank, "right")) - 1
        at = np.flatnonzero(self.marks(c, c + 1))[self.units[own] + rank - self.units[c]]
        inner = np.count_nonzero(_KIND[self.data[self.begin[c] : self.begin[c] + at]] != _INNER)
        return int(self.points[c] - before + inner)


def chunked(texts: pa.Array, chunk: int = CHUNK, stretch: int = STRETCH) -> Chunks:
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    return Chunks(np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8), offsets, chunk, stretch)


CUTS = "struct<n: long, prefix: long, middle: long>"


def unit_cuts(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """(units, code points of the prefix, code points of the middle) where the cuts' ranks are the hashes mod units + 1."""
    chunks = chunked(texts)
    n = chunks.totals()
    ranks = np.sort(np.column_stack([np.asarray(h1) % (n + 1), np.asarray(h2) % (n + 1)]), axis=1)
    cuts = np.array([[chunks.cut(i, a), chunks.cut(i, b)] for i, (a, b) in enumerate(ranks.tolist())], np.int64).reshape(-1, 2)
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(cuts[:, 0]), pa.array(cuts[:, 1] - cuts[:, 0])], ["n", "prefix", "middle"])


def hash_word(id: Column, k: int, salt: str = "1:") -> Column:
    """The k-th 8-digit group of SHA-256 of the salt and the id, as a number; a null id is the empty one."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, text: str = "text", id: str = "doc_id", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """``docs`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars``
    and ``output``, the transformed text.

    A unit is a run of ASCII letters or any other code point. A row's hashes, of its id alone,
    choose its form and its two cuts. A text that is empty (or null), that holds one of the three
    marks, or whose hash says so stays plain, and its two counts are null. One pass, no exchange:
    the texts of a batch are cut into chunks that overlap by a byte, units are counted by chunk,
    sums of these name the chunk of each cut, and only that chunk is looked at again. So a very
    long text takes time in proportion and, beside itself, the memory of a few chunks. Null ids
    hash as empty ones; repeated rows give equal rows; an empty table gives an empty one. Other
    columns are kept, those named like a result are replaced.
    """
    results = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [c for c in docs.columns if c not in results]
    base = docs.select(*kept)
    whole, cuts = free_name(base, "whole"), free_name(base, "cuts")
    h = lambda k: hash_word(F.col(id), k)
    cut = F.arrow_udf(lambda t, a, b: unit_cuts(t, a, b), CUTS)
    found = base.withColumn(whole, F.coalesce(text, F.lit(""))).withColumn(cuts, cut(F.col(whole), h(1), h(2)))
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    plain = (F.col(whole) == "") | marked | (h(3) % 100 >= plain_from)
    form = F.when(plain, "plain").when(h(4) % 100 < spm_below, "spm").otherwise("psm")
    a, b = F.col(f"{cuts}.prefix").cast("int"), F.col(f"{cuts}.middle").cast("int")
    prefix, middle, suffix = F.substring(whole, F.lit(1), a), F.substring(whole, a + 1, b), F.substring(whole, a + b + 1, F.length(whole))
    output = (
        F.when(F.col("form") == "plain", F.col(whole))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    out = found.withColumn("form", form).withColumn("output", output)
    some = F.col("form") != "plain"
    return out.select(*kept, F.col(f"{cuts}.n").alias("n"), "form", F.when(some, F.col(f"{cuts}.prefix")).alias("prefix_chars"), F.when(some, F.col(f"{cuts}.middle")).alias("middle_chars"), "output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A cut text holds no mark, so each mark's first place is its own."""
    one = lambda first, second: (F.substring_index(F.substr(output, F.lit(4)), second, 1), F.substring_index(_after(F.substr(output, F.lit(4)), second), MIDDLE, 1))
    prefix, suffix = one(PREFIX, SUFFIX)
    late_suffix, late_prefix = one(SUFFIX, PREFIX)
    middle = _after(output, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(late_prefix, middle, late_suffix)).otherwise(output)


def _after(text: Column, mark: str) -> Column:
    """What follows the mark's first place."""
    return F.substr(text, F.locate(mark, text) + len(mark))
