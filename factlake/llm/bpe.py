"""Byte-level BPE by prefix-sharing trie traversal.

The encoding of a byte string ends in one token that is fixed by the encoding of what stands
before it: ``t`` is the last token of ``p`` exactly if ``t`` is a suffix of ``p`` and the merges
leave the pair (last token of ``p`` without ``t``, ``t``) as it is. So each trie node has one
state, the last token of the prefix that it stands for, and shared prefixes are encoded once.
A batch's words are taken in sorted order, which walks their trie depth first: only the nodes
on the path to the present word are held. A word's tokens are read by walking back from its
node over the last tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# The printable characters that stand for themselves in the byte alphabet of the
# vocabulary file; other bytes stand as code points from 256 on, in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

# Letters, numbers and white space below U+0250, as the pre-tokeniser takes them.
_LOW_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_LOW_NUMBERS = "0-9²³¹¼-¾"
_LOW_SPACE = "\t-\r \x85\xa0"
_SPACE = _LOW_SPACE + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _byte_of_char() -> dict[str, int]:
    out = {chr(b): b for b in _PRINTABLE}
    rest = [b for b in range(256) if b not in set(_PRINTABLE)]
    out.update({chr(256 + i): b for i, b in enumerate(rest)})
    return out


def _piece_pattern(engine, letters: str, numbers: str, space: str):
    return engine.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


class Pieces:
    """Splits text as the byte-level pre-tokeniser does, special strings first.

    Text below U+0250 goes by a small character class; other text by Unicode properties; text
    with code points that this Python's Unicode tables don't know goes to the library itself.
    """

    def __init__(self, specials: list[str], library_split) -> None:
        import regex

        self.low = _piece_pattern(re, _LOW_LETTERS, _LOW_NUMBERS, _LOW_SPACE).findall
        self.full = _piece_pattern(regex, r"\p{L}", r"\p{N}", _SPACE).findall
        self.high = re.compile("[ɐ-\U0010ffff]").search
        self.library_split = library_split
        # leftmost, then longest
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.specials = specials

    def _plain(self, text: str) -> list[str]:
        if not self.high(text):
            return self.low(text)
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self.library_split(text)
        return self.full(text)

    def parts(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """(is special, pieces) in order."""
        if self.special is None or not any(s in text for s in self.specials):
            yield False, self._plain(text)
            return
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                yield True, [part]
            elif part:
                yield False, self._plain(part)


#: Words of more bytes than this are encoded alone, without nodes in the trie.
LONG = 2000


class PrefixTrie:
    """Encodes words of bytes; see the module text.

    Of the nodes on the path to the present word, by depth, ``last`` holds the last tokens and
    ``reach`` the longest suffixes that begin some token, by number. ``step`` maps
    ``suffix << 8 | byte`` to the next suffix; ``ends`` has the tokens that a suffix ends in,
    longest first, each with its length and with ``fits`` of it: whether it stands beside a left
    neighbour as it is. All are filled as words need them; of pairs and steps about ``max_nodes``
    are kept, and there are no more suffixes than the vocabulary's tokens have beginnings.
    """

    def __init__(self, vocab: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]], max_nodes: int = 300_000) -> None:
        self.vocab, self.max_nodes = vocab, max_nodes
        self.bytes_of = {i: b for b, i in vocab.items()}
        self.size = {i: len(b) for b, i in vocab.items()}
        self.starts = {b[:n] for b in vocab for n in range(1, len(b) + 1)}
        self.rank = {a << 20 | b: r for (a, b), (r, _) in merges.items()}
        self.made = {t: (r, a, b) for (a, b), (r, t) in merges.items()}
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.left: dict[int, list[tuple[int, float]]] = {}
        self.fits: dict[int, dict[int, bool]] = {}
        self.sound: dict[int, bool] = {}
        self.step: dict[int, int] = {}
        self.number, self.suffix = {b"": 0}, [b""]
        self.ends: list[list[tuple[int, int, dict[int, bool]]]] = [[]]
        self.last, self.reach = [-1], [0]

    def trim(self) -> None:
        if sum(map(len, self.fits.values())) > self.max_nodes:
            for pairs in self.fits.values():  # in place: ``ends`` holds them too
                pairs.clear()
        if len(self.step) > self.max_nodes:
            self.step.clear()

    def _next(self, key: int) -> int:
        """The suffix that follows on ``suffix << 8 | byte``."""
        text = self.suffix[key >> 8] + bytes((key & 255,))
        while text and text not in self.starts:
            text = text[1:]
        found = self.number.get(text)
        if found is None:
            found = self.number[text] = len(self.suffix)
            self.suffix.append(text)
            tokens = [self.vocab.get(text[i:]) for i in range(len(text))]
            # a token that the merges don't make of its own bytes is no prefix's last one
            self.ends.append([(self.size[t], t, self.fits.setdefault(t, {})) for t in tokens if t is not None and self._alone(t)])
        self.step[key] = found
        return found

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at a token's edge while it is being merged, each with the rank of the
        merge that ends it; side 1 is the left edge, 2 the right."""
        out, ends = [], float("inf")
        while True:
            out.append((token, ends))
            if token not in self.made:
                return out[::-1]
            ends, token = self.made[token][0], self.made[token][side]

    def _alone(self, token: int) -> bool:
        """Whether the merges make the token out of its own bytes."""
        if (known := self.sound.get(token)) is None:
            rule = self.made.get(token)
            known = self.sound[token] = rule is None or self._alone(rule[1]) and self._alone(rule[2]) and self._meet(rule[1], rule[2], rule[0])
        return known

    def _meet(self, left: int, right: int, but: float = float("inf")) -> bool:
        """Whether nothing merges across the border of two tokens before rank ``but``: follow both
        edges in the order of ranks and look at each two that stand beside each other."""
        if left not in self.right:
            self.right[left] = self._edge(left, 2)
        if right not in self.left:
            self.left[right] = self._edge(right, 1)
        a, b, i, j = self.right[left], self.left[right], 0, 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            rank = self.rank.get(x << 20 | y)
            # of equal pairs the left one merges first
            if rank is not None and rank < x_ends and rank <= y_ends and rank < but:
                return False
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
            if i == len(a) or j == len(b):
                return True

    def encode(self, words: Iterable[bytes]) -> list[tuple[int, ...]]:
        """Tokens of each word. In sorted order the words walk their trie depth first."""
        out = []
        self.trim()
        step, ends, size = self.step, self.ends, self.size
        last, reach, before = [-1], [0], b""
        for word in words:
            if len(word) > LONG:
                out.append(self.encode_alone(word))
                continue
            depth = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                depth += 1
            del last[depth + 1 :], reach[depth + 1 :]
            suffix = reach[depth]
            for byte in word[depth:]:
                depth += 1
                key = suffix << 8 | byte
                suffix = step.get(key)
                if suffix is None:
                    suffix = self._next(key)
                for n, token, fits in ends[suffix]:
                    if n == depth:
                        break
                    left = last[depth - n]
                    fit = fits.get(left)
                    if fit is None:
                        fit = fits[left] = self._meet(left, token)
                    if fit:
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                last.append(token)
                reach.append(suffix)
            before = word
            tokens = []
            while depth:
                token = last[depth]
                tokens.append(token)
                depth -= size[token]
            out.append(tuple(tokens[::-1]))
        self.last, self.reach = last, reach
        return out

    def encode_alone(self, word: bytes) -> tuple[int, ...]:
        """Tokens of a word that gets no nodes: four bytes for each of its bytes, and no more."""
        step, ends = self.step, self.ends
        last, suffix = array("i", bytes(4 * len(word) + 4)), 0
        for depth, byte in enumerate(word, 1):
            key = suffix << 8 | byte
            suffix = step.get(key)
            if suffix is None:
                suffix = self._next(key)
            for n, token, fits in ends[suffix]:
                if n == depth:
                    break
                left = last[depth - n]
                fit = fits.get(left)
                if fit is None:
                    fit = fits[left] = self._meet(left, token)
                if fit:
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last[depth] = token
        tokens, at = array("i"), len(word)
        while at:
            tokens.append(last[at])
            at -= self.size[last[at]]
        return tuple(tokens[::-1])


class ByteBpe:
    """Encoder and decoder for a tokenizer file with byte-level BPE."""

    def __init__(self, path: str, max_words: int = 200_000) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = all(not t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"] or model.get("ignore_merges") or not plain:
            raise ValueError(f"{path}: not a plain byte-level BPE")
        of_char = _byte_of_char()
        as_bytes = lambda s: bytes(of_char[c] for c in s)
        vocab = {as_bytes(s): i for s, i in model["vocab"].items()}
        merges = {}
        for rank, m in enumerate(model["merges"]):
            a, b = map(as_bytes, m.split(" ") if isinstance(m, str) else m)
            merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.trie = PrefixTrie(vocab, merges)
        self.bytes_of = self.trie.bytes_of | {i: s.encode() for s, i in self.special.items()}
        self.digits = [str(i) for i in range(max(self.bytes_of, default=0) + 1)]
        self.bytes_of_digits = {self.digits[i]: b for i, b in self.bytes_of.items()} | {"": b""}
        self.path, self.library = path, None
        self.pieces = Pieces(list(self.special), self._library_split)
        self.max_words = max_words
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.long: list[str] = []  # those that aren't kept after their batch

    def _library_split(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes the distinct words that aren't known yet, in one walk of the trie.

        The table has two halves. When the newer one is full the older one goes, without those of
        its words that were used meanwhile: so a common word is encoded once.
        """
        if len(self.known) > self.max_words // 2:
            self.known, self.older = {}, self.known
        new = set(pieces).difference(self.known)
        again = self.older.keys() & new
        self.known.update((w, self.older[w]) for w in again)
        words = sorted(new - again)
        data = list(map(str.encode, words))
        digits = self.digits.__getitem__
        self.long += [w for w, b in zip(words, data) if len(b) > LONG]
        self.known.update((w, ",".join(map(digits, ids))) for w, ids in zip(words, self.trie.encode(data)))

    def encode_batch(self, texts: list[str]) -> list[str]:
        """Each text's ids in decimal, joined by commas."""
        split = [list(self.pieces.parts(t)) for t in texts]
        self.learn(chain.from_iterable(p for parts in split for special, p in parts if not special))
        known = self.known.__getitem__
        encoded = [",".join(chain.from_iterable((self.digits[self.special[p[0]]],) if special else map(known, p) for special, p in parts)) for parts in split]
        for word in self.long:
            self.known.pop(word, None)
        self.long.clear()
        return encoded

    def decode(self, ids: str) -> str:
        return b"".join(map(self.bytes_of_digits.__getitem__, ids.split(","))).decode("utf-8", "replace")


def n_ids(ids: str) -> int:
    return ids.count(",") + 1 if ids else 0


def id_lists(encoded: list[str]) -> pa.Array:
    joined = ",".join(filter(None, encoded))
    values = pc.split_pattern(pa.array([joined]), ",").values.cast(pa.int32()) if joined else pa.array([], pa.int32())
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(n_ids, encoded))], pa.int32()), values)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each worker process; what it has learnt serves later tasks too."""
    return ByteBpe(path)


def text_chunks(texts: list[str], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` characters, so that long texts don't pile up."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def bpe_round_trip(docs: DataFrame, tokenizer: str, text: str = "text", ids: bool = False) -> DataFrame:
    """Each row's columns with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids``.

    Map-only: no exchange, and each worker keeps a bounded trie and word table. A null text
    counts as empty: no tokens, and the digests of the empty string. Other columns may be null
    and pass unchanged; columns of ``docs`` named like a result are replaced. Repeated rows
    each give their row; an empty table gives an empty one. A very long word, as of a blob
    without spaces, gets no trie nodes and isn't kept.
    """
    results = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32())} if ids else {})
    kept = [c for c in docs.columns if c not in results and c != text]
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

    schema = StructType([docs.schema[c] for c in kept])
    for name in results:
        schema = schema.add(name, {"n_tokens": LongType(), "ids": ArrayType(IntegerType())}.get(name, StringType()))

    def run(batches):
        bpe = byte_bpe(tokenizer)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            texts = [t or "" for t in column.to_pylist()]
            for a, b in text_chunks(texts):
                encoded = bpe.encode_batch(texts[a:b])
                values = [
                    pa.array(map(n_ids, encoded), pa.int64()),
                    pa.array([sha(x.encode()) for x in encoded], pa.string()),
                    pa.array([sha(bpe.decode(x).encode()) for x in encoded], pa.string()),
                ] + ([id_lists(encoded)] if ids else [])
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[:-1]] + values, names=[*kept, *results])

    return docs.select(*kept, docs[text]).mapInArrow(run, schema)
