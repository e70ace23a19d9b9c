"""Corpus operators against brute force, on small tables with the awkward cases."""

import collections
import hashlib
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from factlake.llm import bpe, decontaminate, fingerprints, fm, lines, near, quality, sharding, substrings, token_counts, warc  # noqa: E402
from factlake.llm.common import maybe_in, row_key  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, row string, size long, key string, part int, score string"
ODD = [
    None, "", " \n\t ", "a", "the same text here\nthe same line", "the same text here\nthe same line", "<|endoftext|>x<|endoftext|>", "don't  stop\n\n'S re'LL", "日本語テキスト １２３ ½ ²",
    "😀 emoji and spaces​", "\U0002ebf0 new", "Straße İ ﬁ é", "x" * 3000, "word " * 4000, "\x00\x01\x85", "a\r\nb\x0bc\x0cd",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, ties, repeated rows, long texts, and columns whose names clash with the operators' own."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, "no id"), (None, None), (3, "a"), (500, "another"), (500, "yet another")]
    return spark.createDataFrame([(i, t, "r", 1, "k", 2, "s") for i, t in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def corpus(seed=3, n=160):
    """Invented documents with copies, near copies, shared passages and lines."""
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(600)]
    say = lambda k: [str(w) for w in rng.choice(vocabulary, k)]
    passage, line, texts = say(40), " ".join(say(6)), []
    for i in range(n):
        words = say(int(rng.integers(1, 160)))
        if i % 5 == 1:
            words[len(words) // 2 : len(words) // 2] = passage[int(rng.integers(0, 12)) :]
        if i % 7 == 2 and texts:
            words = texts[int(rng.integers(0, len(texts)))].split(" ")
            if i % 2:
                words[int(rng.integers(0, len(words)))] = "edited"
        text = " ".join(words)
        texts.append(text + ("\n  " + line.upper() + " \n" if i % 3 == 0 else ""))
    return [(i, t) for i, t in enumerate(texts)]


# --- BPE and token counts


def test_encoder_agrees_with_the_library():
    rng = np.random.default_rng(5)
    texts = [t or "" for t in ODD]
    for _ in range(400):
        spans = [(32, 127), (0x20, 0x250), (0x250, 0xD7FF), (0xE000, 0xFFFF), (0x10000, 0x1FFFF), (9, 14)]
        texts.append("".join(chr(int(rng.integers(*spans[int(rng.integers(0, 6))]))) for _ in range(int(rng.integers(0, 40)))))
    texts += [" ".join(x.split()) for _, x in corpus(n=40)]
    encoder, theirs = bpe.ByteBpe(PATH), library()
    expected = theirs.encode_batch(texts, add_special_tokens=False)
    own = encoder.encode_batch(texts)
    assert own == [",".join(map(str, x.ids)) for x in expected]
    assert [encoder.decode(x) for x in own] == [theirs.decode(x.ids, skip_special_tokens=False) for x in expected] == texts


def test_encoder_with_tiny_memory_gives_the_same():
    texts = [t for _, t in corpus(n=30)]
    small = bpe.ByteBpe(PATH, max_words=20)
    small.trie.max_nodes = 50
    whole = bpe.ByteBpe(PATH)
    assert [small.encode_batch([t])[0] for t in texts] == whole.encode_batch(texts)


def test_words_in_use_are_encoded_once():
    """A full word table drops what isn't used, so words of every batch don't reach the trie again."""
    encoder, reached = bpe.ByteBpe(PATH, max_words=40), []
    encode = encoder.trie.encode
    encoder.trie.encode = lambda words: reached.extend(words := list(words)) or encode(words)
    for i in range(30):
        encoder.encode_batch(["common words stay" + "".join(f" rare{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(10))])
    assert [reached.count(w) for w in (b"common", b" words", b" stay")] == [1, 1, 1]
    assert len(encoder.known) + len(encoder.older) < 80


def test_the_trie_holds_the_path_to_the_last_word():
    """Shared prefixes are walked once: of sorted words only what they don't share takes steps."""
    trie, words = bpe.ByteBpe(PATH).trie, sorted(f" prefix{a}{b}".encode() for a in "abcdefgh" for b in "abcdefgh")
    alone = [trie.encode_alone(w) for w in words]
    assert trie.encode(words) == alone and len(trie.last) == len(words[-1]) + 1


def test_long_words_get_no_nodes():
    """A blob without spaces is encoded as the library does, in few nodes, and isn't kept."""
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    texts = ["".join(rng.choice(letters, n)) for n in (2000, 2001, 30_000)] + ["the" * 5000, "日本" * 2000, "short " + "=" * 9000 + " words"]
    encoder = bpe.ByteBpe(PATH)
    assert [[int(i) for i in ids.split(",")] for ids in encoder.encode_batch(texts)] == [x.ids for x in library().encode_batch(texts, add_special_tokens=False)]
    assert len(encoder.trie.last) < 3000 and all(len(w) <= 2000 for w in encoder.known)


def test_vocabulary_tokens_encode_like_the_library():
    encoder, theirs = bpe.ByteBpe(PATH), library()
    words = [b.decode() for b in list(encoder.bytes_of.values())[::7] if b"\xef\xbf\xbd" not in b and b.decode("utf-8", "ignore").encode() == b]
    assert encoder.encode_batch(words) == [",".join(map(str, x.ids)) for x in theirs.encode_batch(words, add_special_tokens=False)]


def test_round_trip_table(docs, none):
    found = bpe.bpe_round_trip(docs, PATH, ids=True).collect()
    assert len(found) == docs.count() and set(found[0].asDict()) == set(SCHEMA.replace(",", "").split()[::2]) - {"text"} | {"n_tokens", "ids_sha256", "decoded_sha256", "ids"}
    by = {r.doc_id: r for r in found if r.doc_id is not None and r.doc_id < len(ODD)}
    theirs = library()
    for i, t in enumerate(ODD):
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        assert by[i].ids == ids and by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.bpe_round_trip(none, PATH).count() == 0


def test_token_counts_and_their_cache(spark, docs, none, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/cache"
    theirs = library()
    expected = sorted((str(i), len((t or "").encode()), len(theirs.encode(t or "", add_special_tokens=False).ids)) for i, t in [(r.doc_id, r.text) for r in docs.collect()])
    for _ in range(2):
        found = token_counts.token_counts(docs, PATH, cache)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in found.collect()) == expected
        assert spark.read.parquet(cache).count() == len({t or "" for t in ODD} | {"no id", "another", "yet another"})
    assert token_counts.token_counts(none, PATH, cache).count() == 0
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        other = token_counts.token_counts(docs, public_tokenizers.path(name), cache)
        assert other.filter("text is not null or n_tokens is null").count() == 0 if "text" in other.columns else other.filter("n_tokens is null").count() == 0
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 3


# --- substrings


def test_a_digest_twice_in_the_cache_counts_once(spark, docs, tmp_path):
    path = f"file://{tmp_path}/cache"
    first = sorted(map(tuple, token_counts.token_counts(docs.select("doc_id", "text"), PATH, path).collect()), key=str)
    spark.read.parquet(path).limit(5).coalesce(1).write.mode("append").partitionBy("tokenizer").parquet(path)
    assert spark.read.parquet(path).count() > spark.read.parquet(path).select("digest").distinct().count()
    assert sorted(map(tuple, token_counts.token_counts(docs.select("doc_id", "text"), PATH, path).collect()), key=str) == first


def removed(rows, window):
    split = {k: (t or "").encode().split() for k, t in rows}
    least = collections.defaultdict(set)
    grams = lambda w: [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
    for (id, _), w in split.items():
        for g in grams(w):
            least[g].add(id)
    out = {}
    for (id, n), w in split.items():
        gone = {i + k for i, g in enumerate(grams(w)) for k in range(window) if id is not None and any(x is not None and x < id for x in least[g])}
        out[id, n] = len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
    return out


@pytest.mark.parametrize("options", [{}, {"filter_keys": 0}, {"hot": 1}, {"filter_keys": 0, "hot": 1}])
def test_substring_dedup(spark, options):
    rows = corpus()
    found = substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    expected = removed([((i, 0), t) for i, t in rows], 13)
    assert {(r.doc_id, 0): (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()} == expected
    assert sum(x[1] for x in expected.values()) > 500


def test_substring_dedup_odd_rows(docs, none):
    rows = [((r.doc_id, i), r.text) for i, r in enumerate(docs.collect())]
    found = substrings.substring_dedup(docs)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()) == sorted((str(k[0]), *v) for k, v in removed(rows, 13).items())
    assert set(found.columns) >= {"row", "size", "key", "part"} and substrings.substring_dedup(none).count() == 0


def test_the_search_decides(spark, monkeypatch):
    """Without what the FM-index finds, windows of passages that differ stay."""
    rows = corpus()
    frame, expected = spark.createDataFrame(rows, "doc_id long, text string"), removed([((i, 0), t) for i, t in rows], 13)
    lost = lambda: {(r.doc_id, 0): r.n_removed for r in substrings.substring_dedup(frame).collect()}
    assert lost() == {k: v[1] for k, v in expected.items()}
    made = substrings._searched
    monkeypatch.setattr(substrings, "_searched", lambda window, f=made: lambda batches: _unfound(f(window)(batches)))
    assert sum(lost().values()) < sum(v[1] for v in expected.values()) - 100


def _unfound(batches):
    for batch in batches:
        yield batch.set_column(3, "least", pa.array([None] * batch.num_rows, pa.list_(pa.int64())))


def test_words_where_they_lie(monkeypatch):
    """Pieces and long words change nothing; words are bytes between ASCII white space."""
    rng = np.random.default_rng(2)
    texts = ["", " ", "a", "\x1c\x85\u2003 b", "x" * 500, *("".join(rng.choice(list("ab é\n\t\x0b\x0c\r日"), int(rng.integers(0, 80)))) for _ in range(300))]
    whole, sizes = substrings.Anchored(13).words(pa.array(texts))
    split = [t.encode().split() for t in texts]
    assert sizes.tolist() == list(map(len, split))
    words = [w for x in split for w in x]
    assert len(set(zip(words, whole.tolist()))) == len(set(words)) == len(set(whole.tolist()))
    assert [n & 255 for n in whole.tolist()] == [min(255, len(w)) for w in words]
    monkeypatch.setattr(substrings, "PIECE", 600)
    pieces, _ = substrings.Anchored(13).words(pa.array(["no", *texts, "no"])[1:-1])
    assert pieces.tolist() == whole.tolist()


def test_matching_statistics():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths, depth = rng.integers(0, 30, rng.integers(1, 12)), int(rng.integers(2, 14))
        words = rng.integers(0, rng.integers(2, 9), lengths.sum()).astype(np.uint64)
        index = fm.FmIndex(words, lengths, depth)
        held = {tuple(s[i : i + d]) for s in map(np.ndarray.tolist, np.split(words, np.cumsum(lengths)[:-1])) for i in range(len(s)) for d in range(1, min(depth, len(s) - i) + 1)}
        sizes = rng.integers(0, 25, rng.integers(1, 9))
        queries = rng.integers(0, 9, sizes.sum()).astype(np.uint64)
        expected = []
        for q in map(np.ndarray.tolist, np.split(queries, np.cumsum(sizes)[:-1])):
            expected += [max((d for d in range(1, min(depth, len(q) - i) + 1) if tuple(q[i : i + d]) in held), default=0) for i in range(len(q))]
        assert index.matching_statistics(queries, sizes)[0].tolist() == expected


# --- lines


def dropped_lines(rows, min_docs, min_chars=1):
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
    seen = collections.defaultdict(set)
    for k, t in rows:
        for x in (t or "").split("\n"):
            seen[key(x)].add((k[0], t))
    hot = {x for x, d in seen.items() if len(d) >= min_docs and len(x) >= min_chars}
    out = []
    for k, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if key(x) not in hot]
        out.append((str(k[0]), len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("min_docs, min_chars", [(10, 1), (2, 1), (2, 20), (1, 1)])
def test_line_dedup(spark, docs, none, min_docs, min_chars):
    shown = lambda f: sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in f.collect())
    rows = corpus()
    found = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=min_docs, min_chars=min_chars)
    assert shown(found) == dropped_lines([((i, 0), t) for i, t in rows], min_docs, min_chars)
    odd = lines.line_dedup(docs, min_docs=min_docs, min_chars=min_chars)
    assert shown(odd) == dropped_lines([((r.doc_id, i), r.text) for i, r in enumerate(docs.collect())], min_docs, min_chars)
    assert lines.line_dedup(none).count() == 0


def test_hot_lines_across_partitions(spark):
    """One line fills many partitions; none of them sees all of its documents."""
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, f"hot\nrare {i % 9}\nown {i}") for i in range(60)]
        found = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=7)
        assert {r.n_dropped for r in found.collect()} == {1 + (1 if 60 // 9 >= 7 else 0)} or {r.n_dropped for r in found.collect()} == {1, 2}
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in found.collect()) == dropped_lines([((i, 0), t) for i, t in rows], 7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_bitmaps_round_trip():
    for gone in ([0], [1, 5], [0, 1, 2, 3, 4, 5, 6, 7, 8]):
        n = max(gone) + 1
        assert [i for i, k in enumerate(lines.read_bitmap(lines.keep_bitmap(n, gone), n)) if not k] == gone


# --- decontamination


def test_templates(spark, none):
    items = [(1, "Ann said that Tom has 12 apples and gives 5 kg of them to Mary, then Tom walks 3 miles back home alone again"), (2, "short item"), (3, None), (None, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    same = "so Ann said that Tom has 12 apples and gives 5 kg of them to Mary, then Tom walks 3 miles back home alone again"
    texts = {
        1: same, 2: same.replace("Tom", "Bob").replace("12", "1,900").replace("kg", "lb"), 3: same.replace("then Tom", "then Joe"), 4: same.replace("apples", "pears").replace("them", "it"),
        5: None, 6: "", 7: "word " * 5000, 8: same.upper(), 9: same.replace("12", "7") + ". " + same, 10: "Mary " * 50,
    }
    docs = spark.createDataFrame([(*x, 1, 2) for x in [*texts.items(), (None, same), (1, same)]], "doc_id long, text string, item long, hash int")
    found = {r.doc_id: (r["items"], r.n_changed) for r in decontaminate.contaminated(docs, bench).collect()}
    assert {k: v[0] for k, v in found.items()} == {1: [1], 2: [1], 9: [1], None: [1]}
    assert found[1][1] == 0 and found[2][1] > 0
    kept = decontaminate.decontaminate(docs, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [3, 4, 5, 6, 7, 8, 10])) and kept.columns == docs.columns
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def leaks(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r["items"] for r in decontaminate.contaminated(docs, bench, whole=True).collect()}


def test_windows_count_by_themselves(spark):
    item = "Ann said that Tom has 12 apples and gives 5 kg of them to Mary, then Tom walks 3 miles back home alone again"
    assert leaks(spark, [item], ["so " + item.replace("then Tom", "then Joe"), "so " + item.replace("12", "9").replace("5", "9"), item.replace("apples", "pears").replace("them", "it")]) == {0: [0], 1: [0]}


def test_slots_agree_over_a_passage(spark):
    ask = "{} has {} apples and {} pears and gives {} apples to {} who eats them all before noon so how many pears does {} have now"
    item = "today " + ask.format("Tom", 12, 5, 3, "Mary", "Tom")
    told = [("Ann", 8, 6, 2, "Sue", "Ann"), ("Tom", 7, 7, 7, "Tom", "Sue"), ("Ann", 8, 6, 2, "Sue", "Joe"), ("Tom", 12, 5, 3, "Mary", "Sue"), ("Ann", 8, 8, 2, "Sue", "Ann")]
    texts = ["so " + ask.format(*x) for x in told]
    assert leaks(spark, [item], texts) == {0: [0], 3: [0]}  # the fourth contradicts itself, but has windows in the item's own words


def test_passages_of_numbers(spark):
    item = "given 3 4 5 6 find 7 8 9 10 between 11 12 13 14 under 15 16 17 18 beyond 19 20 21 22 around 23 24 25 26 minus 27 28 29 30"
    moved = re.sub(r"\d+", lambda m: str(int(m[0]) + 40), item)
    texts = [moved, moved.replace("50", "43"), moved.replace("between", "among"), "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17", " ".join(moved.split()[:14])]
    assert leaks(spark, [item], texts) == {0: [0]}


def test_templates_by_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdeg"), 5))
    say = lambda n, share: [str(rng.integers(1, 60)) if rng.random() < share else word() for _ in range(n)]
    items = [say(int(rng.integers(8, 40)), rng.choice([0, 0.2, 0.5, 0.7])) for _ in range(30)]
    docs = []
    for i in range(240):
        told, kind = list(items[i % 30]), rng.integers(0, 4)
        numbers = {t: str(int(t) + 100 if kind < 3 else rng.integers(1, 9)) for t in told if t.isdigit()}
        told = [numbers.get(t, t) if kind else t for t in told]
        if kind == 2 and rng.random() < 0.7:
            told[int(rng.integers(0, len(told)))] = str(rng.choice(told))
        docs.append(say(int(rng.integers(0, 20)), 0.3) + told + say(int(rng.integers(0, 20)), 0.3))

    def leaked(doc, item):
        n = min(13, len(item))
        if any(doc[i : i + n] == item[j : j + n] for i in range(len(doc) - n + 1) for j in range(len(item) - n + 1)):
            return True
        shape = lambda x: ["#" if t.isdigit() else t for t in x]
        d, t = shape(doc), shape(item)
        for offset in range(-len(item), len(doc)):
            starts = [j for j in range(len(item) - 12) if 0 <= j + offset <= len(doc) - 13 and d[j + offset : j + offset + 13] == t[j : j + 13] and set(t[j : j + 13]) != {"#"}]
            at = {j + k for j in starts for k in range(13)}
            slots = {(item[j], doc[j + offset]) for j in at if t[j] == "#"}
            if len(slots) == len({a for a, _ in slots}) == len({b for _, b in slots}) and sum(t[j] != "#" for j in at) * 2 >= 13:
                return True
        return False

    expected = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if leaked(doc, item)}
    verbatim = {(d, d % 30) for d, doc in enumerate(docs) if " ".join(items[d % 30]) in " ".join(doc)}
    found = leaks(spark, [" ".join(x) for x in items], [" ".join(x) for x in docs])
    assert {(d, i) for d, ids in found.items() for i in ids} == expected
    assert 20 < len(expected - verbatim) and len(expected) < 220


def test_windows_across_blocks(spark):
    item = [f"item{chr(97 + i)}word" for i in range(15)]
    rest = lambda n: [f"other{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n)]
    at = [*range(45, 70), 2 * decontaminate.BLOCK - 1, 600]
    docs = spark.createDataFrame([(n, " ".join(rest(n) + item[:14] + rest(5))) for n in at], "doc_id long, text string")
    found = decontaminate.template_matches(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert sorted(tuple(r) for r in found.select("first_word", "n_windows", "last_word").collect()) == [(n, 2, n + 13) for n in at]


def test_literal_windows_and_short_items(spark):
    sums = "1 2 3 plus 4 5 6 plus 7 8 9 is 12 15 18 or 21 24 27"
    texts = ["so " + sums + " then", "it asks: How many  moons, has\nMars? and so on", "moons has mars", "a\n" + sums.replace("plus", "minus")]
    assert leaks(spark, [sums, "how many moons has Mars?", "", "?"], texts) == {0: [0], 1: [1]}


def test_names_anywhere(spark):
    item = "Tom has 5 red apples. Tom gives 2 to his aunt. Tom eats 1 of them. Tom then sells the rest of all apples"
    other = "Ann said that Tom has some old apples and gives many of them to Mary today"
    texts = [item.replace("Tom", "Ann").replace("5", "8"), other.upper(), other.replace(" ", "\n"), other.lower(), other.replace(" Tom", "  Joe"), item.replace("red", "old").replace("aunt", "dog").replace("eats", "has").replace("sells", "buys")]
    assert leaks(spark, [item, other], texts) == {0: [0], 1: [1], 2: [1], 3: [1], 4: [1]}


def test_verbatim_passages_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    say = lambda n: " ".join("".join(rng.choice(list("abcdef"), 4)) for _ in range(n))
    bench = [(i, say(int(rng.integers(5, 40)))) for i in range(30)]
    docs = [(i, say(20) + (" " + bench[i % 30][1] + " " if i % 3 == 0 else " ") + say(int(rng.integers(0, 20)))) for i in range(120)]
    grams = lambda t: {tuple(t.split()[i : i + 13]) for i in range(len(t.split()) - 12)}
    expected = {(d, i) for d, t in docs for i, b in bench if grams(t) & grams(b)}
    for bound in (decontaminate.BROADCAST_WINDOWS, 0):  # with the broadcast and without
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
        found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
        assert {(r.doc_id, i) for r in found.collect() for i in r["items"]} == expected


# --- near duplicates


def words_and_shingles(text):
    words = re.findall(r"\w+", text.lower())
    return words, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def lcs(a, b):
    """By the table."""
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
        above = row
    return above[-1]


def are_linked(a, b):
    longer = max(len(a[0]), len(b[0]))
    return bool(a[1] & b[1]) and min(len(a[0]), len(b[0])) >= 0.8 * longer and lcs(a[0], b[0]) >= 0.8 * longer


def test_near_duplicates_by_brute_force(spark):
    rows = corpus(n=220)
    found = {r.id: r for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of = [words_and_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or are_linked(of[i], of[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: r.class_id for i, r in found.items()} == {i: find(i) for i in range(len(rows))}
    assert sum(r.first for r in found.values()) == len({find(i) for i in range(len(rows))})
    kept = near.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(rows))})


def test_large_near_groups(spark):
    """Groups beyond all pairs go by centres; everything still meets."""
    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("abcdef"), 5)) for _ in range(200)]
    rows = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :])) for i in range(70) for k in [int(rng.integers(0, 200))]]
    rows += [(1000 + i, " ".join("".join(rng.choice(list("abcdef"), 5)) for _ in range(60))) for i in range(20)]
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(r.class_id for r in found) == {0: 70} | {1000 + i: 1 for i in range(20)}


def test_star_shaped_near_group(spark, monkeypatch):
    """Copies that are linked to their original, but few to each other; one group takes several blocks."""
    monkeypatch.setattr(near, "BLOCK", 64)
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdef"), 6))
    base = [word() for _ in range(200)]
    rows = [(5000, " ".join(base))]
    for i in range(600):
        at = int(rng.integers(0, 164))
        rows.append((i, " ".join(base[:at] + [word() for _ in range(36)] + base[at + 36 :])))
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(r.class_id for r in found) == {0: 601}


def test_common_passage_links_nothing(spark, monkeypatch):
    """A passage in all texts makes large sketch groups of texts that aren't similar; two of them are."""
    monkeypatch.setattr(near, "BLOCK", 64)
    rng = np.random.default_rng(7)
    say = lambda n: ["".join(rng.choice(list("abcdef"), 6)) for _ in range(n)]
    passage = say(60)
    rows = [(i, " ".join(say(40) + passage + say(40))) for i in range(300)]
    rows.append((900, rows[17][1] + " and more"))
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: r.class_id for r in found} == {i: i for i in range(300)} | {900: 17}


def test_every_pair_of_a_large_sketch_group_meets(spark, monkeypatch):
    """All rows share a sketch, only neighbours in a chain are linked; beside it a class owns the group."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdef"), 6))
    chain, rows = [word() for _ in range(100)], []
    for i in range(40):  # a new word at each step: texts over 20 steps apart aren't linked
        rows.append((100 + i, " ".join(chain)))
        chain[(7 * i) % 90 + 5] = word()
    owner = [word() for _ in range(100)]
    rows += [(i, " ".join([*owner, str(i)])) for i in range(60)]
    pair = [word() for _ in range(100)]
    rows += [(200, " ".join(pair)), (201, " ".join(pair[:-1])), (202, " ".join(word() for _ in range(100)))]
    monkeypatch.setattr(near, "BLOCK", 25)
    made = near._sketched
    monkeypatch.setattr(near, "_sketched", lambda batches, f=made: _one_sketch(f, batches))
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(r.class_id for r in found) == {0: 60, 100: 40, 200: 2, 202: 1}


def _one_sketch(sketched, batches):
    for batch in sketched(batches):
        at = batch.schema.get_field_index("sketches")
        yield batch.set_column(at, "sketches", pa.array([[1] for _ in range(batch.num_rows)], pa.list_(pa.int64())))


def test_short_texts_always_meet():
    """Texts of up to 24 shingles that share one and align have a key in common."""
    rng = np.random.default_rng(9)
    texts = [" ".join("".join(rng.choice(list("abcdef"), 6)) for _ in range(n)) for n in [8] * 500 + list(range(5, 29)) * 20]
    linked = 0
    for t in texts:
        words = t.split(" ")
        for k in rng.integers(0, len(words), len(words) // 7):
            words[k] = "new"
        pair = [t, " ".join([*words, "more"])]
        a, b = map(words_and_shingles, pair)
        if are_linked(a, b):
            linked += 1
            (batch,) = near._sketched([pa.RecordBatch.from_arrays([pa.array([b"0", b"1"]), pa.array(pair)], names=["row", "text"])])
            first, second = ({*x, *y} for x, y in zip(batch.column("sketches").to_pylist(), batch.column("singles").to_pylist()))
            assert first & second
    assert linked > 400


def test_near_dedup_without_a_broadcast(spark, docs, monkeypatch):
    rows = lambda: sorted(map(str, near.near_dedup(docs).collect()))
    few = rows()
    monkeypatch.setattr(near, "BROADCAST_KEYS", 0)
    assert rows() == few


def test_near_odd_rows(docs, none):
    found = near.near_duplicates(docs).collect()
    classes = collections.defaultdict(set)
    for r in found:
        classes[r.class_id].add(r.id)
    assert classes[0] == {0, 1, None} and classes[4] == {4, 5}
    kept = near.near_dedup(docs)
    assert kept.columns == docs.columns and kept.filter("text is null or text = ''").count() == 1
    assert near.near_duplicates(none).count() == 0 and near.near_dedup(none).count() == 0


def test_alignment():
    """The bits' longest common subsequence is the table's, wherever that is long enough."""
    a = np.arange(100, dtype=np.uint64)
    assert near.similarity(a, a) == 1.0 and near.similarity(a, a[::-1]) == 0.0
    assert near.similarity(a, a[:80]) == 0.8 and near.similarity(a, a[:79]) == 0.0
    assert near.similarity(a[:0], a[:0]) == 0.0 and near.similarity(a[:0], a) == 0.0
    rng, long_enough = np.random.default_rng(1), 0
    for _ in range(1500):
        n = int(rng.integers(1, 90))
        a = rng.integers(0, int(rng.choice([2, 5, 40])), n).tolist()
        b = list(a)
        for _ in range(int(rng.integers(0, n // 3 + 2))):
            at, what = int(rng.integers(0, len(b) + 1)), rng.random()
            if what < 0.4:
                b.insert(at, int(rng.integers(0, 40)))
            elif what < 0.7 and len(b) > 1:
                b.pop(min(at, len(b) - 1))
            else:
                b[min(at, len(b) - 1)] = int(rng.integers(0, 40))
        longest, least = lcs(a, b), near.least_kept(max(len(a), len(b)))
        assert near.kept_words(a, b, least) == (longest if longest >= least else -1)
        long_enough += longest >= least
    assert 300 < long_enough < 1400


def test_word_counts_rule_out_no_link():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = rng.integers(0, 1000, int(rng.integers(20, 3000))).astype(np.uint64)
        b = np.delete(a, rng.choice(len(a), len(a) // 5, replace=False))
        c, d = (near.word_counts(x).astype(int) for x in (a, b))
        assert np.abs(c - d).sum() <= len(a) + len(b) - 2 * near.least_kept(len(a))


# --- sharding


def check_shards(found, shards, rows):
    sizes = collections.Counter()
    slots = collections.defaultdict(list)
    for r in found:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(found) == rows and set(slots) <= set(range(shards))
    return sizes


def test_shards_are_even(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "x" * int(rng.integers(0, 200))) for i in range(3000)] + [(10_000 + i, "hot copy of a text") for i in range(1500)]
    found = sharding.histogram_shards(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    sizes = check_shards(found, 40, 4500)
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and max(abs(x - mean) for x in sizes.values()) <= 2 * 220
    assert all(r.size == len(r.text) + 16 for r in found)


def test_copies_stay_in_a_shard(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abc"), int(rng.integers(1, 300)))) for _ in range(700)]
    rows = [(3 * i + k, t) for i, t in enumerate(texts) for k in range(1 + i % 3)] + [(9000, "long " * 700)] + [(10_000 + i, "hot copy of a text") for i in range(900)]
    found = sharding.histogram_shards(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    sizes = check_shards(found, 40, len(rows))
    of = collections.defaultdict(set)
    for r in found:
        of[r.text].add(r.shard)
    assert {t for t, shards in of.items() if len(shards) > 1} <= {"hot copy of a text"}
    assert max(abs(x - sum(sizes.values()) / 40) for x in sizes.values()) <= 3516 and len(of["hot copy of a text"]) > 1


def test_odd_shards(docs, none):
    found = sharding.histogram_shards(docs, 3).collect()
    check_shards(found, 3, docs.count())
    assert sharding.histogram_shards(none, 3).count() == 0 and {"key", "part"} <= set(found[0].asDict())


# --- WARC


def test_warc_round_trip(spark, none):
    big, other = "<p>ä</p>" * 200, "é" * 600
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (3, "http://c", other), (None, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (3, "http://c", other), (7, "u", "\r\n\r\nWARC/1.1\r\n")]
    rows += [(100 + i, f"http://h/{i}", f"<html>{i}" + "abc " * (i % 50)) for i in range(300)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, n string")
    found = warc.warc_round_trip(pages).collect()
    largest = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            largest[h] = max(i, largest.get(h, i))
    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = largest.get(h) if len(data) >= 1000 and largest.get(h) != i else None
        expected.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    assert sorted(map(repr, ((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found))) == sorted(map(repr, expected))
    assert {bytes(r.payload).decode() for r in found if r.payload is not None} >= {"small", "", other}
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_archives_with_dictionaries_and_damage():
    import io

    records = [warc.record(i, f"http://x/{i}", (f"<html><body>page {i} " + "some shared boilerplate text " * 20).encode()) for i in range(900)]
    out = io.BytesIO()
    assert warc.write_archive(out, records[:600], iter(records[600:])) == 900
    data = out.getvalue()
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    for chunk in (65_536, 7):
        assert list(warc.read_archive(io.BytesIO(data), chunk)) == records
    assert warc.parse(records[5])["page_id"] == 5
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(data[:-3])))
    for broken in (records[0][:-1], records[0].replace(b"page 0", b"page X"), records[0].replace(b"WARC/1.1", b"XARC/1.1"), records[0].replace(b"WARC-Date", b"WARC-Gate"), records[0].replace(b"WARC-Type: response", b"WARC-Type: other")):
        with pytest.raises(warc.WarcError):
            warc.parse(broken)
    plain = io.BytesIO()
    warc.write_archive(plain, records[:3], iter(()))
    assert list(warc.read_archive(io.BytesIO(plain.getvalue()))) == records[:3]


# --- quality


def junk(i):
    return " ".join(f"W{j}x%%% $$$" for j in range(i % 30 + 3)).upper()


def test_quality(spark, docs, none):
    good = corpus(n=200)
    rows = [(i, t, len(t)) for i, t in good] + [(1000 + i, junk(i), 5) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, 1 if i < 1000 else 0) for i, *_ in rows] + [(None, 1), (7777, 0), (3, None), (4, 9)], "doc_id long, quality int")
    odd = F.col("doc_id") % 2 == 1
    found = quality.quality_scores(table, labels, usable=lambda id: ~(id % 2 == 1)).filter(odd).collect()
    assert np.mean([r.predicted == (r.doc_id < 1000) for r in found]) > 0.97 and all(0 <= r.score <= 1 for r in found)
    out = quality.quality_scores(docs, labels, metadata=()).collect()
    assert len(out) == docs.count() and all(isinstance(r.score, float) for r in out)
    assert quality.quality_scores(none, labels, metadata=("size",)).count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0), metadata=("size",)).collect()} == {0.5}


def test_capitals_count_in_the_whole_text():
    upper = lambda words: quality.structure(" ".join(words), words, len(set(words)))[-1]
    assert upper(["a", "A"] * 256) == upper(["A", "a"] * 256) == int(16 * 0.5**0.5)
    assert upper(["A"] * 256 + ["a"] * 255) == int(16 * (256 / 511) ** 0.5)


def test_pairwise_identity():
    rng = np.random.default_rng(0)
    machine = quality.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    index, value, starts = rng.integers(0, 50, 23), rng.normal(size=23), np.array([0, 9, 17])
    for row, (a, b) in enumerate(((0, 9), (9, 17), (17, 23))):
        i, x = index[a:b], value[a:b]
        pairs = sum(machine.factors[i[p]] @ machine.factors[i[q]] * x[p] * x[q] for p in range(b - a) for q in range(p))
        assert np.isclose(machine.margin(index, value, starts)[row], 0.3 + machine.linear[i] @ x + pairs)


# --- fingerprints


def canon(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return re.sub(r"\s+", " ", folded).strip(" ")


def test_fingerprints(spark, docs, none):
    rows, _ = fingerprints.document_fingerprints(docs)
    texts = {r.row: r.text for r in docs.select(row_key("doc_id", "text").alias("row"), "text").collect()}
    groups = collections.defaultdict(set)
    for r in rows.collect():
        groups[canon(texts[r.row])].add(r.fingerprint)
        assert r.n_chars == len(texts[r.row] or "")
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)
    for a, b in (("Straße\t x", "STRASSE  x "), ("ﬁn", "fin"), ("é", "é")):
        pair = spark.createDataFrame([(1, a), (2, b), (3, a + "!")], "doc_id long, text string")
        prints = [r.fingerprint for r in fingerprints.document_fingerprints(pair)[0].orderBy("doc").collect()]
        assert prints[0] == prints[1] != prints[2]
    assert fingerprints.document_fingerprints(none)[0].count() == 0


def test_colliding_buckets_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "wide_hash", lambda canon: F.lpad(F.substring(canon, 1, 1), 32, "0"))
    rows = [(1, "ab"), (2, "ac"), (3, "AB "), (4, "b"), (5, "aa")]
    found = {r.doc: r.fingerprint for r in fingerprints.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert found[1] == found[3] and len({found[i] for i in (1, 2, 4, 5)}) == 4


def test_edited_fingerprints(spark):
    rows = [*corpus(n=50), (900, None), (901, "a"), (902, "a"), (903, "a"), (904, "ab" * 700)]
    found = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts, reverse=True)
    assert len(found) == len(rows)
    for i, after in zip(ids, ids[1:] + ids[:1]):
        cut = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - cut] + texts[after][:cut]
        r = found[i]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.near_edited == 1.0) == (canon(edited) == canon(texts[i])) and (r.near_next == 1.0) == (canon(texts[after]) == canon(texts[i]))
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


# --- helpers and the pipeline


def test_the_filter_loses_nothing(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 - 9000).alias("k"))
    wanted = rows.filter("k % 5 = 0")
    assert maybe_in(rows, "k", wanted).filter("k % 5 = 0").count() == 1000
    assert maybe_in(rows, "k", wanted).count() + maybe_in(rows, "k", wanted, inverse=True).count() == 5000
    assert maybe_in(rows, "k", wanted.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    bench = " ".join(f"benchword{i}" for i in range(20))
    rows = corpus(n=120) + [(1000 + i, junk(i)) for i in range(30)] + [(2000, "before it " + bench + " after it"), (2001, corpus(n=120)[5][1])]
    folder = f"file://{tmp_path}/t"
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000 or i >= 2000), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    # by hand: the same decisions, one after the other
    kept = [(i, t) for i, t in rows if not 1000 <= i < 2000]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    seen = collections.Counter(k for _, t in kept for k in {key(x) for x in t.split("\n")})
    kept = [(i, "\n".join(x for x in t.split("\n") if not (key(x) and seen[key(x)] >= 10))) for i, t in kept]
    classes = {}
    for i, t in sorted(kept):
        of = words_and_shingles(t)
        links = [c for c, members in classes.items() if any(t == u or are_linked(of, v) for u, v in members)]
        merged = [(t, of)] + [m for c in links for m in classes.pop(c)]
        classes[min([i, *links])] = merged
    firsts = {i: t for i, t in kept if i in classes and i != 2000}
    assert set(found) == set(firsts)
    assert all(found[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in firsts.items())


def test_crc_of_ids_splits_the_labels(spark):
    from factlake.llm.queries import held_out

    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)
