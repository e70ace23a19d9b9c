"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

SQL functions only.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import free_name

# The base kinds in their order, with the group that is the secret and its least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: What a run that has such a match holds.
_HOLDS = {"access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}
LEARNED = "markov"
KINDS = [*BASE, LEARNED]

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SYMBOL = "[A-Za-z0-9+/_=-]"
#: Runs of symbols; those of the kinds access and hex lie in one, as a match too short has no part that is long enough.
_LONG = 16
_RUN = f"(?<!{_SYMBOL}){_SYMBOL}{{{_LONG},}}+"
_PIECE = 512  # symbols of a run that are taken apart at once; neighbouring pieces share one

FOUND = "array<struct<start: int, end: int, value: string>>"


def _sums(lengths: Column) -> Column:
    """(total, ends): the sums up to each of an array's numbers."""
    step = lambda a, x: F.struct((a.total + x).alias("total"), F.array_append(a.ends, a.total + x).alias("ends"))
    return F.aggregate(lengths, F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("ends")), step)


def _blocks(lengths: Column) -> Column:
    """``_sums`` by blocks of 512, so that an array of m takes m * 512 steps and not m * m."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / 512).cast("int")), lambda b: _sums(F.slice(lengths, b * 512 + 1, 512)))


def _lengths(text: Column, pattern: str, found: Column) -> Column:
    """Of each match and what stands before it, together."""
    return F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, match: F.length(gap) + F.length(match))


def _placed(blocks: Column, found: Column, values: Column) -> Column:
    before = _sums(F.transform(blocks, lambda b: b.total)).ends
    ends = F.flatten(F.zip_with(blocks, before, lambda b, upto: F.transform(b.ends, lambda x: x + upto - b.total)))
    return F.zip_with(ends, F.arrays_zip(found.alias("match"), values.alias("value")), lambda end, x: F.struct((end - F.length(x.match)).alias("start"), end.alias("end"), x.value.alias("value")))


def located(rows: DataFrame, text: str, pattern: str, name: str, group: int = 0, least: int = 1, possible: Column | None = None, wanted=lambda found: F.size(found) > 0) -> DataFrame:
    """``rows`` with ``name``: (start, end, value) of a pattern's leftmost non-overlapping matches,
    in code points; ``value`` is the group, and matches whose value is shorter than ``least`` go
    after matching. Rows that aren't ``possible`` or whose matches aren't ``wanted`` have none.

    SQL functions give matches without their places; these are sums of the lengths of what stands
    between the matches and of the matches. The steps are columns, so that each is taken once.
    """
    found, values, lengths, blocks = (free_name(rows, c) for c in ("found", "values", "lengths", "blocks"))
    take = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    none = F.array().cast("array<string>")
    rows = rows.withColumn(found, take(0) if possible is None else F.when(possible, take(0)).otherwise(none))
    rows = rows.withColumn(found, F.when(wanted(F.col(found)), F.col(found)).otherwise(none))
    some = F.size(found) > 0
    rows = rows.withColumn(values, F.col(found) if group == 0 else F.when(some, take(group)).otherwise(none))
    rows = rows.withColumn(lengths, F.when(some, _lengths(F.col(text), pattern, F.col(found))))
    rows = rows.withColumn(blocks, F.when(some, _blocks(F.col(lengths))))
    placed = F.when(some, _placed(F.col(blocks), F.col(found), F.col(values))).otherwise(F.array().cast(FOUND))
    return rows.withColumn(name, F.filter(placed, lambda x: F.length(x.value) >= least)).drop(found, values, lengths, blocks)


def _inside(runs: Column, kind: str) -> Column:
    """The matches of a base kind within runs."""
    pattern, _, least = BASE[kind]

    def of(run: Column) -> Column:
        found = F.regexp_extract_all(run.value, F.lit(pattern), F.lit(0))
        placed = _placed(_blocks(_lengths(run.value, pattern, found)), found, found)
        return F.transform(F.filter(placed, lambda x: F.length(x.value) >= least), lambda x: F.struct((x.start + run.start).alias("start"), (x.end + run.start).alias("end"), x.value.alias("value")))

    return F.flatten(F.transform(F.filter(runs, lambda r: r.value.rlike(_HOLDS[kind])), of))


def scanned(rows: DataFrame, text: str, base: str, runs: str, likely=lambda value: F.lit(False)) -> DataFrame:
    """``rows`` with ``base``, an array of (start, kind's number, end, value) of the base kinds, and
    ``runs``, the long runs of symbols of those texts where one is ``likely`` or holds a base span.
    Other texts' runs, nearly all, need no places."""
    assign = free_name(rows, "assign")
    pattern, group, least = BASE["assign"]
    rows = located(rows, text, pattern, assign, group, least, F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")))
    rows = located(rows, text, _RUN, runs, wanted=lambda found: F.exists(found, lambda v: v.rlike("|".join(_HOLDS.values())) | likely(v)))
    found = {"assign": F.col(assign), "access": _inside(F.col(runs), "access"), "hex": _inside(F.col(runs), "hex")}
    span = lambda kind: lambda x: F.struct(x.start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x.end.alias("end"), x.value.alias("value"))
    return rows.withColumn(base, F.concat(*[F.transform(found[kind], span(kind)) for kind in BASE])).drop(assign)


def labelled_samples(docs: DataFrame, text: str = "text", least: int = 4) -> DataFrame:
    """(sample, random) of a corpus: the values of the base spans are random strings, all other
    words of ``least`` symbols or more are ordinary. Each distinct sample counts once."""
    whole = scanned(docs.select(F.coalesce(text, F.lit("")).alias("whole")), "whole", "base", "runs")
    rest = reduce(lambda t, kind: F.regexp_replace(t, f"{_HOLDS[kind]}[A-Z0-9a-f]*" if kind in _HOLDS else BASE[kind][0], " "), BASE, F.col("whole"))
    whole = whole.withColumn("rest", F.when(F.size("base") > 0, rest).otherwise(F.col("whole")))
    # one array of both, so that a text is read once
    both = F.concat(
        F.transform("base", lambda x: F.struct(x.value.alias("sample"), F.lit(True).alias("random"))),
        F.transform(F.regexp_extract_all("rest", F.lit(f"{_SYMBOL}{{{least},}}+"), F.lit(0)), lambda s: F.struct(s.alias("sample"), F.lit(False).alias("random"))),
    )
    return whole.select(F.inline(both)).distinct()


def pieces(run: Column) -> Column:
    """A run in pieces of bounded length, neighbours sharing a symbol; none of an empty one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1)), F.lit(_PIECE - 1))
    return F.transform(F.when(F.length(run) > 0, starts).otherwise(F.array().cast("array<int>")), lambda at: F.substring(run, at, F.lit(_PIECE)))


def transition_counts(samples: DataFrame) -> DataFrame:
    """(random, kind, pair, n): how often a symbol follows another in a sample (``pair``), begins
    it with another (``head``), and how often a sample ends and begins with two symbols (``ends``)."""
    word = F.col("sample")
    cut = samples.filter(word.rlike(f"\\A{_SYMBOL}{{2,}}\\z")).select("random", F.substring(word, 1, 2).alias("head"), F.concat(F.substring(word, -1, 1), F.substring(word, 1, 1)).alias("ends"), F.posexplode(pieces(word)).alias("no", "piece"))
    one = lambda kind, pair: F.struct(F.lit(kind).alias("kind"), pair.alias("pair"))
    inner = F.transform(F.when(F.length("piece") > 1, F.sequence(F.lit(1), F.length("piece") - 1)).otherwise(F.array().cast("array<int>")), lambda i: one("pair", F.substring("piece", i, F.lit(2))))
    outer = F.when(F.col("no") == 0, F.array(one("head", F.col("head")), one("ends", F.col("ends")))).otherwise(F.array().cast("array<struct<kind: string, pair: string>>"))
    return cut.select("random", F.inline(F.concat(inner, outer))).groupBy("random", "kind", "pair").agg(F.count("*").alias("n"))


def log_ratios(samples: DataFrame, even: float = 0.5, alpha: float = 0.5) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) for all pairs of symbols, from labelled
    samples (sample, random).

    A sample counts in some spellings, all of whose transitions follow from its own: a secret in
    the other case is one too, and identifiers are words as they are, in capitals, capitalised
    side by side, and between the signs that join words. Both chains are smoothed with ``alpha``
    counts a pair; ``even`` is the share of the even distribution in the chain of random strings,
    which may have any alphabet. At most six counts for each of 66 * 66 pairs come to the driver.
    Samples of one symbol or with other characters teach nothing. Without samples of a kind its chain is even.
    """
    counts = {flag: Counter() for flag in (True, False)}
    for r in transition_counts(samples).collect():
        pair, n, own = r["pair"], r["n"], counts[r["random"]]
        if r["random"]:
            own.update({pair: n, pair.swapcase(): n} if r["kind"] == "pair" and pair != pair.swapcase() else {pair: n} if r["kind"] == "pair" else {})
        elif r["kind"] == "pair":
            own[pair] += 7 * n  # as it is, in the two capitalised words, between each of four signs
            own[pair.upper()] += n
        elif r["kind"] == "head":
            own[pair] -= 2 * n
            own[pair[0].upper() + pair[1]] += 2 * n
        else:
            own[pair[0] + pair[1].upper()] += n
            for mark in "_-/=":
                own.update({mark * 2: 2 * n, mark + pair[1]: n, pair[0] + mark: n})
    out = []
    for a in SYMBOLS:
        rows = {flag: [counts[flag][a + b] for b in SYMBOLS] for flag in counts}
        share = {flag: [(n + alpha) / (sum(row) + alpha * len(SYMBOLS)) for n in row] for flag, row in rows.items()}
        out += [math.log((1 - even) * r + even / len(SYMBOLS)) - math.log(o) for r, o in zip(share[True], share[False])]
    return out


def likelihood_ratio(run: Column, ratios: list[float]) -> Column:
    """A run's log-likelihood ratio, random over ordinary, summed over its transitions."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    symbol = lambda piece, i: F.instr(F.lit(SYMBOLS), F.substring(piece, i, F.lit(1))) - 1
    of = lambda a, b: F.when((a >= 0) & (b >= 0), F.get(table, a * len(SYMBOLS) + b)).otherwise(0.0)

    def step(acc, x):
        return F.struct(x.alias("last"), (acc.total + F.when(acc.last == -2, 0.0).otherwise(of(acc.last, x))).alias("total"))

    start = F.struct(F.lit(-2).alias("last"), F.lit(0.0).alias("total"))
    one = lambda piece: F.aggregate(F.transform(F.sequence(F.lit(1), F.length(piece)), lambda i: symbol(piece, i)), start, step, lambda acc: acc.total)
    return F.aggregate(F.transform(pieces(run), one), F.lit(0.0), lambda a, b: a + b)


def secret_spans(docs: DataFrame, ratios: list[float], text: str = "text", least: int = 16, margin: float = 1.25) -> DataFrame:
    """``docs`` with ``spans``: array<struct<start, kind, end, value, score>>, by start and then kind.

    Base spans are the whole matches of the fixed patterns, in code points, ends exclusive;
    ``value`` is the secret itself. The method adds, as kind ``markov``, each run of ``least``
    (16 or more) symbols that touches no base span and whose log-likelihood ratio, random strings
    over ordinary identifiers, is ``margin`` or more a transition; ``score`` is that mean, and
    null for base spans.

    One pass, no exchange. A null text counts as empty and has no spans; texts are scanned whole,
    a long run in pieces; repeated rows give equal rows; an empty table gives an empty one.
    Other columns are kept, one named ``spans`` is replaced.
    """
    if least < _LONG:
        raise ValueError(f"runs have {_LONG} symbols at least")
    kept = [c for c in docs.columns if c != "spans"]
    found = docs.select(*kept)
    whole, base, runs, apart = (free_name(found, c) for c in ("whole", "base", "runs", "apart"))
    score = lambda value: likelihood_ratio(value, ratios) / (F.length(value) - 1)
    found = scanned(found.withColumn(whole, F.coalesce(text, F.lit(""))), whole, base, runs, lambda value: (F.length(value) >= least) & (score(value) >= margin))
    alone = F.filter(runs, lambda r: (F.length(r.value) >= least) & ~F.exists(base, lambda b: (b.start < r.end) & (r.start < b.end)))
    scored = F.transform(alone, lambda r: F.struct(r.start.alias("start"), F.lit(KINDS.index(LEARNED)).alias("kind"), r.end.alias("end"), r.value.alias("value"), score(r.value).alias("score")))
    found = found.withColumn(apart, scored)
    sure = F.transform(base, lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end"), x.value.alias("value"), F.lit(None).cast("double").alias("score")))
    every = F.array_sort(F.concat(sure, F.filter(apart, lambda x: x.score >= margin)))
    names = F.array(*map(F.lit, KINDS))
    named = F.transform(every, lambda x: F.struct(x.start.alias("start"), F.get(names, x.kind).alias("kind"), x.end.alias("end"), x.value.alias("value"), x.score.alias("score")))
    return found.select(*kept, named.alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
