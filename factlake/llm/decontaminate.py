"""Benchmark decontamination by templates: typed placeholders, hashed windows, consistent slots.

SQL functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm.common import free_name, maybe_in, row_key, stored

# What marks a number, a name and a unit, and the units.
NUMBER, NAME, UNIT = "\u0001", "\u0002", "\u0003"
UNITS = "kg g mg t lb oz km m cm mm mi ft in l ml s sec min h hr ms kb mb gb tb percent dollars euros pounds cents miles metres meters kilometers hours minutes seconds days weeks months years degrees watts volts joules newtons".split()
SEPARATOR = r"[^\p{L}\p{M}\p{N}\x01\x02\x03]+"
#: What stands between the runs by which documents are first told apart: words without digits,
#: or for windows that have none, digits.
RUNS = {"words": r"[[^\p{L}\p{M}\p{N}]0-9]+", "digits": r"[^0-9]+"}

#: More benchmark windows than this aren't broadcast.
BROADCAST_WINDOWS = 500_000
#: Windows whose words lie together while they are looked up.
BLOCK = 64


def marked(text: Column, everywhere: bool = False) -> Column:
    """The text with each slot's word behind its mark: numbers (without their own . and ,),
    units after a number, and capitalised words that don't begin a sentence, or all of them."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x01\x02\x03]", " ")
    x = F.regexp_replace(x, r"(\d)[.,](?=\d)", "$1")
    x = F.regexp_replace(x, r"\d+", f" {NUMBER}$0 ")
    x = F.regexp_replace(x, rf"({NUMBER}\d+)\s+({'|'.join(sorted(UNITS, key=len, reverse=True))})\b", f"$1 {UNIT}$2")
    if everywhere:
        return F.regexp_replace(x, r"(?<![\p{L}\p{M}\p{N}\x02\x03])\p{Lu}\p{Ll}+", f"{NAME}$0")
    return F.regexp_replace(x, r"\p{Lu}(?<=[\p{Ll},;] \p{Lu})\p{Ll}+", f"{NAME}$0")


def plain(text: Column) -> Column:
    """The text in lower case without marks: its words stand for themselves."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x01\x02\x03]", " "))


def words(marked_text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(marked_text, SEPARATOR, " ")), " ")


def template(marked_text: Column) -> Column:
    """The words in lower case, each slot only its mark; as many as ``words`` has."""
    return F.split(F.lower(F.trim(F.regexp_replace(F.regexp_replace(marked_text, SEPARATOR, " "), r"([\x01\x02\x03])\S+", "$1"))), " ")


def windows(tokens: str, length: Column) -> Column:
    """A hash of each window of ``length`` words; none where the text has fewer."""
    n = F.size(tokens)
    each = F.transform(F.sequence(F.lit(1), n - length + 1), lambda i: F.xxhash64(F.slice(tokens, i, length)))
    return F.when(n >= length, each).otherwise(F.array().cast("array<bigint>"))


def template_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", id: str = "doc_id", item: str = "item_id", item_text: str = "text", whole: bool = False) -> DataFrame:
    """(row, item, n_windows, n_slots, n_changed, first_word, last_word): the benchmark items that
    documents hold, in their own words or with other numbers, names and units.

    Windows of ``window`` template words meet by hash and are then compared word by word. They
    count where the slots of a passage (all windows at one offset) agree: each value of the item
    stands for one value in the document, and no two values for the same one. What a passage
    covers must hold words outside slots for half a window; a window that has fewer is looked up
    like others and counts with its passage, one of slots alone says nothing and isn't. Items
    shorter than a window can't be found.

    ``whole``, as the registered query and the pipeline have it, finds more: literal windows in
    lower case too, whatever share of them is slots, and items shorter than a window as one
    literal window of their length. So are templates in which every capitalised word is a name,
    at the start of a sentence or after any white space too. Each of these ways judges its own
    passages by the same rule (literal ones have no slots). n_windows, n_slots and n_changed are
    the most of any of these.

    ``row`` is ``row_key(id, text)``. Null texts and items match nothing; null ids are
    ids like others; repeated rows are one row here, repeated items count once; empty tables
    give no rows.
    """
    keyed = docs.select(row_key(id, text).alias("row"), F.col(text).alias("text"))
    asked = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    ways = [(marked, window, None)]
    if whole:
        sizes = asked.select(plain(F.col("text")).alias("plain")).select(words(F.col("plain")).alias("w")).filter("w[0] <> ''").select(F.size("w").alias("n"))
        short = sorted(r.n for r in sizes.filter(F.col("n") < window).distinct().collect())
        ways += [(plain, window, None), (lambda text: marked(text, everywhere=True), window, None)] + [(plain, n, n) for n in short]
    items, sought = sought_windows(asked, ways)
    every = _matches(candidates(keyed, sought), items, sought, ways)
    first = lambda c: F.min_by(c, "way").alias(c)
    return every.groupBy("row", "item").agg(*[F.max(c).alias(c) for c in ("n_windows", "n_slots", "n_changed")], first("first_word"), first("last_word"))


def by_ways(rows: DataFrame, ways: list[tuple]) -> DataFrame:
    """``rows`` with (way, span, marked) for each way (how to mark texts, words of a window, words
    of an item or None for all)."""
    each = [rows.select("*", F.lit(way).alias("way"), F.lit(span).alias("span"), marks(F.col("text")).alias("marked")) for way, (marks, span, _) in enumerate(ways)]
    return reduce(DataFrame.unionAll, each).drop("text")


def sought_windows(asked: DataFrame, ways: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """The items by each way, and their windows: (way, hash, item_row, item_at, kind, one, other,
    reach). ``one`` and ``other`` are the longest two of the window's runs (the same, where it
    has one alone) that aren't in slots, of words or, if it has none, of digits; a document that
    has the window has them within ``reach`` runs."""
    items = by_ways(asked, ways).distinct()
    items = items.select("way", "span", F.xxhash64("item", "marked").alias("item_row"), "item", words(F.col("marked")).alias("item_words"), template(F.col("marked")).alias("item_template"))
    for way, (_, _, of_size) in enumerate(ways):
        if of_size is not None:
            items = items.filter((F.col("way") != way) | (F.size("item_words") == of_size) & (F.col("item_words")[0] != ""))
    items = stored(items, "benchmark-items")
    sought = items.select("way", "span", "item_row", "item_template", F.posexplode(windows("item_template", F.col("span"))).alias("item_at", "hash"))
    tokens = F.slice("item_template", F.col("item_at") + 1, F.col("span"))
    literal = F.filter(tokens, lambda w: ~w.isin(NUMBER, NAME, UNIT))
    text = F.array_join(literal, " ")
    sought = sought.filter(F.size(literal) > 0).withColumn("runs", runs(text, "words")).withColumn("digits", runs(text, "digits"))
    wordless = F.size("runs") == 0
    sought = sought.withColumn("kind", F.when(wordless, "digits").otherwise("words")).withColumn("runs", F.when(wordless, F.col("digits")).otherwise(F.col("runs")))
    longest = F.reverse(F.array_sort(F.transform(F.array_distinct("runs"), lambda w: F.struct(F.length(w).alias("n"), w.alias("run")))))
    sought = sought.withColumn("longest", longest).withColumn("one", F.get("longest", F.lit(0))["run"])
    sought = sought.select("way", "hash", "item_row", "item_at", "kind", "one", F.coalesce(F.get("longest", F.lit(1))["run"], "one").alias("other"), F.greatest("span", F.size("runs")).alias("reach"))
    return items, stored(sought, "benchmark-windows")


def runs(lower: Column, kind: str) -> Column:
    return F.filter(F.split(lower, RUNS[kind]), lambda w: w != "")


def candidates(keyed: DataFrame, sought: DataFrame) -> DataFrame:
    """The distinct rows of ``keyed`` that may hold a window: those that have its two longest
    runs as near each other as it has. Most documents stop here, before any window is made of
    them; a document's runs are looked up in a broadcast table, if that is small, and only the
    few that are found are sorted by place."""
    pairs = stored(sought.groupBy("kind", "one", "other").agg(F.max("reach").alias("reach")), "anchor-runs")
    texts, some = keyed.filter("text IS NOT NULL"), None
    for kind, reach in pairs.groupBy("kind").agg(F.max("reach")).collect():
        wanted = pairs.filter(F.col("kind") == kind).select(F.col("one").alias("run"), "other")
        single = wanted.select("run").unionAll(wanted.select("other")).distinct()
        small = 2 * wanted.count() <= BROADCAST_WINDOWS
        held = texts.select("row", F.posexplode(F.split(F.lower("text"), RUNS[kind])).alias("at", "run"))
        held = held.join(F.broadcast(single), "run", "left_semi") if small else maybe_in(held, "run", single).join(single, "run", "left_semi")
        near = Window.partitionBy("row").orderBy("at").rangeBetween(-reach, reach)
        held = held.withColumn("near", F.collect_set("run").over(near))
        held = held.join(F.broadcast(wanted) if small else wanted, "run").filter(F.array_contains("near", F.col("other"))).select("row")
        some = held if some is None else some.unionAll(held)
    if some is None:
        return keyed.limit(0)
    return stored(maybe_in(texts, "row", some.distinct()).dropDuplicates(["row"]), "candidates")


def _matches(keyed: DataFrame, items: DataFrame, sought: DataFrame, ways: list[tuple]) -> DataFrame:
    """``template_matches`` by each way."""
    sought = sought.select("way", "hash", "item_row", "item_at")
    small = sought.count() <= BROADCAST_WINDOWS
    texts = by_ways(keyed, ways)
    # one lambda, so that Spark marks a text once for both
    read = F.transform(F.array("marked"), lambda m: F.struct(words(m).alias("words"), template(m).alias("template")))
    found = texts.select("row", "way", "span", F.inline(read))
    # a window's row carries the words of its block alone, however long the text
    starts = F.when(F.size("template") >= F.col("span"), F.sequence(F.lit(0), F.size("template") - F.col("span"), F.lit(BLOCK)))
    part = lambda c, at: F.slice(c, at + 1, F.col("span") + BLOCK - 1).alias(c)
    found = found.select("row", "way", "span", F.inline(F.transform(starts, lambda at: F.struct(at.alias("start"), part("words", at), part("template", at)))))
    found = found.select("row", "way", "span", "start", "words", F.posexplode(windows("template", F.col("span"))).alias("nth", "hash")).withColumn("at", F.col("start") + F.col("nth"))
    # a window that meets one of the benchmark takes its words along, so no text is read or exchanged again
    seen = F.array_join(F.slice("words", F.col("nth") + 1, F.col("span")), " ").alias("seen")
    if small:
        found = found.join(F.broadcast(sought), ["way", "hash"]).select("row", "way", "at", seen, "item_row", "item_at")
    else:
        found = maybe_in(found, "hash", sought).select("row", "way", "hash", "at", seen).join(sought, ["way", "hash"])
    pairs = found.groupBy("row", "way", "item_row", (F.col("at") - F.col("item_at")).alias("offset")).agg(F.sort_array(F.collect_set(F.struct("at", "item_at", "seen"))).alias("places"))
    both = pairs.join(items, ["way", "item_row"])
    same = lambda p: template(p.seen) == F.slice("item_template", p.item_at + 1, F.col("span"))
    split = lambda p: F.struct(p.at.alias("at"), p.item_at.alias("item_at"), F.split(p.seen, " ").alias("words"))
    both = both.withColumn("places", F.transform(F.filter("places", same), split)).filter(F.size("places") > 0)
    steps = F.sequence(F.lit(1), F.col("span"))
    last = F.max(F.array_max("places.at") + F.col("span") - 1).cast("long").alias("last_word")
    value = lambda c, at: F.lower(F.element_at(c, at))
    slot = lambda p: F.filter(F.transform(steps, lambda k: F.struct(value("item_words", p.item_at + k).alias("mine"), value(p.words, k).alias("theirs"))), lambda s: F.substring(s.mine, 1, 1).isin(NUMBER, NAME, UNIT))
    both = both.withColumn("slots", F.array_distinct(F.flatten(F.transform("places", slot))))
    n, mine, theirs = F.size("slots"), F.size(F.array_distinct("slots.mine")), F.size(F.array_distinct("slots.theirs"))
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.transform(steps, lambda k: p.item_at + k))))
    literal = F.filter(covered, lambda at: ~F.element_at("item_template", at).isin(NUMBER, NAME, UNIT))
    return both.filter((n == mine) & (n == theirs) & (F.size(literal) * 2 >= F.col("span"))).groupBy("row", "item", "way").agg(
        F.sum(F.size("places")).cast("long").alias("n_windows"), F.max(n).cast("long").alias("n_slots"),
        F.max(F.size(F.filter("slots", lambda s: s.mine != s.theirs))).cast("long").alias("n_changed"),
        F.min(F.array_min("places.at")).cast("long").alias("first_word"), last,
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """(id, items, n_windows, n_changed): a row for each document that holds benchmark items.

    Nulls, empty texts, ties, repeated rows and empty tables are as in ``template_matches``: a
    null id is an id, rows that repeat id and text give one row. Other columns aren't read."""
    matches = template_matches(docs, benchmark, text=text, id=id, **options)
    ids = docs.select(row_key(id, text).alias("row"), F.col(id))
    per = matches.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"), F.sum("n_windows").alias("n_windows"), F.sum("n_changed").alias("n_changed"))
    per = stored(per, "contaminated")
    return maybe_in(ids, "row", per).distinct().join(per, "row").drop("row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold benchmark items, as ``template_matches`` finds
    them. Null and empty texts stay, repeated rows stay or go together, and so do rows with null
    ids and equal texts; all columns are kept, whatever their names. Only rows that may go are
    exchanged."""
    row = free_name(docs, "row")
    bad = stored(template_matches(docs, benchmark, text=text, id=id, **options).select(F.col("row").alias(row)).distinct(), "contaminated")
    keyed = docs.withColumn(row, row_key(id, text))
    clean = maybe_in(keyed, row, bad, inverse=True).unionByName(maybe_in(keyed, row, bad).join(bad, row, "left_anti"))
    return clean.select(docs.columns)
