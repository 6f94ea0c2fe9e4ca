"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers (also spelled out), names (capitalised inside a sentence) and units behind a number become typed placeholders, so a
question with other numbers and names has the same template. Windows of templates are hashed and joined by hash; a pair
of document and item that shares one is aligned there and compared token by token over the whole item. It is reported if
enough of the item's tokens agree and the slots are consistent: each value of the item stands for one value of the same
type in the document throughout, which real re-parameterisations keep and chance overlaps of placeholders do not.

It is also reported for its contiguous runs of SHORTEST tokens or more that are consistent in themselves and at least half
literal or equal: if the runs of neighbouring alignments together hold enough of the item, or one has RUN tokens.

A capitalised first word of an item is literal at the start of a sentence and a name inside one; the item has both readings.

Windows start at every token of documents and items: a shared run of WINDOW tokens always has a window in common. Items
shorter than that have windows of their own length. An item's windows with fewer than half literal tokens are met by
their raw tokens, so verbatim copies share them; if all windows of an item are such, those with a literal token are met
by their templates too.
Items of fewer than SHORTEST tokens, null or empty texts on either side, and rows with a null key are never reported.
A pair is reported once however many rows repeat the document or the item, with its best alignment.

The items' distinct window hashes are broadcast up to BROADCAST_ROWS of them; a larger benchmark is joined by shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import Store

WINDOW, SHORTEST = 6, 4
#: Least share of the item's template tokens that must agree, and most rows of a broadcast side (16 bytes each).
COVERED, BROADCAST_ROWS = 0.5, 1_000_000
#: A contiguous passage of so many tokens is reported whatever its share of the item.
RUN = 20

#: Number words and unit words.
NUMBER_WORDS = (
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "zwei drei vier fünf sechs sieben acht neun zehn deux trois quatre cinq sept huit neuf dix dos tres cuatro cinco seis siete ocho nueve diez"
).split()
UNITS = (
    "mm cm m km in ft mi mile miles yard yards inch inches foot feet meter meters metre metres kilometer kilometers kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ton tons tonnes "
    "ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years jahre jahr tage ans jours años días "
    "mph kmh kph hz khz mhz ghz kb mb gb tb w kw mw v a k c f degree degrees dollar dollars cent cents euro euros usd eur gbp percent"
).split()

#: What makes the capitalised word behind it a name: a letter, digit, comma, semicolon or colon, then white space and perhaps opening marks.
NAMED = r"([\p{L}\p{N},;:][\s\p{Z}]++[\"'`“”„‘’‚«»‹›(\[{*]*+)(?=\p{Lu}\p{Ll})"
_EDGE = r"[^\p{L}\p{N}_#@¤]+"


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def raw_tokens(text: Column) -> Column:
    """Lower-case tokens in which names carry a mark and a number is one token."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), "#@¤_", "    ")
    t = F.regexp_replace(t, NAMED, "$1¤")
    t = _let(t, lambda t: F.when(t.rlike(r"[0-9][.,:\p{L}]"), F.regexp_replace(F.regexp_replace(t, r"(?<=[0-9])[.,:](?=[0-9])", "_"), r"(?<=[0-9])(?=\p{L})", " ")).otherwise(t))
    return F.filter(F.split(F.lower(t), _EDGE), lambda w: w != "")


def template(raw: Column) -> Column:
    """Placeholders instead of names, numbers and units behind numbers; one token for one token."""
    number = lambda w: ((w >= "0") & (w < ":")) | w.isin(NUMBER_WORDS)
    t = F.transform(raw, lambda w: F.when(w.startswith("¤"), "¤").when(number(w), "#").otherwise(w))

    def units(t: Column) -> Column:
        behind = lambda w, i: (i > 0) & w.isin(UNITS) & (F.get(t, i - 1) == "#")
        return F.when(F.array_contains(t, "#"), F.transform(t, lambda w, i: F.when(behind(w, i), "@").otherwise(w))).otherwise(t)

    return _let(t, units)


def inner_tokens(text: Column) -> Column:
    """raw_tokens of a text that stands inside a sentence: a capitalised first word is a name."""
    t = raw_tokens(F.concat(F.lit("x: "), text))
    return F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))


def bare(raw: Column) -> Column:
    """Raw tokens without the marks of names."""
    return F.transform(raw, lambda w: F.translate(w, "¤", ""))


def _windows(hashes: Column, length: int, verbatim: bool) -> Column:
    """array of (length, verbatim, at, h): a hash for each window of an array of token hashes."""
    window = lambda at: F.xxhash64(*(F.get(hashes, at + k) for k in range(length)))
    made = lambda at: F.struct(F.lit(length).alias("length"), F.lit(verbatim).alias("verbatim"), (at + 1).alias("at"), window(at).alias("h"))
    return F.when(F.size(hashes) >= length, F.transform(F.sequence(F.lit(0), F.size(hashes) - length), made))


def _token_hashes(toks: Column) -> Column:
    return F.transform(toks, lambda w: F.xxhash64(w))


def _placeholder(w: Column) -> Column:
    return w.isin("#", "@", "¤")


def item_windows(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, n, length, verbatim, at, h): every window by its template or, if less than half of it is literal, its raw tokens."""
    readings = F.array(raw_tokens(F.col(text)), inner_tokens(F.coalesce(text, F.lit(""))))
    toks = items.where(F.col(item).isNotNull()).select(item, F.explode(F.array_distinct(readings)).alias("r")).select(item, bare(F.col("r")).alias("r"), template(F.col("r")).alias("t")).where(F.size("t") >= SHORTEST)
    each = []
    for length in range(SHORTEST, WINDOW + 1):
        mine = toks.where(F.size("t") >= WINDOW if length == WINDOW else F.size("t") == length)
        both = mine.select(item, "t", F.size("t").alias("n"), *(_windows(_token_hashes(F.col(c)), length, c == "r").alias(f"w{c}") for c in "rt"))
        cut = both.select(item, "t", "n", F.explode(F.concat("wr", "wt")).alias("w")).select(item, "t", "n", "w.*")
        each.append(cut.withColumn("literals", F.size(F.filter(F.slice("t", F.col("at"), length), lambda w: ~_placeholder(w)))).drop("t"))
    cut = reduce(DataFrame.unionByName, each).withColumn("most", F.max("literals").over(Window.partitionBy(item)))
    rich = 2 * F.col("literals") >= F.col("length")
    poor = (2 * F.col("most") < F.col("length")) & (F.col("literals") > 0)
    return cut.where(F.when(F.col("verbatim"), ~rich).otherwise(rich | poor)).select(item, "n", "length", "verbatim", "at", "h").distinct()


def sized(df: DataFrame) -> DataFrame:
    """With a broadcast hint if the (written) table is small; otherwise as it is, and the join shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _slots(z: Column) -> Column:
    """The distinct (kind, item, doc) of the aligned placeholders."""
    return F.array_distinct(F.transform(F.filter(z, lambda x: _placeholder(x["dt"])), lambda x: F.struct(x["dt"].alias("kind"), F.translate(x["ir"], "¤", "").alias("item"), F.translate(x["dr"], "¤", "").alias("doc"))))


def _consistent(slots: Column) -> Column:
    return F.size(F.array_distinct(F.transform(slots, lambda s: F.struct(s["kind"], s["item"])))) == F.size(slots)


def _union(spans: Column) -> Column:
    """How many places the spans (a to b, both inclusive) hold together."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-(2**30)).alias("upto"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["b"] - F.greatest(s["a"] - 1, acc["upto"]), F.lit(0))).alias("n"), F.greatest(s["b"], acc["upto"]).alias("upto"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", store: Store | None = None) -> DataFrame:
    """(key, item, matched, n_tokens, coverage, n_slots): one row for each document and item that it contains."""
    store = store or Store(docs.sparkSession, "leaks")
    items = items.select(F.col(item).alias("_item"), F.col(item_text).alias("_text"))
    docs = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).where("_doc IS NOT NULL")
    windows, by = store.put(item_windows(items, "_item", "_text"), "items"), ["length", "verbatim"]
    known = sized(store.put(windows.select(*by, "h").distinct(), "hashes"))
    kinds = sorted(map(tuple, windows.select(*by).distinct().collect()))  # at most two of each length
    toks = docs.select("_doc", raw_tokens(F.col("_text")).alias("r")).select("_doc", _token_hashes(template(F.col("r"))).alias("t"), *([_token_hashes(bare(F.col("r"))).alias("r")] if any(v for _, v in kinds) else []))
    empty = F.expr("cast(array() as array<struct<length:int,verbatim:boolean,at:int,h:bigint>>)")
    each = [F.coalesce(_windows(F.col("r" if verbatim else "t"), n, verbatim), empty) for n, verbatim in kinds]
    met = toks.select("_doc", F.explode(F.concat(empty, *each)).alias("w")).select("_doc", "w.*")
    hits = store.put(met.join(known, [*by, "h"]).select("_doc", *by, "h", "at"), "hits")
    # what a document shares with an item, by where the item would start in it
    items_at = windows.select("_item", *by, "h", F.col("at").alias("item_at"))
    pairs = hits.join(sized(items_at), [*by, "h"]).select("_doc", "_item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    held = lambda df, k, *more: df.select(k, raw_tokens(F.col("_text")).alias("r"), *more).select(k, "r", template(F.col("r")).alias("t"), *(["inner"] if more else []))
    of = held(items.where("_item IS NOT NULL"), "_item", template(inner_tokens(F.coalesce("_text", F.lit("")))).alias("inner")).select("_item", F.col("r").alias("ir"), F.col("t").alias("it"), F.col("inner"))
    longest = sized(store.put(of.groupBy("_item").agg(F.max(F.size("it")).alias("longest")), "lengths"))
    pairs = store.put(pairs.join(longest, "_item"), "pairs")
    told = store.put(pairs.select("_doc").distinct(), "found")
    some = held(docs.join(sized(told), "_doc", "left_semi"), "_doc")
    both = some.join(pairs, "_doc")
    # the part of the document under the longest text of the item, cut before the items' tokens come: what is joined to them
    # has at most an item's length of the document for each alignment; cut at both ends, so that positions keep their partners
    lo = F.greatest(F.col("shift"), F.lit(0))
    room = F.greatest(F.least(F.col("longest") - (lo - F.col("shift")), F.size("t") - lo), F.lit(0))
    both = both.select("_doc", "_item", "shift", (lo - F.col("shift")).alias("skip"), F.slice("r", lo + 1, room).alias("dr"), F.slice("t", lo + 1, room).alias("dt")).join(of, "_item")
    span = F.greatest(F.least(F.size("it") - F.col("skip"), F.size("dt")), F.lit(0))
    under = lambda c, start: F.slice(c, start + 1, span)
    z = F.arrays_zip(under("dr", F.lit(0)).alias("dr"), under("dt", F.lit(0)).alias("dt"), *(under(c, F.col("skip")).alias(c) for c in ("ir", "it", "inner")))
    both = both.select("_doc", "_item", "shift", "skip", F.size("it").alias("n"), z.alias("z"))
    same = lambda x: (x["dt"] == x["it"]) | (x["dt"] == x["inner"])
    agreed = F.filter("z", same)
    last = F.size("z") - 1
    met_at = lambda i: same(F.get("z", i))
    every = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.expr("cast(array() as array<int>)"))
    begins = F.filter(every, lambda i: met_at(i) & ((i == 0) | ~met_at(i - 1)))
    ends = F.filter(every, lambda i: met_at(i) & ((i == last) | ~met_at(i + 1)))
    runs = F.filter(F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda r: r["b"] - r["a"] + 1 >= SHORTEST)
    both = both.select("_doc", "_item", "n", "shift", "skip", "z", F.size(agreed).alias("matched"), _slots(agreed).alias("slots"), runs.alias("runs"))
    cut = lambda r: F.slice("z", r["a"] + 1, r["b"] - r["a"] + 1)

    def trimmed(r: Column) -> Column:
        """An inconsistent run without the placeholders at its ends, which chance may have put there."""
        literal = F.filter(F.sequence(r["a"], r["b"]), lambda i: ~_placeholder(F.get("z", i)["dt"]))
        return F.when(_consistent(_slots(cut(r))) | (F.size(literal) == 0), r).otherwise(F.struct(F.array_min(literal).alias("a"), F.array_max(literal).alias("b")))

    firm = lambda x: ~_placeholder(x["dt"]) | (F.translate(x["dr"], "¤", "") == F.translate(x["ir"], "¤", ""))
    held_runs = F.filter(F.transform("runs", trimmed), lambda r: (r["b"] - r["a"] + 1 >= SHORTEST) & _consistent(_slots(cut(r))) & (2 * F.size(F.filter(cut(r), firm)) >= r["b"] - r["a"] + 1))
    told_runs = F.transform(held_runs, lambda r: F.struct((r["a"] + F.col("skip")).alias("a"), (r["b"] + F.col("skip")).alias("b"), F.col("shift").alias("shift"), F.size(_slots(cut(r))).alias("n_slots")))
    whole = _consistent(F.col("slots")) & (F.col("matched") >= COVERED * F.col("n"))
    one = both.select("_doc", "_item", "n", "shift", F.when(whole, F.struct("matched", F.size("slots").alias("n_slots"))).alias("whole"), told_runs.alias("runs"))
    # alignments no further apart than the item is long are one copy with words put in or left out
    near = Window.partitionBy("_doc", "_item").orderBy("shift")
    one = one.withColumn("new", (F.col("shift") - F.lag("shift").over(near) > F.col("n")).cast("int")).withColumn("copy", F.sum(F.coalesce("new", F.lit(0))).over(near.rowsBetween(Window.unboundedPreceding, 0)))
    copies = one.groupBy("_doc", "_item", "copy").agg(F.max("n").alias("n"), F.max("whole").alias("whole"), F.flatten(F.collect_list("runs")).alias("runs"))
    spans = lambda by: F.transform("runs", lambda r: F.struct((r["a"] + by(r)).alias("a"), (r["b"] + by(r)).alias("b")))
    # no more than the item's tokens that are met, nor than the document's tokens that meet them
    covered = F.least(_union(spans(lambda r: F.lit(0))), _union(spans(lambda r: r["shift"])))
    longest = F.coalesce(F.array_max(F.transform("runs", lambda r: r["b"] - r["a"] + 1)), F.lit(0))
    slots = F.aggregate("runs", F.lit(0), lambda acc, r: acc + r["n_slots"])
    copies = copies.select("_doc", "_item", "n", "whole", covered.alias("covered"), longest.alias("longest"), slots.alias("n_slots"))
    parts = F.when((F.col("covered") >= COVERED * F.col("n")) | (F.col("longest") >= RUN), F.struct(F.col("covered").alias("matched"), "n_slots"))
    good = copies.select("_doc", "_item", "n", F.greatest("whole", parts).alias("g")).where("g IS NOT NULL")
    best = good.groupBy("_doc", "_item").agg(F.max(F.struct("g.matched", "n", "g.n_slots")).alias("b"))
    return best.select(F.col("_doc").alias(key), F.col("_item").alias(item), F.col("b.matched").cast("long").alias("matched"), F.col("b.n").cast("long").alias("n_tokens"), (F.col("b.matched") / F.col("b.n")).alias("coverage"), F.col("b.n_slots").cast("long").alias("n_slots"))
