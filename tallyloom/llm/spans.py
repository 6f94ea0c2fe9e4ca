"""Places of all matches of a pattern and texts with spans replaced, from built-in functions and linear in the text.

A fold that appends to an array or a text copies it at every step. Sums run over blocks of BLOCK matches here, then over
the blocks' totals, so n matches cost BLOCK x n steps; and no match looks for its place from the start of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches in a block; code points of context before a match; spans from which on a text is taken apart by code points.
BLOCK, CONTEXT, MANY = 128, 30, 8
NO_SPANS = "cast(array() as array<struct<start:int,end:int,value:string,before:string>>)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _sums(lengths: Column) -> Column:
    """What stands before each of a few lengths."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


def blocks(values: Column) -> Column:
    """array of arrays of BLOCK values at most; none of an empty array."""
    nothing = F.slice(F.array(values), 1, 0)
    return F.when(F.size(values) == 0, nothing).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, BLOCK)))


def running(lengths: Column) -> Column:
    """What stands before each length: array<int>."""

    def large(lengths: Column) -> Column:
        total = lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n)
        moved = lambda b, first: F.transform(_sums(b), lambda n: n + first)
        return let(blocks(lengths), lambda bs: F.flatten(F.zip_with(bs, _sums(F.transform(bs, total)), moved)))

    return let(lengths, lambda n: F.when(F.size(n) <= BLOCK, _sums(n)).otherwise(large(n)))


def match_spans(text: Column, pattern: str, shortest: int = 1) -> Column:
    """array<struct<start, end, value, before>>, leftmost and not overlapping; code points, end exclusive.

    `before` is the CONTEXT code points before the match. The pieces between matches, as `split` gives them, have the
    lengths from which the places of the matches follow. Patterns must not match less than `shortest` code points.
    """
    between = F.split(text, pattern, -1)
    paired = lambda found: F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda v, g: F.struct(g.alias("gap"), v.alias("value"), F.length(g).alias("n"), F.length(v).alias("m")))
    back = -(-CONTEXT // shortest)

    def before(pairs: Column, i: Column, gap: Column) -> Column:
        """From the gap where it is long enough, else with what stands before it: so many matches are never too short."""
        last = F.slice(pairs, F.greatest(i + 1 - back, F.lit(1)), F.least(i, F.lit(back)))
        whole = F.concat(F.array_join(F.transform(last, lambda p: F.concat(p["gap"], p["value"])), ""), gap)
        return F.right(F.when(F.length(gap) >= CONTEXT, gap).otherwise(whole), F.lit(CONTEXT))

    def spans(pairs: Column) -> Column:
        at = running(F.transform(pairs, lambda p: p["n"] + p["m"]))
        placed = F.zip_with(pairs, at, lambda p, s: F.struct((s + p["n"]).alias("start"), (s + p["n"] + p["m"]).alias("end"), p["value"].alias("value"), p["gap"].alias("gap")))
        return F.transform(placed, lambda p, i: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["value"].alias("value"), before(pairs, i, p["gap"]).alias("before")))

    # a text without a match is walked once
    some = lambda found: F.when(F.size(found) == 0, F.expr(NO_SPANS)).otherwise(let(paired(found), spans))
    return let(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0)), some)


def apart_from(spans: Column, others: Column) -> Column:
    """Of spans (structs with start and end, in the order of their starts), those that overlap none of the others."""
    clash = lambda s, some: F.exists(some, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))

    def block(b: Column) -> Column:
        # one look at all others for a block, then only at those that can reach it
        near = lambda ends: F.filter(others, lambda o: (o["start"] < ends["hi"]) & (ends["lo"] < o["end"]))
        reach = F.struct(F.array_min(F.transform(b, lambda s: s["start"])).alias("lo"), F.array_max(F.transform(b, lambda s: s["end"])).alias("hi"))
        return let(let(reach, near), lambda some: F.filter(b, lambda s: ~clash(s, some)))

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(F.flatten(F.transform(blocks(spans), block)))


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark in place of each span; spans are in order and do not overlap."""

    def few(acc: Column, s: Column) -> Column:
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    folded = F.aggregate(spans, start, few, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

    def many(letters: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
        starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.size(letters)))
        return F.array_join(F.zip_with(ends, starts, lambda a, b: F.array_join(F.slice(letters, a + 1, b - a), "")), mark)

    return F.when(F.size(spans) == 0, text).when(F.size(spans) <= MANY, folded).otherwise(let(F.split(text, ""), many))
