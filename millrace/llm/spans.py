"""Spans of regular-expression matches as arrays of structs, with built-in functions only. Positions are in code points.

All of it takes about linear time in a text and its matches: positions are running sums over blocks, a match's text and
neighbourhood come from the match and the gaps beside it, and a text is cut by whole chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values in a block of a running combination.
BLOCK = 64
#: Code points in a chunk of a text that is cut in many places.
CHUNK = 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """array<long>: for each value the combination of it and all before it. Blocks are combined apart, then moved on by what is before them."""
    empty = F.array().cast("array<bigint>")

    def scan(of: Column, first: Column, inclusive: bool) -> Column:
        def step(acc: Column, x: Column) -> Column:
            now = combine(acc["at"], x)
            return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now if inclusive else acc["at"])).alias("out"))

        return F.aggregate(of, F.struct(first.cast("long").alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def blocks_of(v: Column) -> Column:
        at = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.slice(v, i, BLOCK))

    def whole(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(start).cast("long"), combine))
        return F.flatten(F.zip_with(blocks, scan(totals, F.lit(start), False), lambda b, first: scan(b, first, True)))

    return let(F.transform(values, lambda x: x.cast("long")), lambda v: let(blocks_of(v), whole))


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def matches(text: Column, pattern: str, window: int = 0) -> Column:
    """All leftmost non-overlapping matches of a pattern that cannot match nothing, as array<struct<start, end, found, before, after>>.

    `before` has up to `window` characters of the gap before a match, `after` the first character of the gap behind it.
    Gaps (split) and matches (extract_all) add up to positions. Texts without a match are read once.
    """

    def placed(m: Column, g: Column, ends: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            gap = F.get(g, i)
            near = F.substring(gap, -window, window) if window else F.lit("")
            near = F.when(F.length(gap) > window, near).otherwise(gap) if window else near
            return F.struct(
                (F.get(ends, i).cast("int") - F.length(x)).alias("start"), F.get(ends, i).cast("int").alias("end"), x.alias("found"), near.alias("before"),
                F.substring(F.get(g, i + 1), 1, 1).alias("after"),
            )

        return F.transform(m, one)

    def with_gaps(m: Column) -> Column:
        steps = lambda g: F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda a, b: F.length(a) + F.length(b))
        some = let(F.split(text, pattern, -1), lambda g: let(running(steps(g), lambda a, b: a + b), lambda ends: placed(m, g, ends)))
        return F.when(F.size(m) > 0, some).otherwise(F.array().cast("array<struct<start: int, end: int, found: string, before: string, after: string>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_gaps)


def chunks(text: Column) -> Column:
    """A text in chunks of CHUNK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(chunked: Column, start: Column, length: Column) -> Column:
    """A part of a text in chunks."""
    low, high = F.floor(start / CHUNK).cast("int"), F.floor((start + length - 1) / CHUNK).cast("int")
    part = F.array_join(F.slice(chunked, low + 1, F.greatest(high - low + 1, F.lit(0))), "")
    return F.when(length > 0, F.substring(part, start - low * CHUNK + 1, length)).otherwise("")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
