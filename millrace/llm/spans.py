"""Where regular expressions match, as SQL expressions: leftmost, non-overlapping, in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.llm.common import let

#: Values that one fold handles; a fold grows an array, which costs the square of its length.
STRETCH = 256


def running(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """The running totals of an array of longs under plus, which is associative.

    They are folded within stretches of STRETCH, then over the stretches, so that long arrays cost little more than their length.
    """
    none = F.array().cast("array<bigint>")
    fold = lambda v: F.aggregate(v, none, lambda a, x: F.when(F.size(a) == 0, F.array(x)).otherwise(F.concat(a, F.array(plus(F.element_at(a, -1), x)))))
    cut = lambda v: F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STRETCH).cast("int")), lambda k: fold(F.slice(v, k * STRETCH + 1, F.lit(STRETCH))))).otherwise(F.array(none))
    moved = lambda parts, upto: F.flatten(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.transform(p, lambda x: plus(F.get(upto, k - 1), x)))))
    over = lambda parts: let(fold(F.transform(parts, lambda p: F.element_at(p, -1))), lambda upto: moved(parts, upto))
    return let(let(values, cut), lambda parts: F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(over(parts)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the matches of pattern, which must not match the empty string; end exclusive."""

    def place(gaps: Column, values: Column) -> Column:
        until = running(F.transform(values, lambda v, k: (F.length(F.get(gaps, k)) + F.length(v)).cast("long")), lambda a, x: a + x)
        return let(
            until,
            lambda e: F.transform(values, lambda v, k: F.struct((F.get(e, k) - F.length(v)).cast("int").alias("start"), F.get(e, k).cast("int").alias("end"), v.alias("value"))),
        )

    return let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda values: place(gaps, values)))


def substrings(text: Column, ranges: Column, width: int = 4096) -> Column:
    """The parts of text in ranges, an array of structs with start and end. Text is cut once into parts of `width`, so that a range late in a long text costs no walk from its beginning."""
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / width).cast("int")), lambda k: F.substring(text, k * width + 1, F.lit(width)))
    within = lambda held, r: F.substring(
        F.array_join(F.slice(held, F.floor(r["start"] / width).cast("int") + 1, (F.floor(r["end"] / width) - F.floor(r["start"] / width)).cast("int") + 1), ""),
        F.pmod(r["start"], F.lit(width)).cast("int") + 1,
        (r["end"] - r["start"]).cast("int"),
    )
    return let(parts, lambda held: F.transform(ranges, lambda r: within(held, r)))
