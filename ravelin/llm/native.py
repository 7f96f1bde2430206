"""Column expressions that the native operators share. A value that a lambda needs is bound by `let`, so that it is
computed once and not for each element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.llm.common import WORD_GAP

#: Elements that are summed up in one go; longer arrays are summed in blocks, so the work stays linear.
BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text: what stands between white space."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP, -1))


def running_sums(steps: Column) -> Column:
    """array<bigint>: the sums of the first 1, 2, ... elements of an array of whole numbers."""
    none = F.array().cast("array<bigint>")

    def inner(block: Column, before: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(before.cast("bigint").alias("s"), none.alias("l")),
            lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["l"], F.array(a["s"] + x)).alias("l")),
            lambda a: a["l"],
        )

    def blocks(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: F.slice(s, b * BLOCK + 1, BLOCK))

    def before(bs: Column) -> Column:
        totals = F.transform(bs, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x))
        return F.aggregate(
            totals,
            F.struct(F.lit(0).cast("bigint").alias("s"), none.alias("l")),
            lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["l"], F.array(a["s"])).alias("l")),
            lambda a: a["l"],
        )

    whole = lambda s: let(blocks(s), lambda bs: F.flatten(F.zip_with(bs, before(bs), inner)))
    return let(steps.cast("array<bigint>"), lambda s: F.when(F.size(s) == 0, none).otherwise(whole(s)))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct(start, end, value)> of a pattern's leftmost non-overlapping matches, in code points, end exclusive.

    The pattern must not match the empty text. value is the group's text.
    """
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))

    def spans(f: Column) -> Column:
        steps = F.zip_with(F.slice(f["gaps"], 1, F.size(f["all"])), f["all"], lambda g, m: F.length(g) + F.length(m))
        both = F.zip_with(f["all"], f["value"], lambda m, v: F.struct(m.alias("m"), v.alias("v")))
        return F.zip_with(both, running_sums(steps), lambda x, e: F.struct((e - F.length(x["m"])).alias("start"), e.alias("end"), x["v"].alias("value")))

    return let(found, spans)
