"""Regular-expression matches with their positions, and what surrounds them.

Spark gives the matches of a pattern but not where they stand. The pieces that end with a match each (what lies between
it and the match before, and itself) give it back: a match ends where the pieces up to its own end. Patterns must be
literals without empty matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT_WIDTH = 70
HEAD_WINDOW = 1500


def let(value: Column, body) -> Column:
    """`body(value)`, with `value` evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


#: Lengths up to which they are just added up.
FEW = 16


def sums_before(lengths: Column, block: int = 64) -> Column:
    """Sum of the lengths before each one; in blocks, so that many matches stay cheap."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def blocks(x: Column) -> Column:
        starts = F.sequence(F.lit(0), ((F.size(x) - 1) / block).cast("int"))
        parts = F.transform(starts, lambda b: F.slice(x, b * block + 1, block))
        return let(
            parts,
            lambda p: let(
                F.transform(p, total),
                lambda s: F.flatten(
                    F.transform(
                        p,
                        lambda part, b: let(
                            total(F.slice(s, 1, b)), lambda before: F.transform(part, lambda _, j: before + total(F.slice(part, 1, j)))
                        ),
                    )
                ),
            ),
        )

    few = lambda x: F.transform(x, lambda _, j: total(F.slice(x, 1, j)))
    return let(lengths, lambda x: F.when(F.size(x) <= FEW, few(x)).otherwise(blocks(x)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of the leftmost non-overlapping matches; start counts code points from 0."""

    def placed(found: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0))
        return let(
            F.transform(pieces, F.length),
            lambda long: let(
                sums_before(long),
                lambda before: F.transform(found, lambda m, i: F.struct((before[i] + long[i] - F.length(m)).alias("start"), m.alias("value"))),
            ),
        )

    none = F.array().cast("array<struct<start:int,value:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.coalesce(let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none)), none)


#: Characters of a block of a long text, a power of two.
BLOCK = 2048


def blocks(text: Column) -> Column:
    """A text in blocks of BLOCK characters, so that cutting pieces out of it takes no longer near its end."""
    n = F.floor(F.length(text) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, i * BLOCK + 1, F.lit(BLOCK)))


def cut(parts: Column, low: Column, high: Column) -> Column:
    """Characters `low` to `high` (exclusive, at most BLOCK apart) of a text in blocks; what lies before or behind it is nothing."""
    first = F.greatest(low, F.lit(0))
    at, offset, long = F.shiftright(first, BLOCK.bit_length() - 1), first.bitwiseAND(BLOCK - 1), F.greatest(high - first, F.lit(0))
    one, next_one = F.coalesce(F.get(parts, at), F.lit("")), F.coalesce(F.get(parts, at + 1), F.lit(""))
    return F.when(offset + long <= BLOCK, F.substring(one, offset + 1, long)).otherwise(F.substring(F.concat(one, next_one), offset + 1, long))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def context(text: Column, start: Column, end: Column, width: int = CONTEXT_WIDTH) -> Column:
    """Up to `width` characters on both sides, white space collapsed: the evidence of a match."""
    low = F.greatest(start - width, F.lit(0))
    return squeeze(F.substring(text, low + 1, F.least(end + width, F.length(text)) - low))


def head_bonus(start: Column, length: Column) -> Column:
    """0.08 at the start of a text, falling to 0 after HEAD_WINDOW characters."""
    return F.when((length > 0) & (start <= HEAD_WINDOW), 0.08 * (1.0 - start / float(HEAD_WINDOW))).otherwise(0.0)


def left_of(text: Column, start: Column, width: int) -> Column:
    low = F.greatest(start - width, F.lit(0))
    return F.lower(F.substring(text, low + 1, start - low))


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(text, F.lit(part))
    return out
