"""Array builders that stay linear: values bound once, sums along an array by blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: inside a lambda's body it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _along(lengths: Column, first: Column) -> Column:
    zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, zero, lambda t, x: F.struct((t["at"] + x).alias("at"), F.concat(t["out"], F.array(t["at"])).alias("out")), lambda t: t["out"])


def starts(lengths: Column) -> Column:
    """The sum of the lengths before each element; appended to within blocks, so that a long array isn't copied for each."""

    def whole(all_: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: F.slice(all_, at + 1, F.lit(BLOCK)))
        sums = lambda blocks: F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda t, x: t + x))
        return bound(cut, lambda blocks: F.flatten(F.zip_with(blocks, _along(sums(blocks), F.lit(0)), _along)))

    return bound(lengths, whole)


def scan(values: Column, zero: Column, state: str, step: Callable[[Column, Column], Column]) -> Column:
    """The state after each element, from ``zero`` by ``step(state, element)``; ``state`` is its type.

    States are appended within blocks, so that a long array isn't copied for each element.
    """
    none, no_blocks = F.array().cast(f"array<{state}>"), F.array().cast(f"array<array<{state}>>")

    def one(t: Column, x: Column) -> Column:
        return bound(step(t["s"], x), lambda s: F.struct(s.alias("s"), F.concat(t["out"], F.array(s)).alias("out")))

    def block(t: Column, b: Column) -> Column:
        inside = F.aggregate(b, F.struct(t["s"].alias("s"), none.alias("out")), one)
        return bound(inside, lambda r: F.struct(r["s"].alias("s"), F.concat(t["out"], F.array(r["out"])).alias("out")))

    def whole(all_: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: F.slice(all_, at + 1, F.lit(BLOCK)))
        return F.aggregate(cut, F.struct(zero.cast(state).alias("s"), no_blocks.alias("out")), block, lambda t: F.flatten(t["out"]))

    return bound(values, whole)
