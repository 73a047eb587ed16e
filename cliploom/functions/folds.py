"""Folds over a sorted array that give something for each element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def running(
    items: Column | str, carry: Column, step: Callable[[Column, Column], tuple[Column, Column]], carry_type: str, out_type: str, part: int = 128
) -> Column:
    """The array of what `step` gives for each element in turn; nulls are left out.

    step(carry, element) -> (next carry, value). Elements are taken in parts of `part`, so a step
    copies the values of its own part only, not of the whole array. A null or empty array gives an
    empty one.
    """
    items = F.coalesce(F.col(items) if isinstance(items, str) else items, F.array())
    carry = carry.cast(carry_type)

    def one(acc: Column, x: Column) -> Column:
        after, value = step(acc["carry"], x)
        return F.struct(after.cast(carry_type).alias("carry"), F.concat(acc["out"], F.array(value.cast(out_type))).alias("out"))

    def several(acc: Column, piece: Column) -> Column:
        last = F.when(F.size(acc) == 0, carry).otherwise(F.get(acc, F.size(acc) - 1)["carry"])
        start = F.struct(last.alias("carry"), F.array().cast(f"array<{out_type}>").alias("out"))
        return F.concat(acc, F.array(F.aggregate(piece, start, one)))

    # the last piece may be empty
    count = F.floor(F.size(items) / part).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(items, i * part + 1, part))
    done = F.aggregate(pieces, F.array().cast(f"array<struct<carry:{carry_type},out:array<{out_type}>>>"), several)
    return F.filter(F.flatten(F.transform(done, lambda r: r["out"])), lambda x: x.isNotNull())
