"""Running folds over arrays in DataFrame functions, in time that follows the array."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lossweave.functions.ranking import bound

#: Elements of a chunk of a running fold.
FOLD = 256


def chunks(values: Column, size: int) -> Column:
    """An array as arrays of ``size`` elements; one empty array for an empty one."""
    return bound(lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / size).cast("int")), lambda c: F.slice(v, c * size + 1, size)), values)


def before(values: Column, step, zero: Column) -> Column:
    """For each element, the fold of those before it.

    Folded in chunks whose own folds are folded first: an array that grows in a
    fold is copied at every step, which over long arrays would take a square.
    """
    def within(chunk, first):
        grow = lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        none = F.array().cast("array<int>")
        return F.aggregate(chunk, F.struct(first.cast("int").alias("at"), none.alias("out")), grow, lambda s: s["out"])

    def run(parts):
        firsts = within(F.transform(parts, lambda c: F.aggregate(c, zero.cast("int"), step)), zero)
        return bound(lambda f: F.flatten(F.transform(parts, lambda c, i: within(c, F.get(f, i)))), firsts)

    return bound(run, chunks(values, FOLD))
