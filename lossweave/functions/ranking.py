"""Selection over ragged score arrays as column expressions: no shuffle, no Python.

Masks are boolean arrays as long as the scores; true means that the token's
label is ignored.  ``eligible`` is a boolean array of the same length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bound(f: Callable[..., Column], *values: Column) -> Column:
    """f over values that are each computed once.

    What a lambda refers to is computed again for every element, also where it
    was a column of its own before the optimizer merged the projections.
    """
    one = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(one), lambda t: f(*[t[f"v{i}"] for i in range(len(values))])), F.lit(0))


def normalized(scores: Column, exponent: float) -> Column:
    """Each score over its number of tokens from there to the end, raised to the exponent."""
    return bound(lambda s: F.transform(s, lambda x, i: x / F.pow(F.size(s) - i, F.lit(float(exponent)))), scores)


def all_of(scores: Column) -> Column:
    return F.array_repeat(F.lit(True), F.size(scores))


def _ranked(values: Column, eligible: Column) -> Column:
    """Eligible (value, position) in ascending order; positions make every entry distinct."""
    pairs = F.zip_with(F.transform(values, lambda x, i: F.struct(x.alias("v"), i.alias("i"))), eligible, lambda p, e: F.when(e, p))
    return F.array_sort(F.filter(pairs, lambda p: p.isNotNull()))


def lowest(values: Column, eligible: Column, k: Column) -> Column:
    """Mask of the k lowest eligible values, ties to the earliest position; one sort, then one comparison each."""
    def marked(v, ok, n):
        edge = F.when(n > 0, F.get(_ranked(v, ok), n - 1))
        return bound(lambda e, w: F.zip_with(F.transform(w, lambda x, i: e["i"].isNotNull() & ((x < e["v"]) | ((x == e["v"]) & (i <= e["i"])))), ok, lambda m, o: m & o), edge, v)

    return bound(marked, values, eligible, k.cast("int"))


def nonpositive(scores: Column, eligible: Column) -> Column:
    return F.zip_with(scores, eligible, lambda x, e: e & (x <= 0.0))


def nonzero(scores: Column, eligible: Column) -> Column:
    return F.zip_with(scores, eligible, lambda x, e: e & (x != 0.0))


def positive(scores: Column, eligible: Column) -> Column:
    return F.zip_with(scores, eligible, lambda x, e: e & (x > 0.0))


def count_true(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda x: x))


def bottom_fraction(scores: Column, eligible: Column, rate: float, exponent: float) -> Column:
    """ceil(rate * eligible) lowest scores after length normalisation."""
    k = F.ceil(F.lit(float(rate)) * count_true(eligible)).cast("int")
    return lowest(normalized(scores, exponent), eligible, k)


def rate_too_small(scores: Column, eligible: Column, rate: float) -> Column:
    """Whether the rate is below the share of eligible scores that are not positive."""
    return F.lit(float(rate)) + 1e-12 < count_true(nonpositive(scores, eligible)) / count_true(eligible)


def count_matched(nll: Column, reference: Column) -> Column:
    """Ignores as many of the lowest likelihood losses as the reference has scores that are not positive."""
    return lowest(nll, all_of(nll), count_true(nonpositive(reference, all_of(reference))))


def random_control(scores: Column, eligible: Column, sample_id: Column, seed: int) -> Column:
    """As many eligible tokens as have non-positive scores, ranked by a seeded SHA-256."""
    nul = F.lit("\u0000")
    keys = F.transform(scores, lambda _, i: F.sha2(F.concat(F.lit(str(seed)), nul, sample_id.cast("string"), nul, i.cast("string")), 256))
    return lowest(keys, eligible, count_true(nonpositive(scores, eligible)))


def find_from(ids: Column, needle: Column, start: Column) -> Column:
    """First position (from 0) at or after ``start`` where needle stands in ids; -1 if nowhere or needle is empty."""


    def first(a, n, s):
        places = F.when((s <= F.size(a) - F.size(n)) & (F.size(n) > 0), F.sequence(s, F.size(a) - F.size(n))).otherwise(F.array().cast("array<int>"))
        return F.coalesce(F.get(F.filter(places, lambda p: (F.get(a, p) == F.get(n, F.lit(0))) & (F.slice(a, p + 1, F.size(n)) == n)), F.lit(0)), F.lit(-1))

    return bound(first, ids, needle, start)


def think_span(ids: Column, opening: Column, closing: Column) -> Column:
    """Mask of the tokens strictly inside the first opening..closing block; to the end if it is not closed."""

    def inside(a, o, c):
        def marked(x, start):
            body = start + F.size(o)
            stop = bound(lambda q: F.when(q < 0, F.size(x)).otherwise(q), find_from(x, c, body))
            return bound(lambda y, f, l, any_: F.transform(y, lambda _, i: any_ & (i >= f) & (i < l)), x, body, stop, start >= 0)

        return bound(marked, a, find_from(a, o, F.lit(0)))

    return bound(inside, ids, opening, closing)


def clipped(scores: Column, transform: str = "signed") -> Column:
    """Scores as they are, or with negative ones as zero."""
    if transform not in ("signed", "positive"):
        raise ValueError(f"score transform must be signed or positive, not {transform!r}")
    return scores if transform == "signed" else F.transform(scores, lambda x: F.greatest(F.lit(0.0), x))


def scores_valid(scores: Column) -> Column:
    """Not empty and every score finite."""
    return (F.size(scores) > 0) & F.forall(scores, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
