"""Jaro and Jaro-Winkler similarity as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendwright.functions.expr import once


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity: 0 if nothing matches or either is empty, null if either is null.

    From left to right each letter of ``a`` takes the first equal letter of ``b`` that is free and no farther than the window; a fold
    over ``a`` carries which places of ``b`` are taken. Matched letters that stand in another order are half a transposition each.
    """
    letters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    return once(F.struct(letters(a).alias("a"), letters(b).alias("b")), lambda p: _of_letters(p["a"], p["b"]))


def _of_letters(a: Column, b: Column) -> Column:
    n, m = F.size(a), F.size(b)
    window = F.greatest(F.lit(0), F.floor(F.greatest(n, m) / 2).cast("int") - 1)
    start = F.array().cast("array<int>")

    def step(taken: Column, i: Column) -> Column:
        """``taken`` has the place (from 1) in b of each letter of a so far, 0 for none."""
        low, high = F.greatest(F.lit(1), i - window), F.least(m, i + window)
        places = F.when(low <= high, F.sequence(low, high)).otherwise(start)
        free = F.filter(places, lambda j: (F.element_at(b, j) == F.element_at(a, i)) & ~F.array_contains(taken, j))
        return F.concat(taken, F.array(F.coalesce(F.try_element_at(free, F.lit(1)), F.lit(0))))

    taken = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(start), start, step)
    return once(F.filter(taken, lambda j: j > 0), lambda in_a: _score(F.size(in_a), _turned(in_a, b), n, m))


def _turned(in_a: Column, b: Column) -> Column:
    """Letters that stand in another order in b: the places in a's order against the same places sorted."""
    return F.size(F.filter(F.zip_with(in_a, F.array_sort(in_a), lambda x, y: F.element_at(b, x) != F.element_at(b, y)), lambda other: other))


def _score(k: Column, turned: Column, n: Column, m: Column) -> Column:
    share = (k / n + k / m + (k - F.floor(turned / 2)) / k) / 3
    return F.when(n.isNull() | m.isNull(), F.lit(None).cast("double")).when(k == 0, 0.0).otherwise(share)


def jaro_winkler(a: Column, b: Column, weight: float = 0.1, least: float = 0.7, most: int = 4) -> Column:
    """Jaro similarity, brought nearer to 1 by up to ``most`` first letters in common where it is above ``least``."""
    places = F.sequence(F.lit(1), F.lit(most))
    prefix = F.size(F.filter(places, lambda k: (k <= F.length(a)) & (k <= F.length(b)) & (F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))))
    return once(jaro(a, b), lambda s: F.when(s > least, s + prefix * weight * (1 - s)).otherwise(s))
