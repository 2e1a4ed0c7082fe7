"""Similarity of strings and sets of words as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.binding import bind

#: Stands for a letter that has been matched; in no text.
_USED = "\x00"


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity, 0 to 1: letters of ``a`` take, in order, the first equal unmatched letter of ``b`` in reach.

    The reach is half the longer length less one; half the matched letters that stand in another order, rounded down, count
    against. Two empty strings are alike; null with null in.
    """

    letters = lambda c: F.split(c, "")

    def rest_of(v: Column) -> Column:
        """The similarity of two unlike strings from what follows their common start, whose letters all match in place."""
        x, y, n, m, start = v["a"], v["b"], v["n"], v["m"], v["start"]

        def take(state: Column, letter: Column) -> Column:
            place = F.call_function("locate", letter, state["rest"], F.greatest(state["i"] - v["reach"], F.lit(1)))

            def taken(place: Column) -> Column:
                hit = (place > 0) & (place <= state["i"] + v["reach"])
                return F.when(hit, F.struct((state["i"] + 1).alias("i"), F.overlay(state["rest"], F.lit(_USED), place, F.lit(1)).alias("rest"), F.concat(state["taken"], letter).alias("taken"))).otherwise(
                    F.struct((state["i"] + 1).alias("i"), state["rest"].alias("rest"), state["taken"].alias("taken"))
                )

            return bind(place, taken)

        def scored(state: Column) -> Column:
            # the matched letters of b in their own order: those that were replaced
            other = F.array_join(F.zip_with(letters(y), letters(state["rest"]), lambda l, r: F.when(r == _USED, l)), "")
            moved = F.size(F.filter(F.zip_with(letters(state["taken"]), letters(other), lambda l, r: l != r), lambda l: l))
            swaps = F.when(state["taken"] == other, F.lit(0)).otherwise(F.floor(moved / 2))
            hits = start + F.length(state["taken"])
            return bind(F.struct(hits.alias("hits"), swaps.alias("swaps")), lambda h: F.when(h["hits"] == 0, F.lit(0.0)).otherwise((h["hits"] / n + h["hits"] / m + (h["hits"] - h["swaps"]) / h["hits"]) / 3))

        begin = F.struct(F.lit(1).alias("i"), y.alias("rest"), F.lit("").alias("taken"))
        places = F.when(F.length(x) > 0, letters(x)).otherwise(F.array().cast("array<string>"))
        return bind(F.aggregate(places, begin, take), scored)

    def of(a: Column, b: Column) -> Column:
        """The common start is found by halves: 32 letters at once, then 16, down to one."""
        n, m = F.length(a), F.length(b)
        start = F.lit(0)
        for step in (32, 16, 8, 4, 2, 1):
            start = bind(start, lambda at, step=step: F.when((n >= at + step) & (m >= at + step) & (F.substr(a, at + 1, F.lit(step)) == F.substr(b, at + 1, F.lit(step))), at + step).otherwise(at))
        reach = F.greatest(F.floor(F.greatest(n, m) / 2).cast("int") - 1, F.lit(0))
        tail = lambda c, at: F.substr(c, at + 1, F.length(c))
        parts = bind(start, lambda at: F.struct(tail(a, at).alias("a"), tail(b, at).alias("b"), n.alias("n"), m.alias("m"), at.alias("start"), reach.alias("reach")))
        return bind(parts, rest_of)

    return F.when(a == b, 1.0).when(a.isNotNull() & b.isNotNull(), of(a, b))


def jaro_winkler(a: Column, b: Column, boost_from: float = 0.7, weight: float = 0.1) -> Column:
    """Jaro similarity, raised by up to four equal first letters where it is above ``boost_from``."""
    same = lambda k: (F.length(a) >= k) & (F.length(b) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k))
    prefix = F.when(same(4), 4).when(same(3), 3).when(same(2), 2).when(same(1), 1).otherwise(0)
    return bind(jaro(a, b), lambda s: F.when(s > boost_from, s + prefix * weight * (1 - s)).otherwise(s))


def token_set(a: Column, b: Column) -> Column:
    """Shared words by all words of both; null with null in, 0 where neither has a word."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    shared, every = F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(every > 0, shared / every).otherwise(F.lit(0.0)))
