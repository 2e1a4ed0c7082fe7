"""Quality rules as a short-circuit cascade, all in DataFrame expressions.

A rule rejects a row by a condition on the text or on measures that the row already has. ``plan_cascade`` estimates
every rule's cost and selectivity on a sample and orders the rules by rejections per unit of cost; ``apply_cascade``
then writes one CASE expression in that order. A rule's own measures stand inside its branch, so a row that an
earlier rule rejects never computes them. The order changes the work and ``rejected_by``, never whether a row is kept.

Null texts count as empty. An empty text has no words, fails the word count and is not kept. Repeated rows are each
judged. Rules that reject equally well for their cost are ordered by name. An empty table gives an empty result, and
an order by name. Columns of the input that clash with a measure's name or with ``out`` are replaced, other columns
stay, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CLASS, let, unused

SAMPLE_ROWS = 1_000
FEW = 16  # repeated windows that are looked up one by one
TIMES = 4  # how often a rule is evaluated on each row of the sample
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true where the row fails; null counts as false."""

    name: str
    rejects: Column


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return let(trimmed(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"{SPACE_CLASS}+")))


def repeated_words(words: Column) -> Column:
    """How many words stand in a three-word window that the text holds twice or more."""

    def covered(w: Column) -> Column:
        n = F.size(w)
        pairs = F.zip_with(F.slice(w, 2, n), F.slice(w, 3, n), lambda b, c: F.xxhash64(b, c))
        hashes = F.slice(F.zip_with(w, pairs, lambda a, bc: F.xxhash64(a, bc)), 1, n - 2)
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_union(h)))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(covered(w)))


def _union(hashes: Column) -> Column:
    """Words covered by the windows whose hash occurs again."""
    n = F.size(hashes)
    told = lambda x: F.filter(x, lambda y: y.isNotNull())
    again = let(F.sort_array(hashes), lambda s: F.array_distinct(told(F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n), lambda a, b: F.when(a == b, a)))))
    few = lambda d: told(F.transform(hashes, lambda h, i: F.when(F.array_contains(d, h), i)))
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = let(ordered, lambda s: told(F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))))
    many = F.sort_array(F.array_distinct(F.flatten(twins)))
    starts = let(again, lambda d: F.when(F.size(d) <= FEW, few(d)).otherwise(many))
    return let(starts, lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, n), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda s, x: s + x))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))


def _repeats(lines: Column) -> Column:
    return let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def measure(name: str, text: str = "text") -> Column:
    """One measure of a text, as a long."""
    t = F.coalesce(F.col(text), F.lit(""))
    if name == "n_words":
        return F.size(words_of(t)).cast("long")
    if name == "n_repeat_words":
        return repeated_words(words_of(t))
    if name == "word_chars":
        return F.length(F.regexp_replace(t, f"{SPACE_CLASS}+", "")).cast("long")
    if name == "n_symbols":
        return F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long")
    if name == "n_upper":
        return (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))).cast("long")
    return _repeats(_lines(t))[name]


#: What ``with_measures`` adds.
MEASURES = ["n_words", "n_repeat_words", "n_lines", "n_dup_lines", "word_chars", "n_symbols"]


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds MEASURES, each text cut into words and lines once."""
    t = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in df.columns if c.lower() not in MEASURES]
    words, lines = unused(kept, "_w", "_l")
    packed = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return df.select(
        *kept, packed.alias(words), _repeats(_lines(t)).alias(lines), measure("word_chars", text).alias("word_chars"), measure("n_symbols", text).alias("n_symbols")
    ).select(*kept, f"{words}.*", f"{lines}.*", "word_chars", "n_symbols")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules(have: list[str] = (), text: str = "text") -> list[Rule]:
    """The base rules and some that leave ordinary prose of any language alone.

    Measures in ``have`` are columns; every other one is computed where its rule is asked.
    """
    get = lambda name: F.col(name) if name in have else measure(name, text)
    return [
        Rule("few_words", get("n_words") < MIN_WORDS),
        Rule("repetition", 100 * get("n_repeat_words") > 50 * get("n_words")),
        Rule("symbols", 100 * get("n_symbols") > 4 * get("word_chars")),
        Rule("duplicate_lines", (get("n_lines") >= 4) & (100 * get("n_dup_lines") > 50 * get("n_lines"))),
        Rule("word_length", (get("word_chars") < 2 * get("n_words")) | (get("word_chars") > 20 * get("n_words"))),
        Rule("shouting", 100 * get("n_upper") > 60 * get("word_chars")),
    ]


def plan_cascade(df: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> list[tuple[Rule, float, float]]:
    """Rules with (share rejected, seconds a row) on a sample, best rejection per cost first.

    The sample is about ``sample_rows`` rows of a uniform fraction of ``df``, kept in memory with what ``prepare`` adds
    to it. A rule's cost is the lesser of two timed evaluations, TIMES on each row, less that of a rule that costs
    nothing. It sets the order only.
    """
    n = df.count()
    sample = prepare((df.sample(fraction=min(1.0, 2 * sample_rows / n), seed=7) if n else df).limit(sample_rows)).cache()
    try:
        rows = max(1, sample.count())
        again = unused(sample.columns, "_time")[0]
        many = sample.withColumn(again, F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

        def timed(rejects: Column) -> tuple[int, float]:
            best = float("inf")
            for _ in range(2):
                began = time.perf_counter()
                rejected = many.agg(F.count_if(F.coalesce(rejects, F.lit(False)))).first()[0]
                best = min(best, time.perf_counter() - began)
            return rejected, best

        free = timed(F.col(again) < 0)[1]
        found = []
        for rule in rules:
            rejected, taken = timed(rule.rejects)
            found.append((rule, rejected / (rows * TIMES), max(taken - free, 1e-4) / (rows * TIMES)))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: (-(x[1] / x[2]), x[0].name))


def apply_cascade(df: DataFrame, ordered: list[Rule], out: str = "rejected_by") -> DataFrame:
    """Adds the name of the first rule, in the given order, that rejects the row; null where none does."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        verdict = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(verdict)
    return df.withColumn(out, verdict)
