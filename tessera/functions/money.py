"""Costs, estimates, back-off and stable keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def backoff_seconds(attempt: Column, base: float = 2.0, most: float = 300.0) -> Column:
    """min(most, base * 2 ** (attempt - 1)); callers add their own jitter. Survey: MTH1."""
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1))


def token_cost_micros(counts: dict[str, Column], prices: dict[str, float]) -> Column:
    """Micros for tokens at micros per million, rounded up once over the sum. Survey: MTH2."""
    total = F.lit(0.0)
    for kind, n in counts.items():
        total = total + F.coalesce(n, F.lit(0)) * prices[kind]
    return F.ceil(total / 1_000_000).cast("long")


def reserve_estimate(rate: Column, max_results: Column, max_credits: Column) -> Column:
    """Credits to reserve and whether the cap cut them. Survey: AGG10."""
    want = rate * max_results
    return F.struct(F.least(want, max_credits).alias("credits"), (want > max_credits).alias("capped"))


def stable_key(*parts: Column) -> Column:
    """A key of its parts in order; null and empty parts differ. Survey: JSN2."""
    return F.sha2(F.array_join(F.array(*(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), "\x1f"), 256)


def json_key(kind: Column, document: Column) -> Column:
    """``kind:md5`` of a JSON document, whatever the order of its keys."""
    return F.concat(kind, F.lit(":"), F.md5(F.to_json(F.parse_json(document))))


CHARS_PER_TOKEN = 4


def prompt_cost_bound(prompt_chars: Column, max_output_tokens: Column, prices: dict[str, float]) -> Column:
    """The most that one call can cost (MTH3): the prompt that is sent and the whole output budget."""
    tokens = F.floor(prompt_chars / CHARS_PER_TOKEN) + 1
    return token_cost_micros({"input": tokens, "output": max_output_tokens}, prices)
