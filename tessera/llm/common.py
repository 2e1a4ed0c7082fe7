"""Shared helpers: scratch tables, let-binding, names that clash with no column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.binding import bind as let  # noqa: F401
from tessera.scratch import Scratch  # noqa: F401

#: ASCII white space that separates words: space, tab, LF, VT, FF, CR.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until none of ``columns`` is spelled so in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def others(columns: list[str], *names: str) -> list[str]:
    """The columns that are spelled like none of ``names`` in any case: Spark takes such names for equal."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that are spelled like one of ``names`` in any case."""
    return df.select(*quoted(others(df.columns, *names)))


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their whole names, dots included."""
    return [F.col(f"`{c}`") for c in columns]


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
