"""First, best and current rows of groups; running totals; pages."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.scratch import Scratch


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``, which should end in a unique column. Survey: WIN4, DED1."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; partial top-k runs before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def with_rank(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Adds the place of each row among the rows of its key, from 1; ``order`` should end in a unique column."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def best_values(values: DataFrame) -> DataFrame:
    """The value with the highest confidence, then the newest, then the smallest id, for each entity and field. Survey: WIN1."""
    return first_per_key(values, ["entity_id", "field"], [F.desc("confidence"), F.desc("observed_at"), F.asc("id")])


def best_map(values: DataFrame) -> DataFrame:
    """(entity_id, best): a map from field to best value, in the order of ``best_values``.

    Both levels aggregate within the tasks before they shuffle, so an entity of very many values is no hot spot.

    Survey: UPS9.
    """
    # the smallest struct is the best row: confidence and time with their sign turned, then the id
    order = F.struct(-F.col("confidence"), -F.unix_micros(F.col("observed_at").cast("timestamp")), "id")
    best = values.groupBy("entity_id", "field").agg(F.min_by("value", order).alias("value"))
    return best.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("best"))


def with_current(values: DataFrame, keys: list[str] = ("entity_id", "field")) -> DataFrame:
    """Sets is_current on the last written row of each key: the one with the highest batch, then ordinal.

    ``keys`` may add source_id, so that each source keeps a current value of its own.

    Survey: JN11, WIN3, UPS5.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("batch"), F.desc("ordinal")))
    return values.withColumn("is_current", rank == 1)


def running_balance(ledger: DataFrame, key: str, order: list[str], delta: str = "delta") -> DataFrame:
    """Adds balance_after: the sum of deltas of a key up to each row. Survey: AGG7, WIN9."""
    return ledger.withColumn("balance_after", F.sum(delta).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def running_total(rows: DataFrame, order: list[str], value: str, out: str = "total") -> DataFrame:
    """Adds the sum of ``value`` over all rows up to each one, in an order over all of them that ends in a unique column.

    No row set goes to one task: rows are sorted into ranges, each range is summed, and its rows add up from the sums of
    the ranges before, one number a range. The sorted rows are a table in the shared folder.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "totals")
    number, part = "_number", F.shiftright("_number", 33)
    ordered = scratch.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(number, F.monotonically_increasing_id()))
    sums, before, at = ordered.groupBy(part.alias("p")).agg(F.sum(value).cast("decimal(38,6)").alias("s")).orderBy("p").collect(), [], Decimal(0)
    for p, s in sums:
        before.append((p, at))
        at += s or 0
    start = spark.createDataFrame(before, "_part long, _before decimal(38,6)")
    within = F.sum(value).over(W.partitionBy("_part").orderBy(number).rowsBetween(W.unboundedPreceding, 0))
    placed = ordered.withColumn("_part", part).join(F.broadcast(start), "_part")
    return placed.withColumn(out, (F.col("_before") + F.coalesce(within, F.lit(0))).cast(rows.schema[value].dataType)).drop(number, "_part", "_before")


def offset_page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Survey: SRT1."""
    return df.orderBy(*order).offset(offset).limit(limit)


def keyset_page(df: DataFrame, key: str, limit: int, after=None, descending: bool = True, most: int = 200) -> tuple[DataFrame, Column]:
    """The page after a cursor, and the next cursor as an aggregate over it.

    The page holds one row more than ``limit`` (clamped to 1..most) where another page follows; that row is not shown.

    Survey: FLT23, SRT2, SRT3.
    """
    limit = max(1, min(limit, most))
    if after is not None:
        df = df.where(F.col(key) < after if descending else F.col(key) > after)
    ahead = df.orderBy(F.desc(key) if descending else F.asc(key)).limit(limit + 1)
    rank = F.row_number().over(W.orderBy(F.desc(key) if descending else F.asc(key)))  # over limit + 1 rows
    page = ahead.withColumn("_rank", rank).withColumn("next_cursor", F.when(F.count("*").over(W.partitionBy()) > limit, F.max(F.when(F.col("_rank") == limit, F.col(key))).over(W.partitionBy())))
    return page.where(F.col("_rank") <= limit).drop("_rank"), F.max("next_cursor")


def split_budget(rows: DataFrame, order: list[str], budget: Column, key: list[str] = ()) -> DataFrame:
    """Adds share: the budget split evenly over a key's rows, the remainder to the first ones. Survey: SRT6.

    Without a key all rows share it: they are counted first and numbered by ranges, never gathered in one task.
    """
    if not key:
        n = F.lit(max(1, rows.count()))
        at = running_total(rows.withColumn("_one", F.lit(1).cast("long")), order, "_one", "_at").drop("_one")
        return at.withColumn("share", (F.floor(budget / n) + F.when(F.col("_at") <= budget % n, 1).otherwise(0)).cast("long")).drop("_at")
    n = F.count("*").over(W.partitionBy(*key))
    at = F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1
    return rows.withColumn("share", (F.floor(budget / n) + F.when(at < budget % n, 1).otherwise(0)).cast("long"))


def affordable_prefix(rows: DataFrame, order: list[str], credits: int, floor: int, share: float, key: list[str] = ()) -> DataFrame:
    """The first rows of each key whose floors fit into the share of the credits; of all rows without a key."""
    if not key:
        return rows.orderBy(*order).limit(int(share * credits) // floor)
    at = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_at", at).where(F.col("_at") <= int(share * credits) // floor).drop("_at")


def capped_by_headroom(rows: DataFrame, key: str, order: list[str], wanted: str, limit: Column) -> DataFrame:
    """Adds granted: what each row may take of its key's limit after the rows before it. Survey: PLN7."""
    before = F.coalesce(F.sum(wanted).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("granted", F.greatest(F.lit(0), F.least(F.col(wanted), limit - before)))


def depth_pages(pages: DataFrame, site: str, order: list[Column], budget: Column) -> DataFrame:
    """The first pages of each site within its depth's budget. Survey: SRT8."""
    return pages.withColumn("_at", F.row_number().over(W.partitionBy(site).orderBy(*order))).where(F.col("_at") <= budget).drop("_at")


def linked_first(values: DataFrame, key: list[str]) -> DataFrame:
    """Adds preference: values from links first, then by position. Survey: SRT7."""
    return values.withColumn("preference", F.row_number().over(W.partitionBy(*key).orderBy((~F.col("from_link")).cast("int"), "pos")))
