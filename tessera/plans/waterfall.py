"""Joint confidence of values, and which sources to ask for what is not sure enough yet.

A value's confidence is one less the chance that all its sources are wrong, each as reliable as its kind and as its age
lets it be. The waterfall asks the sources of a field from the cheapest on until the target is met; a budget goes to the
steps, over all leads, that raise confidence most for their cost, without skipping a step. Survey: §2.14.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators import ranking

# How far kinds of sources are trusted, days after which that has faded to 1/e, and what lowers a value.
RELIABILITY = {"registry": 0.95, "own_website": 0.90, "places": 0.85, "provider": 0.75, "directory": 0.60, "ai": 0.50}
FADING_DAYS = {"phone": 365.0, "email": 270.0, "address": 540.0, "jobs": 30.0, "social_activity": 14.0, "rating": 60.0}
BY_MODEL, IN_CONFLICT = 0.6, 0.5
VERIFIED, LIKELY = 0.85, 0.60


def _looked_up(table: dict[str, float], c: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c)


def confidence(values: DataFrame, now: Column, reliability: dict[str, float] = RELIABILITY) -> DataFrame:
    """(entity_id, field, confidence, conflict, status) of values (entity_id, field, value, source_kind, method, observed_at).

    A kind that is not listed counts as a directory; a field without a fading time does not fade; a time to come is now. The
    value that is most confirmed speaks for the field: what a model derived counts by BY_MODEL, and a field for
    which sources disagree is worth IN_CONFLICT at most.
    """
    days = F.greatest(F.unix_micros(now.cast("timestamp")) - F.unix_micros("observed_at"), F.lit(0)) / 86_400_000_000
    fade = F.coalesce(F.exp(-days / _looked_up(FADING_DAYS, F.col("field"))), F.lit(1.0))
    trust = F.coalesce(_looked_up(reliability, F.col("source_kind")), F.lit(reliability.get("directory", 0.6))) * fade
    each = values.where("value IS NOT NULL").withColumn("_wrong", F.log(F.greatest(1 - trust, F.lit(1e-12)))).withColumn("_found", F.coalesce(F.col("method") != "ai", F.lit(True)))
    joint = each.groupBy("entity_id", "field", "value").agg((1 - F.exp(F.sum("_wrong"))).alias("c"), F.bool_or("_found").alias("found"))
    joint = joint.withColumn("c", F.when(F.col("found"), F.col("c")).otherwise(F.col("c") * BY_MODEL))
    best = joint.groupBy("entity_id", "field").agg(F.max("c").alias("c"), (F.count("*") > 1).alias("conflict"))
    held = F.round(F.when(F.col("conflict"), F.least("c", F.lit(IN_CONFLICT))).otherwise(F.col("c")), 9)
    status = F.when(F.col("conflict"), "conflict").when(F.col("confidence") >= VERIFIED, "verified").when(F.col("confidence") >= LIKELY, "likely").otherwise("unverified")
    return best.select("entity_id", "field", held.alias("confidence"), "conflict").withColumn("status", status)


def steps(needs: DataFrame, modules: DataFrame, target: float) -> DataFrame:
    """(lead_id, field, step, module, cost, before, after) of the sources to ask, in turn, until the target is met.

    ``needs`` (lead_id, field, confidence): what there is; ``modules`` (module, field, cost, reliability): what could be
    asked, cheapest first, then by name. A field that is sure enough has no steps.
    """
    asked = needs.where(F.coalesce("confidence", F.lit(0.0)) < target).join(F.broadcast(modules), "field")
    turn = W.partitionBy("lead_id", "field").orderBy("cost", "module")
    wrong = F.log(F.greatest(1 - F.col("reliability"), F.lit(1e-12)))
    left = (1 - F.coalesce("confidence", F.lit(0.0))) * F.exp(F.coalesce(F.sum(wrong).over(turn.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    rows = asked.withColumn("step", F.row_number().over(turn)).withColumn("before", F.round(1 - left, 9)).withColumn("after", F.round(1 - left * (1 - F.col("reliability")), 9))
    return rows.where(F.col("before") < target).select("lead_id", "field", "step", "module", "cost", "before", "after")


def unsatisfiable(needs: DataFrame, planned: DataFrame, target: float) -> DataFrame:
    """(lead_id, field): what no source can make sure enough."""
    reached = planned.groupBy("lead_id", "field").agg(F.max("after").alias("reached"))
    short = needs.where(F.coalesce("confidence", F.lit(0.0)) < target).join(reached, ["lead_id", "field"], "left")
    return short.where(F.coalesce("reached", F.lit(0.0)) < target).select("lead_id", "field")


def within_budget(planned: DataFrame, budget: int) -> DataFrame:
    """The steps that a budget pays for, best gain for the cost first, with ``spent`` up to each.

    A step is worth no more than those before it in its field, so none is paid for without them; spending ends at the first
    step that no longer fits. Costs are whole numbers above zero.
    """
    gain = F.round((F.col("after") - F.col("before")) / F.col("cost"), 6)
    so_far = W.partitionBy("lead_id", "field").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    ranked = planned.withColumn("cost", F.col("cost").cast("long")).withColumn("_gain", gain).withColumn("_worst", -F.min("_gain").over(so_far))
    paid = ranking.running_total(ranked, ["_worst", "lead_id", "field", "step"], "cost", "spent")
    return paid.where(F.col("spent") <= budget).drop("_gain", "_worst")
