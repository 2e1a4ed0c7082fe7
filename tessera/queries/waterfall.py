"""Confidence of values and the sources to ask, over line items as evidence and customers as leads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import waterfall
from tessera.registry import query, table

KINDS, FIELDS = list(waterfall.RELIABILITY), [*waterfall.FADING_DAYS, "name"]
EVIDENCE = f"""v AS (SELECT l_orderkey AS entity_id, {FIELDS}[1 + l_linenumber % {len(FIELDS)}] AS field, 'v' || (l_partkey % 3) AS value, {[*KINDS, "blog"]}[1 + l_suppkey % {len(KINDS) + 1}] AS kind,
  l_partkey % 4 <> 0 AS found, CAST(l_shipdate AS TIMESTAMP) AS seen FROM lineitem)"""


@query("cnf_confidence", f"""WITH {EVIDENCE}, t AS (SELECT *, CASE kind {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in waterfall.RELIABILITY.items())} ELSE 0.6::DOUBLE END
  * coalesce(exp(-greatest(epoch_us(TIMESTAMP '1998-06-01') - epoch_us(seen), 0) / 86400000000.0::DOUBLE / CASE field {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in waterfall.FADING_DAYS.items())} END), 1.0::DOUBLE) AS trust FROM v),
j AS (SELECT entity_id, field, value, (1 - product(1 - trust)) * CASE WHEN bool_or(found) THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS c FROM t GROUP BY ALL),
b AS (SELECT entity_id, field, count(*) > 1 AS conflict, max(c) AS c FROM j GROUP BY ALL)
SELECT entity_id, field, conflict, round(round(CASE WHEN conflict THEN least(c, 0.5) ELSE c END, 9), 6) AS confidence, CASE WHEN conflict THEN 'conflict' WHEN c >= 0.85 THEN 'verified' WHEN c >= 0.6 THEN 'likely' ELSE 'unverified' END AS status FROM b""")  # fmt: skip
def cnf_confidence(spark, sf_dir):
    """Line items as evidence of an order's fields: kinds fade with age, models count less, disagreement caps."""
    li = table(spark, sf_dir, "lineitem")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (1 + i % len(names)).cast("int"))
    values = li.select(
        F.col("l_orderkey").alias("entity_id"), pick(FIELDS, F.col("l_linenumber")).alias("field"), F.concat(F.lit("v"), (F.col("l_partkey") % 3).cast("string")).alias("value"),
        pick([*KINDS, "blog"], F.col("l_suppkey")).alias("source_kind"), F.when(F.col("l_partkey") % 4 == 0, "ai").otherwise("crawl").alias("method"), F.col("l_shipdate").cast("timestamp").alias("observed_at"),
    )
    return waterfall.confidence(values, F.lit("1998-06-01").cast("timestamp")).withColumn("confidence", F.round("confidence", 6))


MODULES = [("contact_extractor", "email", 2, 0.6), ("provider", "email", 9, 0.75), ("email_verifier", "email", 4, 0.5), ("contact_extractor", "phone", 2, 0.7), ("provider", "phone", 9, 0.75), ("registry_matcher", "address", 5, 0.95), ("places", "address", 3, 0.6)]
TARGET, BUDGET = 0.85, 4_000
NEEDS = "n AS (SELECT c_custkey AS lead_id, f.field, (c_custkey * f.k % 97) / 100.0::DOUBLE AS c FROM customer, (VALUES ('email', 7), ('phone', 11), ('address', 13), ('fax', 17)) AS f(field, k))"
STEPS = f"""m AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY cost, module) AS step FROM (VALUES {", ".join(f"('{m}', '{f}', {c}, {r}::DOUBLE)" for m, f, c, r in MODULES)}) AS v(module, field, cost, r)),
s AS (SELECT lead_id, field, 0::BIGINT AS step, NULL::VARCHAR AS module, 0 AS cost, c AS before, c AS after FROM n WHERE c < {TARGET}
  UNION ALL SELECT s.lead_id, s.field, m.step, m.module, m.cost, s.after, 1 - (1 - s.after) * (1 - m.r) FROM s JOIN m ON m.field = s.field AND m.step = s.step + 1 WHERE round(s.after, 9) < {TARGET})"""


def _steps(spark, sf_dir):
    k = F.col("c_custkey")
    fields = F.array(*(F.struct(F.lit(f).alias("field"), ((k * m % 97) / 100.0).alias("confidence")) for f, m in (("email", 7), ("phone", 11), ("address", 13), ("fax", 17))))
    needs = table(spark, sf_dir, "customer").select(k.alias("lead_id"), F.inline(fields))
    modules = spark.createDataFrame(MODULES, "module string, field string, cost long, reliability double")
    return needs, waterfall.steps(needs, modules, TARGET)


@query("pln_waterfall", f"WITH RECURSIVE {NEEDS}, {STEPS} SELECT lead_id, field, step, module, cost, round(before, 6) AS before, round(after, 6) AS after FROM s WHERE step > 0")
def pln_waterfall(spark, sf_dir):
    """The sources to ask for each field of each lead, until it is sure enough."""
    _, planned = _steps(spark, sf_dir)
    return planned.withColumns({"before": F.round("before", 6), "after": F.round("after", 6)})


@query("pln_unsatisfiable", f"WITH RECURSIVE {NEEDS}, {STEPS} SELECT lead_id, field FROM s GROUP BY ALL HAVING round(max(after), 9) < {TARGET}")
def pln_unsatisfiable(spark, sf_dir):
    """Fields that no source can make sure enough: nobody supplies a fax."""
    needs, planned = _steps(spark, sf_dir)
    return waterfall.unsatisfiable(needs, planned, TARGET)


@query("pln_waterfall_budget", f"""WITH RECURSIVE {NEEDS}, {STEPS},
g AS (SELECT *, min(round((round(after, 9) - round(before, 9)) / cost, 6)) OVER (PARTITION BY lead_id, field ORDER BY step) AS worth FROM s WHERE step > 0),
t AS (SELECT lead_id, field, step, module, cost, sum(cost) OVER (ORDER BY worth DESC, lead_id, field, step)::BIGINT AS spent FROM g) SELECT * FROM t WHERE spent <= {BUDGET}""")  # fmt: skip
def pln_waterfall_budget(spark, sf_dir):
    """The steps that a budget pays for, over all leads, by gain for their cost."""
    _, planned = _steps(spark, sf_dir)
    return waterfall.within_budget(planned, BUDGET).drop("before", "after")


@query("srt_numbered", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS at, 100003 // n + CASE WHEN row_number() OVER (ORDER BY o_totalprice, o_orderkey) <= 100003 % n THEN 1 ELSE 0 END AS share FROM orders, (SELECT count(*) AS n FROM orders)")
def srt_numbered(spark, sf_dir):
    """All orders numbered by price, and a budget split over them, without a task that holds them all."""
    from tessera.operators import ranking

    rows = ranking.split_budget(table(spark, sf_dir, "orders").withColumn("one", F.lit(1).cast("long")), ["o_totalprice", "o_orderkey"], F.lit(100_003))
    return ranking.running_total(rows, ["o_totalprice", "o_orderkey"], "one", "at").select("o_orderkey", "at", "share")
