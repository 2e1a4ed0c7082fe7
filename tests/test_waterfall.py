"""Confidence, waterfalls, budgets and totals over all rows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ranking
from tessera.plans import waterfall as P

VALUES = "entity_id long, field string, value string, source_kind string, method string, observed_at timestamp"
NOW = dt.datetime(2026, 6, 1, tzinfo=dt.timezone.utc)


def test_confidence_by_hand(spark):
    old = NOW - dt.timedelta(days=365)
    rows = [
        (1, "name", "A", "registry", "crawl", old), (2, "phone", "1", "own_website", "crawl", old), (3, "phone", "1", "own_website", "crawl", NOW), (3, "phone", "1", "directory", "crawl", NOW),
        (4, "phone", "1", "own_website", "crawl", NOW), (4, "phone", "2", "directory", "crawl", NOW), (5, "name", "A", "ai", "ai", NOW), (6, "name", "A", "ai", "ai", NOW), (6, "name", "A", "places", None, NOW),
        (7, "email", None, "registry", "crawl", NOW), (8, "phone", "1", "hearsay", "crawl", NOW + dt.timedelta(days=9)),
    ]
    got = {r["entity_id"]: (r["confidence"], r["status"]) for r in P.confidence(spark.createDataFrame(rows, VALUES), F.lit(NOW)).collect()}
    want = {1: (0.95, "verified"), 2: (0.9 / math.e, "unverified"), 3: (0.96, "verified"), 4: (0.5, "conflict"), 5: (0.3, "unverified"), 6: (1 - 0.5 * 0.15, "verified"), 8: (0.6, "likely")}
    assert {k: v for k, (v, _) in got.items()} == pytest.approx({k: v for k, (v, _) in want.items()}, abs=1e-6) and {k: s for k, (_, s) in got.items()} == {k: s for k, (_, s) in want.items()}


MODULES = [("a", "email", 2, 0.5), ("b", "email", 1, 0.4), ("c", "email", 2, 0.9), ("d", "phone", 3, 1.0)]


def planned(spark, needs, target=0.8):
    return P.steps(spark.createDataFrame(needs, "lead_id long, field string, confidence double"), spark.createDataFrame(MODULES, "module string, field string, cost long, reliability double"), target)


def test_cheapest_first_until_sure(spark):
    got = [(r["lead_id"], r["field"], r["step"], r["module"], r["after"]) for r in planned(spark, [(1, "email", None), (2, "email", 0.7), (3, "email", 0.8), (4, "phone", 0.0), (5, "fax", 0.0)]).orderBy("lead_id", "step").collect()]
    assert got == [(1, "email", 1, "b", 0.4), (1, "email", 2, "a", 0.7), (1, "email", 3, "c", 0.97), (2, "email", 1, "b", 0.82), (4, "phone", 1, "d", 1.0)]
    needs = spark.createDataFrame([(1, "email", None), (5, "fax", 0.0), (6, "fax", 0.9)], "lead_id long, field string, confidence double")
    assert [tuple(r) for r in P.unsatisfiable(needs, planned(spark, [(1, "email", None)]), 0.8).collect()] == [(5, "fax")]


@pytest.mark.parametrize("budget", [0, 1, 7, 100, 10**6])
def test_a_budget_skips_no_step_and_is_kept(spark, budget):
    rnd = random.Random(budget)
    plan = planned(spark, [(i, rnd.choice(["email", "phone"]), round(rnd.random(), 3)) for i in range(80)], 0.95)
    every, got = plan.collect(), P.within_budget(plan, budget).collect()
    assert sum(r["cost"] for r in got) <= budget and (budget < 10**6 or len(got) == len(every))
    taken = {(r["lead_id"], r["field"], r["step"]) for r in got}
    assert all(s == 1 or (lead, f, s - 1) in taken for lead, f, s in taken)
    assert sorted(r["spent"] for r in got) == [sum(r["cost"] for r in sorted(got, key=lambda r: r["spent"])[: i + 1]) for i in range(len(got))]


@pytest.mark.parametrize("kind", ["long", "double", "decimal(12,2)"])
def test_totals_over_all_rows(spark, kind):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(4), rnd.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k long, v long").withColumn("v", F.when(F.col("id") % 50 > 0, F.col("v")).cast(kind)).repartition(6)
    got = {r["id"]: float(r["total"]) for r in ranking.running_total(df, ["k", "id"], "v").collect()}
    want, total = {}, 0
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        total += v if i % 50 else 0
        want[i] = total
    assert got == want and ranking.running_total(df.limit(0), ["k", "id"], "v").count() == 0


def test_budgets_without_a_key(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "id long")
    assert [r["share"] for r in ranking.split_budget(df, ["id"], F.lit(17)).orderBy("id").collect()] == [3, 3, 3, 2, 2, 2, 2]
    assert [r["id"] for r in ranking.affordable_prefix(df, ["id"], 100, 20, 0.8).collect()] == [0, 1, 2, 3]
