"""Radius joins, adaptive search grids, kept sketches, bounds of helpers."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators import export, matching, reports
from tessera.plans import search_grid


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("radius, spread", [(0.5, 0.02), (30, 1.0), (700, 180.0), (9000, 180.0)])
def test_radius_join_against_all_pairs(spark, radius, spread):
    rnd = random.Random(radius)
    near = lambda lat, lon: (max(-90.0, min(90.0, lat + rnd.uniform(-spread, spread))), (lon + rnd.uniform(-spread, spread) + 180) % 360 - 180)
    spots = [(0.0, 0.0), (52.0, 179.999), (89.9, 10.0), (-90.0, -180.0), (60.0, -179.99), (12.9716, 77.5946)]
    points = [(i, *near(*spots[i % 6])) for i in range(240)] + [(240, 0.0, 180.0), (241, 90.0, 0.0)]
    centres = [(i, *near(*spots[i % 6])) for i in range(36)] + [(36, 0.0, -180.0), (37, 90.0, 77.0), (38, -90.0, 5.0)]
    want = {(c, i): d for c, a, b in centres for i, x, y in points if (d := km(x, y, a, b)) <= radius}
    p = spark.createDataFrame(points + [(900, None, 1.0), (901, 1.0, None)], "id long, lat double, lon double")
    c = spark.createDataFrame(centres + [(900, None, None)], "centre_id long, lat double, lon double")
    rows = geo.within_radius(p, c, radius)
    got = [((r["centre_id"], r["id"]), r["km"]) for r in rows.collect()]
    assert len(got) == len(dict(got)) and dict(got) == pytest.approx(want, abs=1e-6) and want
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_every_place_is_found_once_and_only_full_boxes_are_cut(spark):
    rnd = random.Random(7)
    places = [(i, rnd.random() ** 4 * 0.999, 10 + rnd.random() ** 4 * 0.999) for i in range(600)] + [(600 + i, 0.5, 10.5) for i in range(30)] + [(900, None, 1.0), (901, 5.0, 5.0), (902, 1.0, 10.5)]
    areas = [(1, 0.0, 10.0, 1.0, 11.0), (2, 40.0, 10.0, 41.0, 11.0), (3, 1.0, 1.0, 1.0, 2.0)]
    found, asked = search_grid.adaptive_search(spark.createDataFrame(places, "id long, lat double, lon double"), spark.createDataFrame(areas, "area_id long, min_lat double, min_lon double, max_lat double, max_lon double"), cap=20, depth=5)
    got, boxes = found.collect(), {(r["area_id"], r["path"]): (r["n"], r["answer"]) for r in asked.collect()}
    assert len(got) == len({r["id"] for r in got}) and {r["area_id"] for r in got} == {1}
    short = sum(n - 20 for n, answer in boxes.values() if answer == "partial")
    assert len(got) == 630 - short and any(answer == "partial" for _, answer in boxes.values())  # thirty places share one point
    for (area, path), (n, answer) in boxes.items():
        assert (n > 20) == (answer != "whole") and (not path or boxes[area, path[:-1]][1] == "cut")
        inside = sum(n for (a, p), (n, _) in boxes.items() if a == area and len(p) == len(path) + 1 and p.startswith(path))
        assert answer != "cut" or inside == n


def test_areas_that_touch_too_many_tiles_are_refused(spark):
    places = spark.createDataFrame([(1, 1.0, 1.0)], "id long, lat double, lon double")
    world = spark.createDataFrame([(1, -90.0, -180.0, 90.0, 180.0)], "area_id long, min_lat double, min_lon double, max_lat double, max_lon double")
    with pytest.raises(Exception, match="too many tiles"):
        search_grid.in_areas(places, world).collect()


@pytest.mark.parametrize("box", [(10.0, 20.0, 10.2, 20.3), (-5.0, -5.0, 5.0, 5.0), (-90.0, -180.0, 90.0, 180.0), (3.0, 3.0, 2.0, 4.0)])
def test_tile_filters_are_short_and_lose_no_place(spark, box):
    rnd = random.Random(1)
    df = spark.createDataFrame([(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(300)] + [(rnd.uniform(box[0], box[2]), rnd.uniform(box[1], box[3])) for _ in range(100)], "lat double, lon double")
    held = geo.in_tiles(geo.tile_of(F.col("lat"), F.col("lon")), box)
    assert df.where(geo.in_box(F.col("lat"), F.col("lon"), box) & ~held).count() == 0
    assert len(str(held._jc)) < 200_000


def test_kept_sketches_merge_for_any_days(spark):
    rnd = random.Random(2)
    rows = [(dt.datetime(2026, 1, 1 + rnd.randrange(20)), rnd.choice("ab"), rnd.randrange(3000), rnd.randrange(10**6)) for _ in range(20_000)]
    kept = reports.usage_sketches(spark.createDataFrame(rows, "created_at timestamp, meter string, user_id long, cost_micros long"), ["meter"])
    for first, last in ((3, 3), (2, 17)):
        for r in reports.sketched_usage(kept, ["meter"], F.lit(dt.date(2026, 1, first)), F.lit(dt.date(2026, 1, last)), [0.1, 0.5, 0.99]).collect():
            own = sorted(x[3] for x in rows if x[1] == r["meter"] and first <= x[0].day <= last)
            users = len({x[2] for x in rows if x[1] == r["meter"] and first <= x[0].day <= last})
            assert r["n"] == len(own) and r["total"] == sum(own) and abs(r["users"] - users) <= reports.DISTINCT_ERROR * users
            for q, share in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99)):
                assert abs(sum(x <= r[q] for x in own) / len(own) - share) <= reports.RANK_ERROR + 1 / len(own)
    assert reports.sketched_usage(kept, ["meter"], F.lit(dt.date(2027, 1, 1)), F.lit(dt.date(2027, 1, 2))).count() == 0


@pytest.mark.parametrize(
    "before, maker",
    [
        ("Website by Acme, ", True), ("Designed & developed by Acme ", True), ("Crafted in Pune by ", True), ("powered with care by X ", True), ("Powered by <a>", True), ("Template by X ", True),
        ("Visit by appointment, call ", False), ("Stand by us: ", False), ("made of steel, call ", False), ("our website: ", False), ("Call us ", False),
    ],
)
def test_who_made_a_site_is_not_who_owns_it(spark, before, maker):
    got = spark.createDataFrame([(before,)], "b string").select(matching.what_it_is(F.lit("98765 43210"), F.col("b"), F.lit(False))).first()[0]
    assert (got == "built by") == maker


def test_too_many_fields_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(export, "MOST_FIELDS", 3)
    values = spark.createDataFrame([(f"f{i}",) for i in range(3)] + [(None,)], "field string")
    assert export.fields_of(values) == ["f0", "f1", "f2"]
    with pytest.raises(ValueError, match="more than 3"):
        export.fields_of(values.unionByName(spark.createDataFrame([("f9",)], "field string")))
