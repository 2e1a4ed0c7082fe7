"""Searches whose answers are cut off: areas are quartered only where there is more than one answer can hold.

A search in a box answers with at most ``cap`` places. Where it holds more, its four quarters are asked instead, down to
``depth`` or to boxes too small to cut; what is still cut off there is said. Places lie in one box of each level, so a
level is one count by box and every place is found once. Survey: SRC14, GEO2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import geo
from tessera.scratch import Scratch

CAP = 60
DEPTH = 6
SIDES = ["min_lat", "min_lon", "max_lat", "max_lon"]
#: Tiles that one area may touch when places are dealt to areas.
MOST_TILES = 100_000


def in_areas(places: DataFrame, areas: DataFrame, size: float = geo.TILE_DEGREES) -> DataFrame:
    """Places (id, lat, lon) with each area (area_id and SIDES) that holds them, its upper borders left out.

    Areas are spread over the tiles that they touch and meet the places of those tiles; a place may lie in several.
    """
    at = lambda c, shift: F.floor((F.col(c) + shift) / size)
    rows, columns = F.sequence(at("min_lat", 90), at("max_lat", 90)), F.sequence(at("min_lon", 180), at("max_lon", 180))
    n = (at("max_lat", 90) - at("min_lat", 90) + 1) * (at("max_lon", 180) - at("min_lon", 180) + 1)
    checked = areas.where((F.col("max_lat") > F.col("min_lat")) & (F.col("max_lon") > F.col("min_lon"))).withColumn("_fits", F.when(n > MOST_TILES, F.raise_error(F.lit("an area touches too many tiles"))).otherwise(F.lit(True)).cast("boolean"))
    spread = checked.where("_fits").withColumn("_row", F.explode(rows)).withColumn("_tile", F.explode(F.transform(columns, lambda c: (F.col("_row") * 100_000 + c).cast("long")))).drop("_row", "_fits")
    placed = places.where("lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon", geo.tile_of(F.col("lat"), F.col("lon"), size).alias("_tile"))
    inside = (F.col("lat") >= F.col("min_lat")) & (F.col("lat") < F.col("max_lat")) & (F.col("lon") >= F.col("min_lon")) & (F.col("lon") < F.col("max_lon"))
    return placed.join(spread, "_tile").where(inside).select("id", "lat", "lon", "area_id", *SIDES)


def _quartered(rows: DataFrame) -> DataFrame:
    """The quarter of each place's box that holds it, named by one more digit."""
    lat, lon = (F.col("min_lat") + F.col("max_lat")) / 2, (F.col("min_lon") + F.col("max_lon")) / 2
    north, east = F.col("lat") >= lat, F.col("lon") >= lon
    pick = lambda cond, yes, no: F.when(cond, yes).otherwise(no)
    return rows.withColumns(
        {
            "path": F.concat("path", (pick(north, 2, 0) + pick(east, 1, 0)).cast("string")), "min_lat": pick(north, lat, F.col("min_lat")), "max_lat": pick(north, F.col("max_lat"), lat),
            "min_lon": pick(east, lon, F.col("min_lon")), "max_lon": pick(east, F.col("max_lon"), lon),
        }
    )


def _can_be_cut() -> Column:
    return ((F.col("max_lat") - F.col("min_lat")) / 2 >= geo.MIN_SPAN) & ((F.col("max_lon") - F.col("min_lon")) / 2 >= geo.MIN_SPAN)


def adaptive_search(places: DataFrame, areas: DataFrame, cap: int = CAP, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(found, asked): found (area_id, path, id) are the answers, asked (area_id, path, n, answer) the searches made.

    ``path`` is empty for an area and has a digit for each cut: 0 and 1 south, 1 and 3 east. ``answer`` is whole, cut (and
    quartered) or partial: a box that is cut off for good, of which the ``cap`` places of smallest id are found.
    """
    scratch = Scratch(places.sparkSession, "grid")
    open_ = scratch.save(in_areas(places, areas).withColumn("path", F.lit("")))
    found, asked = [], []
    for level in range(depth + 1):
        boxes = open_.groupBy("area_id", "path", *SIDES).agg(F.count("*").alias("n"))
        answer = F.when(F.col("n") <= cap, "whole").when(_can_be_cut() & F.lit(level < depth), "cut").otherwise("partial")
        boxes = scratch.save(boxes.withColumn("answer", answer))
        asked.append(boxes.select("area_id", "path", "n", "answer"))
        dealt = open_.join(boxes.select("area_id", "path", "answer"), ["area_id", "path"])
        found.append(dealt.where("answer = 'whole'").select("area_id", "path", "id"))
        rank = F.row_number().over(W.partitionBy("area_id", "path").orderBy("id"))
        found.append(dealt.where("answer = 'partial'").withColumn("_n", rank).where(F.col("_n") <= cap).select("area_id", "path", "id"))
        if boxes.where("answer = 'cut'").isEmpty():
            break
        open_ = scratch.save(_quartered(dealt.where("answer = 'cut'").drop("answer")))
    together = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(together(parts[1:]))
    return together(found), together(asked)
