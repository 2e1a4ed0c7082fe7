"""Boxes, tiles and distances on the globe as column expressions and exploding operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.binding import bind

KM_PER_DEGREE = 111.32
TILE_KM = 15.0
TILE_DEGREES = 0.05
MIN_SPAN = 0.01


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Closed on all sides; ``box``: min lat, min lon, max lat, max lon."""
    return lat.between(box[0], box[2]) & lon.between(box[1], box[3])


def tile_of(lat: Column, lon: Column, size: float = TILE_DEGREES) -> Column:
    """One number for the tile of a point: the layout key of place tables."""
    return (F.floor((lat + 90) / size) * 100_000 + F.floor((lon + 180) / size)).cast("long")


#: Tiles that a filter lists one by one; a larger box is met by its rows of tiles, a still larger one by the first and last.
LISTED_TILES, LISTED_ROWS = 2_000, 500


def in_tiles(tile: Column, box: tuple[float, float, float, float], size: float = TILE_DEGREES) -> Column:
    """Whether a tile's number is one that a box can touch: a filter for the scan, whose length is bounded."""
    at = lambda x, shift: math.floor((x + shift) / size)  # noqa: E731  the same division as tile_of
    bottom, top, left, right = at(box[0], 90), at(box[2], 90), at(box[1], 180), at(box[3], 180)
    if top < bottom or right < left:
        return F.lit(False)
    if (top - bottom + 1) * (right - left + 1) <= LISTED_TILES:
        return tile.isin([r * 100_000 + c for r in range(bottom, top + 1) for c in range(left, right + 1)])
    if top - bottom + 1 <= LISTED_ROWS:
        out = F.lit(False)
        for r in range(bottom, top + 1):
            out |= tile.between(r * 100_000 + left, r * 100_000 + right)
        return out
    return tile.between(bottom * 100_000 + left, top * 100_000 + right)


def width_km(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    """Survey: GEO3."""
    return (max_lon - min_lon) * KM_PER_DEGREE * F.cos(F.radians((min_lat + max_lat) / 2))


def height_km(min_lat: Column, max_lat: Column) -> Column:
    return (max_lat - min_lat) * KM_PER_DEGREE


def tile_grid(boxes: DataFrame, max_km: float = TILE_KM) -> DataFrame:
    """Each box (min_lat, min_lon, max_lat, max_lon) cut into rows and columns no longer than ``max_km``.

    Adds row, column and the tile's own box as t_min_lat, t_min_lon, t_max_lat, t_max_lon.

    Survey: GEO1.
    """
    c = F.col
    rows = F.greatest(F.lit(1), F.ceil(height_km(c("min_lat"), c("max_lat")) / max_km)).cast("int")
    columns = F.greatest(F.lit(1), F.ceil(width_km(c("min_lat"), c("min_lon"), c("max_lat"), c("max_lon")) / max_km)).cast("int")
    cut = boxes.withColumn("_rows", rows).withColumn("_columns", columns)
    cut = cut.withColumn("row", F.explode(F.sequence(F.lit(0), c("_rows") - 1))).withColumn("column", F.explode(F.sequence(F.lit(0), c("_columns") - 1)))
    d_lat, d_lon = (c("max_lat") - c("min_lat")) / c("_rows"), (c("max_lon") - c("min_lon")) / c("_columns")
    return cut.select(
        *boxes.columns, "row", "column",
        (c("min_lat") + c("row") * d_lat).alias("t_min_lat"), (c("min_lon") + c("column") * d_lon).alias("t_min_lon"),
        (c("min_lat") + (c("row") + 1) * d_lat).alias("t_max_lat"), (c("min_lon") + (c("column") + 1) * d_lon).alias("t_max_lon"),
    )


def quarters(boxes: DataFrame) -> DataFrame:
    """Each box cut in four, or left whole where a side would be shorter than MIN_SPAN. Survey: SRC14, GEO2."""
    c = F.col
    lat, lon = (c("min_lat") + c("max_lat")) / 2, (c("min_lon") + c("max_lon")) / 2
    box = lambda a, b, x, y: F.struct(a.alias("min_lat"), b.alias("min_lon"), x.alias("max_lat"), y.alias("max_lon"))
    whole = box(c("min_lat"), c("min_lon"), c("max_lat"), c("max_lon"))
    four = [box(c("min_lat"), c("min_lon"), lat, lon), box(c("min_lat"), lon, lat, c("max_lon")), box(lat, c("min_lon"), c("max_lat"), lon), box(lat, lon, c("max_lat"), c("max_lon"))]
    small = ((c("max_lat") - c("min_lat")) / 2 < MIN_SPAN) | ((c("max_lon") - c("min_lon")) / 2 < MIN_SPAN)
    rest = [x for x in boxes.columns if x not in ("min_lat", "min_lon", "max_lat", "max_lon")]
    return boxes.select(*rest, F.inline(F.when(small, F.array(whole)).otherwise(F.array(*four))))


def radius_box(lat: Column, lon: Column, km: Column) -> Column:
    """The box around a point, as a struct. Survey: GEO4."""
    d_lat, d_lon = km / KM_PER_DEGREE, km / (KM_PER_DEGREE * F.cos(F.radians(lat)))
    return F.struct((lat - d_lat).alias("min_lat"), (lon - d_lon).alias("min_lon"), (lat + d_lat).alias("max_lat"), (lon + d_lon).alias("max_lon"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Survey: GEO5."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(h))


#: The digits of geohashes, by value.
GEOHASH_DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"


def _spread(c: Column) -> Column:
    """The lowest 32 bits of a long with a zero before each bit."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = (c.bitwiseOR(F.shiftleft(c, shift))).bitwiseAND(F.lit(mask))
    return c


def _steps(c: Column, low: float, high: float, bits: int) -> Column:
    """Which of 2^bits equal steps from low to high holds the value; values beyond the ends take the last one."""
    step = F.floor((c - low) / (high - low) * (1 << bits))
    return F.when(c.isNotNull(), F.least(F.greatest(step, F.lit(0)), F.lit((1 << bits) - 1)).cast("long"))


def cell(lat: Column, lon: Column, bits: int) -> Column:
    """The number of the cell of a point: ``bits`` halvings of the globe, longitude first, interleaved. Survey: GEO5."""
    of_lon, of_lat = _steps(lon, -180.0, 180.0, (bits + 1) // 2), _steps(lat, -90.0, 90.0, bits // 2)
    first, second = (of_lat, of_lon) if bits % 2 else (of_lon, of_lat)
    return F.shiftleft(_spread(first), 1).bitwiseOR(_spread(second))


def geohash(lat: Column, lon: Column, length: int = 7) -> Column:
    """The geohash of a point, at most 12 digits; null where a coordinate is. Survey: GEO5."""
    digits = F.conv(cell(lat, lon, 5 * length).cast("string"), 10, 32)
    return F.lpad(F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", GEOHASH_DIGITS), length, "0")


# ------------------------------------------------------------------------------------------------------------------
# Radius joins

EARTH_KM = 6371.0088


def _row(lat: Column, km: float) -> Column:
    return F.floor((F.greatest(F.least(lat, F.lit(90.0)), F.lit(-90.0)) + 90) / (km / KM_PER_DEGREE)).cast("int")


def _columns_of(row: Column, km: float) -> Column:
    """How many columns a row of cells has, none of them narrower than ``km`` anywhere in the row; one near the poles."""
    step = km / KM_PER_DEGREE
    edge = F.greatest(F.abs(row * step - 90), F.abs((row + 1) * step - 90))
    width = step / F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(1e-9))
    return F.greatest(F.floor(360 / width), F.lit(1)).cast("int")


def _column(lon: Column, columns: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * columns).cast("int"), columns)


def radius_cell(lat: Column, lon: Column, km: float) -> Column:
    """The cell (row, column) of a point, in a grid of cells at least ``km`` high and wide."""
    return bind(_row(lat, km), lambda r: F.struct(r.alias("row"), _column(lon, _columns_of(r, km)).alias("column")))


def radius_cover(lat: Column, lon: Column, km: float) -> Column:
    """The cells that a circle of ``km`` can touch: in the point's row and its neighbours, two or three columns each."""

    def in_row(r: Column) -> Column:
        n = _columns_of(r, km)
        turn = lambda n: F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(km / EARTH_KM)) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))))) / 360 * n

        def cells(n: Column) -> Column:
            at, reach = (lon + 180) / 360 * n, turn(n) + 1e-9
            near = F.transform(F.sequence(F.floor(at - reach).cast("int"), F.floor(at + reach).cast("int")), lambda c: F.pmod(c, n))
            return F.transform(F.array_distinct(F.when((n <= 3) | (2 * reach >= n), F.sequence(F.lit(0), n - 1)).otherwise(near)), lambda c: F.struct(r.alias("row"), c.alias("column")))

        return bind(n, cells)

    return F.flatten(F.transform(F.sequence(_row(lat, km) - 1, _row(lat, km) + 1), in_row))


def within_radius(points: DataFrame, centres: DataFrame, km: float) -> DataFrame:
    """(centre_id, id, km) of the points (id, lat, lon) within ``km`` of centres (centre_id, lat, lon).

    An equi-join on cells, then the exact distance. Every point stands in one cell and a centre asks for nine or so, so no
    pair meets twice; very dense cells are hot join keys, which adaptive execution splits. Points without a
    coordinate are within nothing. Survey: GEO5.
    """
    if km <= 0:
        raise ValueError("a radius above zero")
    there = points.where("lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon", radius_cell(F.col("lat"), F.col("lon"), km).alias("cell"))
    asked = centres.where("lat IS NOT NULL AND lon IS NOT NULL").select("centre_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), F.explode(radius_cover(F.col("lat"), F.col("lon"), km)).alias("c_cell"))
    met = there.join(asked, (F.col("cell.row") == F.col("c_cell.row")) & (F.col("cell.column") == F.col("c_cell.column")))
    return met.select("centre_id", "id", haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")).alias("km")).where(F.col("km") <= km)
