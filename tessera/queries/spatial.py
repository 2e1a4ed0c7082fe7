"""Radius joins, adaptive search grids, and usage from kept sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators import reports
from tessera.plans import search_grid
from tessera.queries.reporting import U, usage
from tessera.registry import query, table

KM = 400.0


@query("geo_radius_join", f"""WITH p AS (SELECT c_custkey AS id, -89.95::DOUBLE + (c_custkey * 97 % 1800) * 0.1::DOUBLE AS lat, -180 + (c_custkey * 53 % 3600) * 0.1::DOUBLE AS lon FROM customer),
c AS (SELECT s_suppkey AS centre_id, -90 + (s_suppkey * 61 % 1801) * 0.1::DOUBLE AS lat, -180 + (s_suppkey * 89 % 3601) * 0.1::DOUBLE AS lon FROM supplier),
d AS (SELECT centre_id, id, 2 * 6371.0088 * asin(sqrt(pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2))) AS km FROM p, c)
SELECT centre_id, id, round(km, 6) AS km FROM d WHERE km <= {KM}""")  # fmt: skip
def geo_radius_join(spark, sf_dir):
    """Customers within 400 km of suppliers, all over the globe: across the date line and at the poles too."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, sf_dir, "customer").select(c.alias("id"), (-89.95 + (c * 97 % 1800) * 0.1).alias("lat"), (-180 + (c * 53 % 3600) * 0.1).alias("lon"))
    centres = table(spark, sf_dir, "supplier").select(s.alias("centre_id"), (-90 + (s * 61 % 1801) * 0.1).alias("lat"), (-180 + (s * 89 % 3601) * 0.1).alias("lon"))
    return geo.within_radius(points, centres, KM).withColumn("km", F.round("km", 6))


CAP, DEPTH = 12, 5
#: Places crowd towards the south-west corner of each nation's square of one degree.
GRID_PLACES = "p AS (SELECT p_partkey AS id, p_partkey % 25 AS n, 0.03125::DOUBLE * 0.03125::DOUBLE * (p_partkey * 7 % 1021 / 1021.0::DOUBLE) * (p_partkey * 11 % 1019 / 1019.0::DOUBLE) * 1024 AS y, (p_partkey * 13 % 1013 / 1013.0::DOUBLE) * (p_partkey * 17 % 1009 / 1009.0::DOUBLE) AS x FROM part)"


def _levels() -> str:
    """The SQL of all levels: what is cut off goes on, by the quarter of its box."""
    parts = [f"{GRID_PLACES}, l0 AS MATERIALIZED (SELECT n_nationkey AS area_id, '' AS path, id, y, x, 0.0::DOUBLE AS s, 0.0::DOUBLE AS w FROM p JOIN nation ON n = n_nationkey)"]
    for k in range(DEPTH + 1):
        half = 0.5 ** (k + 1)
        last = f"WHEN {k} < {DEPTH} THEN 'cut'" if half >= 0.01 else ""
        parts.append(f"b{k} AS MATERIALIZED (SELECT area_id, path, count(*) AS n, CASE WHEN count(*) <= {CAP} THEN 'whole' {last} ELSE 'partial' END AS answer FROM l{k} GROUP BY ALL)")
        if k < DEPTH:
            parts.append(f"l{k + 1} AS MATERIALIZED (SELECT area_id, path || (CASE WHEN y >= s + {half} THEN 2 ELSE 0 END + CASE WHEN x >= w + {half} THEN 1 ELSE 0 END)::VARCHAR AS path, id, y, x, "
                         f"CASE WHEN y >= s + {half} THEN s + {half} ELSE s END AS s, CASE WHEN x >= w + {half} THEN w + {half} ELSE w END AS w FROM l{k} JOIN b{k} USING (area_id, path) WHERE answer = 'cut')")  # fmt: skip
    return ", ".join(parts)


def _grid(spark, sf_dir):
    k = F.col("p_partkey")
    part = lambda m, n: (k * m % n) / float(n)
    y, x = F.lit(0.03125 * 0.03125) * part(7, 1021) * part(11, 1019) * 1024, part(13, 1013) * part(17, 1009)
    places = table(spark, sf_dir, "part").select(k.alias("id"), y.alias("lat"), (x + (k % 25) * 2).alias("lon"))
    west = F.col("n_nationkey") * 2.0
    areas = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area_id"), F.lit(0.0).alias("min_lat"), west.alias("min_lon"), F.lit(1.0).alias("max_lat"), (west + 1).alias("max_lon"))
    return search_grid.adaptive_search(places, areas, CAP, DEPTH)


@query("pln_grid_found", f"WITH {_levels()}, f AS (" + " UNION ALL ".join(f"SELECT area_id, path, id, answer, row_number() OVER (PARTITION BY area_id, path ORDER BY id) AS pos FROM l{k} JOIN b{k} USING (area_id, path) WHERE answer <> 'cut'" for k in range(DEPTH + 1)) + f") SELECT area_id, path, id FROM f WHERE answer = 'whole' OR pos <= {CAP}")
def pln_grid_found(spark, sf_dir):
    """Every place once, in the box whose answer held it."""
    return _grid(spark, sf_dir)[0]


@query("pln_grid_asked", f"WITH {_levels()} " + " UNION ALL ".join(f"SELECT area_id, path, n, answer FROM b{k}" for k in range(DEPTH + 1)))
def pln_grid_asked(spark, sf_dir):
    """The searches made: only boxes that are cut off are quartered."""
    return _grid(spark, sf_dir)[1]


@query("agg_usage_sketches", f"WITH u AS (SELECT *, created_at::DATE AS day FROM ({U})), r AS (SELECT *, min(day) OVER () + 2 AS first, min(day) OVER () + 20 AS last FROM u) SELECT meter, count(*) AS n, sum(cost_micros)::BIGINT AS total, true AS users_close, true AS median_close, true AS high_close FROM r WHERE day BETWEEN first AND last GROUP BY meter")
def agg_usage_sketches(spark, sf_dir):
    """Nineteen days of usage from daily sketches, against exact figures: counts within 5 %, ranks within 1 %."""
    u = usage(spark, sf_dir).withColumn("day", F.to_date("created_at"))
    start = u.agg(F.min("day")).first()[0]
    first, last = F.date_add(F.lit(start), 2), F.date_add(F.lit(start), 20)
    got = reports.sketched_usage(reports.usage_sketches(u.drop("day"), ["meter"], "org_id"), ["meter"], first, last)
    exact = u.where(F.col("day").between(first, last)).join(F.broadcast(got.select("meter", "q50", "q95")), "meter").groupBy("meter").agg(
        F.countDistinct("org_id").alias("orgs"), F.count("*").alias("rows"),
        *(f(c).alias(f"{n}{q}") for q in ("q50", "q95") for n, f, c in (("below_", F.count_if, F.col("cost_micros") < F.col(q)), ("upto_", F.count_if, F.col("cost_micros") <= F.col(q)))),
    )
    near = lambda q, share: (F.col(f"below_{q}") <= (share + reports.RANK_ERROR) * F.col("rows")) & (F.col(f"upto_{q}") >= (share - reports.RANK_ERROR) * F.col("rows"))
    return got.join(exact, "meter").select("meter", "n", "total", (F.abs(F.col("users") - F.col("orgs")) <= reports.DISTINCT_ERROR * F.col("orgs")).alias("users_close"), near("q50", 0.5).alias("median_close"), near("q95", 0.95).alias("high_close"))
