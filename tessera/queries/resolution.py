"""Entity resolution over customers and suppliers as companies, with planted variants of their records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import resolution
from tessera.registry import query, table
from tessera.scratch import Scratch

FIRST = "Amber Birch Cedar Delta Ember Falcon Granite Harbor Indigo Jasper Kestrel Lumen Maple Nimbus Onyx Pioneer Quartz Raven Summit Tidal Umbra Vertex Willow Zephyr".split()
SECOND = "Analytics Bakery Clinic Dental Exports Foods Garments Hotels Interiors Jewels Kitchens Logistics Motors Nursery Optics Printing Quarries Realty Schools Textiles Utilities Ventures Works Yachts Zinc".split()
THIRD = "Agra Bhopal Chennai Delhi Erode Faridabad Guntur Hubli Indore Jaipur Kochi".split()

#: Companies as records: a customer each, a variant of every third, and a supplier that is the customer of its number.
ENTITIES = f"""
k AS (SELECT c_custkey AS k, {FIRST}[1 + c_custkey % {len(FIRST)}] || ' ' || {SECOND}[1 + c_custkey // {len(FIRST)} % {len(SECOND)}] || ' ' || {THIRD}[1 + c_custkey % {len(THIRD)}] AS n FROM customer),
r AS (SELECT k * 4 AS id, k, n, 0 AS v FROM k UNION ALL SELECT k * 4 + 1, k, n, 1 FROM k WHERE k % 3 = 0
      UNION ALL SELECT s_suppkey * 4 + 2, k, n, 2 FROM supplier JOIN k ON s_suppkey = k),
e AS MATERIALIZED (SELECT id, lower(CASE WHEN v = 1 AND k % 6 = 3 THEN substr(n, 1, 2) || substr(n, 4) WHEN v = 2 THEN substr(n, 1, 1) || substr(n, 3, 1) || substr(n, 2, 1) || substr(n, 4) ELSE n END) AS name_key,
  CASE WHEN k % 4 = 1 OR (v = 1 AND k % 6 = 3 AND k % 30 <> 3) THEN NULL WHEN k % 9 = 2 THEN NULL WHEN k % 3 = 2 THEN 'bigmall.in' ELSE 'site' || k || '.co.in' END AS domain,
  CASE WHEN v = 1 AND k % 30 = 3 THEN '+9199' || lpad(k::VARCHAR, 8, '0') WHEN (v = 1 AND k % 9 = 0) OR (v = 2 AND k % 2 = 1) THEN NULL ELSE '+9198' || lpad(k::VARCHAR, 8, '0') END AS phone,
  CASE WHEN v = 2 OR (v = 1 AND k % 2 = 0) OR k % 5 = 0 THEN NULL ELSE 'c' || k || '.in' END AS mail_domain,
  8 + (k * 37 % 2500) * 0.01::DOUBLE + CASE WHEN v = 1 AND k % 30 = 3 THEN 0.5::DOUBLE WHEN v = 1 THEN 0.001::DOUBLE ELSE 0 END AS lat, 70 + (k * 53 % 2000) * 0.01::DOUBLE AS lon,
  CASE WHEN k % 15 = 0 AND v = 0 THEN 'R' || k WHEN k % 15 = 0 AND v = 1 THEN 'R' || k || 'X' END AS registry_id FROM r)"""
DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"
BLOCKS = f"""
q AS (SELECT *, floor((lon + 180.0::DOUBLE) / 360 * 262144)::BIGINT AS x, floor((lat + 90.0::DOUBLE) / 180 * 131072)::BIGINT AS y FROM e),
g AS MATERIALIZED (SELECT *, array_to_string(list_transform(range(0, 7), lambda c: substr('{DIGITS}', 1 + list_sum(list_transform(range(0, 5),
  lambda b: (CASE WHEN (5 * c + b) % 2 = 0 THEN (x >> (17 - (5 * c + b) // 2)) & 1 ELSE (y >> (16 - (5 * c + b) // 2)) & 1 END) << (4 - b)))::BIGINT, 1)), '') AS place FROM q),
b AS (SELECT kind, key, name_key AS sort, id FROM (SELECT id, name_key, unnest(['domain', 'phone', 'mail', 'place', 'registry', 'name']) AS kind,
  unnest([domain, phone, mail_domain, place || ':' || substr(name_key, 1, 3), registry_id, substr(name_key, 1, 1)]) AS key FROM g) WHERE key IS NOT NULL),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY sort, id) AS at FROM b),
p AS MATERIALIZED (SELECT least(l.id, r.id) AS a, greatest(l.id, r.id) AS b, array_to_string(list_sort(list(DISTINCT l.kind)), ',') AS kinds
      FROM n l JOIN n r ON l.kind = r.kind AND l.key = r.key AND r.at - l.at BETWEEN 1 AND 10 GROUP BY 1, 2)"""
TOKENS = "string_split({0}, ' ')"
FEATURES = """
f AS MATERIALIZED (SELECT a, b, kinds, l.domain = r.domain AS domain_equal, l.phone = r.phone AS phone_equal, l.mail_domain = r.mail_domain AS mail_equal,
  jaro_winkler_similarity(l.name_key, r.name_key) AS name_jw,
  len(list_intersect(string_split(l.name_key, ' '), string_split(r.name_key, ' '))) / len(list_distinct(list_concat(string_split(l.name_key, ' '), string_split(r.name_key, ' '))))::DOUBLE AS name_words,
  2 * 6371.0088 * asin(sqrt(pow(sin(radians(r.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lon - l.lon) / 2), 2))) AS km, l.registry_id = r.registry_id AS registry_equal
  FROM p JOIN e l ON a = l.id JOIN e r ON b = r.id)"""
DECISIONS = """
t AS (SELECT *, -6 + coalesce(CASE WHEN domain_equal THEN 9 ELSE -3 END * CASE WHEN domain_equal IS NULL THEN 0 ELSE 1 END, 0) + CASE phone_equal WHEN true THEN 10 WHEN false THEN -2.5 ELSE 0 END
  + CASE mail_equal WHEN true THEN 7 WHEN false THEN -2 ELSE 0 END + CASE WHEN name_jw >= 0.93 THEN 7 WHEN name_jw >= 0.85 THEN 2.5 ELSE -4 END
  + CASE WHEN name_words >= 0.99 THEN 2 WHEN name_words >= 0.5 THEN 0.5 ELSE -1.5 END + CASE WHEN km <= 0.25 THEN 6 WHEN km <= 5 THEN 0.5 ELSE -3 END AS bits FROM f),
s AS (SELECT *, CASE registry_equal WHEN true THEN 1 WHEN false THEN 0 ELSE 1 / (1 + pow(2.0::DOUBLE, -bits)) END AS score FROM t),
d AS MATERIALIZED (SELECT a, b, kinds, score, CASE WHEN registry_equal = false THEN 'separate' WHEN domain_equal AND name_jw >= 0.85 AND km > 0.5 AND phone_equal IS DISTINCT FROM true AND registry_equal IS DISTINCT FROM true THEN 'branch'
  WHEN score >= 0.92 THEN 'merge' WHEN score >= 0.7 THEN 'review' ELSE 'separate' END AS decision FROM s)"""
COMPANIES = """
m AS (SELECT a AS u, b AS v FROM d WHERE decision = 'merge' UNION SELECT b, a FROM d WHERE decision = 'merge'),
w AS (SELECT id, id AS c FROM e UNION SELECT m.v, c FROM w JOIN m ON m.u = w.id),
z AS (SELECT id, min(c) AS c FROM w GROUP BY id),
full_ AS (SELECT z.id, c, registry_id, (name_key IS NOT NULL)::INT + (domain IS NOT NULL)::INT + (phone IS NOT NULL)::INT + (mail_domain IS NOT NULL)::INT + 3 + (registry_id IS NOT NULL)::INT AS n FROM z JOIN e USING (id)),
o AS (SELECT c, arg_min(id, [-n, id]) AS winner, min(registry_id) IS DISTINCT FROM max(registry_id) AS mixed FROM full_ GROUP BY c),
x AS (SELECT id, CASE WHEN mixed THEN id ELSE winner END AS owner_id FROM full_ JOIN o USING (c))"""


def entities(spark, sf_dir):
    """Names, sites, phones and places as people write them; what is one company follows from the tables' keys."""
    k, number = F.col("c_custkey"), F.col("k").cast("string")
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (1 + i).cast("int"))
    name = F.concat_ws(" ", pick(FIRST, k % len(FIRST)), pick(SECOND, F.floor(k / len(FIRST)) % len(SECOND)), pick(THIRD, k % len(THIRD)))
    base = table(spark, sf_dir, "customer").select(k.alias("k"), name.alias("n"))
    supplied = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).join(base, "k").select("k", "n", F.lit(2).alias("v"))
    rows = base.withColumn("v", F.lit(0)).unionByName(base.where("k % 3 = 0").withColumn("v", F.lit(1))).unionByName(supplied)
    k, v, n = F.col("k"), F.col("v"), F.col("n")
    far = (v == 1) & (k % 30 == 3)
    typed = F.when((v == 1) & (k % 6 == 3), F.concat(F.substring("n", 1, 2), F.substring("n", 4, 99), F.lit(" Pvt Ltd"))).when(v == 1, F.concat(F.upper(n), F.lit(" PVT. LTD.")))
    typed = typed.when(v == 2, F.concat(F.substring("n", 1, 1), F.substring("n", 3, 1), F.substring("n", 2, 1), F.substring("n", 4, 99))).otherwise(n)
    site = F.when((k % 4 == 1) | ((v == 1) & (k % 6 == 3) & (k % 30 != 3)), None).when(k % 9 == 2, F.concat(F.lit("https://www.facebook.com/p"), number))
    site = site.when(k % 3 == 2, F.concat(F.lit("http://shop"), number, F.lit(".bigmall.in/"))).otherwise(F.concat(F.lit("https://www.Site"), number, F.lit(".co.in/home")))
    phone = F.when(far, F.concat(F.lit("+9199"), F.lpad(number, 8, "0"))).when(((v == 1) & (k % 9 == 0)) | ((v == 2) & (k % 2 == 1)), None).otherwise(F.concat(F.lit("+9198"), F.lpad(number, 8, "0")))
    email = F.when((v == 2) | ((v == 1) & (k % 2 == 0)), None).when(k % 5 == 0, "info@gmail.com").otherwise(F.concat(F.lit("sales@C"), number, F.lit(".in")))
    lat = 8 + (k * 37 % 2500) * 0.01 + F.when(far, 0.5).when(v == 1, 0.001).otherwise(0.0)
    registry = F.when((k % 15 == 0) & (v == 0), F.concat(F.lit("R"), number)).when((k % 15 == 0) & (v == 1), F.concat(F.lit("R"), number, F.lit("X")))
    return rows.select(
        (k * 4 + v).alias("id"), typed.alias("name"), site.alias("website"), phone.alias("phone"), email.alias("email"),
        lat.alias("lat"), (70 + (k * 53 % 2000) * 0.01).alias("lon"), registry.alias("registry_id"),
    )


@query("geo_geohash", f"WITH {ENTITIES}, {BLOCKS} SELECT id, place FROM g")
def geo_geohash(spark, sf_dir):
    return resolution.prepared(entities(spark, sf_dir)).select("id", "place")


@query("er_candidate_pairs", f"WITH {ENTITIES}, {BLOCKS} SELECT * FROM p")
def er_candidate_pairs(spark, sf_dir):
    """Six keys a record; the shared domain of a mall and the names of one first letter are large blocks."""
    pairs = resolution.candidate_pairs(resolution.blocking_keys(resolution.prepared(entities(spark, sf_dir))))
    return pairs.withColumn("kinds", F.array_join("kinds", ","))


@query("er_pair_features", f"WITH {ENTITIES}, {BLOCKS}, {FEATURES} SELECT * REPLACE (round(name_jw, 6) AS name_jw, round(name_words, 6) AS name_words, round(km, 5) AS km) FROM f")
def er_pair_features(spark, sf_dir):
    records = Scratch(spark, "records").save(resolution.prepared(resolution.spread(entities(spark, sf_dir))))
    found = resolution.features(resolution.candidate_pairs(resolution.blocking_keys(records)), records)
    return found.withColumns({"kinds": F.array_join("kinds", ","), "name_jw": F.round("name_jw", 6), "name_words": F.round("name_words", 6), "km": F.round("km", 5)})


@query("er_decisions", f"WITH {ENTITIES}, {BLOCKS}, {FEATURES}, {DECISIONS} SELECT a, b, round(score, 6) AS score, decision FROM d")
def er_decisions(spark, sf_dir):
    decided, _ = resolution.resolve(entities(spark, sf_dir))
    return decided.select("a", "b", F.round("score", 6).alias("score"), "decision")


@query("er_companies", f"WITH RECURSIVE {ENTITIES}, {BLOCKS}, {FEATURES}, {DECISIONS}, {COMPANIES} SELECT id, owner_id FROM x")
def er_companies(spark, sf_dir):
    """Who owns each record after the merges; two registry ids in a cluster hold it."""
    records = entities(spark, sf_dir)
    _, log = resolution.resolve(records)
    return resolution.repoint(records, log, "id").select("id", "owner_id")


@query("er_undo", f"WITH RECURSIVE {ENTITIES}, {BLOCKS}, {FEATURES}, {DECISIONS}, {COMPANIES}, "
       "v AS (SELECT o_custkey * 4 + CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS company_id FROM orders) "
       "SELECT company_id, CASE WHEN company_id % 8 = 1 THEN company_id ELSE owner_id END AS owner_id, count(*) AS n_orders FROM v JOIN x ON company_id = id GROUP BY ALL")  # fmt: skip
def er_undo(spark, sf_dir):
    """Orders of companies after all merges, of which those of every other variant were taken back."""
    _, log = resolution.resolve(entities(spark, sf_dir))
    log = resolution.undo(log, log.where("loser_id % 8 = 1"), F.current_timestamp())
    k = F.col("o_custkey")
    orders = table(spark, sf_dir, "orders").select((k * 4 + F.when((k % 3 == 0) & (F.col("o_orderkey") % 2 == 0), 1).otherwise(0)).alias("company_id"))
    return resolution.repoint(orders, log).groupBy("company_id", "owner_id").agg(F.count("*").alias("n_orders"))
