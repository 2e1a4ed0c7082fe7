"""Filters, categories, normalisers and geography."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions import normalize as N
from tessera.functions import text as TX
from tessera.registry import query, table
from tessera.sources import places

HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*')), '^.*@', ''), ':.*$', '')"
BARE = f"regexp_replace({HOST}, '^www\\.', '')"
SUFFIXES = ", ".join(f"'{s}'" for s in N.MULTI_LABEL_SUFFIXES)
PLATFORMS = ", ".join(f"'{s}'" for s in N.PLATFORM_HOSTS)


def part_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as places: type words are category levels, price and size the coordinates, brand the phone."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.split("p_type", " ").alias("categories"),
        (F.col("p_retailprice") / 100).alias("lat"), F.col("p_size").cast("double").alias("lon"), F.lit("part").alias("source"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("phone"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).alias("email"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("website"),
    )


PART = "SELECT p_partkey AS id, p_name AS name, string_split(p_type, ' ') AS categories, p_retailprice / 100 AS lat, CAST(p_size AS DOUBLE) AS lon, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS phone, CASE WHEN p_partkey % 5 = 0 THEN p_name END AS email, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS website FROM part"
BOX = (9.5, 10.0, 14.0, 30.0)


@query("flt_bbox_range", f"SELECT id, lat, lon FROM ({PART}) WHERE lat BETWEEN 9.5 AND 14 AND lon BETWEEN 10 AND 30")
def flt_bbox_range(spark, sf_dir):
    return places.search(part_places(spark, sf_dir), box=BOX).select("id", "lat", "lon")


@query("flt_tile_layout_search", f"SELECT id FROM ({PART}) WHERE lat BETWEEN 9.5 AND 10.5 AND lon BETWEEN 10 AND 12")
def flt_tile_layout_search(spark, sf_dir):
    """A box search that prunes by the layout's tile key first."""
    rows = part_places(spark, sf_dir).withColumn("tile", geo.tile_of(F.col("lat"), F.col("lon")))
    return places.search(rows, box=(9.5, 10.0, 10.5, 12.0)).select("id")


@query("flt_category_any_level_semi", f"SELECT id FROM ({PART}) WHERE list_has_any(categories, ['TIN', 'PROMO', 'brushed'])")
def flt_category_any_level_semi(spark, sf_dir):
    return places.search(part_places(spark, sf_dir), categories=["TIN", "PROMO", "brushed"]).select("id")


@query("flt_tristate", f"SELECT 'yes' AS asked, id FROM ({PART}) WHERE website IS NOT NULL UNION ALL SELECT 'no', id FROM ({PART}) WHERE website IS NULL UNION ALL SELECT 'any', id FROM ({PART})")
def flt_tristate(spark, sf_dir):
    rows = part_places(spark, sf_dir)
    parts = [places.search(rows, has_website=v).select(F.lit(k).alias("asked"), "id") for k, v in (("yes", True), ("no", False), ("any", None))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("flt_any_of", f"SELECT id FROM ({PART}) WHERE phone IS NOT NULL OR email IS NOT NULL")
def flt_any_of(spark, sf_dir):
    """Channels that cannot be checked narrow nothing."""
    return places.search(part_places(spark, sf_dir), any_of=["phone", "email", "fax"]).select("id")


@query("flt_contactable", f"SELECT id FROM ({PART}) WHERE phone IS NOT NULL OR email IS NOT NULL")
def flt_contactable(spark, sf_dir):
    return places.search(part_places(spark, sf_dir), contactable=True).select("id")


@query("flt_name_ilike_escape", f"SELECT id, id % 6 = 0 AS underscore FROM ({PART}) WHERE id % 6 IN (0, 2, 5)")
def flt_name_ilike_escape(spark, sf_dir):
    """Names that end in one of six ways; ``_``, ``%`` and a backslash in what is asked for stand for themselves."""
    ends = ["UNIT_1 west", "unitA1 west", "50% OFF", "500 off", "back/slash", "back\\slash"]
    rows = part_places(spark, sf_dir)
    rows = rows.withColumn("name", F.concat("name", F.lit(" "), F.element_at(F.array(*map(F.lit, ends)), (F.col("id") % 6 + 1).cast("int"))))
    found = [places.search(rows, name=n).select("id", F.lit(n == "t_1").alias("underscore")) for n in ("t_1", "0% o", "k\\s")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("flt_search_page", f"SELECT id, array_to_string(categories, ',') AS categories FROM ({PART}) WHERE list_contains(categories, 'PROMO') OR list_contains(categories, 'STANDARD') ORDER BY id LIMIT 20 OFFSET 5")
def flt_search_page(spark, sf_dir):
    from tessera.operators import ranking

    found = places.search(part_places(spark, sf_dir), categories=["PROMO", "STANDARD"])
    return ranking.offset_page(found, ["id"], 5, 20).select("id", F.array_join("categories", ",").alias("categories"))


@query("flt_all_of", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'O') > 0 AND count(*) FILTER (o_orderstatus = 'F') > 0")
def flt_all_of(spark, sf_dir):
    """Customers whose orders show both states: every platform asked for is present."""
    orders = table(spark, sf_dir, "orders")
    values = F.collect_set(F.struct(F.col("o_orderstatus").alias("field"), F.lit("x").alias("value")))
    rows = orders.groupBy("o_custkey").agg(values.alias("values")).withColumns({"url": F.lit(None).cast("string"), "phone": F.lit(None).cast("string")})
    return places.narrow(rows, social_all_of=["O", "F"]).select("o_custkey")


@query("src_category_counts_explode", "SELECT category, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS category FROM part) GROUP BY category")
def src_category_counts_explode(spark, sf_dir):
    return places.category_counts(part_places(spark, sf_dir))


@query("src_top_categories", "SELECT category, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS category FROM part) GROUP BY category ORDER BY n DESC, category LIMIT 10")
def src_top_categories(spark, sf_dir):
    """Survey: SRT4."""
    return places.category_counts(part_places(spark, sf_dir)).limit(10)


@query("src_unpivot_observations", f"""
WITH p AS ({PART})
SELECT CAST(id AS VARCHAR) AS external_id, field, value, CAST(confidence AS DOUBLE) AS confidence FROM (
  SELECT id, 'name' AS field, name AS value, 0.85 AS confidence FROM p UNION ALL SELECT id, 'phone', phone, 0.85 FROM p
  UNION ALL SELECT id, 'email', email, 0.85 FROM p UNION ALL SELECT id, 'website', website, 0.85 FROM p
  UNION ALL SELECT id, 'category', categories[1], 0.7 FROM p) WHERE value IS NOT NULL AND value <> ''""")  # fmt: skip
def src_unpivot_observations(spark, sf_dir):
    rows = part_places(spark, sf_dir).withColumn("external_id", F.col("id").cast("string")).withColumn("category", F.col("categories")[0])
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("city", "region", "postcode", "country", "street")})
    out = places.observations(rows, F.lit("2024-01-01").cast("timestamp"))
    return out.select("external_id", "field", "value", "confidence")


@query("src_providing_cheapest", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey % 2 = 0 AND (s_nationkey % 3 <> 0 OR s_suppkey % 2 = 0)")
def src_providing_cheapest(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    sources = s.select(
        "s_suppkey", "s_acctbal", F.col("s_acctbal").alias("cost_micros"), F.col("s_name").alias("key"), F.lit(True).alias("enabled"), (F.col("s_suppkey") % 2 == 0).alias("legal_approved"),
        F.when(F.col("s_nationkey") % 3 == 0, "red").otherwise("green").alias("tos_class"), F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("phone"))).otherwise(F.array(F.lit("name"))).alias("fields_provided"),
    )
    return places.providing(sources, "phone").select("s_suppkey", "s_acctbal")


@query("src_search_result_hosts", f"SELECT host, min(page_id) AS position FROM (SELECT {BARE} AS host, page_id FROM pages) WHERE host NOT LIKE 'th%' GROUP BY host")
def src_search_result_hosts(spark, sf_dir):
    """One candidate for each host that is no directory, at its best position."""
    p = table(spark, sf_dir, "pages").withColumn("host", N.host_of(F.col("url")))
    listings = p.where(F.col("host").startswith("th")).select("host")
    results = p.select(F.lit("q").alias("query"), F.col("url").alias("link"), F.col("page_id").alias("position"))
    return places.search_results(results, listings).select("host", "position")


@query("nrm_host", f"SELECT page_id, {BARE} AS host FROM pages")
def nrm_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.host_of(F.col("url")).alias("host"))


@query("nrm_site_domain", f"""SELECT page_id, CASE WHEN array_to_string(list_slice(l, len(l) - 1, len(l)), '.') IN ({SUFFIXES}) THEN array_to_string(list_slice(l, len(l) - 2, len(l)), '.')
  ELSE array_to_string(list_slice(l, len(l) - 1, len(l)), '.') END AS site, replace(CASE WHEN array_to_string(list_slice(l, len(l) - 1, len(l)), '.') IN ({SUFFIXES}) THEN l[len(l) - 2] ELSE l[len(l) - 1] END, '-', '') AS stem
  FROM (SELECT page_id, string_split({BARE}, '.') AS l FROM pages)""")  # fmt: skip
def nrm_site_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.site_domain(F.col("url")).alias("site"), N.registrable_stem(F.col("url")).alias("stem"))


@query("nrm_platform_host", f"SELECT page_id, list_has_any(string_split({BARE}, '.'), [{PLATFORMS}]) AS is_platform FROM pages")
def nrm_platform_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.is_platform_host(F.col("url")).alias("is_platform"))


@query("nrm_canonical_url", r"""
WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
q AS (SELECT page_id, lower(regexp_extract(u, '^([a-zA-Z]+://[^/?]*)', 1)) AS head, regexp_replace(regexp_extract(u, '^[a-zA-Z]+://[^/?]*([^?]*)', 1), '/+$', '') AS path,
  array_to_string(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(string_split(x, '=')[1], '^(utm_[a-z_]+|gclid|fbclid|msclkid|mc_[a-z]+|ref|source)$', 'i')), '&') AS qs FROM p)
SELECT page_id, head || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN qs = '' THEN '' ELSE '?' || qs END AS canonical FROM q""")  # fmt: skip
def nrm_canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.canonical_url(F.col("url")).alias("canonical"))


@query("nrm_homepage", "SELECT page_id, regexp_extract(lower(url), '^(https?://[^/?#]+)', 1) AS homepage FROM pages")
def nrm_homepage(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.homepage_of(F.col("url")).alias("homepage"))


@query("nrm_slugify", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def nrm_slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.slugify(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


SUFFIX = "|".join(sorted(N.LEGAL_SUFFIXES, key=lambda s: (-len(s), s)))


@query("nrm_matching_key", f"""SELECT c_custkey, CASE WHEN bare = '' THEN spaced ELSE bare END AS key FROM (
  SELECT c_custkey, spaced, trim(regexp_replace(spaced, '(\\s+({SUFFIX}))+$', '')) AS bare FROM (
    SELECT c_custkey, trim(regexp_replace(lower(c_name || CASE c_custkey % 4 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ', Inc' WHEN 2 THEN ' GmbH & Co' ELSE '' END), '[^a-z0-9]+', ' ', 'g')) AS spaced FROM customer))""")  # fmt: skip
def nrm_matching_key(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    tail = F.when(F.col("c_custkey") % 4 == 0, " Pvt. Ltd.").when(F.col("c_custkey") % 4 == 1, ", Inc").when(F.col("c_custkey") % 4 == 2, " GmbH & Co").otherwise("")
    return c.select("c_custkey", N.matching_key(F.concat("c_name", tail)).alias("key"))


def of(values, key):
    """The value of a list that a key points at, as columns."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def sql_of(values, key):
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"[{', '.join(map(text, values))}][1 + ({key}) % {len(values)}]"


UNITS = ["", " District", " sub-district", ", Tehsil", "  municipal   corporation", " Taluka District", " Nagar Palika", " - urban agglomeration", " Blocks", " Mandal (East)"]
KEPT_UNITS = ["", "", "", "", "", "", "", "", " Blocks", " Mandal (East)"]


@query("nrm_city_lookup", f"SELECT c_custkey, coalesce({sql_of(['', 'Old ', None], 'c_custkey // 10')} || 'Town' || c_custkey || {sql_of(KEPT_UNITS, 'c_custkey')}, 'District') AS city FROM customer")
def nrm_city_lookup(spark, sf_dir):
    """Ten endings, eight of them administrative, on one or two words; a name that is only an ending stays (NRM8)."""
    k = F.col("c_custkey")
    name = F.concat(of(["", "Old ", None], F.floor(k / 10)), F.lit("Town"), k, of(UNITS, k))
    return table(spark, sf_dir, "customer").select("c_custkey", N.lookup_name(F.coalesce(F.concat(F.lit(" "), name, F.lit(" ")), F.lit("District"))).alias("city"))


@query("nrm_phone_e164", """
WITH p AS (SELECT o_orderkey, CAST(1000000000 + o_orderkey * 7919891 % 9000000000 AS VARCHAR) AS n, o_orderkey % 5 AS r FROM orders),
d AS (SELECT *, CASE r WHEN 3 THEN right(n, 8) ELSE n END AS own FROM p)
SELECT o_orderkey, CASE WHEN r = 0 AND regexp_matches(own, '^[1-9]') THEN '+91' || own WHEN r = 1 AND regexp_matches(own, '^[2-9]..[2-9]') THEN '+1' || own WHEN r = 2 AND regexp_matches(own, '^[1-9]') THEN '+44' || own
  WHEN r = 3 AND regexp_matches(own, '^[3689]') THEN '+65' || own END AS e164,
  CASE WHEN r = 0 THEN CASE WHEN regexp_matches(own, '^[6-9]') THEN 'mobile' ELSE 'fixed_line' END WHEN r = 1 AND regexp_matches(own, '^[2-9]..[2-9]') THEN 'fixed_line_or_mobile'
  WHEN r = 2 THEN CASE WHEN own LIKE '7%' THEN 'mobile' ELSE 'fixed_line' END WHEN r = 3 AND regexp_matches(own, '^[3689]') THEN CASE WHEN regexp_matches(own, '^[89]') THEN 'mobile' ELSE 'fixed_line' END END AS kind FROM d""")  # fmt: skip
def nrm_phone_e164(spark, sf_dir):
    """Numbers of every first digits in four regions' ways of writing, and of a region without rules (NRM2)."""
    k = F.col("o_orderkey")
    n = (F.lit(1_000_000_000) + k * 7919891 % 9_000_000_000).cast("string")
    part = lambda a, b: F.substring(n, a, b)
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit("0"), part(1, 5), F.lit("·"), part(6, 5))).when(k % 5 == 1, F.concat(F.lit("("), part(1, 3), F.lit(") "), part(4, 3), F.lit("-"), part(7, 4)))
        .when(k % 5 == 2, F.concat(F.lit("+44 "), part(1, 4), F.lit(" "), part(5, 6))).when(k % 5 == 3, F.concat(part(3, 4), F.lit(" "), part(7, 4))).otherwise(n)
    )
    e164 = N.phone_e164(raw, of(["in", "US", "FR", "SG", "XX"], k))
    return table(spark, sf_dir, "orders").select("o_orderkey", e164.alias("e164"), N.phone_type(e164).alias("kind"))


LOCALS = [("Info", True, True), ("a.b-c", True, False), ("user", False, False), ("x..y", False, False), ("No-Reply", True, True), ("ünï", False, False), ("o'neil", True, False), ("a b", False, False), ("bookings", True, True)]
DOMAINS = [("Clinic.CO.in", True), ("example.com", False), ("my.agency", True), ("sub.sentry.io", False), ("img@2x.png", False), ("museum", False), ("x-1.org.", True), ("a_b.com", False), ("hospital.dental", True), ("host.local", False)]


@query("nrm_email", f"""
WITH p AS (SELECT o_orderkey, {sql_of([x for x, _, _ in LOCALS], 'o_orderkey')} AS l, {sql_of([x for _, x, _ in LOCALS], 'o_orderkey')} AS l_ok, {sql_of([x for _, _, x in LOCALS], 'o_orderkey')} AS role, {sql_of([x for x, _ in DOMAINS], 'o_orderkey // 9')} AS d, {sql_of([x for _, x in DOMAINS], 'o_orderkey // 9')} AS d_ok FROM orders)
SELECT o_orderkey, CASE WHEN l_ok AND d_ok THEN lower(l || '@' || rtrim(d, '.')) END AS email, CASE WHEN l_ok AND d_ok THEN role END AS is_role FROM p""")  # fmt: skip
def nrm_email(spark, sf_dir):
    """Nine local parts before ten domains, each pair in brackets and spaces (NRM3, NRM7)."""
    k = F.col("o_orderkey")
    email = N.email(F.concat(F.lit(" <"), of([x for x, _, _ in LOCALS], k), F.lit("@"), of([x for x, _ in DOMAINS], F.floor(k / 9)), F.lit("> ")))
    return table(spark, sf_dir, "orders").select("o_orderkey", email.alias("email"), N.is_role_email(email).alias("is_role"))


@query("nrm_plausible", """
WITH p AS (SELECT p_partkey, substr('12345678901234567890', 1, p_partkey % 20) AS digits, p_partkey % 7 = 0 AS odd, p_partkey % 11 AS n FROM part)
SELECT p_partkey, length(digits) BETWEEN 7 AND 15 AND NOT odd AS phone, n NOT IN (1, 2, 4, 5) AS url FROM p""")
def nrm_plausible(spark, sf_dir):
    """Up to nineteen digits with separators, some with a letter; hosts, numbers and words as urls (FLT13, FLT14)."""
    k = F.col("p_partkey")
    phone = F.concat(F.lit("+("), F.expr("substr('12345678901234567890', 1, p_partkey % 20)"), F.when(k % 7 == 0, "a").otherwise(") - "))
    url = of(["https://p.test", "12.5", "no dots", "p.test/x", "https://nodot", "two words.in it", "HTTP://A.B", "a.b.c", "x.1", "http://1.2", "k.in"], k)
    return table(spark, sf_dir, "part").select("p_partkey", N.looks_like_phone(phone).alias("phone"), N.looks_like_url(url).alias("url"))


ROLE_PATHS = [("/Contact-Us/", "contact"), ("/x/our-team", "team"), ("/company/overview", "about"), ("/people-and-contact", "contact"), ("/servicesx", None), ("/what-we-do#top", "services"), ("/jobs?team=1", "careers"), ("/", None), ("/leadership/about.html", "about")]
ANCHORS = [(None, None), ("Reach us", None), ("Our  STAFF", "team"), ("vacancies", "careers"), ("", None)]


@query("nrm_page_role", f"SELECT page_id, coalesce({sql_of([r for _, r in ANCHORS], 'page_id')}, {sql_of([r for _, r in ROLE_PATHS], 'page_id // 5')}) AS role FROM pages")
def nrm_page_role(spark, sf_dir):
    """Nine paths under five anchors; the anchor decides where it says something (NRM14)."""
    k = F.col("page_id")
    url = F.concat(N.homepage_of(F.col("url")), of([x for x, _ in ROLE_PATHS], F.floor(k / 5)))
    return table(spark, sf_dir, "pages").select("page_id", TX.page_role(url, of([x for x, _ in ANCHORS], k)).alias("role"))


@query("flt_crawlable", f"SELECT page_id, NOT (regexp_matches(path, '\\.(pdf|html|css)$') AND path LIKE '%.pdf') AND NOT regexp_matches(path, '(^|/)(tag|page)(/|$)') AS crawlable FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || CASE page_id % 3 WHEN 0 THEN '/a.pdf' WHEN 1 THEN '/tag/x' ELSE '' END AS path FROM pages)")
def flt_crawlable(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    bare = F.regexp_extract("url", "^([^?#]*)", 1)
    url = F.concat(bare, F.when(F.col("page_id") % 3 == 0, "/a.pdf").when(F.col("page_id") % 3 == 1, "/tag/x").otherwise(""))
    return p.select("page_id", TX.is_crawlable(url, F.col("url")).alias("crawlable"))


@query("geo_tile_grid", """
WITH b AS (SELECT r_regionkey, 10.0 + r_regionkey AS min_lat, 70.0 AS min_lon, 10.0 + r_regionkey + 0.3 * (r_regionkey + 1) AS max_lat, 70.0 + 0.5 AS max_lon FROM region),
n AS (SELECT *, greatest(1, ceil((max_lat - min_lat) * 111.32 / 15))::INT AS nr, greatest(1, ceil((max_lon - min_lon) * 111.32 * cos(radians((min_lat + max_lat) / 2)) / 15))::INT AS nc FROM b)
SELECT r_regionkey, CAST(r AS INT) AS "row", CAST(c AS INT) AS "column", round(min_lat + r * ((max_lat - min_lat) / nr), 6) AS t_min_lat, round(min_lon + c * ((max_lon - min_lon) / nc), 6) AS t_min_lon
FROM n, unnest(range(nr)) AS u(r), unnest(range(nc)) AS v(c)""")  # fmt: skip
def geo_tile_grid(spark, sf_dir):
    k = F.col("r_regionkey")
    boxes = table(spark, sf_dir, "region").select("r_regionkey", (k + 10.0).alias("min_lat"), F.lit(70.0).alias("min_lon"), (k + 10.0 + (k + 1) * 0.3).alias("max_lat"), F.lit(70.5).alias("max_lon"))
    return geo.tile_grid(boxes).select("r_regionkey", "row", "column", F.round("t_min_lat", 6).alias("t_min_lat"), F.round("t_min_lon", 6).alias("t_min_lon"))


@query("geo_quarters", "SELECT n_nationkey, CAST(q AS INT) AS q FROM nation, unnest(CASE WHEN n_nationkey % 2 = 0 THEN [0, 1, 2, 3] ELSE [0] END) AS u(q)")
def geo_quarters(spark, sf_dir):
    k = F.col("n_nationkey")
    side = F.when(k % 2 == 0, 0.5).otherwise(0.015)
    boxes = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(1.0).alias("min_lat"), F.lit(2.0).alias("min_lon"), (F.lit(1.0) + side).alias("max_lat"), (F.lit(2.0) + side).alias("max_lon"))
    q = geo.quarters(boxes)
    return q.select("n_nationkey", ((F.col("min_lat") > 1.0).cast("int") * 2 + (F.col("min_lon") > 2.0).cast("int")).alias("q"))


@query("geo_radius_and_distance", """
WITH p AS (SELECT c_custkey, c_custkey % 121 - 60.0 AS lat, c_custkey * 7 % 360 - 180.0 AS lon, 1.0 + c_custkey % 50 AS km FROM customer)
SELECT c_custkey, round(km / 111.32, 9) AS d_lat, round(km / (111.32 * cos(radians(lat))), 9) AS d_lon,
  round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(1.5) / 2), 2) + cos(radians(lat)) * cos(radians(lat + 1.5)) * pow(sin(radians(-2.5) / 2), 2))), 6) AS km FROM p""")  # fmt: skip
def geo_radius_and_distance(spark, sf_dir):
    """Boxes and distances at every latitude up to sixty degrees (GEO4, GEO5)."""
    k = F.col("c_custkey")
    lat, lon, km = k % 121 - 60.0, k * 7 % 360 - 180.0, k % 50 + 1.0
    box = geo.radius_box(lat, lon, km)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(box["max_lat"] - lat, 9).alias("d_lat"), F.round(box["max_lon"] - lon, 9).alias("d_lon"), F.round(geo.haversine_km(lat, lon, lat + 1.5, lon - 2.5), 6).alias("km"))


@query("nrm_find_area", "SELECT n_name AS name, n_nationkey FROM nation")
def nrm_find_area(spark, sf_dir):
    """Names with suffixes find their area by slug; a state of the same name loses against the city."""
    n = table(spark, sf_dir, "nation")
    city = n.select(F.lit("XX").alias("country"), F.format_string("c-%d", "n_nationkey").alias("slug"), F.lit("city").alias("kind"), F.lit(5).alias("population"), F.col("n_name").alias("name"), F.array(F.col("n_name")).alias("aliases"))
    state = city.withColumns({"slug": F.regexp_replace("slug", "c-", "s-"), "kind": F.lit("state"), "population": F.lit(99)})
    names = n.select(F.concat("n_name", F.lit(" District")).alias("name"), F.lit("XX").alias("country"))
    found = places.find_areas(names, city.unionByName(state))
    return found.select(F.regexp_replace("name", " District$", "").alias("name"), F.regexp_extract("slug", r"c-(\d+)", 1).cast("int").alias("n_nationkey"))


@query("src_json_round_trip", f"SELECT CAST(id AS VARCHAR) AS external_id, name, lat, phone FROM ({PART})")
def src_json_round_trip(spark, sf_dir):
    rows = part_places(spark, sf_dir).withColumn("external_id", F.col("id").cast("string"))
    return places.from_json(places.as_json(rows)).select("external_id", "name", "lat", "phone")


@query("src_record_by_id", f"SELECT id, name FROM ({PART}) WHERE id = 77")
def src_record_by_id(spark, sf_dir):
    return places.by_id(part_places(spark, sf_dir).withColumn("external_id", F.col("id").cast("string")), "part", "77").select("id", "name")


@query("flt_own_site", f"SELECT page_id, len(string_split({BARE}, '.')) = 2 AND {BARE} <> 'example.org' AS own FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'http://own' || page_id || '.com/' WHEN 1 THEN 'https://www.example.org' ELSE url END AS url FROM pages)")
def flt_own_site(spark, sf_dir):
    k = F.col("page_id")
    url = F.when(k % 3 == 0, F.concat(F.lit("http://own"), k, F.lit(".com/"))).when(k % 3 == 1, "https://www.example.org").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", TX.is_own_site(url, ["example"]).alias("own"))


PIECES = [("&#64;", "@"), ("%2E", "."), ("\u2013", "-"), ("&amp;", "&"), ("&nbsp;", " "), ("%40", "@"), ("&period;", "."), ("&lt", "&lt"), ("%41", "%41"), ("\u2015", "-"), ("%20", " "), ("x", "x")]


@query("nrm_decode_entities", f"SELECT o_orderkey, 'a' || {sql_of([x for _, x in PIECES], 'o_orderkey')} || o_orderkey || {sql_of([x for _, x in PIECES], 'o_orderkey // 12')} AS plain FROM orders")
def nrm_decode_entities(spark, sf_dir):
    """Every pair of twelve pieces, two of which stay as they are (NRM16)."""
    k = F.col("o_orderkey")
    raw = F.concat(F.lit("a"), of([x for x, _ in PIECES], k), k, of([x for x, _ in PIECES], F.floor(k / 12)))
    return table(spark, sf_dir, "orders").select("o_orderkey", TX.decode_entities(raw).alias("plain"))


def geography(spark, sf_dir):
    """Nations as cities with an alias, and regions as states; some nations are also states of the same name."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    area = lambda df, slug, kind, people, name, alias: df.select(F.lit("IN").alias("country"), slug.alias("slug"), F.lit(kind).alias("kind"), people.alias("population"), name.alias("name"), F.array(alias).alias("aliases"))
    k, name = F.col("n_nationkey"), F.col("n_name")
    city = area(n, F.lower(name), "city", k, name, F.concat(F.lit("Old Town "), k))
    twin = area(n.where("n_nationkey % 4 = 0"), F.concat(F.lit("s-"), F.lower(name)), "state", k + 1000, name, F.concat(F.lit("S"), k))
    state = area(r, F.lower(F.col("r_name")), "state", F.col("r_regionkey"), F.col("r_name"), F.concat(F.lit("R"), F.col("r_regionkey")))
    return city.unionByName(twin).unionByName(state)


@query("nrm_canonical_city", """
WITH c AS (SELECT o_orderkey, o_custkey % 30 AS k, o_orderkey % 4 AS form FROM orders)
SELECT o_orderkey, CASE WHEN form = 3 THEN NULL WHEN k < 25 THEN n_name ELSE CASE WHEN form = 1 THEN 'Old Town ' || k ELSE 'NATION_' || k END END AS city FROM c LEFT JOIN nation ON n_nationkey = k""")
def nrm_canonical_city(spark, sf_dir):
    """Names, aliases and names with a suffix become the area's; unknown ones lose the suffix only (NRM9)."""
    k, form = F.col("o_custkey") % 30, F.col("o_orderkey") % 4
    city = F.when(form == 0, F.concat(F.lit("nation_"), k)).when(form == 1, F.concat(F.lit("Old Town "), k)).when(form == 2, F.concat(F.lit("NATION_"), k, F.lit(" Sub-District")))
    city = F.when((form == 0) & (k >= 25), F.concat(F.lit("NATION_"), k)).otherwise(city)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", city.alias("city"), F.lit("IN").alias("country"))
    return places.canonical_cities(rows, geography(spark, sf_dir)).select("o_orderkey", "city")


@query("ups_project_state", """
WITH c AS (SELECT c_custkey, c_custkey % 7 AS k, c_custkey % 3 AS form FROM customer)
SELECT c_custkey AS entity_id, CASE WHEN form = 2 THEN n_name ELSE r_name END AS state FROM c LEFT JOIN region ON r_regionkey = k LEFT JOIN nation ON n_nationkey = k WHERE (form < 2 AND k < 5) OR (form = 2 AND k % 4 = 0)""")
def ups_project_state(spark, sf_dir):
    """States by name or alias; a city's name that is no state's is left out (UPS9)."""
    k, form = F.col("c_custkey") % 7, F.col("c_custkey") % 3
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), "r_name")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), k.alias("k"), form.alias("form")).join(r, "k", "left")
    state = F.when(F.col("form") == 0, F.upper("r_name")).when(F.col("form") == 1, F.concat(F.lit("r"), "k")).otherwise(F.concat(F.lit("NATION_"), "k"))
    return places.project_states(c.select("entity_id", F.coalesce(state, F.lit(" ")).alias("state"), F.lit("IN").alias("country")), geography(spark, sf_dir))


@query("src_seed_areas", """
WITH h AS (SELECT c_custkey, c_custkey % 3 AS t, c_custkey % 2 = 0 AS city, c_custkey % 4 * 0.6 AS span, c_custkey % 7 * 1000000 AS people, c_custkey % 50.0 AS lat, 70.0 + c_custkey % 10 AS lon FROM customer),
b AS (SELECT *, t > 0 AND (NOT city OR span <= 1.5) AS boundary, CASE WHEN people >= 5000000 THEN 25 WHEN people >= 1000000 THEN 15 ELSE 10 END AS km FROM h)
SELECT 'Place ' || c_custkey AS name, 'place-' || c_custkey AS slug, round(CASE WHEN boundary THEN lat ELSE lat - km / 111.32 END, 6) AS min_lat, round(CASE WHEN boundary THEN lon + span ELSE lon + km / (111.32 * cos(radians(lat))) END, 6) AS max_lon,
  CASE WHEN boundary THEN 'boundary' ELSE 'radius' END AS bbox_source, CASE WHEN people > 0 THEN people END::BIGINT AS population FROM b""")  # fmt: skip
def src_seed_areas(spark, sf_dir):
    """Geocoder answers to areas: boundaries, too wide ones and points, with and without population (SRC21)."""
    k = F.col("c_custkey")
    lat, lon, span = k % F.lit(50.0), k % 10 + F.lit(70.0), k % 4 * F.lit(0.6)
    hits = table(spark, sf_dir, "customer").select(
        F.when(k % 2 == 0, "city").otherwise("state").alias("kind"), F.concat(F.lit("Place "), k).alias("name"), of(["node", "way", "relation"], k).alias("osm_type"), lat.alias("lat"), lon.alias("lon"),
        F.array(lat, lat + span, lon, lon + span).alias("box"), F.format_number(k % 7 * 1_000_000, 0).alias("population"),
    )
    return places.seed_areas(hits).select("name", "slug", "min_lat", "max_lon", "bbox_source", "population")


@query("src_prune_absent", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 2")
def src_prune_absent(spark, sf_dir):
    """Rows that the seed no longer names go (SRC20)."""
    n = table(spark, sf_dir, "nation")
    return places.prune_absent(n.withColumn("slug", F.lower("n_name")), n.where("n_regionkey <> 2").select(F.lower("n_name").alias("slug"))).select("n_nationkey")
