"""Place sources: bulk releases and map elements to places, places to candidates, and the searchable index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import geo
from tessera.functions import normalize as N

# Fixed values -----------------------------------------------------------------------------------------------

#: Release categories that are machines or infrastructure.
NOT_A_BUSINESS = ["atm", "bench", "bus_stop", "charging_station", "fuel_station_atm", "parking", "parking_lot", "post_box", "toilet", "vending_machine"]
CLOSED_STATUSES = ["closed", "closed_permanently"]
#: Map keys that make an element a candidate, in order; the first four are taken with any value.
PRIMARY_KEYS = ["shop", "office", "craft", "healthcare", "amenity", "leisure", "tourism"]
DENIED_VALUES = {
    "amenity": [
        "atm", "bench", "bicycle_parking", "bicycle_repair_station", "bus_station", "charging_station", "clock",
        "drinking_water", "fountain", "grave_yard", "hunting_stand", "parking", "parking_entrance", "parking_space",
        "public_bookcase", "recycling", "shelter", "telephone", "toilets", "vending_machine", "waste_basket",
        "waste_disposal", "waste_transfer_station", "water_point",
    ],
    "leisure": [
        "common", "dog_park", "firepit", "garden", "nature_reserve", "park", "picnic_table", "pitch", "playground",
        "slipway", "swimming_area", "track",
    ],
    "tourism": ["artwork", "attraction", "information", "picnic_site", "viewpoint"],
}
NAME_TAGS = ["name", "name:en", "int_name", "brand"]
PHONE_TAGS = ["phone", "contact:phone", "contact:mobile", "mobile"]
WEBSITE_TAGS = ["website", "contact:website", "url"]
EMAIL_TAGS = ["email", "contact:email"]
CITY_TAGS = ["addr:city", "addr:town", "addr:village"]
#: Confidence of a bulk place's values; categories are less sure.
VALUE_CONFIDENCE, CATEGORY_CONFIDENCE = 0.85, 0.7

PLACE_COLUMNS = [
    "source", "external_id", "name", "category", "categories", "lat", "lon", "phone", "website", "email", "socials",
    "street", "city", "postcode", "region", "country", "confidence", "operating_status",
]


def first_present(values: Column) -> Column:
    """The first element that says something, trimmed."""
    return F.get(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))


def is_business(categories: Column, status: Column) -> Column:
    """Whether no level of the category is infrastructure and the place is not closed. Survey: FLT10."""
    denied = F.arrays_overlap(categories, F.array(*map(F.lit, NOT_A_BUSINESS)))
    return (F.size(categories) > 0) & ~F.coalesce(denied, F.lit(False)) & ~F.coalesce(F.lower(status).isin(CLOSED_STATUSES), F.lit(False))


def scan_release(release: DataFrame, box: tuple[float, float, float, float], min_confidence: float = 0.0) -> DataFrame:
    """Named rows whose box's lower corner lies in ``box``, sure enough: filters on nested numbers reach the scan. Survey: SRC1."""
    near = F.col("bbox.ymin").between(box[0], box[2]) & F.col("bbox.xmin").between(box[1], box[3])
    return release.where(near & F.col("names.primary").isNotNull() & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence))


def release_places(rows: DataFrame, source: str) -> DataFrame:
    """Rows of a bulk release as places; implausible contacts become null, other refusals are left to the caller. Survey: SRC2."""
    leaf = F.coalesce("taxonomy.primary", "basic_category")
    levels = F.array_distinct(F.filter("taxonomy.hierarchy", lambda x: x.isNotNull() & (x != "")))
    categories = F.when(F.size(levels) > 0, levels).otherwise(F.array_compact(F.array(leaf)))
    phone, email, site = first_present(F.col("phones")), first_present(F.col("emails")), first_present(F.col("websites"))
    address = F.get(F.col("addresses"), F.lit(0))
    return rows.select(
        F.lit(source).alias("source"), F.col("id").alias("external_id"), F.col("names.primary").alias("name"), leaf.alias("category"), categories.alias("categories"),
        ((F.col("bbox.ymin") + F.col("bbox.ymax")) / 2).alias("lat"), ((F.col("bbox.xmin") + F.col("bbox.xmax")) / 2).alias("lon"),
        F.when(N.looks_like_phone(phone), phone).alias("phone"), F.when(N.looks_like_url(site), site).alias("website"), F.when(N.looks_like_email(email), email).alias("email"),
        F.coalesce("socials", F.array().cast("array<string>")).alias("socials"), address["freeform"].alias("street"), address["locality"].alias("city"),
        address["postcode"].alias("postcode"), address["region"].alias("region"), address["country"].alias("country"), "confidence", "operating_status",
    )


def refusal_report(rows: DataFrame, places: DataFrame) -> DataFrame:
    """One row of counts: read, not a business, implausible contacts, and contacts kept. Survey: SRC3."""
    raw = rows.agg(F.count("*").alias("rows_read"), *(F.count(first_present(F.col(c))).alias(f"given_{c}") for c in ("phones", "emails", "websites")))
    kept = places.agg(F.count_if(~is_business(F.col("categories"), F.col("operating_status"))).alias("not_a_business"), *(F.count(c).alias(f"with_{c}") for c in ("phone", "email", "website")))
    one = raw.crossJoin(kept)  # two single rows
    return one.select("rows_read", "not_a_business", *((F.col(f"given_{a}") - F.col(f"with_{b}")).alias(f"bad_{b}") for a, b in (("phones", "phone"), ("emails", "email"), ("websites", "website"))), "with_phone", "with_email", "with_website")


def category_counts(rows: DataFrame, categories: str = "categories") -> DataFrame:
    """(category, n) over all levels, commonest first. Survey: SRC4."""
    return rows.select(F.explode(categories).alias("category")).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def release_date(release: Column) -> Column:
    """Survey: SRC5."""
    return F.try_to_date(F.substring_index(release, ".", 1), "yyyy-MM-dd")


def tag(tags: Column, names: list[str]) -> Column:
    """The first of several tags that says something. Survey: FLT12."""
    return F.coalesce(*(F.nullif(F.trim(F.element_at(tags, n)), F.lit("")) for n in names))


def element_category(tags: Column) -> Column:
    """``key=value`` of the first primary key present; null if that value is denied. Survey: FLT11."""
    out = F.lit(None).cast("string")
    for key in reversed(PRIMARY_KEYS):
        value = F.element_at(tags, key)
        denied = value.isin(DENIED_VALUES[key]) if key in DENIED_VALUES else F.lit(False)
        out = F.when(F.coalesce(value, F.lit("")) != "", F.when(~denied, F.concat(F.lit(f"{key}="), value))).otherwise(out)
    return out


def centroid(nodes: Column) -> Column:
    """Mean (lat, lon) of a way's valid nodes, its closing repeat left out; null without one. Survey: SRC7."""
    last = F.size(nodes)
    closed = (last > 1) & (F.element_at(nodes, 1)["ref"] == F.element_at(nodes, -1)["ref"])
    own = F.filter(F.when(closed, F.slice(nodes, F.lit(1), last - 1)).otherwise(nodes), lambda n: n["valid"])
    mean = lambda f: F.aggregate(own, F.lit(0.0), lambda s, n: s + n[f]) / F.size(own)
    return F.when(F.size(own) > 0, F.struct(mean("lat").alias("lat"), mean("lon").alias("lon")))


def element_places(elements: DataFrame) -> DataFrame:
    """Named nodes and ways of a business category as places; relations are skipped. Survey: SRC6, SRC8."""
    tags = F.col("tags")
    at = F.when(F.col("osm_type") == "n", F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon"))).otherwise(centroid(F.col("nodes")))
    out = elements.where(F.col("osm_type").isin("n", "w")).withColumn("at", at).withColumn("name", tag(tags, NAME_TAGS)).withColumn("category", element_category(tags))
    out = out.where(F.col("name").isNotNull() & F.col("category").isNotNull() & F.col("at").isNotNull())
    return out.select(
        F.lit("osm").alias("source"), F.concat("osm_type", "osm_id").alias("external_id"), "name", "category", F.array("category").alias("categories"), "at.lat", "at.lon",
        tag(tags, PHONE_TAGS).alias("phone"), tag(tags, WEBSITE_TAGS).alias("website"), tag(tags, EMAIL_TAGS).alias("email"), F.array().cast("array<string>").alias("socials"),
        tag(tags, ["addr:street"]).alias("street"), tag(tags, CITY_TAGS).alias("city"), tag(tags, ["addr:postcode"]).alias("postcode"),
        F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("country"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("operating_status"),
        F.when(F.year("timestamp") > 1970, F.col("timestamp")).alias("updated_at"),
    )


# The index --------------------------------------------------------------------------------------------------


def build_index(places: DataFrame, path: str) -> None:
    """Writes places laid out by tile: the first of each (source, external_id), range-partitioned and sorted.

    ``ordinal`` orders the input. A box search then reads the row groups of its tiles only.

    Survey: SNK1.
    """
    rank = F.row_number().over(W.partitionBy("source", "external_id").orderBy("ordinal"))
    rows = places.withColumn("_rank", rank).where("_rank = 1").drop("_rank").withColumn("tile", geo.tile_of(F.col("lat"), F.col("lon")))
    rows.repartitionByRange("tile").sortWithinPartitions("tile", "id").write.mode("errorifexists").parquet(path)


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search(
    index: DataFrame, box=None, categories=None, source=None, name=None, contactable=None, has_website=None, any_of=None, tiles: bool = True
) -> DataFrame:
    """Places that meet every filter given. Contact channels that an index does not hold narrow nothing. Survey: SRC11, FLT1, FLT2, FLT3, FLT4, FLT5, FLT6, FLT7, FLT8, FLT9, JN1, JN2."""
    df = index
    if box:
        if tiles and "tile" in df.columns:
            df = df.where(geo.in_tiles(F.col("tile"), box))
        df = df.where(geo.in_box(F.col("lat"), F.col("lon"), box))
    if categories:
        df = df.where(F.arrays_overlap("categories", F.array(*map(F.lit, categories))))
    if source:
        df = df.where(F.col("source") == source)
    if name:
        df = df.where(F.expr("name ILIKE concat('%', :n, '%') ESCAPE '\\\\'".replace(":n", "'" + escape_like(name).replace("\\", "\\\\").replace("'", "\\'") + "'")))
    if contactable:
        df = df.where(F.col("phone").isNotNull() | F.col("email").isNotNull())
    if has_website is not None:
        df = df.where(F.col("website").isNotNull() if has_website else F.col("website").isNull())
    known = [c for c in (any_of or []) if c in ("phone", "email")]
    if known:
        either = F.lit(False)
        for c in known:
            either = either | F.col(c).isNotNull()
        df = df.where(either)
    return df


PLACE_SCHEMA = """source string, external_id string, name string, category string, categories array<string>, lat double, lon double,
 phone string, website string, email string, socials array<string>, street string, city string, postcode string, region string, country string,
 confidence double, operating_status string"""


def by_id(index: DataFrame, source: str, external_id: str) -> DataFrame:
    """Survey: SRC12."""
    return index.where((F.col("source") == source) & (F.col("external_id") == external_id))


def as_json(places: DataFrame) -> DataFrame:
    """(source, external_id, raw): each place as one JSON record."""
    present = [c for c in PLACE_COLUMNS if c in places.columns]
    return places.select("source", "external_id", F.to_json(F.struct(*present)).alias("raw"))


def from_json(records: DataFrame) -> DataFrame:
    """Places of JSON records by the declared schema; what does not fit a column's type is null."""
    return records.select(F.from_json("raw", PLACE_SCHEMA, {"mode": "PERMISSIVE"}).alias("p")).select("p.*")


def health(index: DataFrame) -> DataFrame:
    """State of an index: missing rows make it empty. Survey: SRC13."""
    return index.agg(F.count("*").alias("places"), F.max("updated_at").alias("data_until")).withColumn("state", F.when(F.col("places") == 0, "empty").otherwise("ok"))


# Candidates -------------------------------------------------------------------------------------------------


def observations(places: DataFrame, observed_at: Column) -> DataFrame:
    """(source, external_id, field, value, confidence, observed_at): places unpivoted; without a time, nothing. Survey: SRC15, SRC16, UPS4."""
    named = {"name": "name", "phone": "phone", "email": "email", "website": "website", "city": "city", "state": "region", "postal_code": "postcode", "country": "country", "address": "street", "category": "category"}
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("value"), F.lit(CATEGORY_CONFIDENCE if f == "category" else VALUE_CONFIDENCE).alias("confidence")) for f, c in named.items()))
    rows = places.withColumn("observed_at", observed_at).where(F.col("observed_at").isNotNull())
    return rows.select("source", "external_id", F.inline(cells), "observed_at").where(F.coalesce("value", F.lit("")) != "")


def narrow(candidates: DataFrame, has_website=None, contact_any_of=None, social_all_of=None) -> DataFrame:
    """Candidates (url, phone, values array of field and value) that meet the request's filters. Survey: FLT15."""
    has = lambda field: F.exists("values", lambda v: (v["field"] == field) & (F.coalesce(v["value"], F.lit("")) != ""))
    df = candidates
    if has_website is not None:
        present = F.col("url").isNotNull() | has("website")
        df = df.where(present if has_website else ~present)
    checkable = [c for c in (contact_any_of or []) if c in ("phone", "email")]
    if checkable:
        either = F.lit(False)
        for c in checkable:
            either = either | (F.col("phone").isNotNull() if c == "phone" else F.lit(False)) | has(c)
        df = df.where(either)
    for platform in social_all_of or []:
        df = df.where(has(platform))
    return df


def search_results(results: DataFrame, listings: DataFrame) -> DataFrame:
    """One candidate for each host of a result page that is no directory (``listings``: host), at its best position. Survey: SRC17."""
    rows = results.withColumn("host", N.host_of(F.col("link"))).where(F.col("host") != "").join(listings.select("host").distinct(), "host", "left_anti")
    return rows.groupBy("query", "host").agg(F.min_by("link", "position").alias("link"), F.min("position").alias("position")).withColumn("name", F.col("host"))


# Sources and areas ------------------------------------------------------------------------------------------


def providing(sources: DataFrame, field: str, production: bool = True) -> DataFrame:
    """Enabled sources that can fill a field, cheapest first; in production red ones need legal approval. Survey: SRC18."""
    df = sources.where(F.col("enabled") & F.array_contains("fields_provided", field))
    if production:
        df = df.where((F.col("tos_class") != "red") | F.col("legal_approved"))
    return df.orderBy("cost_micros", "key")


def find_areas(names: DataFrame, areas: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(name, country, slug, kind, area): each name's area by slug, name or alias, cities first, then the most people.

    ``area`` is the area's own name; ``kinds`` narrows the areas, to states for example. Names of no area are left out.

    Survey: JN19, NRM11, PLN2.
    """
    if kinds:
        areas = areas.where(F.col("kind").isin(kinds))
    spelled = areas.select("country", "slug", "kind", "population", F.col("name").alias("area"), F.explode(F.array_distinct(F.concat(F.array("slug", N.slugify(F.col("name"))), F.transform("aliases", N.slugify)))).alias("_slug"))
    joined = names.withColumn("_slug", N.slugify(N.lookup_name(F.col("name")))).join(spelled, ["country", "_slug"])
    best = F.max_by(F.struct("slug", "kind", "area"), F.struct((F.col("kind") == "city").cast("int"), F.coalesce("population", F.lit(0)), "slug"))
    return joined.groupBy("name", "country").agg(best.alias("a")).select("name", "country", "a.slug", "a.kind", "a.area")


def canonical_cities(candidates: DataFrame, areas: DataFrame) -> DataFrame:
    """``candidates`` (city, country) with each city as the areas spell it, else without administrative suffixes (NRM9).

    Only distinct spellings meet the areas. Candidates without a city keep none.
    """
    wanted = candidates.where(F.col("city").isNotNull()).select(F.col("city").alias("name"), "country").distinct()
    found = find_areas(wanted, areas).where("kind = 'city'").select(F.col("name").alias("city"), "country", F.col("area").alias("_area"))
    joined = candidates.join(found, ["city", "country"], "left")
    return joined.withColumn("city", F.coalesce("_area", N.lookup_name(F.col("city")))).select(*candidates.columns)


def project_states(best: DataFrame, areas: DataFrame) -> DataFrame:
    """(entity_id, state) of (entity_id, state, country): the states that the areas know, by their own name (UPS9)."""
    wanted = best.where(F.trim("state") != "").select(F.col("state").alias("name"), "country").distinct()
    found = find_areas(wanted, areas, ["state"]).select(F.col("name").alias("state"), "country", "area")
    return best.join(found, ["state", "country"]).select("entity_id", F.col("area").alias("state"))


def prune_absent(rows: DataFrame, seed: DataFrame, key: str = "slug") -> DataFrame:
    """The rows that the seed still has (SRC20)."""
    return rows.join(seed.select(key).distinct(), key, "left_semi")


#: The radius in km that stands in for a boundary, by population, and how wide a city's boundary may be.
RADII, LEAST_RADIUS, MAX_CITY_SPAN = [(5_000_000, 25), (1_000_000, 15)], 10, 1.5


def seed_areas(hits: DataFrame) -> DataFrame:
    """(name, slug, min_lat, min_lon, max_lat, max_lon, bbox_source, population) of geocoder answers (SRC21).

    ``hits``: kind, name, osm_type, lat, lon, box (south, north, west, east), population as printed. A city's boundary
    wider than MAX_CITY_SPAN, and a point, become a box around the point, by population.
    """
    people = F.nullif(F.regexp_replace("population", "[^0-9]", ""), F.lit("")).try_cast("long")
    people = F.when(people > 0, people)
    km = F.lit(LEAST_RADIUS)
    for least, radius in reversed(RADII):
        km = F.when(people >= least, radius).otherwise(km)
    south, north, west, east = (F.col("box")[i] for i in range(4))
    boundary = (F.col("osm_type") != "node") & ((F.col("kind") != "city") | (F.greatest(north - south, east - west) <= MAX_CITY_SPAN))
    around = geo.radius_box(F.col("lat"), F.col("lon"), km.cast("double"))
    box = F.when(boundary, F.struct(south.alias("min_lat"), west.alias("min_lon"), north.alias("max_lat"), east.alias("max_lon"))).otherwise(around)
    rounded = [F.round(F.col(f"b.{c}"), 6).alias(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")]
    rows = hits.select("name", N.slugify(F.col("name")).alias("slug"), box.alias("b"), F.when(boundary, "boundary").otherwise("radius").alias("bbox_source"), people.alias("population"))
    return rows.select("name", "slug", *rounded, "bbox_source", "population")


def link_parents(rows: DataFrame, parent_slug: str = "parent_slug") -> DataFrame:
    """Adds parent_id by looking each row's parent slug up in the same table. Survey: SRC20, JN18."""
    parents = rows.select(F.col("slug").alias(parent_slug), F.col("id").alias("parent_id"))
    return rows.join(parents, parent_slug, "left")


def load(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table in any file format that Spark reads; text formats need a schema, nothing is inferred. Survey: SRC10, SRC19."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)
