"""Requests to plans: checked specs, feasibility of their filters, and discovery tasks as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators import ranking
from tessera.sources import places

SPEC = """intent string, country string, cities array<string>, states array<string>, industries array<string>, has_website boolean,
          contact_any_of array<string>, social array<string>, employees_gte long, employees_lte long, min_confidence double,
          fields array<string>, keywords_must array<string>, depth string, max_results long, max_credits long"""

#: How a filter is met, in the order in which filters are reported.
FILTER_MODES = [
    ("industry", "directly_searchable"), ("location", "directly_searchable"), ("has_website", "post_filter"), ("contact", "post_filter"),
    ("min_confidence", "unsupported"), ("employee_count", "unsupported"), ("rating", "unsupported"), ("social", "post_filter"),
    ("technologies", "unsupported"), ("funding", "unsupported"), ("hiring", "unsupported"),
]
DEPTHS = ["quick", "standard", "deep"]
MAX_RESULTS = 2_000
PROBLEMS = "array<string>"


def parse_specs(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON requests by a declared schema, with defaults and the problems that make one invalid.

    Swapped employee bounds are put right, depth defaults to standard, the result cap to MAX_RESULTS.

    Survey: JSN3, JSN4.
    """
    spec = F.from_json(column, SPEC, {"mode": "PERMISSIVE"})
    df = lines.withColumn("spec", spec).select(*lines.columns, "spec.*")
    low, high = F.least("employees_gte", "employees_lte"), F.greatest("employees_gte", "employees_lte")
    both = F.col("employees_gte").isNotNull() & F.col("employees_lte").isNotNull()
    df = df.withColumns({"employees_gte": F.when(both, low).otherwise(F.col("employees_gte")), "employees_lte": F.when(both, high).otherwise(F.col("employees_lte"))})
    df = df.withColumn("depth", F.coalesce("depth", F.lit("standard"))).withColumn("max_results", F.least(F.coalesce("max_results", F.lit(MAX_RESULTS)), F.lit(MAX_RESULTS)))
    checks = {
        "not an object": F.col("intent").isNull(),
        "country": F.col("country").isNotNull() & ~F.regexp_like("country", F.lit("^[A-Z]{2}$")),
        "depth": ~F.col("depth").isin(DEPTHS),
        "max_results": F.col("max_results") < 1,
        "min_confidence": F.col("min_confidence").isNotNull() & ~F.col("min_confidence").between(0, 1),
    }
    return df.withColumn("problems", F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()))))


def feasibility(specs: DataFrame) -> DataFrame:
    """(id, ordinal, filter, mode) of the filters that each request uses. Survey: FLT16."""
    used = {
        "industry": F.size("industries") > 0, "location": F.col("country").isNotNull() | (F.size("cities") > 0) | (F.size("states") > 0), "has_website": F.col("has_website").isNotNull(),
        "contact": F.size("contact_any_of") > 0, "min_confidence": F.col("min_confidence").isNotNull(), "social": F.size("social") > 0,
        "employee_count": F.col("employees_gte").isNotNull() | F.col("employees_lte").isNotNull(),
    }
    rows = F.array(*(F.when(F.coalesce(used[name], F.lit(False)), F.struct(F.lit(i).alias("ordinal"), F.lit(f"filters.{name}").alias("filter"), F.lit(mode).alias("mode"))) for i, (name, mode) in enumerate(FILTER_MODES) if name in used))
    return specs.select("id", F.inline(F.array_compact(rows)))


def searches(specs: DataFrame, areas: DataFrame, queries: DataFrame, localities: DataFrame, cap: Column) -> DataFrame:
    """(id, at, area, query, locality): areas times queries, then cities times their localities, up to the cap.

    ``areas`` and ``queries`` carry the request's id and a position; ``localities`` an area's slug.

    Survey: PLN3.
    """
    order = lambda round_, local: F.struct(round_.alias("round"), "area_pos", "query_pos", local.alias("local")).alias("order")
    wide = areas.join(queries, "id").select("id", "area", "query", F.lit(None).cast("string").alias("locality"), order(F.lit(0), F.lit(0)))
    first = queries.where("query_pos = 0")
    near = areas.where("is_city").join(localities, "area").join(first, "id").select("id", "area", "query", "locality", order(F.lit(1), F.col("locality_pos")))
    at = F.row_number().over(W.partitionBy("id").orderBy("order"))
    return wide.unionByName(near).withColumn("at", at).join(specs.select("id", cap.alias("_cap")), "id").where(F.col("at") <= F.col("_cap")).select("id", "at", "area", "query", "locality")


def funded_tasks(rows: DataFrame, specs: DataFrame, share: float, floor: int) -> DataFrame:
    """Tasks with a credit budget: the searches that the share of the credits can pay at the floor, split evenly. Survey: PLN1, PLN4, PLN5."""
    pot = F.floor(F.greatest("max_credits", F.lit(0)) * min(share, 1.0)).cast("long")
    joined = rows.join(specs.select("id", pot.alias("pot")), "id").where(F.col("at") <= F.floor(F.col("pot") / floor))
    out = ranking.split_budget(joined, ["at"], F.col("pot"), ["id"]).where(F.col("share") >= floor)
    payload = F.to_json(F.struct("area", "query", "locality"))  # absent parts are left out
    return out.select("id", "at", F.lit("discovery.place_index_search").alias("type"), payload.alias("input"), F.col("share").alias("credit_budget"), F.concat(F.lit("discovery.place_index_search:"), F.md5(payload)).alias("task_key"))


def charge(delivered: DataFrame, rates: DataFrame) -> DataFrame:
    """Credits of new leads: the source's rate, else the depth's. A rate of zero is a rate. Survey: PLN9."""
    by_source = rates.where("scope = 'source'").select(F.col("key").alias("source"), F.col("credits_per_unit").alias("a"))
    by_depth = rates.where("scope = 'depth'").select(F.col("key").alias("depth"), F.col("credits_per_unit").alias("b"))
    joined = delivered.join(by_source, "source", "left").join(by_depth, "depth", "left")
    return joined.withColumn("credits", F.col("new_leads") * F.coalesce("a", "b", F.lit(0))).withColumn("unit_key", F.concat(F.lit("task:"), "task_id")).drop("a", "b")


def capabilities(sources: DataFrame, fields: DataFrame) -> DataFrame:
    """(field, sources): usable sources of each wanted field, cheapest first; none means it cannot be satisfied. Survey: AGG19, PLN6."""
    usable = sources.where(F.col("enabled") & ((F.col("tos_class") != "red") | F.col("legal_approved")))
    offers = usable.select(F.explode("fields_provided").alias("field"), "cost_micros", "key")
    have = offers.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("cost_micros", "key"))), lambda x: x["key"]).alias("sources"))
    return fields.select("field").distinct().join(have, "field", "left").withColumn("satisfiable", F.col("sources").isNotNull())


def resolve_places(specs: DataFrame, areas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Areas (id, area_pos, slug, kind, country) and unknown names (id, name) of requests (PLN2).

    ``specs``: id, country, cities, states. Two names of one area count once, at the first one's place. A request that
    names no place searches its whole country.
    """
    named = F.concat(F.coalesce("cities", F.array().cast("array<string>")), F.coalesce("states", F.array().cast("array<string>")))
    asked = F.when(F.size(named) > 0, named).otherwise(F.array_compact(F.array("country")))
    rows = specs.select("id", "country", F.size(named).alias("given"), F.posexplode(asked).alias("pos", "name"))
    found = places.find_areas(rows.select("name", "country").distinct(), areas)
    joined = rows.join(found, ["name", "country"], "left")
    known = joined.where(F.col("slug").isNotNull()).groupBy("id", "country", "kind", "slug").agg(F.min("pos").alias("area_pos")).select("id", "area_pos", "slug", "kind", "country")
    return known, joined.where(F.col("slug").isNull() & (F.col("given") > 0)).select("id", "name").distinct()


#: Why a plan has no task, and the kinds of task that each discovery source takes.
NO_PLACE, NO_SOURCE = "no searchable place in this request", "no enabled source can discover businesses for this request"
TASK_TYPES = {"overture": "discovery.place_index_search", "osm": "discovery.place_index_search", "google_places": "discovery.places_text_search"}


def build_plan(specs: DataFrame, areas: DataFrame, queries: DataFrame, localities: DataFrame, sources: DataFrame, fields: DataFrame, templates: DataFrame, micros_per_credit: int) -> tuple[DataFrame, DataFrame]:
    """Tasks (id, at, type, input, credit_budget, task_key) and plans (id, unsatisfiable, unknown_places, notes,
    budget_limited) of requests, all at once (PLN1).

    ``specs``: id, intent, country, cities, states, max_credits; ``queries``: id, query, query_pos; ``fields``: id,
    field; ``sources`` as for ``capabilities`` with ``discovers``; ``templates``: intent, share, most. The cheapest
    source that discovers places and has a kind of task is used, and its cost in credits, rounded up, is the least a
    task may get.
    """
    usable = sources.where(F.col("enabled") & ((F.col("tos_class") != "red") | F.col("legal_approved")))
    kinds = F.create_map(*(F.lit(x) for pair in TASK_TYPES.items() for x in pair))
    source = usable.where(F.col("discovers") & F.col("key").isin(list(TASK_TYPES))).orderBy("cost_micros", "key").select("key", "cost_micros").limit(1)
    floor = F.greatest(F.lit(1), F.ceil(F.col("cost_micros") / micros_per_credit)).cast("long")
    source = source.select(F.element_at(kinds, F.col("key")).alias("type"), floor.alias("floor"))

    known, unknown = resolve_places(specs, areas)
    have = usable.select(F.explode("fields_provided").alias("field")).distinct()
    lacking = fields.join(have, "field", "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("field")).alias("unsatisfiable"))
    missing = unknown.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("unknown_places"))
    ready = specs.join(templates, "intent").join(source)  # one row of source at most
    wide = known.select("id", F.col("slug").alias("area"), "area_pos", (F.col("kind") == "city").alias("is_city"))
    rows = searches(ready.select("id", "most"), wide, queries, localities, F.col("most"))
    pot = F.floor(F.greatest("max_credits", F.lit(0)) * F.least("share", F.lit(1.0))).cast("long")
    joined = rows.join(ready.select("id", pot.alias("pot"), "floor", "type"), "id")
    funded = ranking.split_budget(joined.where(F.col("at") <= F.floor(F.col("pot") / F.col("floor"))), ["at"], F.col("pot"), ["id"]).where(F.col("share") >= F.col("floor"))
    payload = F.to_json(F.struct("area", "query", "locality"))
    tasks = funded.select("id", "at", "type", payload.alias("input"), F.col("share").alias("credit_budget"), F.concat("type", F.lit(":"), F.md5(payload)).alias("task_key"))

    counts = joined.groupBy("id").agg(F.count("*").alias("wanted")).join(tasks.groupBy("id").agg(F.count("*").alias("planned")), "id", "left")
    any_source = source.select(F.lit(True).alias("_source"))
    out = specs.select("id").join(known.select("id", F.lit(True).alias("_place")).distinct(), "id", "left").join(any_source, F.lit(True), "left").join(counts, "id", "left").join(lacking, "id", "left").join(missing, "id", "left")
    cut = F.coalesce("wanted", F.lit(0)) - F.coalesce("planned", F.lit(0))
    notes = F.array_compact(F.array(
        F.when(F.col("_source").isNull(), NO_SOURCE).when(F.col("_place").isNull(), NO_PLACE),
        F.when(cut > 0, F.concat(cut.cast("string"), F.lit(" searches not planned: the credits do not fund them"))),
    ))
    none = F.array().cast("array<string>")
    return tasks, out.select("id", F.coalesce("unsatisfiable", none).alias("unsatisfiable"), F.coalesce("unknown_places", none).alias("unknown_places"), notes.alias("notes"), (cut > 0).alias("budget_limited"))
