"""Messages that keep or break their schemas, and schemas that are refused."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.json_schema import problems
from tessera.plans import contracts as C

ID = "0190b3a4-1111-7222-8333-444455556666"
ENVELOPE = {
    "envelope_version": 1, "job_id": ID, "type": "crawl.fetch_page", "org_id": ID, "research_job_id": ID, "idempotency_key": "k", "attempt": 3, "priority": "backfill",
    "budget": {"credits_remaining": 0, "cost_cap_micros": 5_000_000}, "trace_id": "t", "payload": {"anything": [1, {"at": None}]}, "created_at": "2026-02-03T04:05:06.789Z",
}
PROGRESS = {
    "event_version": 1, "job_id": ID, "org_id": None, "trace_id": "t", "stage": "ping", "status": "running", "counts": {"seen": 3, "kept": 0}, "credits_used": 0,
    "ts": "2026-02-03T04:05:06+05:30",
}
REQUEST = {
    "spec_version": 1, "entity": "company", "intent": "market_map", "filters": {}, "fields": ["name"], "depth": "standard", "limits": {"max_results": 10_000, "max_credits": 1},
}
FULL = REQUEST | {
    "seed_company": {"name": "Ácme"}, "keywords": {"must": ["x"], "not": []}, "exclude": {"lists": [ID], "existing_leads": True},
    "custom_columns": [{"name": "n", "prompt": "p", "output_type": "enum"}], "feasibility": [{"filter": "f", "mode": "post_filter"}],
    "filters": {
        "industry": {"include": ["dentists"], "taxonomy_ids": ["a-b1"]}, "location": {"country": "IN", "cities": ["Pune"] * 50, "radius_km": 0.5}, "employee_count": {"gte": None, "lte": 5},
        "has_website": None, "contact": {"any_of": ["email"]}, "social": {"x": {}, "youtube": {"required": True, "active_within_days": 1}}, "rating": {"gte": 5, "min_reviews": 0}, "min_confidence": 1,
    },
}


def changed(base, **paths):
    """A copy with values put at dotted paths; ``...`` takes the member away."""
    out = copy.deepcopy(base)
    for path, value in paths.items():
        *way, last = path.split("__")
        at = out
        for step in way:
            at = at[int(step) if isinstance(at, list) else step]
        if value is ...:
            del at[last]
        else:
            at[int(last) if isinstance(at, list) else last] = value
    return out


CASES = [
    (C.JOB_ENVELOPE, [
        (ENVELOPE, []), (changed(ENVELOPE, research_job_id=None, org_id=None), []), (changed(ENVELOPE, attempt=3.0), []),
        (changed(ENVELOPE, org_id=None), ["$.org_id: type"]), (changed(ENVELOPE, attempt="3"), ["$.attempt: type"]), (changed(ENVELOPE, attempt=6), ["$.attempt: maximum"]), (changed(ENVELOPE, attempt=0), ["$.attempt: minimum"]),
        (changed(ENVELOPE, attempt=True), ["$.attempt: type"]), (changed(ENVELOPE, created_at="2026-02-03 04:05:06"), ["$.created_at: format"]), (changed(ENVELOPE, created_at="2026-02-31T04:05:06Z"), ["$.created_at: format"]),
        (changed(ENVELOPE, type="Crawl"), ["$.type: pattern"]), (changed(ENVELOPE, job_id="17"), ["$.job_id: format"]), (changed(ENVELOPE, more=1), ["$.more: additionalProperties"]),
        (changed(ENVELOPE, budget__cost_cap_micros=0.5), ["$.budget.cost_cap_micros: type"]), (changed(ENVELOPE, budget__more=1, budget__credits_remaining=...), ["$.budget.credits_remaining: required", "$.budget.more: additionalProperties"]),
        (changed(ENVELOPE, envelope_version=2), ["$.envelope_version: const"]), (changed(ENVELOPE, envelope_version="1"), ["$.envelope_version: const"]), (changed(ENVELOPE, payload=[]), ["$.payload: type"]),
        (changed(ENVELOPE, idempotency_key="", trace_id="x" * 129), ["$.idempotency_key: minLength", "$.trace_id: maxLength"]), (changed(ENVELOPE, priority="low", research_job_id=...), ["$.priority: enum", "$.research_job_id: required"]),
    ]),
    (C.PROGRESS_EVENT, [
        (PROGRESS, []), (PROGRESS | {"message": None, "error_class": None}, []), (PROGRESS | {"message": "ü" * 500, "error_class": "transient"}, []),
        (PROGRESS | {"message": "ü" * 501}, ["$.message: maxLength"]), (changed(PROGRESS, trace_id=...), ["$.trace_id: required"]), (changed(PROGRESS, counts__seen=-1, counts__new=0.5), ["$.counts.new: type", "$.counts.seen: minimum"]),
        (PROGRESS | {"error_class": "odd"}, ["$.error_class: enum"]), (PROGRESS | {"stage": "thinking"}, ["$.stage: enum"]), (PROGRESS | {"stage": None}, ["$.stage: enum", "$.stage: type"]), (PROGRESS | {"counts": None}, ["$.counts: type"]),
    ]),
    (C.REQUEST, [
        (REQUEST, []), (FULL, []),
        (changed(FULL, filters__location__country="ind"), ["$.filters.location.country: pattern"]), (changed(REQUEST, fields=[]), ["$.fields: minItems"]), (changed(REQUEST, fields=["name", "phone", "name"]), ["$.fields: uniqueItems"]),
        (changed(REQUEST, fields=["name", "shoe"]), ["$.fields[1]: enum"]), (changed(FULL, filters__industry__taxonomy_ids=["ok", "Not ok"]), ["$.filters.industry.taxonomy_ids[1]: pattern"]),
        (changed(FULL, filters__location__cities=["Pune"] * 51), ["$.filters.location.cities: maxItems"]), (changed(REQUEST, limits__max_results=10_001), ["$.limits.max_results: maximum"]), (changed(REQUEST, depth="abyssal"), ["$.depth: enum"]),
        (changed(FULL, filters__social__orkut={}), ["$.filters.social.orkut: propertyNames"]), (changed(FULL, filters__social__x={"required": 1}), ["$.filters.social.x.required: type"]), (changed(REQUEST, spec_version=2), ["$.spec_version: const"]),
        (changed(FULL, filters__location__radius_km=0), ["$.filters.location.radius_km: exclusiveMinimum"]), (changed(FULL, custom_columns__0__prompt=...), ["$.custom_columns[0].prompt: required"]), ([], ["$: type"]), (None, ["$: type"]),
    ]),
]


@pytest.mark.parametrize("schema, cases", CASES, ids=["envelope", "progress", "request"])
def test_families(spark, schema, cases):
    df = spark.createDataFrame([(i, json.dumps(doc)) for i, (doc, _) in enumerate(cases)] + [(-1, "{"), (-2, None)], "i int, doc string")
    got = {r["i"]: r["p"] for r in df.select("i", problems(F.col("doc"), schema).alias("p")).collect()}
    for i, (doc, want) in enumerate(cases):
        assert got[i] == want, doc
    assert got[-1] == ["$: json"] and got[-2] == ["$: missing"]


@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ({"anyOf": [{"type": "integer"}, {"type": "string", "maxLength": 2}]}, [1, "ab"], ["abc", 1.5]),
        ({"oneOf": [{"minimum": 2}, {"maximum": 4}]}, [1, 5], [3, "x"]),
        ({"not": {"type": "null"}}, [1, "", {}], [None]),
        ({"allOf": [{"multipleOf": 0.5}, {"exclusiveMaximum": 3}]}, [2.5, "x"], [2.25, 3]),
        ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"type": "boolean"}}, ["ab", True], ["a", 1]),
        ({"$defs": {"p": {"type": "array", "items": {"type": "array", "items": {"enum": [1, None, "a", False]}}}}, "$ref": "#/$defs/p"}, [[[1, "a"], [], [None, False]]], [[["b"]], [[0]], [1]]),
        ({"properties": {"it's": {"const": 1}, 'a"b.c': False}, "minProperties": 1, "maxProperties": 2}, [{"it's": 1}, []], [{"it's": 2}, {'a"b.c': 0}, {}, {"a": 1, "b": 2, "c": 3}]),
        ({"uniqueItems": True}, [[1, "1", {"a": 1}, {"a": 2}], []], [[1, 1.0], [{"a": [1]}, {"a": [1]}]]),
        ({"format": "date"}, ["2024-02-29", 5], ["2023-02-29", "x"]),
        (False, [], [1, None]),
        (True, [1, None], []),
    ],
)
def test_keywords(spark, schema, good, bad):
    if isinstance(schema, bool):
        schema = {"properties": {"x": schema}}
        good, bad = [{"x": v} for v in good] + [{}], [{"x": v} for v in bad]
    df = spark.createDataFrame([(json.dumps(v), k) for k, vs in ((True, good), (False, bad)) for v in vs], "doc string, good boolean")
    for r in df.select("doc", "good", problems(F.col("doc"), schema).alias("p")).collect():
        assert (r["p"] == []) == r["good"], r


@pytest.mark.parametrize(
    "schema",
    [{"typo": 1}, {"format": "colour"}, {"properties": {"a": {"patternProperties": {}}}}, {"$ref": "#/$defs/none"}, {"$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}, "$ref": "#/$defs/a"}, {"const": [1]}],
)
def test_refused_schemas(spark, schema):
    with pytest.raises((ValueError, KeyError)):
        spark.range(1).select(problems(F.lit("1"), schema))


def test_no_python_runs(spark):
    plan = spark.range(1).select(problems(F.col("id").cast("string"), C.JOB_ENVELOPE))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
