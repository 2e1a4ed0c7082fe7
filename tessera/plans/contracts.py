"""The shapes of messages: requests, job envelopes and progress events, as JSON schemas. Survey: JSN4."""

from __future__ import annotations


def closed(required: dict[str, dict], optional: dict[str, dict] | None = None) -> dict:
    """An object of these members and no others."""
    return {"type": "object", "properties": {**required, **(optional or {})}, "required": list(required), "additionalProperties": False}


def text(most: int | None = None, least: int | None = None, **more) -> dict:
    return {"type": "string", **({"maxLength": most} if most is not None else {}), **({"minLength": least} if least is not None else {}), **more}


def whole(least: int | None = None, most: int | None = None) -> dict:
    return {"type": "integer", **({"minimum": least} if least is not None else {}), **({"maximum": most} if most is not None else {})}


def number(**bounds) -> dict:
    return {"type": "number", **bounds}


def one_of(*values: str) -> dict:
    return {"type": "string", "enum": list(values)}


def listed(item: dict, most: int | None = None, **more) -> dict:
    return {"type": "array", "items": item, **({"maxItems": most} if most is not None else {}), **more}


def or_null(shape: dict) -> dict:
    """The same shape, or null."""
    out = {**shape, "type": [shape["type"], "null"]}
    return {**out, "enum": [*out["enum"], None]} if "enum" in out else out


UUID, TIME, FLAG = text(format="uuid"), text(format="date-time"), {"type": "boolean"}

# Names, bounds and lists that messages of other services keep to.
STAGES = ["queued", "planning", "discovery", "crawling", "extracting", "resolving", "verifying", "enriching", "scoring", "exporting", "ping"]
STATUSES = ["running", "completed", "failed", "paused", "cancelled"]
ERROR_CLASSES = ["transient", "rate_limited", "access_restricted", "parse_failed", "invalid_input", "budget_exhausted"]
PRIORITIES = ["interactive", "scheduled", "backfill"]
INTENTS = ["prospecting", "market_map", "competitor_scan", "hiring_signal", "single_company"]
DEPTHS = ["quick", "standard", "deep"]
CHANNELS = ["email", "phone", "whatsapp", "contact_form"]
PLATFORMS = ["instagram", "facebook", "linkedin", "x", "youtube", "whatsapp"]
MODES = ["directly_searchable", "post_filter", "estimate_only"]
FIELDS = [
    "name", "category", "industry", "description", "website", "phone", "email", "whatsapp", "contact_form", "address", "city", "state", "country", "postal_code",
    "geo", "google_maps_url", "rating", "review_count", "business_status", "opening_hours", "instagram", "facebook", "linkedin", "x", "youtube", "employee_band",
    "founded_year", "technologies", "hiring", "people",
]

JOB_ENVELOPE = {
    **closed(
        {
            "envelope_version": {"const": 1}, "job_id": UUID, "type": text(pattern=r"^[a-z][a-z0-9_]*\.[a-z][a-z0-9_]*$"), "org_id": or_null(UUID), "research_job_id": or_null(UUID),
            "idempotency_key": text(512, 1), "attempt": whole(1, 5), "priority": one_of(*PRIORITIES), "budget": closed({"credits_remaining": whole(0), "cost_cap_micros": whole(0)}),
            "trace_id": text(128, 1), "payload": {"type": "object"}, "created_at": TIME,
        }
    ),
    # work for a request belongs to an organisation
    "if": {"properties": {"research_job_id": text()}, "required": ["research_job_id"]},
    "then": {"properties": {"org_id": text()}},
}

PROGRESS_EVENT = closed(
    {
        "event_version": {"const": 1}, "job_id": UUID, "org_id": or_null(UUID), "trace_id": text(128, 1), "stage": one_of(*STAGES), "status": one_of(*STATUSES),
        "counts": {"type": "object", "additionalProperties": whole(0)}, "credits_used": whole(0), "ts": TIME,
    },
    {"message": or_null(text(500)), "error_class": or_null(one_of(*ERROR_CLASSES))},
)

_NAME = text(100, 1)
_BOTH = closed({}, {"include": listed(_NAME, 50), "exclude": listed(_NAME, 50)})
REQUEST = closed(
    {
        "spec_version": {"const": 1},
        "entity": one_of("company"),
        "intent": one_of(*INTENTS),
        "filters": closed(
            {},
            {
                "industry": closed({}, {"include": listed(_NAME, 20), "exclude": listed(_NAME, 20), "taxonomy_ids": listed(text(64, pattern=r"^[a-z0-9]+(-[a-z0-9]+)*$"), 20)}),
                "location": closed({}, {"country": text(pattern=r"^[A-Z]{2}$"), "states": listed(_NAME, 40), "cities": listed(_NAME, 50), "radius_km": or_null(number(exclusiveMinimum=0)), "include_metro_area": FLAG}),
                "employee_count": closed({}, {"gte": or_null(whole(0)), "lte": or_null(whole(0)), "allow_estimate": FLAG}),
                "has_website": or_null(FLAG),
                "contact": closed({}, {"any_of": listed(one_of(*CHANNELS))}),
                "social": {"type": "object", "propertyNames": {"enum": PLATFORMS}, "additionalProperties": closed({}, {"required": FLAG, "active_within_days": or_null(whole(1))})},
                "technologies": _BOTH,
                "hiring": closed({}, {"required": FLAG, "departments": listed(text())}),
                "funding": closed({}, {"last_round_within_days": or_null(whole(1))}),
                "rating": closed({}, {"gte": or_null(number(minimum=0, maximum=5)), "min_reviews": or_null(whole(0))}),
                "min_confidence": number(minimum=0, maximum=1),
            },
        ),
        "fields": listed(one_of(*FIELDS), 30, minItems=1, uniqueItems=True),
        "depth": one_of(*DEPTHS),
        "limits": closed({"max_results": whole(1, 10_000), "max_credits": whole(1, 1_000_000)}),
    },
    {
        "seed_company": closed({"name": text(200, 1)}, {"website": text(300)}),
        "keywords": closed({}, {k: listed(_NAME, 20) for k in ("must", "should", "not")}),
        "custom_columns": listed(closed({"name": text(80, 1), "prompt": text(1000, 1), "output_type": one_of("boolean", "text", "number", "enum")}), 10),
        "exclude": closed({}, {"lists": listed(UUID), "existing_leads": FLAG}),
        "feasibility": listed(closed({"filter": text(), "mode": one_of(*MODES)}, {"note": text()})),
    },
)
