"""Messages made of the tables' rows, checked against their schemas; the SQL states each rule by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.json_schema import problems
from tessera.plans import contracts
from tessera.registry import query, table

PROPS = contracts.closed({"k": {"type": "integer", "minimum": 5, "exclusiveMaximum": 90}}, {"note": {"type": "string", "maxLength": 3}})


@query("jsn_props_contract", """WITH e AS (SELECT event_id, json_extract(props, '$.k') AS k, json_keys(props) AS keys FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN k IS NULL THEN '$.k: required' END, CASE WHEN k::INT >= 90 THEN '$.k: exclusiveMaximum' END, CASE WHEN k::INT < 5 THEN '$.k: minimum' END,
  CASE WHEN len(list_filter(keys, lambda x: x NOT IN ('k', 'note'))) > 0 THEN '$.?: additionalProperties' END], lambda x: x IS NOT NULL), ',') AS problems FROM e""")  # fmt: skip
def jsn_props_contract(spark, sf_dir):
    """The events' own JSON, as it is."""
    return table(spark, sf_dir, "events").select("event_id", F.array_join(problems(F.col("props"), PROPS), ",").alias("problems"))


@query("jsn_progress_contract", """WITH e AS (SELECT event_id AS i, event_type AS t, user_id AS u, value AS v, json_extract(props, '$.k')::INT AS k FROM events)
SELECT i AS event_id, list_sort(list_filter([
  CASE WHEN k - 20 < 0 THEN '$.counts.found: minimum' END, CASE WHEN v <> floor(v) THEN '$.counts.kept: type' END, CASE WHEN v < 0 THEN '$.counts.kept: minimum' END,
  CASE WHEN u % 3 = 0 THEN '$.credits_used: required' END, CASE WHEN u % 3 = 1 THEN '$.credits_used: type' END, CASE WHEN k * 6 > 500 THEN '$.message: maxLength' END,
  CASE WHEN t NOT IN ('transient', 'rate_limited', 'access_restricted', 'parse_failed', 'invalid_input', 'budget_exhausted') THEN '$.error_class: enum' END,
  CASE WHEN k % 4 = 0 THEN '$.stage: enum' END, CASE WHEN k % 5 = 0 THEN '$.ts: format' END, CASE WHEN k % 7 = 0 THEN '$.job_id: format' END, CASE WHEN k % 11 = 0 THEN '$.t: additionalProperties' END,
  CASE WHEN k % 13 = 0 THEN '$.event_version: const' END], lambda x: x IS NOT NULL)) AS problems FROM e""")  # fmt: skip
def jsn_progress_contract(spark, sf_dir):
    """Progress events: counts from values, messages as long as their key says, classes and times of several shapes."""
    k, u = F.get_json_object("props", "$.k").cast("int"), F.col("user_id")
    job = F.format_string("%08x-0000-7000-8000-%012x", F.col("event_id"), u)
    sent = F.to_json(
        F.struct(
            F.when(k % 13 == 0, 2).otherwise(1).alias("event_version"), F.when(k % 7 == 0, F.substring(job, 2, 99)).otherwise(job).alias("job_id"), F.lit(None).cast("string").alias("org_id"),
            F.concat(F.lit("trace-"), u).alias("trace_id"), F.when(k % 4 == 0, "thinking").otherwise(F.element_at(F.array(*map(F.lit, contracts.STAGES)), (k % len(contracts.STAGES) + 1))).alias("stage"),
            F.lit("running").alias("status"), F.struct((k - 20).alias("found"), F.col("value").alias("kept")).alias("counts"), F.when(u % 3 == 1, u.cast("string")).alias("credits_text"),
            F.when(u % 3 == 2, u).alias("credits_used"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_good"), F.date_format("ts", "dd.MM.yyyy").alias("ts_bad"),
            F.repeat(F.lit("läuft "), k).alias("message"), F.col("event_type").alias("error_class"), F.when(k % 11 == 0, "x").alias("t"),
        )
    )
    # absent members are left out by to_json; a null stays where the shape asks for one
    sent = F.regexp_replace(sent, r'^\{"event_version"', '{"org_id":null,"event_version"')
    sent = F.regexp_replace(sent, '"credits_text"', '"credits_used"')
    sent = F.when(k % 5 == 0, F.regexp_replace(F.regexp_replace(sent, '"ts_good":"[^"]*",', ""), '"ts_bad"', '"ts"')).otherwise(F.regexp_replace(F.regexp_replace(sent, ',"ts_bad":"[^"]*"', ""), '"ts_good"', '"ts"'))
    return table(spark, sf_dir, "events").select("event_id", problems(sent, contracts.PROGRESS_EVENT).alias("problems"))


@query("jsn_envelope_contract", """WITH o AS (SELECT o_orderkey AS i, o_custkey AS c, o_totalprice AS p, o_orderpriority AS q, o_orderstatus AS s FROM orders)
SELECT i AS o_orderkey, list_sort(list_filter([
  CASE WHEN i % 7 < 1 THEN '$.attempt: minimum' END, CASE WHEN i % 7 > 5 THEN '$.attempt: maximum' END, CASE WHEN c % 4 = 0 THEN '$.attempt: type' END,
  CASE WHEN floor(p) - 200000 < 0 THEN '$.budget.credits_remaining: minimum' END, CASE WHEN p <> floor(p) THEN '$.budget.cost_cap_micros: type' END,
  CASE WHEN q <> '1-URGENT' THEN '$.priority: enum' END, CASE WHEN NOT regexp_matches(lower(s) || '.run' || CASE WHEN c % 5 = 0 THEN '!' ELSE '' END, '^[a-z][a-z0-9_]*\\.[a-z][a-z0-9_]*$') THEN '$.type: pattern' END,
  CASE WHEN c % 6 < 3 THEN '$.org_id: type' END, CASE WHEN c % 9 = 0 THEN '$.idempotency_key: minLength' END, CASE WHEN c % 10 = 0 THEN '$.payload: type' END], lambda x: x IS NOT NULL)) AS problems FROM o""")  # fmt: skip
def jsn_envelope_contract(spark, sf_dir):
    """Job envelopes of orders; work for a request (three of six customers) without its organisation breaks the rule between members."""
    i, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    number = lambda x: F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
    uuid = F.format_string("%08x-0000-7000-8000-000000000001", i)
    n = i % 7
    attempt = F.when(c % 4 != 0, n.cast("string")).when(n < 1, "-0.25").when(n > 5, "6.5").otherwise(F.concat(F.lit('{"n":'), n.cast("string"), F.lit("}")))
    fields = [
        F.lit('{"envelope_version":1,"job_id":"'), uuid, F.lit('","type":"'), F.lower("o_orderstatus"), F.lit(".run"), F.when(c % 5 == 0, "!").otherwise(""),
        F.lit('","org_id":'), F.when(c % 6 < 3, F.lit("null")).otherwise(F.concat(F.lit('"'), uuid, F.lit('"'))),
        F.lit(',"research_job_id":'), F.when(c % 6 < 4, F.concat(F.lit('"'), uuid, F.lit('"'))).otherwise("null"),
        F.lit(',"idempotency_key":"'), F.when(c % 9 == 0, "").otherwise("k"), F.lit('","attempt":'), attempt,
        F.lit(',"priority":"'), F.when(F.col("o_orderpriority") == "1-URGENT", "interactive").otherwise(F.col("o_orderpriority")),
        F.lit('","budget":{"credits_remaining":'), (F.floor(p) - 200_000).cast("string"), F.lit(',"cost_cap_micros":'), number(p),
        F.lit('},"trace_id":"t","payload":'), F.when(c % 10 == 0, "[]").otherwise("{}"), F.lit(',"created_at":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}'),
    ]
    return table(spark, sf_dir, "orders").select("o_orderkey", problems(F.concat(*fields), contracts.JOB_ENVELOPE).alias("problems"))


@query("jsn_request_contract", """WITH p AS (SELECT p_partkey AS i, p_name AS n, p_size AS z, p_retailprice AS r FROM part)
SELECT i AS p_partkey, list_sort(list_filter(list_concat([
  CASE WHEN z > 45 THEN '$.limits.max_results: maximum' END, CASE WHEN r <> floor(r) THEN '$.limits.max_credits: type' END, CASE WHEN z % 4 = 0 THEN '$.fields: minItems' END,
  CASE WHEN z % 4 = 2 THEN '$.fields: uniqueItems' END, CASE WHEN z % 6 = 1 THEN '$.filters.social.orkut: propertyNames' END, CASE WHEN z > 40 THEN '$.filters.rating.gte: maximum' END,
  CASE WHEN z % 9 = 0 THEN '$.depth: required' END, CASE WHEN contains(n, ' ') THEN '$.filters.industry.taxonomy_ids[1]: pattern' END, CASE WHEN z % 5 = 0 THEN '$.filters.location.radius_km: exclusiveMinimum' END],
  CASE WHEN z > 20 THEN ['$.filters.location.cities: maxItems'] ELSE [] END, CASE WHEN z % 7 = 3 THEN ['$.custom_columns[0].output_type: enum', '$.custom_columns[0].prompt: required'] ELSE [] END),
  lambda x: x IS NOT NULL)) AS problems FROM part JOIN p ON i = p_partkey""")  # fmt: skip
def jsn_request_contract(spark, sf_dir):
    """Requests whose members follow from a part's name, size and price."""
    z, r = F.col("p_size"), F.col("p_retailprice")
    pick = lambda cond, yes, no: F.when(cond, yes).otherwise(no)
    cities = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('"Pune"'), F.when(z > 20, 51).otherwise(z)), ","), F.lit("]"))
    price = F.when(r == F.floor(r), r.cast("long").cast("string")).otherwise(r.cast("string"))
    fields = [
        F.lit('{"spec_version":1,"entity":"company","intent":"prospecting","filters":{"industry":{"taxonomy_ids":["a-b","'), F.col("p_name"), F.lit('"]},"location":{"country":"IN","cities":'), cities,
        F.lit(',"radius_km":'), (z % 5).cast("string"), F.lit('},"social":{"'), pick(z % 6 == 1, "orkut", "x"), F.lit('":{"required":true}},"rating":{"gte":'), (z / 8).cast("string"),
        F.lit('}},"fields":'), F.when(z % 4 == 0, "[]").when(z % 4 == 2, '["name","phone","name"]').otherwise('["name","phone"]'), pick(z % 9 == 0, "", ',"depth":"deep"'),
        F.lit(',"limits":{"max_results":'), pick(z > 45, "10001", "10000"), F.lit(',"max_credits":'), price, F.lit("}"),
        pick(z % 7 == 3, ',"custom_columns":[{"name":"n","output_type":"date"}]', ""), F.lit("}"),
    ]
    return table(spark, sf_dir, "part").select("p_partkey", problems(F.concat(*fields), contracts.REQUEST).alias("problems"))
