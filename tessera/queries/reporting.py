"""Health, usage, dashboards, billing, exports, requests and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import money
from tessera.functions import text as TX
from tessera.operators import export, graph, guards, ranking, reports
from tessera.plans import research
from tessera.queries.places import geography, of, sql_of
from tessera.registry import query, table

AS_OF = "(SELECT max(ts) FROM events)"


def as_of(events):
    """The newest event's time, as a literal: reports must not depend on the clock."""
    return F.lit(events.agg(F.max("ts")).first()[0])


def usage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("org_id"), F.col("event_type").alias("meter"), F.lit(1).alias("units"), (F.col("event_id") % 5).alias("credits"), F.round(F.col("value") * 100).cast("long").alias("cost_micros"), F.col("ts").alias("created_at"))


U = "SELECT event_id, user_id AS org_id, event_type AS meter, 1 AS units, event_id % 5 AS credits, CAST(round(value * 100) AS BIGINT) AS cost_micros, ts AS created_at FROM events"


@query("agg_health_filter", f"""
SELECT event_type AS type, count(*) AS total, count(*) FILTER (user_id % 3 = 0) AS succeeded, count(*) FILTER (user_id % 3 = 1) AS failed, count(*) FILTER (event_id % 4 > 1) AS retried,
  CAST(round(avg(event_id % 977)) AS BIGINT) AS avg_ms, max(ts + to_milliseconds(event_id % 977)) AS last_finished FROM events WHERE ts >= {AS_OF} - INTERVAL 10 DAY GROUP BY event_type""")  # fmt: skip
def agg_health_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("user_id") % 3
    tasks = e.select(
        F.col("event_type").alias("type"), F.when(k == 0, "succeeded").when(k == 1, "failed").otherwise("queued").alias("status"), (F.col("event_id") % 4).alias("attempts"),
        F.lit("transient").alias("error_class"), F.col("ts").alias("started_at"), F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 977) * 1000).alias("finished_at"), F.col("ts").alias("created_at"),
    )
    out = reports.health_by_type(tasks, as_of(e) - F.expr("INTERVAL 10 DAYS"))
    return out.select("type", "total", "succeeded", "failed", "retried", "avg_ms", "last_finished")


@query("agg_usage_by_meter", f"SELECT meter, count(*) AS events, sum(units)::BIGINT AS units, sum(credits)::BIGINT AS credits, sum(cost_micros)::BIGINT AS cost_micros, count(DISTINCT org_id) AS orgs, max(created_at) AS last_at FROM ({U}) GROUP BY meter")
def agg_usage_by_meter(spark, sf_dir):
    return reports.usage_by_meter(usage(spark, sf_dir), F.lit("1970-01-01").cast("timestamp"))


@query("agg_usage_rollup", f"SELECT org_id, meter, day, count(*) AS events, sum(cost_micros)::BIGINT AS cost_micros, grouping(org_id, meter, day) AS level FROM (SELECT *, CAST(created_at AS DATE) AS day FROM ({U})) GROUP BY ROLLUP (org_id, meter, day)")
def agg_usage_rollup(spark, sf_dir):
    return reports.usage_rollup(usage(spark, sf_dir))


@query("agg_p95_null_safe", """
WITH t AS (SELECT CASE user_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'completed' END AS status, event_id % 3 AS pages, event_id % 7 AS v, event_id % 977 AS ms, user_id % 4 <> 1 AS done, ts FROM events),
d AS (SELECT CASE user_id % 4 WHEN 0 THEN 'restricted' WHEN 1 THEN 'error' ELSE 'ok' END AS access, event_id % 9 <> 0 AS stored, event_id % 2 = 0 AS hashed, event_id % 5000 AS bytes FROM events WHERE event_type <> 'view')
SELECT count(*) AS tasks, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, sum(pages)::BIGINT AS pages_read,
  count(*) FILTER (pages = 0 AND status = 'completed') AS read_nothing, count(*) FILTER (pages > 0 AND v = 0) AS found_nothing, sum(v)::BIGINT AS values_found,
  (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM d WHERE access = 'ok') AS ok, (SELECT count(*) FROM d WHERE access = 'restricted') AS restricted, (SELECT count(*) FROM d WHERE access = 'error') AS error,
  (SELECT count(*) FROM d WHERE stored) AS stored, (SELECT count(*) FROM d WHERE hashed AND NOT stored) AS deduplicated, (SELECT sum(bytes)::BIGINT FROM d WHERE stored) AS stored_bytes,
  CAST(round(avg(ms) FILTER (done)) AS BIGINT) AS avg_ms, CAST(round(quantile_cont(ms, 0.95) FILTER (done)) AS BIGINT) AS p95_ms, (SELECT sum(event_id % 13)::BIGINT FROM events) AS cost_micros,
  (SELECT count(*) FROM orders) AS leads, (SELECT CAST(round((SELECT sum(event_id % 13) FROM events) / count(*)) AS BIGINT) FROM orders) AS cost_per_lead, max(ts + to_milliseconds(ms)) FILTER (done) AS last_finished FROM t""")  # fmt: skip
def agg_p95_null_safe(spark, sf_dir):
    """Crawl health, all figures (AGG3)."""
    e = table(spark, sf_dir, "events")
    k, ms = F.col("user_id") % 4, F.col("event_id") % 977
    tasks = e.select(
        F.when(k == 0, "failed").when(k == 1, "running").otherwise("completed").alias("status"), (F.col("event_id") % 3).alias("pages_read"), (F.col("event_id") % 7).alias("values_found"),
        F.col("ts").alias("started_at"), F.when(k != 1, F.timestamp_micros(F.unix_micros("ts") + ms * 1000)).alias("finished_at"),
    )
    documents = e.where("event_type <> 'view'").select(
        F.when(k == 0, "restricted").when(k == 1, "error").otherwise("ok").alias("access_status"), F.when(F.col("event_id") % 9 != 0, "key").alias("storage_key"),
        F.when(F.col("event_id") % 2 == 0, "hash").alias("content_hash"), (F.col("event_id") % 5000).alias("bytes"),
    )
    return reports.crawl_health(tasks, documents, e.select((F.col("event_id") % 13).alias("cost_micros")), table(spark, sf_dir, "orders"), exact=True)


@query("agg_cost_without_leads", "SELECT l.leads, CASE WHEN l.leads > 0 THEN 1 END::BIGINT AS cost_per_lead, e.tasks, e.cost_micros FROM (SELECT count(*) AS leads FROM customer WHERE c_acctbal < -1000000) l, (SELECT count(*) AS tasks, CAST(sum(user_id) AS BIGINT) AS cost_micros FROM events) e")
def agg_cost_without_leads(spark, sf_dir):
    """All events cost something, and no customer is a lead: the cost of one is null."""
    e = table(spark, sf_dir, "events")
    stamp = F.col("ts")
    leads = table(spark, sf_dir, "customer").where("c_acctbal < -1000000")
    tasks = e.select(F.lit("x").alias("status"), F.lit(1).alias("pages_read"), F.lit(1).alias("values_found"), stamp.alias("started_at"), stamp.alias("finished_at"))
    documents = e.select(*(F.lit("x").alias(c) for c in ("access_status", "storage_key", "content_hash")), F.lit(1).alias("bytes"))
    return reports.crawl_health(tasks, documents, e.select(F.col("user_id").alias("cost_micros")), leads).select("leads", "cost_per_lead", "tasks", "cost_micros")


@query("agg_usage_cube", f"SELECT meter, day, count(*) AS events, sum(cost_micros)::BIGINT AS cost_micros, grouping(meter, day) AS level FROM (SELECT *, CAST(created_at AS DATE) AS day FROM ({U})) GROUP BY CUBE (meter, day)")
def agg_usage_cube(spark, sf_dir):
    """All combinations of meter and day (AGG21)."""
    return reports.usage_cube(usage(spark, sf_dir), ["meter", "day"])


@query("agg_usage_grouping_sets", f"SELECT org_id, meter, count(*) AS events, sum(cost_micros)::BIGINT AS cost_micros FROM ({U}) GROUP BY GROUPING SETS ((org_id), (meter), ())")
def agg_usage_grouping_sets(spark, sf_dir):
    return reports.usage_sets(usage(spark, sf_dir), [["org_id"], ["meter"], []])


@query("agg_dashboard_counts", """
WITH now AS (SELECT max(o_orderdate) AS t FROM orders)
SELECT count(*) AS total, count(*) FILTER (o_orderdate >= date_trunc('day', t)) AS today, count(*) FILTER (o_orderdate >= date_trunc('day', t) - INTERVAL 7 DAY) AS last_7_days, count(*) FILTER (o_orderdate >= date_trunc('day', t) - INTERVAL 30 DAY) AS last_30_days,
  count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)) AS with_2 FROM orders, now""")  # fmt: skip
def agg_dashboard_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").cast("string").alias("field"), F.lit(True).alias("is_current"))
    leads = o.select(F.col("o_orderkey").alias("company_id"), F.col("o_orderdate").alias("created_at"))
    return reports.lead_counts(leads, reports.channel_marks(v, ["2"]), F.lit(o.agg(F.max("o_orderdate")).first()[0]))


@query("agg_jobs_by_status", "SELECT count(*) AS total, count(*) FILTER (o_orderkey % 5 = 0) AS queued, count(*) FILTER (o_orderkey % 5 IN (1, 2)) AS failed, count(*) FILTER (o_orderkey % 5 = 3) AS completed FROM orders")
def agg_jobs_by_status(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    jobs = table(spark, sf_dir, "orders").select(F.when(k == 0, "queued").when(k == 1, "failed").when(k == 2, "cancelled").when(k == 3, "completed").otherwise("paused").alias("status"), F.col("o_orderdate").alias("finished_at"))
    return reports.job_counts(jobs).select("total", "queued", "failed", "completed")


LEDGER = """SELECT o_custkey AS org_id, 'job' AS ref_type, o_orderkey AS ref_id, -(o_orderkey % 100) AS delta, 'reserve' AS reason, o_orderdate AS created_at FROM orders
 UNION ALL SELECT o_custkey, 'job', o_orderkey, -(o_orderkey % 10), 'consume', o_orderdate FROM orders WHERE o_orderkey % 3 = 0
 UNION ALL SELECT o_custkey, 'job', o_orderkey, o_orderkey % 100, 'release', o_orderdate FROM orders WHERE o_orderkey % 3 = 0"""


def ledger(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    entry = lambda rows, delta, reason: rows.select(F.col("o_custkey").alias("org_id"), F.lit("job").alias("ref_type"), k.alias("ref_id"), delta.alias("delta"), F.lit(reason).alias("reason"), F.col("o_orderdate").alias("created_at"))
    done = o.where(k % 3 == 0)
    return entry(o, -(k % 100), "reserve").unionByName(entry(done, -(k % 10), "consume")).unionByName(entry(done, k % 100, "release"))


@query("agg_settlement", f"""
WITH l AS ({LEDGER}), e AS (SELECT ref_id AS job_id, any_value(org_id) AS org_id, -coalesce(sum(delta) FILTER (reason = 'reserve'), 0) AS reserved, -coalesce(sum(delta) FILTER (reason = 'consume'), 0) AS consumed, count(*) FILTER (reason = 'release') AS releases FROM l GROUP BY ref_id),
u AS (SELECT l_orderkey AS job_id, sum(l_quantity::BIGINT) AS credits FROM lineitem GROUP BY 1)
SELECT job_id, org_id, reserved::BIGINT AS reserved, used::BIGINT AS used, greatest(used - consumed, 0)::BIGINT AS delta, (reserved - used)::BIGINT AS released, (CASE WHEN releases = 0 THEN reserved ELSE 0 END - greatest(used - consumed, 0))::BIGINT AS balance_effect
FROM (SELECT *, least(coalesce(credits, 0), reserved) AS used FROM e LEFT JOIN u USING (job_id))""")  # fmt: skip
def agg_settlement(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("org_id"))
    used = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_quantity").cast("long").alias("credits"))
    return reports.settle(jobs, ledger(spark, sf_dir), used)


@query("agg_credits_spent", f"SELECT org_id, coalesce(-sum(delta), 0)::BIGINT AS spent FROM ({LEDGER}) WHERE reason = 'consume' AND created_at >= TIMESTAMP '1997-01-01' GROUP BY org_id")
def agg_credits_spent(spark, sf_dir):
    return reports.credits_spent(ledger(spark, sf_dir), F.lit("1997-01-01").cast("timestamp"))


@query("agg_reserved_for_job", f"SELECT org_id, ref_id AS job_id, -sum(delta)::BIGINT AS reserved FROM ({LEDGER}) WHERE reason IN ('reserve', 'release') GROUP BY ALL")
def agg_reserved_for_job(spark, sf_dir):
    return reports.reserved_for(ledger(spark, sf_dir))


@query("agg_reserve_estimate", "SELECT p_partkey, least(p_size * 10, 200)::BIGINT AS credits, p_size * 10 > 200 AS capped FROM part")
def agg_reserve_estimate(spark, sf_dir):
    e = money.reserve_estimate(F.lit(10).cast("long"), F.col("p_size"), F.lit(200).cast("long"))
    return table(spark, sf_dir, "part").select("p_partkey", e["credits"].alias("credits"), e["capped"].alias("capped"))


@query("agg_delivered_per_job", "SELECT o_custkey AS job_id, count(DISTINCT o_orderkey) AS found, count(DISTINCT o_orderkey) FILTER (o_orderkey % 2 = 0) AS new FROM orders GROUP BY o_custkey")
def agg_delivered_per_job(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("lead_id"), (F.col("o_orderkey") % 2 == 0).alias("is_new"))
    return reports.delivered(o.unionAll(o))


@query("json_counters", "SELECT user_id AS job_id, count(DISTINCT event_type) FILTER (event_type <> 'error') AS n_counters, sum(event_id % 10) FILTER (event_type = 'view')::BIGINT AS views FROM events WHERE event_type <> 'error' GROUP BY user_id")
def json_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("counter"), (F.col("event_id") % 10).alias("n"))
    out = reports.counters(e, ["view", "signup", "click", "purchase"])
    return out.select("job_id", F.size("counters").cast("long").alias("n_counters"), F.element_at("counters", "view").alias("views"))


@query("agg_member_counts", "SELECT c_nationkey AS org_id, count(DISTINCT c_custkey) AS members, count(*) FILTER (c_mktsegment = 'BUILDING') AS owners FROM customer GROUP BY 1")
def agg_member_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return reports.members_by_org(c.select(F.col("c_nationkey").alias("org_id"), F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment") == "BUILDING", "owner").otherwise("member").alias("role")))


@query("agg_sources_present", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT s_name)), ',') AS sources FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey")
def agg_sources_present(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return reports.sources_of(li.select("l_orderkey", F.col("s_name").alias("source")), "l_orderkey").select("l_orderkey", F.array_join("sources", ",").alias("sources"))


@query("agg_corpus_recall", """
SELECT source AS field, count(*) FILTER (quality = toxic) AS found, count(*) FILTER (toxic IS NULL) AS missed, count(*) FILTER (quality <> toxic) AS wrong, 0::BIGINT AS other, count(*) FILTER (quality = toxic) / count(*) AS recall FROM documents JOIN labels USING (doc_id) GROUP BY source""")  # fmt: skip
def agg_corpus_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return reports.recall_by_field(rows.select(F.col("source").alias("field"), F.col("quality").alias("expected"), F.col("toxic").alias("extracted")))


@query("agg_eval_report", "SELECT event_type AS task, count(*) AS cases, avg(CAST(user_id % 3 > 0 AS INT)) AS pass_rate, sum(event_id % 4) / sum(5) AS field_accuracy, sum(event_id % 100) * 1000 / count(*) AS cost_micros_per_1k FROM events GROUP BY 1")
def agg_eval_report(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return reports.eval_report(e.select(F.col("event_type").alias("task"), (F.col("user_id") % 3 > 0).alias("passed"), (F.col("event_id") % 4).alias("fields_right"), F.lit(5).alias("fields"), (F.col("event_id") % 100).alias("cost_micros")))


@query("agg_capabilities", "SELECT f AS field, CASE WHEN f = 'f3' THEN NULL ELSE (SELECT s_name FROM supplier WHERE 'f' || (s_suppkey % 3) = f ORDER BY s_acctbal, s_name LIMIT 1) END AS cheapest FROM (VALUES ('f0'), ('f1'), ('f2'), ('f3')) AS t(f)")
def agg_capabilities(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.lit(True).alias("enabled"), F.lit("green").alias("tos_class"), F.lit(False).alias("legal_approved"), F.array(F.concat(F.lit("f"), F.col("s_suppkey") % 3)).alias("fields_provided"), F.col("s_acctbal").alias("cost_micros"), F.col("s_name").alias("key"))
    wanted = spark.sql("SELECT * FROM VALUES ('f0'), ('f1'), ('f2'), ('f3') AS t(field)")
    return research.capabilities(s, wanted).select("field", F.get("sources", F.lit(0)).alias("cheapest"))


@query("exp_pivot_eav", """
WITH v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, CAST(l_partkey AS VARCHAR)) AS rn FROM lineitem)
SELECT l_orderkey AS lead_id, array_to_string(list_sort(list(DISTINCT 's' || l_suppkey)), ' | ') AS sources, max(l_partkey::VARCHAR) FILTER (l_linenumber = 1 AND rn = 1) AS name,
  max(l_partkey::VARCHAR) FILTER (l_linenumber = 2 AND rn = 1) AS email, max(l_partkey::VARCHAR) FILTER (l_linenumber = 3 AND rn = 1) AS zeta
FROM v WHERE l_linenumber <= 3 GROUP BY l_orderkey""")  # fmt: skip
def exp_pivot_eav(spark, sf_dir):
    """Attribute rows to a wide export, the newest value of each field: leading fields first, then the others by name."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3")
    name = F.when(F.col("l_linenumber") == 1, "name").when(F.col("l_linenumber") == 2, "email").otherwise("zeta")
    rows = li.select(F.col("l_orderkey").alias("lead_id"), name.alias("field"), F.col("l_partkey").cast("string").alias("value"), F.concat(F.lit("s"), "l_suppkey").alias("source"), F.lit("u").alias("source_url"), F.col("l_shipdate").alias("observed_at"))
    return export.wide(rows, ["name", "email", "zeta"])


@query("exp_csv_escape", r"""
SELECT doc_id, CASE WHEN regexp_matches(g, '[",\r\n]') THEN '"' || replace(g, '"', '""') || '"' ELSE g END AS cell FROM (
  SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+\-@\t\r]') THEN '''' || t ELSE t END AS g FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '=' || lang WHEN 1 THEN '-"' || source ELSE text END AS t FROM documents))""")  # fmt: skip
def exp_csv_escape(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("="), "lang")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('-"'), "source")).otherwise(F.col("text"))
    return d.select("doc_id", TX.csv_cell(raw).alias("cell"))


@query("exp_csv_lines", "SELECT c_custkey || ',' || c_name || ',' || CASE WHEN c_acctbal < 0 THEN '''' ELSE '' END || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || chr(13) || chr(10) AS line FROM customer")
def exp_csv_lines(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return export.csv_lines(c.select("c_custkey", "c_name", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal")))


@query("exp_notice_lines", "SELECT DISTINCT 's' || l_suppkey AS source, 'notice ' || l_suppkey AS notice FROM lineitem WHERE l_suppkey % 9 = 0")
def exp_notice_lines(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"))
    k = F.col("s_suppkey")
    duties = table(spark, sf_dir, "supplier").where(k % 9 == 0).select(F.concat(F.lit("s"), k).alias("source"), F.concat(F.lit("notice "), k).alias("notice"), k.alias("ordinal"))
    return export.notice_lines(v, duties)


@query("exp_names_and_keys", "SELECT o_orderkey, 'leads-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) || '-' || strftime(o_orderdate, '%Y-%m-%d') || '.csv' AS file, 'raw/' || strftime(o_orderdate, '%Y/%m/') || md5(CAST(o_orderkey AS VARCHAR)) || '/' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '.html.gz' AS key FROM orders")
def exp_names_and_keys(spark, sf_dir):
    job = F.md5(F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", export.filename(job, F.col("o_orderdate")).alias("file"), export.storage_key(job, F.col("o_orderdate")).alias("key"))


@query("exp_display_groups", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'Small' WHEN p_size <= 20 THEN 'Middle' ELSE 'Other' END AS heading FROM part")
def exp_display_groups(spark, sf_dir):
    groups = spark.range(1, 21).select(F.col("id").cast("int").alias("field"), F.when(F.col("id") <= 10, "Small").otherwise("Middle").alias("heading"), F.col("id").cast("int").alias("ordinal"))
    return export.grouped_for_display(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("field")), groups).select("p_partkey", "heading")


@query("red_text", r"""
SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(https?://[^\s?#''"]+)[?#][^\s''"]*', '\1?[redacted]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'),
  '(?i)(bearer|token|key|secret|password)([=: ]+)([^\s,;''"&(][^\s,;''"&]*)', '\1\2[redacted]', 'g'), '(?i)(\bcode=)[^\s,;''"&]+', '\1[redacted]', 'g'), 1, 500) AS text FROM documents""")  # fmt: skip
def red_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", TX.redact(F.col("text")).alias("text"))


@query("json_stable_keys", "SELECT event_id, sha256(event_type || chr(31) || CAST(user_id AS VARCHAR)) AS fingerprint FROM events")
def json_stable_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", money.stable_key(F.col("event_type"), F.col("user_id")).alias("fingerprint"))


@query("json_task_key", "SELECT event_id, event_type || ':' || md5(json_object('k', CAST(props->>'k' AS BIGINT))) AS task_key FROM events")
def json_task_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", money.json_key(F.col("event_type"), F.col("props")).alias("task_key"))


@query("json_extract_cast", "SELECT event_type, sum(CAST(props->>'k' AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def json_extract_cast(spark, sf_dir):
    """Survey: JSN1."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.variant_get(F.parse_json("props"), "$.k", "bigint")).alias("total"))


@query("json_provenance_kind", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'user' WHEN user_id % 3 = 0 THEN 'ai' WHEN user_id % 3 = 1 THEN 'derived' ELSE 'found' END AS kind FROM events")
def json_provenance_kind(spark, sf_dir):
    k = F.col("user_id") % 3
    return table(spark, sf_dir, "events").select("event_id", TX.provenance_kind(F.when(F.col("event_type") == "view", "user").otherwise("scan"), F.when(k == 1, "rule"), F.when(k == 0, "m")).alias("kind"))


@query("mth_backoff_and_cost", "SELECT p_partkey, least(300, 2 * pow(2, p_size - 1))::DOUBLE AS wait_s, CAST(ceil((p_partkey * 150000 + p_size * 600000) / 1000000.0) AS BIGINT) AS micros FROM part")
def mth_backoff_and_cost(spark, sf_dir):
    cost = money.token_cost_micros({"in": F.col("p_partkey"), "out": F.col("p_size")}, {"in": 150_000, "out": 600_000})
    return table(spark, sf_dir, "part").select("p_partkey", money.backoff_seconds(F.col("p_size")).alias("wait_s"), cost.alias("micros"))


@query("dat_retry_after", """
WITH p AS (SELECT o_orderkey, o_orderkey % 5 AS form, o_orderkey % 9000 AS s FROM orders)
SELECT o_orderkey, CASE form WHEN 0 THEN least(s, 3600) WHEN 1 THEN least(greatest(s - 3000, 0), 3600) WHEN 2 THEN least(s + 0.5, 3600) WHEN 3 THEN 0 END::DOUBLE AS wait_s FROM p""")
def dat_retry_after(spark, sf_dir):
    """Seconds, dates before and after now, fractions, negative numbers, words (DAT2)."""
    k = F.col("o_orderkey")
    s, form = k % 9000, k % 5
    now = F.lit("2015-10-21 07:28:00").cast("timestamp")
    at = F.timestamp_micros(F.unix_micros(now) + (s - 3000) * 1_000_000)
    date = F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    header = F.when(form == 0, s.cast("string")).when(form == 1, date).when(form == 2, F.concat(F.lit(" "), s, F.lit(".5 "))).when(form == 3, F.concat(F.lit("-"), s)).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", TX.retry_after(header, now).alias("wait_s"))


@query("mth_prompt_bound", "SELECT doc_id, CAST(ceil(((length(text) // 4 + 1) * 3.0 + (doc_id % 4096) * 15.0) / 1000000) AS BIGINT) AS micros FROM documents")
def mth_prompt_bound(spark, sf_dir):
    """The most a call with each text as its prompt can cost (MTH3)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", money.prompt_cost_bound(F.length("text"), F.col("doc_id") % 4096, {"input": 3.0, "output": 15.0}).alias("micros"))


@query("ups_stamp_exported", "SELECT o_orderkey AS lead_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2030-01-01' END AS exported_at FROM orders")
def ups_stamp_exported(spark, sf_dir):
    """Sent leads get the time once; those sent before keep theirs (SNK7)."""
    k = F.col("o_orderkey")
    leads = table(spark, sf_dir, "orders").select(k.alias("lead_id"), F.when(k % 5 == 0, F.col("o_orderdate")).alias("exported_at"))
    return graph.stamp_exported(leads, leads.where("lead_id % 3 = 0"), F.lit("2030-01-01").cast("timestamp"))


@query("json_display", f"SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '—' WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS flag, CASE WHEN c_custkey % 7 = 0 THEN '—' ELSE format('{{:,}}', c_custkey * 12345) END AS number, {sql_of(['a · b', 'a · —', ''], 'c_custkey')} AS list, printf('%.4f, %.4f', c_custkey / 8.0, -c_custkey / 16.0) AS place FROM customer")
def json_display(spark, sf_dir):
    """Values as people read them (JSN8)."""
    k = F.col("c_custkey")
    lists = F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(k % 3 == 1, F.array(F.lit("a"), F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    place = F.struct((k / 8.0).alias("lat"), (-k / 16.0).alias("lng"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", TX.shown(F.when(k % 9 != 0, k % 2 == 0), "boolean").alias("flag"), TX.shown(F.when(k % 7 != 0, k * 12345), "number").alias("number"), TX.shown(lists, "strings").alias("list"), TX.shown(place, "place").alias("place"),
    )


@query("flt_history_filters", f"SELECT doc_id, {sql_of(['queued', None, 'failed', None], 'doc_id')} AS status, nullif(substr(trim(text, ' '), 1, 200), '') AS term FROM documents")
def flt_history_filters(spark, sf_dir):
    """Unknown states are dropped, terms trimmed and cut (FLT24); the cut is the feature."""
    d = table(spark, sf_dir, "documents")
    f = TX.allowed_filters(of(["queued", "QUEUED", "failed", "' or 1"], F.col("doc_id")), F.concat(F.lit("  "), "text"))
    return d.select("doc_id", f.alias("f")).select("doc_id", "f.status", "f.term")


@query("ded_in_order", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'b,A,c' WHEN 1 THEN 'x' ELSE '' END AS folded, CASE o_orderkey % 3 WHEN 0 THEN 'b,A,a,B,c' WHEN 1 THEN 'x' ELSE '' END AS plain FROM orders")
def ded_in_order(spark, sf_dir):
    """Distinct values in their first order, with and without regard to case (DED2)."""
    k = F.col("o_orderkey") % 3
    rows = F.when(k == 0, F.split(F.lit("b,A,a,B,b,c,A"), ",")).when(k == 1, F.split(F.lit("x,x"), ",")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(TX.distinct_in_order(rows, fold=True), ",").alias("folded"), F.array_join(TX.distinct_in_order(rows), ",").alias("plain"))


@query("nrm_opening_hours", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Mo,Tu 09:00-17:00; Sa 10:00-12:00' WHEN 1 THEN 'Su 1' || s_suppkey % 9 || ':00-20:00' END AS hours FROM supplier")
def nrm_opening_hours(spark, sf_dir):
    """Days and times on one line; a specification that lacks a part says nothing (NRM21)."""
    k = F.col("s_suppkey")
    spec = lambda days, opens, closes: F.struct(F.array(*map(F.lit, days)).cast("array<string>").alias("days"), opens.alias("opens"), F.lit(closes).alias("closes"))
    specs = (
        F.when(k % 4 == 0, F.array(spec(["https://schema.org/Monday", "Tuesday"], F.lit("09:00"), "17:00"), spec(["Saturday"], F.lit("10:00"), "12:00")))
        .when(k % 4 == 1, F.array(spec(["Sunday"], F.concat(F.lit("1"), k % 9, F.lit(":00")), "20:00"), spec(["Monday"], F.lit(""), "12:00"))).when(k % 4 == 2, F.array(spec([], F.lit("1"), "2")))
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", TX.opening_hours(specs).alias("hours"))


@query("flt_tenant_rows", "SELECT c_custkey FROM customer WHERE c_nationkey = 5")
def flt_tenant_rows(spark, sf_dir):
    """Rows of one tenant; a query without a tenant adds none."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("org_id"))
    return guards.tenant_rows(c, "5").unionAll(guards.tenant_rows(c, None)).select("c_custkey")


GRANTS = {
    "read": "owner admin member viewer billing", "research": "owner admin member", "export": "owner admin member", "billing": "owner billing",
    "members": "owner admin", "settings": "owner admin", "delete": "owner", "audit": "owner admin",
}


@query("flt_role_matrix", "SELECT c_custkey, list_contains(string_split(CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GRANTS.items()) + """ END, ' '), r) AS allowed FROM (
  SELECT c_custkey, ['owner', 'admin', 'member', 'viewer', 'billing', 'guest'][1 + c_custkey % 6] AS r, ['read', 'research', 'export', 'billing', 'members', 'settings', 'delete', 'audit'][1 + c_custkey // 6 % 8] AS p FROM customer)""")
def flt_role_matrix(spark, sf_dir):
    """Every role, and one that there is not, against every permission (FLT26)."""
    k = F.col("c_custkey")
    of = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    permission = of(list(GRANTS), F.floor(k / 6) % 8)
    role = of(["owner", "admin", "member", "viewer", "billing", "guest"], k % 6)
    return table(spark, sf_dir, "customer").select("c_custkey", guards.allowed(role, permission).alias("allowed"))


BODIES = [
    ("<p>hello</p>", None, None), ("Checking your browser before accessing", "bot_challenge", "bot_challenge"), ("<p>reCAPTCHA here</p>", "captcha", "captcha"), ("", None, None),
    ("<input name=p type='password'>", "login_required", "login_required"), ("Subscribe to continue reading", "paywall", "paywall"), ("Verify you are human; captcha", "bot_challenge", "bot_challenge"), ("unusual traffic from your network", "bot_challenge", "bot_challenge"),
]
STATUSES = [(200, None), (403, "http_403"), (401, "http_401"), (404, None), (451, "legal_block"), (503, None), (429, None)]


@query("flt_restriction_reason", f"""
WITH p AS (SELECT page_id, page_id % 3 = 0 AS challenged, {sql_of([s for s, _ in STATUSES], 'page_id')} AS status, {sql_of([r for _, r in STATUSES], 'page_id')} AS by_status, {sql_of([r for _, r, _ in BODIES], 'page_id // 7')} AS by_body FROM pages)
SELECT page_id, CASE WHEN challenged AND status = 429 THEN 'rate_limit_challenge' WHEN challenged THEN 'bot_challenge:x-datadome' ELSE coalesce(by_status, by_body) END AS reason FROM p""")  # fmt: skip
def flt_restriction_reason(spark, sf_dir):
    """Seven states, eight bodies and a challenging header in all combinations (FLT20)."""
    k = F.col("page_id")
    headers = F.when(k % 3 == 0, F.array(F.lit("x-datadome"), F.lit("server"))).otherwise(F.array(F.lit("server")))
    return table(spark, sf_dir, "pages").select("page_id", TX.restriction_reason(of([s for s, _ in STATUSES], k), headers, of([b for b, _, _ in BODIES], F.floor(k / 7))).alias("reason"))


GUARDED = [
    ("http://169.254.169.254/x", "metadata"), ("http://[::ffff:10.0.0.1]/", "address"), ("ftp://example.org/", "scheme"), ("https://a:b@example.org/", "userinfo"), ("https://example.org/a?b", None), ("http://8.8.8.8/", None),
    ("http://127.0.0.1:80/", "address"), ("http://192.168.1.1/", "address"), ("http://LOCALHOST/", "local"), ("http://db.internal/", "local"), ("http://[fe80::1]/", "address"), ("http:///x", "host"), ("file:///etc", "scheme"),
    ("http://metadata.google.internal/", "metadata"), ("http://[2606:4700::1111]/", None), ("http://[bad/", "unparsable"), ("http://172.31.0.9/", "address"), ("http://172.32.0.9/", None),
]


@query("flt_url_guard", f"SELECT page_id, {sql_of([r for _, r in GUARDED], 'page_id')} AS reason FROM pages")
def flt_url_guard(spark, sf_dir):
    """Eighteen addresses with the reasons that a reader gave them (FLT19)."""
    return guards.with_url_rejection(table(spark, sf_dir, "pages"), of([u for u, _ in GUARDED], F.col("page_id"))).select("page_id", "reason")


ROBOTS = """# all robots
User-agent: *
Disallow: /de/   # nothing here
Crawl-delay: 5

User-agent: Other
User-Agent: Tessera
Disallow: /en/
Allow: /en/1
Disallow: /*?page=
Allow: /fr/*.html$
Disallow: /fr/
Sitemap: https://example.org/map
Crawl-delay: 2"""


@query("flt_robots_rules", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM pages),
o AS (SELECT page_id, path, unnest([{'n': 4, 'a': false, 'f': path LIKE '/en/%'}, {'n': 5, 'a': true, 'f': path LIKE '/en/1%'}, {'n': 8, 'a': false, 'f': path LIKE '/%?page=%'}, {'n': 11, 'a': true, 'f': path LIKE '/fr/%.html'}, {'n': 4, 'a': false, 'f': path LIKE '/fr/%'}]) AS r FROM p),
t AS (SELECT page_id, arg_max(r.a, r.n) FILTER (r.f) AS own FROM o GROUP BY page_id)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN coalesce(own, true) WHEN 1 THEN path NOT LIKE '/de/%' WHEN 2 THEN true ELSE false END AS allowed,
  CASE page_id % 4 WHEN 0 THEN CASE WHEN coalesce(own, true) THEN 'robots_allow' ELSE 'robots_disallow' END WHEN 1 THEN CASE WHEN path NOT LIKE '/de/%' THEN 'robots_allow' ELSE 'robots_disallow' END WHEN 2 THEN 'robots_absent' ELSE 'robots_unavailable' END AS reason,
  CASE page_id % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 5.0 END::DOUBLE AS crawl_delay FROM p JOIN t USING (page_id)""")
def flt_robots_rules(spark, sf_dir):
    """An agent with a group of its own, one without, a file that is not there and one that cannot be had."""
    k = F.col("page_id") % 4
    status = F.when(k < 2, 200).when(k == 2, 404).otherwise(503)
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^#]*)", 1)
    text = F.lit(ROBOTS)
    named, other = (guards.robots_decision(status, text, agent, path) for agent in ("tessera/1.0", "unheard"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(k == 1, other).otherwise(named).alias("d")).select("page_id", "d.*")


@query("pln_specs_and_feasibility", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'filters.industry,filters.location' WHEN 1 THEN 'filters.location,filters.has_website,filters.employee_count' ELSE '' END AS filters, CASE c_custkey % 3 WHEN 2 THEN 'not an object' ELSE '' END AS problems FROM customer")
def pln_specs_and_feasibility(spark, sf_dir):
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, '{"intent": "x", "country": "IN", "industries": ["a"]}').when(k == 1, '{"intent": "x", "cities": ["b"], "has_website": false, "employees_gte": 9, "employees_lte": 2}').otherwise("[broken")
    specs = research.parse_specs(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.alias("value")))
    used = research.feasibility(specs).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "filter"))), lambda x: x["filter"]), ",").alias("filters"))
    return specs.join(used, "id", "left").select("id", F.coalesce("filters", F.lit("")).alias("filters"), F.array_join("problems", ",").alias("problems"))


@query("pln_resolve_places", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN 'country' ELSE 'nation_' || c_custkey % 25 END AS slug, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 25 <> 24 THEN 'Nowhere' END AS unknown FROM customer WHERE c_custkey % 3 <> 1
UNION ALL SELECT c_custkey, 'nation_' || c_custkey % 25, NULL FROM customer WHERE c_custkey % 3 = 1""")  # fmt: skip
def pln_resolve_places(spark, sf_dir):
    """Two names of one area count once, unknown names are told, no name means the country (PLN2)."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("NATION_"), k % 25)
    cities = F.when(k % 3 == 0, F.when(k % 25 != 24, F.array(F.lit("Nowhere"), name)).otherwise(F.array(name))).when(k % 3 == 1, F.array(name, F.concat(F.lit("Old Town "), k % 25), F.concat(name, F.lit(" District"))))
    specs = table(spark, sf_dir, "customer").select(k.alias("id"), F.lit("IN").alias("country"), cities.alias("cities"), F.array().cast("array<string>").alias("states"))
    whole = spark.sql("SELECT 'IN' country, 'country' slug, 'country' kind, 9 population, 'India' name, array('IN') aliases")
    known, unknown = research.resolve_places(specs, geography(spark, sf_dir).unionByName(whole))
    return known.join(unknown, "id", "left").select("id", "slug", F.col("name").alias("unknown"))


@query("pln_build_plan", """
WITH s AS (SELECT c_custkey AS id, c_custkey % 4 AS form, c_custkey % 40 AS credits FROM customer),
p AS (SELECT *, CASE form WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 0 END AS wanted, credits * 8 // 10 AS pot FROM s),
t AS (SELECT *, least(wanted, pot // 2) AS planned FROM p)
SELECT id, planned, CASE WHEN planned > 0 THEN pot ELSE 0 END AS credits, CASE WHEN form = 3 THEN 'Nowhere' ELSE '' END AS unknown, CASE WHEN form = 0 THEN 'fax' ELSE '' END AS unsatisfiable, wanted > planned AS limited,
  CASE WHEN form > 1 THEN 'no searchable place in this request' WHEN wanted > planned THEN (wanted - planned) || ' searches not planned: the credits do not fund them' ELSE '' END AS notes FROM t""")  # fmt: skip
def pln_build_plan(spark, sf_dir):
    """Requests with one place, two, none and an unknown one, each with its own credits (PLN1, PLN3-5)."""
    k = F.col("c_custkey")
    form, name = k % 4, F.concat(F.lit("NATION_"), k % 24)
    cities = F.when(form == 0, F.array(name)).when(form == 1, F.array(name, F.concat(F.lit("NATION_"), k % 24 + 1))).when(form == 3, F.array(F.lit("Nowhere")))
    specs = table(spark, sf_dir, "customer").select(k.alias("id"), F.lit("find").alias("intent"), F.when(form != 2, "IN").alias("country"), cities.alias("cities"), F.lit(None).cast("array<string>").alias("states"), (k % 40).alias("max_credits"))
    queries = specs.select("id", F.posexplode(F.array(F.lit("gym"), F.lit("yoga"))).alias("query_pos", "query"))
    sources = spark.sql("""SELECT * FROM VALUES ('osm', 30000, true, 'green', false, true, array('phone')), ('google_places', 90000, true, 'green', false, true, array('phone')),
        ('secret', 1, true, 'red', false, true, array('fax')), ('site', 1, true, 'green', false, false, array('email')) AS t(key, cost_micros, enabled, tos_class, legal_approved, discovers, fields_provided)""")
    fields = specs.select("id", F.explode(F.when(F.col("id") % 4 == 0, F.array(F.lit("phone"), F.lit("fax"))).otherwise(F.array(F.lit("email")))).alias("field"))
    templates = spark.sql("SELECT 'find' intent, 0.8D share, 6 most")
    local = spark.sql("SELECT '' area, '' locality, 0 locality_pos WHERE false")
    tasks, plans = research.build_plan(specs, geography(spark, sf_dir), queries, local, sources, fields, templates, 20_000)
    got = tasks.groupBy("id").agg(F.count("*").alias("planned"), F.sum("credit_budget").alias("credits"))
    joined = lambda c: F.array_join(c, ",")
    out = plans.join(got, "id", "left").select("id", F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("credits", F.lit(0)).alias("credits"), joined("unknown_places").alias("unknown"), joined("unsatisfiable").alias("unsatisfiable"), F.col("budget_limited").alias("limited"), joined("notes").alias("notes"))
    return out


@query("pln_cross_searches", """
WITH w AS (SELECT r_regionkey AS id, n_name AS area, q AS query, NULL AS locality, 0 AS a, n_nationkey AS b, i AS c, 0 AS d FROM region JOIN nation ON n_regionkey = r_regionkey, (VALUES ('x', 0), ('y', 1)) AS t(q, i)
  UNION ALL SELECT r_regionkey, n_name, 'x', l, 1, n_nationkey, 0, j FROM region JOIN nation ON n_regionkey = r_regionkey, (VALUES ('l0', 0), ('l1', 1)) AS t(l, j) WHERE n_nationkey % 2 = 0)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY a, b, c, d) AS "at", area, query, locality FROM w QUALIFY "at" <= 14""")  # fmt: skip
def pln_cross_searches(spark, sf_dir):
    """Areas times queries first, then each city's localities, up to the template's cap."""
    specs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"))
    areas = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("id"), F.col("n_name").alias("area"), F.col("n_nationkey").alias("area_pos"), (F.col("n_nationkey") % 2 == 0).alias("is_city"))
    asked = specs.select("id", F.explode(F.array(F.struct(F.lit("x").alias("query"), F.lit(0).alias("query_pos")), F.struct(F.lit("y").alias("query"), F.lit(1).alias("query_pos")))).alias("q")).select("id", "q.*")
    local = areas.where("is_city").select("area", F.explode(F.array(F.struct(F.lit("l0").alias("locality"), F.lit(0).alias("locality_pos")), F.struct(F.lit("l1").alias("locality"), F.lit(1).alias("locality_pos")))).alias("l")).select("area", "l.*")
    return research.searches(specs, areas, asked, local, F.lit(14)).withColumn("at", F.col("at").cast("long"))


@query("pln_funded_tasks", 'WITH s AS (SELECT n_regionkey AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS "at" FROM nation), f AS (SELECT * FROM s WHERE "at" <= (20 + id) * 8 // 10 // 5) SELECT id, "at", (20 + id) * 8 // 10 // count(*) OVER (PARTITION BY id) + CASE WHEN "at" <= ((20 + id) * 8 // 10) % count(*) OVER (PARTITION BY id) THEN 1 ELSE 0 END AS credit_budget FROM f')
def pln_funded_tasks(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("id"), F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("at"), F.col("n_name").alias("area"), F.lit("q").alias("query"), F.lit(None).cast("string").alias("locality"))
    specs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), (F.lit(20) + F.col("r_regionkey")).alias("max_credits"))
    return research.funded_tasks(rows, specs, 0.8, 5).select("id", F.col("at").cast("long").alias("at"), "credit_budget")


@query("pln_charge", "SELECT o_orderkey AS task_id, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN (o_orderkey % 7) * 5 ELSE (o_orderkey % 7) * 2 END AS credits FROM orders")
def pln_charge(spark, sf_dir):
    """A source's rate outranks the depth's, also where it is zero."""
    k = F.col("o_orderkey")
    done = table(spark, sf_dir, "orders").select(k.alias("task_id"), (k % 7).alias("new_leads"), F.when(k % 3 == 0, "free").when(k % 3 == 1, "dear").otherwise("unlisted").alias("source"), F.lit("deep").alias("depth"))
    rates = spark.sql("SELECT * FROM VALUES ('source', 'free', 0), ('source', 'dear', 5), ('depth', 'deep', 2) AS t(scope, key, credits_per_unit)")
    return research.charge(done, rates).select("task_id", "credits")


@query("agg_due_jobs", "SELECT o_orderkey AS job_id, o_custkey AS org_id FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 3 <> 0 ORDER BY o_orderdate, o_orderkey LIMIT 50")
def agg_due_jobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("org_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return reports.due_jobs(o, o.where("job_id % 3 = 0"), ["F", "P"], 50).select("job_id", "org_id")


@query("jn_workspace_members", "SELECT c_custkey AS user_id, c_name AS email, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS name FROM customer")
def jn_workspace_members(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("user_id", F.col("c_custkey"))
    return reports.workspace_members(c.select("user_id"), c.select("user_id", F.col("c_name").alias("email")), c.where("user_id % 2 = 0").select("user_id", F.col("c_mktsegment").alias("name")))


@query("ups_bootstrap_org", "SELECT n_name AS name, lower(replace(n_name, '_', '-')) AS slug, 'owner' AS role, 100 AS delta FROM nation")
def ups_bootstrap_org(spark, sf_dir):
    rows = graph.bootstrap_org(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("user_id"), F.col("n_name").alias("org_name")), 100)
    joined = rows["organizations"].join(rows["memberships"].withColumnRenamed("org_id", "id"), "id").join(rows["credit_ledger"].withColumnRenamed("org_id", "id"), "id")
    return joined.select("name", "slug", "role", F.col("delta").cast("int").alias("delta"))


@query("snk_audit_append", "SELECT CAST(o_custkey AS VARCHAR) AS actor, 'lead.export' AS action, CAST(o_orderkey AS VARCHAR) AS target, '{\"status\":\"' || o_orderstatus || '\"}' AS meta FROM orders")
def snk_audit_append(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return graph.audit_entries(o, F.col("o_custkey").cast("string"), "lead.export", F.col("o_orderkey"), F.struct(F.col("o_orderstatus").alias("status")))


@query("flagship_best_value_reach", """
WITH v AS (SELECT l_orderkey, l_linenumber % 4 AS field, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 4 ORDER BY l_discount DESC, l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem),
c AS (SELECT l_orderkey, bool_or(field = 0) AS f0, bool_or(field = 1) AS f1 FROM v WHERE rn = 1 GROUP BY 1)
SELECT o_orderpriority, count(*) AS leads, count(*) FILTER (f0) AS with_0, count(*) FILTER (f1) AS with_1 FROM orders LEFT JOIN c ON o_orderkey = l_orderkey GROUP BY 1""")  # fmt: skip
def flagship(spark, sf_dir):
    """Best current value of each entity, marks for each channel, and reach by priority."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("entity_id"), (F.col("l_linenumber") % 4).cast("string").alias("field"), F.col("l_discount").alias("confidence"), F.col("l_shipdate").alias("observed_at"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), F.lit(True).alias("is_current"))
    marks = reports.channel_marks(ranking.best_values(rows), ["0", "1"])
    leads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("company_id"), "o_orderpriority").join(marks, "company_id", "left")
    reach = [F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(f"with_{c}") for c in ("0", "1")]
    return leads.groupBy("o_orderpriority").agg(F.count("*").alias("leads"), *reach)

