"""Best values, resolution, upserts, delivery, retention, joins and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph, ranking, reports
from tessera.registry import query, table


def values(spark, sf_dir):
    """lineitem as observed values."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").alias("field"), F.col("l_partkey").alias("value"), F.col("l_suppkey").alias("source_id"),
        F.col("l_discount").alias("confidence"), F.col("l_shipdate").alias("observed_at"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("id"),
    )


V = "SELECT l_orderkey AS entity_id, l_linenumber AS field, l_partkey AS value, l_suppkey AS source_id, l_discount AS confidence, l_shipdate AS observed_at, l_extendedprice AS price, l_quantity AS qty FROM lineitem"


@query("win_best_value", f"SELECT entity_id, value, confidence FROM ({V}) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, observed_at DESC, value, price, qty) = 1")
def win_best_value(spark, sf_dir):
    """The best of each entity's values: highest confidence, then newest, then smallest id."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("entity_id"), F.lit("all").alias("field"), F.col("l_partkey").alias("value"), F.col("l_discount").alias("confidence"), F.col("l_shipdate").alias("observed_at"), F.struct("l_partkey", "l_extendedprice", "l_quantity").alias("id"))
    return ranking.best_values(rows).select("entity_id", "value", "confidence")


@query("win_best_map", f"SELECT entity_id, count(DISTINCT field) AS n_fields, CAST(sum(value) FILTER (rn = 1) AS BIGINT) AS checksum FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY confidence DESC, observed_at DESC, value, source_id) AS rn FROM ({V})) GROUP BY entity_id")
def win_best_map(spark, sf_dir):
    rows = values(spark, sf_dir).withColumn("id", F.struct("value", "source_id"))
    best = ranking.best_map(rows)
    return best.select("entity_id", F.size("best").cast("long").alias("n_fields"), F.aggregate(F.map_values("best"), F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"))


@query("win_first_per_key", "SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey")
def win_first_per_key(spark, sf_dir):
    first = ranking.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.asc("o_orderkey")])
    return first.select("o_custkey", F.col("o_orderkey").alias("first_order"))


@query("win_running_balance", "SELECT o_orderkey, sum(o_orderkey % 7 - 3) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS balance_after FROM orders")
def win_running_balance(spark, sf_dir):
    ledger = table(spark, sf_dir, "orders").withColumn("delta", F.col("o_orderkey") % 7 - 3)
    return ranking.running_balance(ledger, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "balance_after")


@query("ups_supersede_current", "SELECT l_orderkey, l_linenumber, count(*) AS n, max(l_suppkey) FILTER (rn = 1) AS current_source FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem) GROUP BY l_orderkey, l_linenumber")
def ups_supersede_current(spark, sf_dir):
    """The last written value of a field stays current, whatever its confidence or source."""
    rows = table(spark, sf_dir, "lineitem").withColumns({"batch": F.col("l_shipdate"), "ordinal": F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "f": F.col("l_linenumber") % 2})
    now = ranking.with_current(rows, ["l_orderkey", "f"])
    return now.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.max(F.when(F.col("is_current"), F.col("l_suppkey"))).alias("current_source"))


@query("ups_supersede_by_source", "SELECT l_orderkey, count(*) FILTER (rn = 1) AS current_values FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS rn FROM lineitem) GROUP BY l_orderkey")
def ups_supersede_by_source(spark, sf_dir):
    """The documented option: every source keeps a current value of its own."""
    rows = table(spark, sf_dir, "lineitem").withColumns({"batch": F.col("l_shipdate"), "ordinal": F.col("l_linenumber")})
    return ranking.with_current(rows, ["l_orderkey", "l_suppkey"]).groupBy("l_orderkey").agg(F.count_if("is_current").alias("current_values"))


@query("ups_coalesce_merge", """
WITH s AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS bal, c_nationkey FROM customer WHERE c_custkey % 3 <> 0),
b AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN upper(c_name) END AS c_name, c_acctbal + 1 AS bal, c_nationkey + 100 AS c_nationkey FROM customer WHERE c_custkey % 3 <> 1)
SELECT c_custkey, coalesce(b.c_name, s.c_name) AS c_name, coalesce(b.bal, s.bal) AS bal, CAST(coalesce(s.c_nationkey, b.c_nationkey) AS INT) AS c_nationkey FROM s FULL JOIN b USING (c_custkey)""")  # fmt: skip
def ups_coalesce_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    state = c.where(k % 3 != 0).select("c_custkey", "c_name", F.when(k % 2 == 0, F.col("c_acctbal")).alias("bal"), "c_nationkey")
    batch = c.where(k % 3 != 1).select("c_custkey", F.when(k % 5 != 0, F.upper("c_name")).alias("c_name"), (F.col("c_acctbal") + 1).alias("bal"), (F.col("c_nationkey") + 100).alias("c_nationkey"))
    return graph.upsert(state, batch, "c_custkey", ["c_name", "bal"], ["c_nationkey"])


@query("ups_company_resolution", """
WITH c AS (SELECT p.page_id AS ordinal, CASE WHEN page_id % 4 = 0 THEN NULL ELSE CAST(page_id % 50 AS VARCHAR) END AS place_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS domain FROM pages p),
l AS (SELECT *, coalesce('p' || place_id, '#' || ordinal) AS place FROM c),
d AS (SELECT *, first_value(domain) OVER (PARTITION BY place ORDER BY ordinal) AS lead_domain FROM l),
r AS (SELECT ordinal, CASE WHEN place_id IN ('1', '2', '3') THEN 'known-' || place_id WHEN lead_domain LIKE 'blog.%' THEN 'host-' || lead_domain ELSE 'd' || lead_domain END AS company, place_id IS NULL OR place_id NOT IN ('1', '2', '3') AND lead_domain NOT LIKE 'blog.%' AS x FROM d)
SELECT ordinal, min(ordinal) OVER (PARTITION BY company) AS first_of_company FROM r""")  # fmt: skip
def ups_company_resolution(spark, sf_dir):
    """Known places, then the domain of each place's first candidate, decide whose company a candidate is."""
    from pyspark.sql import Window as W

    p = table(spark, sf_dir, "pages")
    rows = p.select(F.col("page_id").alias("ordinal"), F.when(F.col("page_id") % 4 != 0, (F.col("page_id") % 50).cast("string")).alias("place_id"), "url", F.lit("n").alias("name"))
    known = spark.sql("SELECT * FROM VALUES ('1', 'known-1'), ('2', 'known-2'), ('3', 'known-3') AS t(place_id, company_id)")
    hosts = rows.select(F.regexp_replace(F.regexp_extract("url", "^https?://([^/?#]+)", 1), r"^www\.", "").alias("domain")).where("domain LIKE 'blog.%'").distinct().withColumn("company_id", F.concat(F.lit("host-"), "domain"))
    out = graph.resolve_companies(rows, known, hosts)
    return out.select("ordinal", F.min("ordinal").over(W.partitionBy("company_id")).alias("first_of_company"))


@query("ups_record_domains", "SELECT DISTINCT page_id % 7 AS company_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS domain, true AS is_primary FROM pages WHERE regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') NOT LIKE 'm.%'")
def ups_record_domains(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("company_id"), "url")
    from tessera.functions import normalize as N

    state = p.select("company_id", N.registrable_domain(F.col("url")).alias("domain")).where("domain LIKE 'm.%'").distinct()
    return graph.record_domains(p, state).select("company_id", "domain", "is_primary")


@query("ups_deliver_is_new", "SELECT o_custkey, o_custkey % 3 <> 0 AS is_new FROM (SELECT DISTINCT o_custkey FROM orders)")
def ups_deliver_is_new(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey")
    return graph.deliver(o, o.where("o_custkey % 3 = 0"), ["o_custkey"])


@query("ups_link_once", "SELECT o_custkey % 10 AS job_id, o_custkey AS lead_id FROM orders WHERE o_custkey % 2 = 1 GROUP BY 1, 2")
def ups_link_once(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("job_id"), F.col("o_custkey").alias("lead_id"))
    return graph.insert_new(o.where("lead_id % 2 = 0"), o, ["job_id", "lead_id"], [F.asc("lead_id")])


@query("ups_task_upsert", "SELECT DISTINCT user_id % 20 AS job_id, event_type AS task_key, user_id % 20 >= 10 AS inserted FROM events")
def ups_task_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("job_id"), F.col("event_type").alias("task_key"))
    return graph.upsert_tasks(e.where("job_id < 10"), e)


@query("ups_finish_jobs", "SELECT o_custkey AS job_id FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'O') = 0")
def ups_finish_jobs(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderstatus").alias("status"))
    return graph.finished_jobs(tasks, ["O"])


@query("ups_state_guard", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F') THEN 'F' ELSE 'running' END AS status FROM orders")
def ups_state_guard(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", graph.guarded_status(F.col("o_orderstatus"), F.lit("running"), ["F"]).alias("status"))


@query("ups_change_role", "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey = 7 AND (SELECT count(*) FROM customer x WHERE x.c_nationkey = c.c_nationkey AND x.c_custkey % 10 = 7) > 1 THEN 'viewer' WHEN c_custkey % 10 = 7 THEN 'owner' ELSE 'member' END AS role FROM customer c")
def ups_change_role(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    members = c.select("c_custkey", "c_nationkey", F.col("c_nationkey").alias("org_id"), F.col("c_custkey").cast("string").alias("user_id"), F.when(F.col("c_custkey") % 10 == 7, "owner").otherwise("member").alias("role"))
    return graph.change_role(members, "7", "viewer").select("c_custkey", "c_nationkey", "role")


@query("ded_unit_key", "SELECT event_id FROM events WHERE user_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def ded_unit_key(spark, sf_dir):
    """Only the first event of a unit key counts, and none of a key that was claimed before."""
    e = table(spark, sf_dir, "events")
    twice = e.unionAll(e.where("event_id % 3 = 0"))
    return graph.claim_units(twice, e.where("user_id % 4 = 0"), ["user_id", "event_type"], ["event_id"]).select("event_id")


@query("raw_content_dedupe", "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS owner_id, doc_id <> first_value(doc_id) OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS deduplicated FROM documents")
def raw_content_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    fetches = d.select("doc_id", F.col("doc_id").alias("id"), F.col("source").alias("url_hash"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("fetched_at"))
    return graph.duplicates_by_content(fetches).select("doc_id", "owner_id", "deduplicated")


@query("jn_left_anti_retention", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate < (SELECT max(l_shipdate) FROM lineitem) - to_days(CAST(365 * (1 + s_nationkey % 3) AS INT))")
def jn_left_anti_retention(spark, sf_dir):
    v = values(spark, sf_dir).withColumn("l_linenumber", F.col("field")).withColumn("l_orderkey", F.col("entity_id"))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), (365 * (1 + F.col("s_nationkey") % 3)).alias("retention_days"))
    now = v.agg(F.max("observed_at")).first()[0]
    return graph.expired(v, sources, F.lit(now)).select("l_orderkey", "l_linenumber")


@query("agg_bool_and_having", "SELECT o_custkey AS company_id FROM orders GROUP BY o_custkey HAVING bool_and(o_orderstatus <> 'O' AND o_orderdate < TIMESTAMP '1997-01-01')")
def agg_bool_and_having(spark, sf_dir):
    leads = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("exported_at"))
    return graph.fully_exported(leads, F.lit("1997-01-01").cast("timestamp"))


@query("ups_prune_exported", "SELECT count(*) AS kept FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_and(o_orderstatus <> 'O'))")
def ups_prune_exported(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    done = graph.fully_exported(o.select(F.col("o_custkey").alias("company_id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("exported_at")), F.lit("2999-01-01").cast("timestamp"))
    v = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("entity_id"))
    return graph.prune(v, done).agg(F.count("*").alias("kept"))


@query("jn_one_row_per_lead", "SELECT o_orderkey, c_name, first_line FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def jn_one_row_per_lead(spark, sf_dir):
    from tessera.operators import export

    leads = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("company_id"), "o_custkey")
    companies = leads.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("company_id", "c_name")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("company_id"), F.col("l_linenumber").alias("location_id"))
    return export.page_of_leads(leads, companies, lines).select("o_orderkey", "c_name", F.col("location_id").alias("first_line"))


@query("jn_exists_marks", "SELECT l_orderkey AS company_id, bool_or(l_linenumber = 1) AS \"1\", bool_or(l_linenumber = 3) AS \"3\" FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey")
def jn_exists_marks(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").cast("string").alias("field"), (F.col("l_returnflag") != "R").alias("is_current"))
    return reports.channel_marks(v, ["1", "3"])


@query("jn_values_per_source", "SELECT s_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderstatus = 'F' GROUP BY s_name")
def jn_values_per_source(spark, sf_dir):
    """Survey: JN4, JN7, JN15."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    per = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return per.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_name").agg(F.sum("n").alias("n"))


@query("jn_recent_runs", "SELECT c_custkey, count(o_orderkey) AS links, count(o_orderkey) FILTER (o_orderstatus = 'O') AS new_links FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def jn_recent_runs(spark, sf_dir):
    """Counts are taken before the left join, so that no link multiplies a run. Survey: JN5, JN6, JN14."""
    links = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("links"), F.count_if(F.col("o_orderstatus") == "O").alias("new_links"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(links, "c_custkey", "left").fillna(0, ["links", "new_links"])


@query("jn_parent_slug", "SELECT n_nationkey, r_regionkey AS parent_id FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 1000 + r_regionkey, NULL FROM region")
def jn_parent_slug(spark, sf_dir):
    from tessera.sources import places

    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("n_nationkey"), F.col("r_regionkey").alias("id"), F.concat(F.lit("r"), "r_regionkey").alias("slug"), F.lit(None).cast("string").alias("parent_slug"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(None).cast("int").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("slug"), F.concat(F.lit("r"), "n_regionkey").alias("parent_slug"))
    return places.link_parents(r.unionByName(n)).select("n_nationkey", "parent_id")


@query("jn_unknown_slugs", "SELECT DISTINCT c_mktsegment AS slug FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def jn_unknown_slugs(spark, sf_dir):
    """Survey: FLT27."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("slug")).distinct()
    known = spark.sql("SELECT * FROM VALUES ('BUILDING'), ('MACHINERY') AS t(slug)")
    return asked.join(known, "slug", "left_anti")


@query("srt_keyset_page", "SELECT o_orderkey, (SELECT min(k) FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey < 9000 ORDER BY 1 DESC LIMIT 25)) AS next_cursor FROM orders WHERE o_orderkey < 9000 ORDER BY o_orderkey DESC LIMIT 25")
def srt_keyset_page(spark, sf_dir):
    page, _ = ranking.keyset_page(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 25, 9000)
    return page


@query("srt_keyset_clamped", "SELECT c_custkey FROM customer WHERE c_custkey > 10 ORDER BY c_custkey LIMIT 200")
def srt_keyset_clamped(spark, sf_dir):
    page, _ = ranking.keyset_page(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 9999, 10, descending=False)
    return page.select("c_custkey")


@query("srt_offset_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 40 OFFSET 30")
def srt_offset_page(spark, sf_dir):
    return ranking.offset_page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 30, 40)


@query("srt_split_budget", "SELECT o_orderkey, 1000 // count(*) OVER w + CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 1000 % count(*) OVER w THEN 1 ELSE 0 END AS share FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def srt_split_budget(spark, sf_dir):
    return ranking.split_budget(table(spark, sf_dir, "orders"), ["o_orderkey"], F.lit(1000), ["o_custkey"]).select("o_orderkey", "share")


@query("srt_affordable_prefix", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 4")
def srt_affordable_prefix(spark, sf_dir):
    return ranking.affordable_prefix(table(spark, sf_dir, "orders"), ["o_orderkey"], 100, 20, 0.8, ["o_custkey"]).select("o_orderkey")


@query("pln_headroom_cap", "SELECT l_orderkey, l_linenumber, greatest(0, least(l_quantity::BIGINT, 60 - coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS granted FROM lineitem")
def pln_headroom_cap(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("wanted", F.col("l_quantity").cast("long"))
    return ranking.capped_by_headroom(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "wanted", F.lit(60)).select("l_orderkey", "l_linenumber", F.col("granted").cast("long").alias("granted"))


@query("json_task_tree", """
WITH RECURSIVE t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey < 7 OR o_orderkey % 997 = 0 THEN NULL WHEN o_orderkey % 991 = 0 THEN o_orderkey WHEN o_orderkey % 983 = 0 THEN -o_orderkey
    WHEN o_orderkey % 977 = 8 THEN o_orderkey + 1 WHEN o_orderkey % 977 = 9 THEN o_orderkey - 1 ELSE o_orderkey - 7 END AS parent FROM orders),
k AS (SELECT id, CASE WHEN parent IN (SELECT id FROM t) AND parent <> id THEN parent END AS parent FROM t),
w AS (SELECT id, id AS root_id, 0::BIGINT AS level FROM k WHERE parent IS NULL UNION ALL SELECT k.id, w.root_id, w.level + 1 FROM w JOIN k ON k.parent = w.id)
SELECT id, root_id, level FROM w""")  # fmt: skip
def json_task_tree(spark, sf_dir):
    """Seven chains over all orders, cut by roots, tasks that are their own parent, orphans and pairs in a circle."""
    k = F.col("o_orderkey")
    parent = (
        F.when((k < 7) | (k % 997 == 0), None).when(k % 991 == 0, k).when(k % 983 == 0, -k)
        .when(k % 977 == 8, k + 1).when(k % 977 == 9, k - 1).otherwise(k - 7)
    )
    return graph.task_tree(table(spark, sf_dir, "orders").select(k.alias("id"), parent.alias("parent_id")))
