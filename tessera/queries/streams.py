"""Event windows, limits and budgets, and facts from pages and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions import text as TX
from tessera.operators import extract, ranking
from tessera.queries.places import of, sql_of
from tessera.registry import query, table
from tessera.scratch import Scratch
from tessera.streaming import events as S


QUERY_BLOCK = 10_000


def streamed(spark, sf_dir, transform, mode="append"):
    """The rows that a transformation of the events stream has put out by its end."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = S.read_events(spark, f"{sf_dir}/*.parquet", raw, pathGlobFilter="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out, base = transform(stream), Scratch(spark, "stream").base
    schema = out.schema
    S.drain(out, f"{base}/checkpoint", lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out/batch={i}"), mode)
    return spark.read.schema(schema).parquet(f"{base}/out/*")


@query("str_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def str_tumbling(spark, sf_dir):
    return S.tumbling(table(spark, sf_dir, "events"), "1 day", ["event_type"])


@query("str_sliding_window", "SELECT date_trunc('hour', ts) - to_hours(CAST(k AS INT)) AS window_start, event_type, count(*) AS n FROM events, (VALUES (0), (1), (2)) AS v(k) GROUP BY 1, 2")
def str_sliding_window(spark, sf_dir):
    return S.sliding(table(spark, sf_dir, "events"), "3 hours", "1 hour", ["event_type"])


@query("str_session", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")  # fmt: skip
def str_session(spark, sf_dir):
    return S.sessions(table(spark, sf_dir, "events"), "6 hours", "user_id")


@query("str_dedupe", "SELECT event_id, user_id FROM events")
def str_dedupe(spark, sf_dir):
    """A real stream in which every event arrives twice; each key passes once."""
    twice = lambda s: S.once(s.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))), "event_id").select("event_id", "user_id")
    return streamed(spark, sf_dir, twice)


BUCKET_SQL = """
WITH RECURSIVE n AS (SELECT event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT event_type, event_id, us, i, 4.0::DOUBLE AS tokens, true AS allowed FROM n WHERE i = 1
  UNION ALL SELECT event_type, event_id, us, i, CASE WHEN full_ >= 1 THEN full_ - 1 ELSE full_ END, full_ >= 1
  FROM (SELECT n.*, least(5.0::DOUBLE, b.tokens + greatest(0, n.us - b.us) / 1000000::DOUBLE * 0.002::DOUBLE) AS full_ FROM b JOIN n ON n.event_type = b.event_type AND n.i = b.i + 1))
SELECT event_type AS key, event_id, round(tokens, 6) AS tokens, allowed FROM b"""


@query("str_token_bucket", BUCKET_SQL)
def str_token_bucket(spark, sf_dir):
    """A real stream with keyed state."""
    out = streamed(spark, sf_dir, lambda s: S.token_bucket(s, "event_type", 0.002, 5.0))
    return out.select("key", "event_id", F.round("tokens", 6).alias("tokens"), "allowed")


@query("str_token_bucket_twin", BUCKET_SQL)
def str_token_bucket_twin(spark, sf_dir):
    out = S.token_bucket(table(spark, sf_dir, "events"), "event_type", 0.002, 5.0)
    return out.select("key", "event_id", F.round("tokens", 6).alias("tokens"), "allowed")


@query("str_sliding_counter", """
WITH m AS (SELECT event_id, event_type, epoch_us(ts) // 60000000 AS minute, 60000000 - epoch_us(ts) % 60000000 AS rest, ts FROM events),
c AS (SELECT event_type, minute, count(*) AS n FROM m GROUP BY 1, 2)
SELECT event_id, used, used > 1 AS limited FROM (
  SELECT event_id, row_number() OVER (PARTITION BY m.event_type, m.minute ORDER BY ts, event_id) + coalesce(c.n, 0) * rest // 60000000 AS used
  FROM m LEFT JOIN c ON c.event_type = m.event_type AND c.minute = m.minute - 1)""")  # fmt: skip
def str_sliding_counter(spark, sf_dir):
    return S.sliding_counter(table(spark, sf_dir, "events"), "event_type", 1).select("event_id", "used", "limited")


@query("str_monthly_allowance", "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) <= 2 AS free FROM events")
def str_monthly_allowance(spark, sf_dir):
    return S.monthly_allowance(table(spark, sf_dir, "events"), "user_id", 2).select("event_id", "free")


@query("str_budget_cap", """
WITH RECURSIVE n AS (SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN -(event_id % 40) ELSE event_id % 97 END AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS event_id, 0::BIGINT AS i, 0::BIGINT AS spent, true AS accepted FROM events
  UNION ALL SELECT n.user_id, n.event_id, n.i, CASE WHEN n.cost <= 0 OR r.spent + n.cost <= 300 THEN r.spent + n.cost ELSE r.spent END, n.cost <= 0 OR r.spent + n.cost <= 300
  FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
SELECT event_id, spent, accepted FROM r WHERE i > 0""")  # fmt: skip
def str_budget_cap(spark, sf_dir):
    """Refused calls give their claim back, so cheaper ones after them may pass; every eleventh event is a release."""
    k = F.col("event_id")
    cost = F.when(k % 11 == 0, -(k % 40)).otherwise(k % 97)
    return S.within_budget(table(spark, sf_dir, "events"), "user_id", cost, 300).select("event_id", "spent", "accepted")


@query("str_host_slots", """
WITH n AS (SELECT event_id, user_id, ts, row_number() OVER w - 1 AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, max(ts - to_seconds(CAST(i * 7200 AS BIGINT))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + to_seconds(CAST(i * 7200 AS BIGINT)) AS due_at FROM n""")  # fmt: skip
def str_host_slots(spark, sf_dir):
    """One request of a host at a time, two hours apart."""
    return S.host_slots(table(spark, sf_dir, "events"), "user_id", 7200).select("event_id", "due_at")


@query("str_failure_routes", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'paused' WHEN event_type IN ('view', 'click') AND event_id % 9 < 5 THEN 'retry' ELSE 'dead' END AS route FROM events")
def str_failure_routes(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "budget").when(F.col("event_type") == "view", "transient").when(F.col("event_type") == "click", "rate_limited").otherwise("invalid")
    e = table(spark, sf_dir, "events").select("event_id", kind.alias("error_class"), (F.col("event_id") % 9).alias("attempts"))
    return S.routed(e).select("event_id", "route")


@query("str_due_retries", "SELECT event_id, ts + to_seconds(CAST(least(300, 2 * pow(2, event_id % 9 - 1)) AS BIGINT)) AS due_at FROM events WHERE event_type = 'view' AND event_id % 9 BETWEEN 1 AND 4 AND ts + to_seconds(CAST(least(300, 2 * pow(2, event_id % 9 - 1)) AS BIGINT)) <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def str_due_retries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 1 DAY")
    failed = e.where("event_id % 9 > 0").select("event_id", F.when(F.col("event_type") == "view", "transient").otherwise("invalid").alias("error_class"), (F.col("event_id") % 9).alias("attempts"), F.col("ts").alias("failed_at"))
    return S.due_retries(failed, now).select("event_id", "due_at")


@query("str_cancelled_jobs", "SELECT event_id FROM events WHERE user_id % 6 <> 0")
def str_cancelled_jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"))
    return S.not_cancelled(e, e.where("job_id % 6 = 0")).select("event_id")


@query("str_latest_progress", "SELECT user_id AS job_id, arg_max(event_type, ts) AS stage, max(ts) AS ts FROM (SELECT user_id, ts, min(event_type) AS event_type FROM events GROUP BY 1, 2) GROUP BY 1")
def str_latest_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min("event_type").alias("stage"))
    return S.latest_progress(e.select(F.col("user_id").alias("job_id"), "stage", F.lit(1).alias("percent"), "ts")).select("job_id", "stage", "ts")


@query("str_fresh_cache", "SELECT event_id FROM events WHERE event_type = 'view' AND ts > (SELECT max(ts) FROM events) - INTERVAL 48 HOUR")
def str_fresh_cache(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    cache = e.select("event_id", F.when(F.col("event_type") == "view", 2).otherwise(1).alias("version"), F.col("ts").alias("stored_at"))
    return S.fresh(cache, F.lit(now), "48 HOURS", 2).select("event_id")


@query("ext_links", "SELECT page_id, len(regexp_extract_all(html, '<a href=\"[^\"#]')) AS n_links FROM pages WHERE len(regexp_extract_all(html, '<a href=\"[^\"#]')) > 0")
def ext_links(spark, sf_dir):
    rows = extract.links(extract.with_page_parts(table(spark, sf_dir, "pages")))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_links"))


@query("ext_reduce_page", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g') AS reduced FROM pages")
def ext_reduce_page(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", TX.reduce_page(F.col("html")).alias("reduced"))


MAIL_RUN = "[a-z0-9!#$%&''*+/=?^_`|~-]+(?:\\.[a-z0-9!#$%&''*+/=?^_`|~-]+)*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\\.)+[a-z]{2,24}"
IGNORED = "|".join(h.replace(".", "\\.") for h in N.IGNORED_MAIL_HOSTS)
PLANTED = "text || ' write to Sales.' || doc_id % 50 || '@Firm' || doc_id % 7 || '.co.in or info' || doc_id % 3 || '@clinic-' || doc_id % 5 || '.agency, you@x.org, a@example.com, b' || doc_id || ' (at) kiosk' || doc_id % 4 || ' [dot] museum'"


@query("ext_emails", f"""
WITH t AS (SELECT doc_id, {PLANTED} AS x FROM documents),
f AS (SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(regexp_replace(x, ' \\(at\\) ', '@', 'g'), ' \\[dot\\] ', '.', 'g')), '{MAIL_RUN}')) AS m FROM t)
SELECT doc_id, m AS email FROM f WHERE NOT regexp_matches(m, '(@|\\.)({IGNORED})$') AND split_part(m, '@', 1) NOT IN ('you', 'your', 'name', 'email', 'someone', 'user', 'username') AND m NOT LIKE '%*%@%' GROUP BY 1, 2""")  # fmt: skip
def ext_emails(spark, sf_dir):
    """Every document's own addresses and some planted ones: role and personal, spelled out, of templates, of new domains."""
    k = F.col("doc_id")
    planted = F.concat(
        "text", F.lit(" write to Sales."), k % 50, F.lit("@Firm"), k % 7, F.lit(".co.in or info"), k % 3, F.lit("@clinic-"), k % 5,
        F.lit(".agency, you@x.org, a@example.com, b"), k, F.lit(" (at) kiosk"), k % 4, F.lit(" [dot] museum"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(TX.emails_in(planted)).alias("email"))


@query("ext_phone_candidates")
def ext_phone_candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(TX.phones_in(F.col("text"), "US")).alias("phone"))


@query("scrub_pii", r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS a FROM documents),
r AS (SELECT doc_id, list_reduce(list_prepend(text, list_distinct(a)), lambda t, m: replace(t, m, 'user-' || substr(sha256(m), 1, 8) || '@example.org')) AS t FROM d)
SELECT doc_id, md5(regexp_replace(t, '\+[0-9][0-9 ().-]{8,}[0-9]', '+', 'g')) AS rest, len(regexp_extract_all(t, '\+[0-9][0-9 ().-]{8,}[0-9]')) AS n_numbers, length(t) AS chars FROM r""")
def scrub_pii(spark, sf_dir):
    """What stands outside numbers is compared whole, numbers by how many there are and by their length."""
    t = table(spark, sf_dir, "documents").select("doc_id", extract.scrub(F.col("text")).alias("t"))
    number = r"\+[0-9][0-9 ().-]{8,}[0-9]"
    return t.select("doc_id", F.md5(F.regexp_replace("t", number, "+")).alias("rest"), F.size(F.regexp_extract_all("t", F.lit(number), F.lit(0))).alias("n_numbers"), F.length("t").alias("chars"))


SOCIALS = [
    ("https://in.LinkedIn.com/company/Acme/about", "linkedin", "company/acme"), ("https://api.whatsapp.com/send?phone=+447700", "whatsapp", "447700"), ("http://www.instagram.com/@Shop/", "instagram", "shop"),
    ("https://facebook.com/sharer/x", "facebook", None), ("https://wa.me/919876543210", "whatsapp", "919876543210"), ("https://twitter.com/Acme?lang=en", "x", "acme"), ("https://notfacebook.com/acme", None, None),
    ("https://m.fb.com/acme.page", "facebook", "acme.page"), ("https://linkedin.com/feed", "linkedin", None), ("https://youtu.be/", "youtube", None), ("https://www.youtube.com/@Chan", "youtube", "chan"), ("mailto:a@b.org", None, None),
]


@query("nrm_social_profiles", f"SELECT page_id, {sql_of([p for _, p, _ in SOCIALS], 'page_id')} AS platform, {sql_of([h for _, _, h in SOCIALS], 'page_id')} AS handle FROM pages")
def nrm_social_profiles(spark, sf_dir):
    """Twelve addresses with what a reader sees in them (NRM15, EXT4)."""
    url = of([u for u, _, _ in SOCIALS], F.col("page_id"))
    return table(spark, sf_dir, "pages").select("page_id", TX.social_platform(url).alias("platform"), TX.social_handle(url).alias("handle"))


@query("x_confidence", "SELECT l_orderkey, round(least(CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 0.5 ELSE 1 END, 1 - exp(sum(ln(1 - l_discount * 0.9)))), 6) AS confidence FROM lineitem GROUP BY l_orderkey")
def x_confidence(spark, sf_dir):
    """An extension: joint confidence of independent sources, capped on conflict."""
    li = table(spark, sf_dir, "lineitem")
    joint = 1 - F.exp(F.sum(F.log(1 - F.col("l_discount") * 0.9)))
    cap = F.when(F.countDistinct("l_returnflag") > 1, 0.5).otherwise(1.0)
    return li.groupBy("l_orderkey").agg(F.round(F.least(cap, joint), 6).alias("confidence"))


@query("x_score", "SELECT c_custkey, (CASE WHEN c_acctbal > 1000 THEN 40 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 35 ELSE 0 END + CASE WHEN c_nationkey < 10 THEN 25 ELSE 0 END)::BIGINT AS score FROM customer")
def x_score(spark, sf_dir):
    """An extension: points of the criteria that a lead meets, with the breakdown summed."""
    checks = F.array(F.when(F.col("c_acctbal") > 1000, 40).otherwise(0), F.when(F.col("c_mktsegment") == "BUILDING", 35).otherwise(0), F.when(F.col("c_nationkey") < 10, 25).otherwise(0))
    return table(spark, sf_dir, "customer").select("c_custkey", F.aggregate(checks, F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))


@query("x_cosine_topk", """
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS match_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM q, embeddings e WHERE q.vec_id <> e.vec_id)
SELECT query_id, match_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) <= 5""")  # fmt: skip
def x_cosine_topk(spark, sf_dir):
    """An extension: exact top five of a stated query set against all vectors, best-first heaps per task."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    unit = e.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))
    asked = unit.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("norm").alias("q_norm"))
    score = F.round(dot(F.col("q"), F.col("v")) / (F.col("q_norm") * F.col("norm")), 6)
    # the query set goes to all tasks in blocks of bounded size; each block's pairs are cut to five a query at once
    n = -(-asked.count() // QUERY_BLOCK) or 1
    best = lambda df: ranking.first_k(df, ["query_id"], [F.desc("score"), F.asc("match_id")], 5)
    parts = []
    for i in range(n):
        block = F.broadcast(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i))
        parts.append(best(unit.join(block, F.col("query_id") != F.col("vec_id")).select("query_id", F.col("vec_id").alias("match_id"), score.alias("score"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("x_blocked_pairs", "SELECT a.c_custkey AS id_a, b.c_custkey AS id_b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND CAST(round(a.c_acctbal) AS BIGINT) // 50 = CAST(round(b.c_acctbal) AS BIGINT) // 50 AND a.c_custkey < b.c_custkey WHERE levenshtein(a.c_name, b.c_name) <= 2")
def x_blocked_pairs(spark, sf_dir):
    """An extension: candidate pairs within a narrow block, decided by edit distance."""
    c = table(spark, sf_dir, "customer")
    rows = c.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.expr("cast(round(c_acctbal) AS bigint) div 50").alias("band"))
    other = rows.select(F.col("c_custkey").alias("id_b"), F.col("c_name").alias("name_b"), "c_nationkey", "c_mktsegment", "band")
    pairs = rows.join(other, ["c_nationkey", "c_mktsegment", "band"]).where("c_custkey < id_b")
    return pairs.where(F.levenshtein("c_name", "name_b") <= 2).select(F.col("c_custkey").alias("id_a"), "id_b")
