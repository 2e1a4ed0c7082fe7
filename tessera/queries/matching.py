"""Names against domains, mail providers, contexts of contacts, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.operators import matching
from tessera.registry import query, table


@query("win_best_website", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'https://northstar' || c_custkey || '.co.in/' WHEN 1 THEN 'http://www.northstar.com/' END AS website, CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN CASE WHEN c_custkey < 100 THEN 1.0 ELSE 0.667 END ELSE 0.0 END::DOUBLE AS score FROM customer")
def win_best_website(spark, sf_dir):
    """Of an aggregator's page, a stranger's and (for some) the own site, the own one wins if it spells the name."""
    c = table(spark, sf_dir, "customer")
    k, key = F.col("c_custkey") % 4, F.col("c_custkey")
    own = F.when(k == 0, F.concat(F.lit("https://NorthStar"), key, F.lit(".co.in/home"))).when(k == 1, "http://www.northstar.com/x").when(k == 2, "https://northern.com/").otherwise("https://star-north.com/")
    name = F.concat(F.lit("Dr North Star "), key, F.lit(" Clinic Pvt Ltd"))
    name = F.when(k == 0, F.concat(F.lit("Dr North Star "), key, F.lit(" Ltd"))).otherwise(name)
    urls = F.array(F.lit("https://northstar.justdial.com/"), F.lit("https://other.org/"), own)
    rows = c.select(key.alias("id"), name.alias("name"), F.posexplode(urls).alias("position", "url"))
    return matching.best_websites(rows).select("id", "website", "score")


@query("nrm_mail_provider", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Google Workspace' WHEN 1 THEN 'Microsoft 365' WHEN 2 THEN 'self-hosted' END AS provider FROM supplier")
def nrm_mail_provider(spark, sf_dir):
    k = F.col("s_suppkey")
    domain = F.concat(F.lit("d"), k, F.lit(".in"))
    first = F.when(k % 4 == 0, "ASPMX.L.Google.com.").when(k % 4 == 1, F.concat(F.lit("d"), k, F.lit("-in.mail.protection.outlook.com"))).when(k % 4 == 2, F.concat(F.lit("mx."), domain)).otherwise("mx.unknown.test")
    records = table(spark, sf_dir, "supplier").select("s_suppkey", domain.alias("domain"), F.explode(F.array(F.struct(F.lit(10).alias("preference"), first.alias("exchanger")), F.struct(F.lit(20).alias("preference"), F.lit("a.zoho.com").alias("exchanger")))).alias("r"))
    best = matching.preferred_exchangers(records.select("domain", "r.*"))
    return records.select("s_suppkey", "domain").distinct().join(best, "domain").select("s_suppkey", "provider")


@query("ext_occurrences", "SELECT doc_id AS id, count(*) AS n FROM documents, unnest(range(len(string_split(text, ' the ')) - 1)) AS u(i) GROUP BY doc_id")
def ext_occurrences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = matching.occurrences(d, d.select("id", F.lit(" the ").alias("value")))
    return found.groupBy("id").agg(F.count("*").alias("n"))


CONTEXTS = [
    ("Website designed by X, call ", "98765 43210", "built by"), ("Pin: ", "110001 12", "postcode"), ("Call us ", "1234567890123", "long id"), ("Call us ", "1712345678", "timestamp"),
    ("Write ", "***info@clinic.in", "masked"), ("Call us ", "98765 43210", None), ("<img width=\"", "1200 800 10", "drawing"), ("<a href=\"/x-", "9876543210", "address of a file"),
    ("GSTIN ", "2799887766", "registration"), ("Updated: ", "9876543210", "date"), ("latitude ", "28.61390", "coordinate"), ("at ", "28.61390", "decimal"), ("on ", "2019-04-05", "date"),
    ("from ", "10.0.0.12", "address"), ("see https://x.org/p", "9876543210", "part of a url"), ("a <b>bold</b> word: ", "9876543210", None), ("<input placeholder='", "9876543210", "unshown text"),
    ("<div data-el=\"", "9876543210", "name in the page"), ("Invoice #", "9876543210", "order"), ("maintained with care by hand, call ", "9876543210", "built by"),
]


@query("flt_contact_context", "SELECT p_partkey, c[1 + p_partkey % len(c)] AS reason FROM part, (SELECT [" + ", ".join("NULL" if r is None else f"'{r}'" for _, _, r in CONTEXTS) + "] AS c)")
def flt_contact_context(spark, sf_dir):
    """Twenty contexts with the reasons that a reader gave them."""
    pick = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in CONTEXTS)), (F.col("p_partkey") % len(CONTEXTS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", matching.what_it_is(pick(1), pick(0), F.lit(False)).alias("reason"))


@query("win_strongest_context", "SELECT event_type AS id, user_id AS value, CASE WHEN bool_or(event_id % 4 = 0) THEN 'tel' WHEN bool_or(event_id % 4 = 1) THEN 'whatsapp' ELSE 'text' END AS context FROM events GROUP BY 1, 2")
def win_strongest_context(spark, sf_dir):
    k = F.col("event_id") % 4
    seen = table(spark, sf_dir, "events").select(F.col("event_type").alias("id"), F.col("user_id").alias("value"), F.when(k == 0, "tel").when(k == 1, "whatsapp").otherwise("text").alias("context"))
    return matching.strongest_context(seen)


@query("ext_label_compare", """
WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'phone' ELSE 'email' END AS field, CASE WHEN o_orderkey % 2 = 0 THEN '+91 ' || (9000000000 + o_custkey * 7919) ELSE 'U' || o_custkey || '@x.in' END AS label,
  CASE WHEN o_orderkey % 2 = 0 THEN '0' || (9000000000 + (o_custkey + o_orderkey % 3 // 2) * 7919) ELSE ' u' || (o_custkey + o_orderkey % 5 // 4) || '@X.in' END AS got FROM orders)
SELECT o_orderkey, CASE WHEN field = 'phone' THEN right(regexp_replace(label, '[^0-9]', '', 'g'), 10) = right(regexp_replace(got, '[^0-9]', '', 'g'), 10) ELSE lower(trim(label)) = lower(trim(got)) END AS same FROM p""")  # fmt: skip
def ext_label_compare(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = lambda n: (F.lit(9_000_000_000) + n * 7919).cast("string")
    phone = k % 2 == 0
    label = F.when(phone, F.concat(F.lit("+91 "), number(c))).otherwise(F.concat(F.lit("U"), c, F.lit("@x.in")))
    got = F.when(phone, F.concat(F.lit("0"), number(c + F.floor(k % 3 / 2)))).otherwise(F.concat(F.lit(" u"), c + F.floor(k % 5 / 4), F.lit("@X.in")))
    return table(spark, sf_dir, "orders").select("o_orderkey", matching.same_value(F.when(phone, "phone").otherwise("email"), label, got).alias("same"))


@query("ext_unaccounted_values", "SELECT l_partkey AS value, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1")
def ext_unaccounted_values(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("value"))
    labels = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("value"))
    return matching.unaccounted(found, labels).groupBy("value").agg(F.count("*").alias("n"))


@query("nrm_website_confidence", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'https://acme' || c_custkey || '.org/' WHEN 1 THEN 'https://acme' || c_custkey || '.com/' END AS website, CASE WHEN c_custkey % 3 < 2 THEN 0.7 END::DOUBLE AS confidence FROM customer")
def nrm_website_confidence(spark, sf_dir):
    """Of two hosts that spell the name the knowledge panel's wins, as it comes first; others win only without it (NRM20)."""
    k = F.col("c_custkey")
    panel = F.when(k % 3 == 0, F.concat(F.lit("https://acme"), k, F.lit(".org/about"))).otherwise(F.lit("https://facebook.com/acme"))
    found = F.when(k % 3 < 2, F.concat(F.lit("https://acme"), k, F.lit(".com/x"))).otherwise(F.lit("https://else.com/"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit("Acme "), k).alias("name"), F.posexplode(F.array(panel, found)).alias("position", "url"))
    return matching.best_websites(rows).select("id", "website", "confidence")


#: Names in nine scripts and the keys that a reader expects of them.
SCRIPTS = [
    ("Яндекс Такси", "yandeks taksi"), ("Θεσσαλονίκη", "thessaloniki"), ("שלום", "shlvm"), ("شركة النور", "shrka alnwr"), ("राम मेडिकल", "ram medikal"), ("কলকাতা", "kalakata"), ("ગુજરાત", "gujarat"),
    ("ಬೆಂಗಳೂರು", "bengaluru"), ("தமிழ்", "tamil"), ("Café Münster", "cafe munster"),
]


@query("nrm_other_scripts", "SELECT c_custkey, k[1 + c_custkey % len(k)] || ' ' || c_custkey AS name_key, true AS ascii FROM customer, (SELECT [" + ", ".join(f"'{k}'" for _, k in SCRIPTS) + "] AS k)")
def nrm_other_scripts(spark, sf_dir):
    """Names in other scripts give keys of Latin letters."""
    key = F.col("c_custkey")
    name = F.concat(F.element_at(F.array(*(F.lit(n) for n, _ in SCRIPTS)), (1 + key % len(SCRIPTS)).cast("int")), F.lit(" № "), key.cast("string"), F.lit(" Pvt. Ltd."))
    made = table(spark, sf_dir, "customer").select(key, N.matching_key(name).alias("name_key"))
    return made.withColumn("ascii", F.col("name_key").rlike("^[ -~]+$"))
