"""Operators on small cases: bounds, nulls, ties, empty tables."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions import normalize as N
from tessera.functions import text as TX
from tessera.operators import export, extract, graph, guards, matching, ranking, reports
from tessera.plans import research
from tessera.sources import places
from tessera.streaming import events as S
from tests import oracles


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "raw, key",
    [
        ("Acme Industries Pvt. Ltd.", "acme industries"), ("Ltd", "ltd"), ("Café Münster GmbH", "cafe munster"), ("\U0001d402\U0001d403 Clinic", "cd clinic"),
        ("Straße & Søn", "strasse son"), ("सत्यम", "satyam"), ("", ""), (None, None),
    ],
)
def test_matching_key(spark, raw, key):
    got = one(spark, N.matching_key, raw)
    assert got == key


@pytest.mark.parametrize(
    "url, host, site, stem",
    [
        ("https://user:pw@www.Shop.Acme.co.in:8443/x", "shop.acme.co.in", "acme.co.in", "acme"), ("acme.com/path", "acme.com", "acme.com", "acme"),
        ("http://localhost/", "localhost", None, "localhost"), ("http://co.in/", "co.in", None, ""), ("//a-b.example.org", "a-b.example.org", "example.org", "example"),
        ("", "", None, ""), (None, "", None, ""),
    ],
)
def test_hosts(spark, url, host, site, stem):
    assert (one(spark, N.host_of, url), one(spark, N.site_domain, url), one(spark, N.registrable_stem, url)) == (host, site, stem)


@pytest.mark.parametrize(
    "raw, want",
    [
        (" <Info@Clinic.IN> ", "info@clinic.in"), ("a@b@clinic.in", None), ("you@clinic.in", None), ("x@sub.example.com", None), ("done@dr.bhatia", None),
        ("x@" + "a" * 260 + ".com", None), ("x@clinic.care.", "x@clinic.care"), ("***info@clinic.in", None), (None, None),
    ],
)
def test_email(spark, raw, want):
    assert one(spark, N.email, raw) == want


@pytest.mark.parametrize(
    "raw, region, want",
    [
        ("098765 43210", "IN", "+919876543210"), ("+91 98765-43210", None, "+919876543210"), ("98765 43210", None, None), ("0124 · 519 9464", "in", "+911245199464"),
        ("122004", "IN", None), ("(415) 555-0123", "US", "+14155550123"), ("IN-HR", "IN", None), (None, "IN", None),
    ],
)
def test_phone(spark, raw, region, want):
    row = spark.createDataFrame([(raw, region)], "x string, r string").select(N.phone_e164(F.col("x"), F.col("r"))).first()
    assert row[0] == want


def test_lookup_name_and_slug(spark):
    assert one(spark, N.lookup_name, "  Bengaluru   Urban District Taluk ") == "Bengaluru Urban"
    assert one(spark, N.lookup_name, "District") == "District" and one(spark, N.lookup_name, "  ") is None
    assert one(spark, N.slugify, "Ñandú & Co!") == "ñandú-co"


def test_canonical_url_and_rules(spark):
    assert one(spark, N.canonical_url, "HTTPS://Www.X.com/A/b/?utm_source=f&q=1&ref=z#top") == "https://www.x.com/A/b?q=1"
    assert one(spark, N.canonical_url, "http://x.com") == "http://x.com/" and one(spark, N.canonical_url, "not a url") == "not a url"
    df = spark.createDataFrame([("http://blog.a.co.in/x", "http://a.co.in"), ("http://a.co.in.evil.test/", "http://a.co.in"), ("http://a.co.in/f.PDF", "http://a.co.in"), (None, "http://a.co.in")], "u string, s string")
    assert [r[0] for r in df.select(TX.is_crawlable(F.col("u"), F.col("s"))).collect()] == [True, False, False, False]


def test_emails_and_phones_in_text(spark):
    text = "Write to info [at] clinic (dot) in or Sales@Clinic.in; you@clinic.in\nGSTIN 0987654321\nCall 098765 43210"
    assert set(one(spark, TX.emails_in, text)) == {"info@clinic.in", "sales@clinic.in"}
    assert one(spark, lambda c: TX.phones_in(c, "IN"), text) == ["+919876543210"]
    assert one(spark, TX.emails_in, None) in (None, []) and one(spark, TX.emails_in, "") == []


def test_redact(spark):
    got = one(spark, TX.redact, "at https://x.io/a?key=1 for a@b.com token=abc Key (id)=(7) code=9" + "z" * 600)
    assert got.startswith("at https://x.io/a?[redacted] for [email] token=[redacted] Key (id)=([redacted]) code=[redacted]") and len(got) <= 500


def test_csv_cells(spark):
    cases = {"=1+1": "'=1+1", 'a"b': '"a""b"', "a,b": '"a,b"', "-": "'-", "": "", None: "", "x\ny": '"x\ny"'}
    assert {k: one(spark, TX.csv_cell, k) for k in cases} == cases


RELEASE = """id string, names struct<primary:string>, basic_category string, taxonomy struct<primary:string, hierarchy:array<string>>,
 bbox struct<xmin:double, xmax:double, ymin:double, ymax:double>, phones array<string>, emails array<string>, websites array<string>, socials array<string>,
 addresses array<struct<freeform:string, locality:string, postcode:string, region:string, country:string>>, confidence double, operating_status string"""


def test_release_to_index(spark, tmp_path):
    box = lambda lat, lon: (lon, lon + 0.002, lat, lat + 0.002)
    rows = [
        ("a", ("Cafe",), "cafe", ("cafe", ["food", None, "cafe"]), box(28.6, 77.2), [" ", "+91 11 2345 6789"], ["a@b.in"], ["x.in"], None, [("1 St", "Delhi", "110001", "DL", "IN")], 0.9, "open"),
        ("b", ("Cash",), "atm", ("atm", ["services", "atm"]), box(28.6, 77.2), None, None, None, None, None, 0.9, None),
        ("c", ("Gone",), "shop", (None, None), box(28.6, 77.2), None, None, None, None, None, 0.9, "Closed"),
        ("d", ("Shifted",), "shop", (None, None), box(28.7, 77.3), ["IN-HR"], ["IN"], ["122004"], None, None, None, None),
        ("e", (None,), "shop", (None, None), box(28.6, 77.2), None, None, None, None, None, 0.9, None),
        ("f", ("Edge",), "shop", (None, None), (77.2, 78.0, 28.7, 29.0), None, None, None, None, None, 0.9, None),
        ("a", ("Cafe again",), "cafe", (None, None), box(28.6, 77.2), None, None, None, None, None, 0.9, None),
    ]
    release = spark.createDataFrame(rows, RELEASE)
    found = places.release_places(places.scan_release(release, (28.5, 77.1, 28.7, 77.3)), "bulk")
    report = places.refusal_report(places.scan_release(release, (28.5, 77.1, 28.7, 77.3)), found).first()
    assert (report["rows_read"], report["not_a_business"], report["bad_phone"], report["bad_email"], report["bad_website"]) == (6, 2, 1, 1, 1)
    kept = found.where(places.is_business(F.col("categories"), F.col("operating_status")))
    assert {r["external_id"] for r in kept.collect()} == {"a", "d", "f"}
    cafe = kept.where("external_id = 'a' and name = 'Cafe'").first()
    assert cafe["categories"] == ["food", "cafe"] and cafe["phone"] == "+91 11 2345 6789" and abs(cafe["lat"] - 28.601) < 1e-9 and cafe["city"] == "Delhi"
    with_id = kept.withColumn("id", F.xxhash64("external_id")).withColumn("ordinal", F.when(F.col("name") == "Cafe again", 9).otherwise(1)).withColumn("updated_at", F.lit(None).cast("timestamp"))
    places.build_index(with_id, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() == 3
    hit = places.search(index, box=(28.6, 77.2, 28.61, 77.21))
    assert [r["name"] for r in hit.collect()] == ["Cafe"]
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(tile" in plan or "In(tile" in plan
    assert places.search(index, name="caf_").count() == 0 and places.search(index, name="CAFE").count() == 1
    assert places.search(index, has_website=False).count() == 2 and places.search(index, any_of=["fax"]).count() == 3
    assert places.health(index.limit(0)).first()["state"] == "empty"


def test_elements(spark):
    schema = "osm_type string, osm_id long, tags map<string,string>, lat double, lon double, nodes array<struct<ref:long,lat:double,lon:double,valid:boolean>>, timestamp timestamp"
    square = [(1, 0.0, 0.0, True), (2, 0.0, 2.0, True), (3, 9.0, 9.0, False), (4, 2.0, 1.0, True), (1, 0.0, 0.0, True)]
    rows = [
        ("n", 1, {"name": " Shop ", "shop": "tea", "contact:phone": "1"}, 1.0, 2.0, None, None),
        ("w", 2, {"name:en": "Mall", "amenity": "cafe"}, None, None, square, None),
        ("n", 3, {"name": "P", "amenity": "parking", "leisure": "pitch"}, 1.0, 2.0, None, None),
        ("r", 4, {"name": "R", "shop": "x"}, 1.0, 2.0, None, None),
        ("w", 5, {"name": "None", "shop": "x"}, None, None, [(1, 1.0, 1.0, False)], None),
        ("n", 6, {"name": " ", "shop": "x"}, 1.0, 2.0, None, None),
    ]
    got = {r["external_id"]: r for r in places.element_places(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"n1", "w2"}
    assert got["n1"]["name"] == "Shop" and got["n1"]["category"] == "shop=tea" and got["n1"]["phone"] == "1"
    assert abs(got["w2"]["lat"] - 2 / 3) < 1e-9 and abs(got["w2"]["lon"] - 1.0) < 1e-9


def test_tiles_agree(spark):
    box = (9.5, 10.0, 9.9, 10.6)
    df = spark.range(2000).select((F.col("id") % 50 * 0.01 + 9.5).alias("lat"), (F.col("id") / 2000 + 10.0).alias("lon")).where(geo.in_box(F.col("lat"), F.col("lon"), box))
    assert df.where(~geo.in_tiles(geo.tile_of(F.col("lat"), F.col("lon")), box)).count() == 0


def test_resolution_cases(spark):
    rows = [
        (1, "p1", "http://a.in", "x"), (2, "p1", "http://other.in", "x"), (3, None, "http://a.in/branch", "x"), (4, None, "https://sites.google.com/s", "x"),
        (5, None, None, "x"), (6, "known", "http://a.in", "x"), (7, "p2", "http://dom.in", "x"),
    ]
    batch = spark.createDataFrame(rows, "ordinal long, place_id string, url string, name string")
    known = spark.createDataFrame([("known", "K")], "place_id string, company_id string")
    domains = spark.createDataFrame([("dom.in", "D")], "domain string, company_id string")
    got = {r["ordinal"]: (r["company_id"], r["is_new_company"]) for r in graph.resolve_companies(batch, known, domains).collect()}
    assert got[1] == got[2] == got[3] and got[1][1]
    assert got[6] == ("K", False) and got[7] == ("D", False)
    assert len({got[i][0] for i in (1, 4, 5)}) == 3
    assert graph.resolve_companies(batch.limit(0), known, domains).count() == 0


def test_supersession_ignores_confidence(spark):
    rows = [(1, "e", "f", "a", 1, 1, 0.9), (2, "e", "f", "b", 2, 1, 0.1), (3, "e", "f", "a", 2, 2, 0.2)]
    v = spark.createDataFrame(rows, "id long, entity_id string, field string, source_id string, batch long, ordinal long, confidence double")
    assert [r["id"] for r in ranking.with_current(v).where("is_current").collect()] == [3]
    assert {r["id"] for r in ranking.with_current(v, ["entity_id", "field", "source_id"]).where("is_current").collect()} == {2, 3}


def test_settlement_cases(spark):
    jobs = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "job_id long, org_id long")
    entries = [(1, "job", 1, -100, "reserve"), (1, "job", 2, -50, "reserve"), (1, "job", 2, 50, "release"), (1, "job", 2, -20, "consume"), (1, "job", 3, -10, "reserve")]
    ledger = spark.createDataFrame(entries, "org_id long, ref_type string, ref_id long, delta long, reason string")
    usage = spark.createDataFrame([(1, 30), (2, 25), (2, 5), (3, 99)], "job_id long, credits long")
    got = {r["job_id"]: (r["used"], r["delta"], r["released"], r["balance_effect"]) for r in reports.settle(jobs, ledger, usage).collect()}
    assert got == {1: (30, 30, 70, 70), 2: (30, 10, 20, -10), 3: (10, 10, 0, 0)}


def test_guards(spark):
    df = spark.createDataFrame([("http://10.0.0.1/",), ("https://ok.org/",), ("javascript:x",), (None,), ("http://[bad",)], "u string")
    assert [r[0] for r in guards.with_url_rejection(df, F.col("u")).select("reason").collect()] == ["address", None, "scheme", "scheme", "unparsable"]
    rows = spark.createDataFrame([("a", 1)], "org_id string, x long")
    assert guards.tenant_rows(rows, None).count() == 0 and guards.tenant_rows(rows, "b").count() == 0 and guards.tenant_rows(rows, "a").count() == 1


PAGE = """<html><head><base href="/in/"><meta property="og:title" content="T"><script type="application/ld+json">{"@type": "Organization", "name": "Org", "email": "bad", "telephone": "098765 43210"}</script>
<script type="application/ld+json">{broken</script></head><body><a href="mailto:Sales@Acme.in?subject=x">mail</a><a href="tel:+91 98765 43211">call</a><a href="contact-us" aria-label="Contact"></a>
<a href="https://instagram.com/acme/">i</a><a href="#top">t</a><p>Write to help [at] acme [dot] in</p><!-- x@acme.in --></body></html>"""


def test_page_extraction(spark):
    pages = spark.createDataFrame([(1, "https://acme.in/home", PAGE), (2, "https://acme.in/b", None), (3, None, "<a href='x'>y</a>")], "page_id long, url string, html string")
    links = extract.links(extract.with_page_parts(pages)).collect()
    assert {r["link"] for r in links if r["page_id"] == 1} >= {"https://acme.in/in/contact-us", "https://instagram.com/acme/"}
    chosen = extract.choose_pages(extract.links(extract.with_page_parts(pages)), F.lit(6)).collect()
    assert [(r["role"], r["link"]) for r in chosen] == [("contact", "https://acme.in/in/contact-us")]
    got = {r["field"]: (r["value"], r["confidence"]) for r in extract.page_values(pages, "IN").where("page_id = 1").collect()}
    assert got["phone"] == ("+919876543210", 0.8) and got["email"] == ("sales@acme.in", 0.75) and got["instagram"] == ("acme", 0.75) and got["name"] == ("Org", 0.8)


def test_export_files(spark):
    v = spark.createDataFrame([(1, "zeta", "9", "s2", "u", "t"), (1, "name", "=A", "s1", "u", "t"), (2, "name", "B", "s1", "u", "t")], "lead_id long, field string, value string, source string, source_url string, observed_at string")
    wide = export.wide(v)
    assert wide.columns == ["lead_id", "sources", "name", "zeta"]
    lines = {r[0] for r in export.csv_lines(wide).collect()}
    assert lines == {"1,s1 | s2,'=A,9\r\n", "2,s1,B,\r\n"}
    assert len(export.wide(v, preset="sources").columns) == 10
    assert export.header_line(["name", "zeta_x"]) == "﻿lead_id,sources,Name,zeta x\r\n"


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "s")
    export.write_snapshot(spark.range(3), root, "v1")
    export.write_snapshot(spark.range(5), root, "v2")
    assert export.read_snapshot(spark, root).count() == 5


def test_specs(spark):
    lines = ['{"intent": "x", "country": "IN", "employees_gte": 9, "employees_lte": 2}', '{"intent": "x", "country": "india", "depth": "huge"}', "[]", ""]
    rows = {r["id"]: r for r in research.parse_specs(spark.createDataFrame(list(enumerate(lines)), "id long, value string")).collect()}
    assert rows[0]["problems"] == [] and (rows[0]["employees_gte"], rows[0]["employees_lte"], rows[0]["depth"]) == (2, 9, "standard")
    assert rows[1]["problems"] == ["country", "depth"] and rows[2]["problems"] == ["not an object"] and rows[3]["problems"] == ["not an object"]


def test_streams_match_their_twins(spark, tmp_path):
    """Windows, sessions and buckets over a file stream that a last, late event flushes."""
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    end = rows.agg(F.max("ts")).first()[0]
    flush = rows.limit(1).withColumns({"ts": F.lit(end) + F.expr("INTERVAL 30 DAYS"), "event_type": F.lit("flush"), "user_id": F.lit(-1).cast("long")})
    rows.repartition(1).write.parquet(str(tmp_path / "in/a"))
    flush.repartition(1).write.parquet(str(tmp_path / "in/b"))

    def run(transform, name):
        stream = S.read_events(spark, str(tmp_path / "in/*"), rows.schema, maxFilesPerTrigger=1)
        out = transform(stream)
        target = str(tmp_path / name)
        S.drain(out, f"{target}-checkpoint", lambda df, i: df.write.mode("overwrite").parquet(f"{target}/batch={i}"))
        return spark.read.schema(out.schema).parquet(f"{target}/*")

    day = lambda df: S.tumbling(df, "1 day", ["event_type"], "1 hour" if df.isStreaming else None)
    got = run(day, "day").where("event_type <> 'flush'")
    assert got.exceptAll(day(rows)).count() == 0 and day(rows).exceptAll(got).count() == 0
    gap = lambda df: S.sessions(df, "6 hours", "user_id", "1 hour" if df.isStreaming else None)
    got = run(gap, "gap").where("user_id >= 0")
    assert got.exceptAll(gap(rows)).count() == 0 and gap(rows).exceptAll(got).count() == 0
    bucket = lambda df: S.token_bucket(df, "event_type", 0.002, 5.0)
    got, twin = run(bucket, "bucket").where("key <> 'flush'"), bucket(rows)
    assert got.count() == twin.count() and got.where("allowed").count() == twin.where("allowed").count()


def test_plans(spark):
    """One shuffle and a pruned window for best values, no shuffle for a place search, top-k for pages."""
    v = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("l_orderkey entity_id", "l_linenumber field", "l_discount confidence", "l_shipdate observed_at", "l_partkey id")
    plan = ranking.best_values(v)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan
    p = spark.read.parquet("/root/testdata/sf0.001/part.parquet").selectExpr("p_retailprice lat", "p_retailprice lon", "p_partkey id")
    assert "Exchange" not in places.search(p, box=(0, 0, 1, 1))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in ranking.keyset_page(v.select("id"), "id", 5)[0]._jdf.queryExecution().executedPlan().toString()


def test_robots_groups(spark):
    text = "Disallow: /early\nUser-agent: a\n\nUser-agent: Tess\n# comment\nDisallow: /x\nAllow: /x/y$\nUser-agent: *\nDisallow: /\nUser-agent: tess\nCrawl-delay: 1.5\nDisallow:"
    ask = lambda agent, path, status=200: one(spark, lambda c: guards.robots_decision(F.lit(status), c, agent, F.lit(path)), text)
    got = [tuple(ask(*x)) for x in (("tessera", "/x/y"), ("tessera", "/x/y/z"), ("tessera", "/early"), ("b", "/z"), ("b", "/z", 404), ("b", "/z", 500))]
    assert got == [
        (True, "robots_allow", 1.5), (False, "robots_disallow", 1.5), (True, "robots_allow", 1.5), (False, "robots_disallow", None), (True, "robots_absent", None), (False, "robots_unavailable", None),
    ]


def test_refused_calls_give_their_claim_back(spark):
    rows = [("a", i, t, c) for i, (t, c) in enumerate([(1, 50), (2, 500), (3, 10), (4, -30), (5, 70), (6, None)])] + [("b", 9, 1, 101), (None, 10, 1, 5)]
    df = spark.createDataFrame(rows, "k string, event_id long, ts long, micros long")
    got = {r["event_id"]: (r["spent"], r["accepted"]) for r in S.within_budget(df, "k", F.col("micros"), 100).collect()}
    assert got == {0: (50, True), 1: (50, False), 2: (60, True), 3: (30, True), 4: (100, True), 5: (100, True), 9: (0, False), 10: (5, True)}


def test_names_of_repeated_short_words_stay_small(spark):
    name = "aa " * 24 + "b"
    assert one(spark, lambda c: matching.domain_match(c, F.lit("https://" + "aa" * 24 + "b.com/")), name) == 1.0
    assert one(spark, lambda c: matching.domain_match(c, F.lit("https://" + "aa" * 24 + "c.com/")), name) == 0.0


def test_scrub_keeps_shapes(spark):
    text = "call +44 (20) 7946-0958 or a@b.org, again +44 (20) 7946-0958 or +1 212 555 0100"
    out = one(spark, extract.scrub, text)
    assert re.sub("[0-9]", "0", out.split(" or ")[0]) == "call +00 (00) 0000-0000" and out.count("@example.org") == 1
    numbers = re.findall(r"\+[0-9][0-9 ().-]{8,}[0-9]", out)
    assert numbers[0] == numbers[1] != numbers[2] and "7946" not in out and len(out) == len(text) - len("a@b.org") + len("user-12345678@example.org")


@pytest.mark.parametrize("more", ["", " 3456", " 3456 118.112.190.161", " 3456 118.112.190.161" * 3])
def test_scrub_keeps_every_digit_of_long_numbers(spark, tmp_path, more):
    """A number, a card and an address in a row are one number of over 36 digits; the query agrees with its SQL."""
    from tessera import catalogue

    text = f"call +1 (836) 555-9331 491318719667{more} now"
    out = one(spark, extract.scrub, text)
    assert re.sub("[0-9]", "0", out) == re.sub("[0-9]", "0", text) and out != text
    spark.createDataFrame([(1, text), (2, "x@y.org +44 20 7946 0958")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = oracles.connect(tmp_path)
    assert oracles.compare(spark, con, catalogue.queries()["scrub_pii"], catalogue.oracle_sql()["scrub_pii"], str(tmp_path)) is None


def test_any_of_query_takes_phones_and_emails(spark, tmp_path):
    """The query and its SQL ask for either channel, beside one that cannot be checked."""
    import duckdb

    from tessera import catalogue

    rows = [(k, f"part {k}", "STANDARD ANODIZED TIN", 1.0, 1, f"Brand#{k}") for k in range(1, 31)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_retailprice double, p_size int, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    want = [k for k in range(1, 31) if k % 3 == 0 or k % 5 == 0]
    assert sorted(r["id"] for r in catalogue.queries()["flt_any_of"](spark, str(tmp_path)).collect()) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(r[0] for r in con.sql(catalogue.oracle_sql()["flt_any_of"]).fetchall()) == want
