"""Structured data of pages: microdata scopes, kinds of business, fields of many shapes, one parse a page."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import extract

MICRODATA = """<div itemscope itemtype="https://schema.org/Bakery"><h1 itemprop="name">Blue <b>Door</b></h1><meta itemprop="telephone" content="098765 43210">
<div itemprop="address" itemscope itemtype="http://schema.org/PostalAddress"><span itemprop="streetAddress">12 MG Road<br>2nd floor</span>, <span itemprop="addressLocality">Pune</span>
<span itemprop="addressCountry">in</span></div><a itemprop="sameAs" href="https://instagram.com/bluedoor/">i</a><a itemprop="sameAs" href="https://x.com/blue_door">x</a>
<time itemprop="openingHours" datetime="Mo-Sa 09:00-18:00">Mon to Sat</time><img itemprop="logo" src="https://b.in/l.png"><p itemprop="description">Bread <script>var x</script>and cake</div><p itemprop="name">stray</p>"""


def nodes(html):
    return extract.parse(html, "https://b.in/")[1]


def test_microdata_scopes():
    (bakery, place) = nodes(MICRODATA)
    assert bakery["types"] == ["Bakery"] and bakery["name"] == "Blue Door" and bakery["telephones"] == ["098765 43210"]
    assert (bakery["street"], bakery["locality"], bakery["country"]) == ("12 MG Road2nd floor", "Pune", "IN") and place["types"] == ["PostalAddress"]
    assert bakery["same_as"] == ["https://instagram.com/bluedoor/", "https://x.com/blue_door"] and bakery["hours"] == ["Mo-Sa 09:00-18:00"]
    assert bakery["logo"] == "https://b.in/l.png" and bakery["description"] == "Bread and cake"
    assert nodes("<div itemscope><span itemprop=a>x</div></div></span><b itemprop=c>") == []


def test_nested_items_lists_and_broken_tags():
    html = '<ul itemscope itemtype="X/ItemList"><li itemprop="itemListElement" itemscope itemtype="X/Store"><i itemprop="name">A<li itemprop="itemListElement" itemscope itemtype="X/Store"><i itemprop="name">B</ul><i itemprop="name">C'
    found = nodes(html)
    assert [n["types"] for n in found][0] == ["ItemList"] and {n["name"] for n in found if n["types"] == ["Store"]} >= {"B"}


@pytest.mark.parametrize(
    "node, want",
    [
        ({"name": ["", " A  b "], "telephone": {"@value": "1"}, "email": ["mailto:x@y.in", "z@y.in"]}, {"name": "A b", "telephones": ["1"], "emails": ["x@y.in", "z@y.in"]}),
        ({"legalName": "L", "address": "12 Road, Pune", "logo": {"url": "//c/l.png"}}, {"name": "L", "street": "12 Road, Pune", "locality": None, "logo": "//c/l.png"}),
        ({"address": [{"postalCode": 411001, "addressCountry": {"name": "India"}}], "image": "l.png"}, {"postal_code": "411001", "country": "India", "logo": None}),
        ({"openingHoursSpecification": [{"dayOfWeek": ["https://schema.org/Monday", "Tuesday"], "opens": "09:00", "closes": "17:00"}, {"dayOfWeek": "Sunday"}]}, {"hours": ["Mo,Tu 09:00-17:00"]}),
        ({"aggregateRating": {"ratingValue": 4.5, "reviewCount": "12"}, "sameAs": "https://x.com/a"}, {"rating": "4.5", "reviews": "12", "same_as": ["https://x.com/a"]}),
    ],
)
def test_fields_of_many_shapes(node, want):
    html = f'<script type="application/ld+json">{json.dumps({"@graph": [{"@type": "https://schema.org/Dentist", **node}]})}</script>'
    (found,) = (n for n in nodes(html) if n["types"] == ["Dentist"])
    assert {k: found[k] for k in want} == want


def test_the_best_kind_of_business(spark):
    rows = [
        (["LocalBusiness"], 18), (["Dentist"], 1), (["Organization", "MedicalClinic"], 2), (["Hotel"], 17), (["Bakery"], 7), (["WebSite"], None), (["Organization", "WebPage"], None),
        (["OpenGraph"], 21), (["Person"], None), ([], None), (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, types array<string>")
    assert {r[0]: r[1] for r in df.select("i", extract.business_rank(F.col("types"))).collect()} == {i: r for i, (_, r) in enumerate(rows)}


def ld(*nodes):
    return "".join(f'<script type="application/ld+json">{json.dumps(n)}</script>' for n in nodes)


def values(spark, html, url="https://b.in/"):
    pages = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return {r["field"]: (r["value"], r["confidence"]) for r in extract.page_values(pages, "IN").collect()}


def test_a_site_s_own_name_gives_way_to_the_business(spark):
    html = '<meta property="og:site_name" content="Tagline">' + ld({"@type": "WebSite", "name": "My CMS"}, {"@type": "Restaurant", "name": "Blue Door", "telephone": "098765 43210", "email": "Hi@BlueDoor.in"})
    got = values(spark, html)
    assert got["name"] == ("Blue Door", 0.8) and got["phone"] == ("+919876543210", 0.8) and got["email"] == ("hi@bluedoor.in", 0.8)
    assert values(spark, '<meta property="og:site_name" content="Tagline">' + ld({"@type": "WebSite", "name": "My CMS"}))["name"] == ("Tagline", 0.8)


def test_all_fields_and_their_evidence(spark):
    got = values(spark, MICRODATA + '<a href="mailto:nobody,Info@bluedoor.in,raj@bluedoor.in?subject=x">m</a><a href="tel:020 2612 3456">t</a><a href="https://instagram.com/agency">a</a> or 98765 43219')
    assert got["address"] == ("12 MG Road2nd floor, Pune", 0.8) and got["city"] == ("Pune", 0.8) and got["country"] == ("IN", 0.8)
    assert got["instagram"] == ("bluedoor", 0.8) and got["x"] == ("blue_door", 0.8) and got["opening_hours"] == ('["Mo-Sa 09:00-18:00"]', 0.8)
    assert got["email"] == ("info@bluedoor.in", 0.75) and got["email_role"] == ("role", 0.75) and got["phone"] == ("+919876543210", 0.8) and got["phone_type"] == ("fixed_line", 0.75)
    assert got["logo"] == ("https://b.in/l.png", 0.8) and "rating" not in got
    text = values(spark, "<p>raj@bluedoor.in, 98765 43219</p>")
    assert text == {"email": ("raj@bluedoor.in", 0.55), "email_role": ("person", 0.55), "phone": ("+919876543219", 0.55), "phone_type": ("mobile", 0.75)}
    assert values(spark, None) == values(spark, "") == values(spark, "<p>nothing", None) == {}


def test_a_page_is_parsed_once_and_nothing_is_shuffled(spark):
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    plan = extract.page_values(pages, "IN")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_several_addresses_in_one_link(spark):
    df = spark.createDataFrame([("mailto:a@b.in, C@d.in?cc=x@y.in",), ("MAILTO:",), ("tel:1",), (None,)], "h string")
    assert [r[0] for r in df.select(extract.mailto_addresses(F.col("h"))).collect()] == [["a@b.in", "c@d.in"], [], [], None]
