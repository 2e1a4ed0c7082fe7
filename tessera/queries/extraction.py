"""Facts of pages: a page of one of six makes for every row of ``pages``, three pages a site."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.operators import extract
from tessera.registry import query, table

LD = '<script type="application/ld+json">{}</script>'
MAKES = [
    # a site node before the business, whose own profile beats the footer's
    LD.format('{"@type":"WebSite","name":"Built by a CMS"}') + LD.format('{"@graph":[{"@type":["Thing","https://schema.org/Restaurant"],"name":"  Kitchen   #N ","telephone":"98765 #P","email":"mailto:Info@Site#S.in","sameAs":["https://www.instagram.com/Kitchen#N/"],"openingHoursSpecification":[{"dayOfWeek":["Monday","Friday"],"opens":"09:00","closes":"21:00"}]}]}')
    + '<a href="https://instagram.com/agency">made by</a><a href="mailto:raj@site#S.in">Raj</a>',
    '<div itemscope itemtype="https://schema.org/Bakery"><h2 itemprop="name">Bakery <i>#N</i></h2><p itemprop="address" itemscope itemtype="https://schema.org/PostalAddress"><b itemprop="streetAddress">#N MG Road</b>'
    '<b itemprop="addressLocality">Pune</b><b itemprop="postalCode">411001</b><b itemprop="addressCountry">in</b></p><time itemprop="openingHours" datetime="Mo-Su 08:00-20:00">daily</time></div>',
    '<meta property="og:site_name" content="Tagline #N"><meta property="og:description" content="All of #N"><a href="mailto:you@site#S.in,sales@site#S.in?subject=hi">Mail</a><a href="tel:+91 20 26#P">Call</a>',
    "<p>Write to asha@site#S.in or call 98765 #P, <b>any time</b></p>",
    LD.format("{broken") + LD.format('{"@type":"Organization","name":"Group #N","email":"***info@site#S.in"}') + '<a href="mailto:sales@site#S.in">us</a><a href="https://facebook.com/group#N">f</a>',
    "<p>Nothing to see</p>",
]
VALUES = [
    [("name", "Kitchen #N", 0.8), ("phone", "+9198765#P", 0.8), ("email", "info@site#S.in", 0.8), ("instagram", "kitchen#N", 0.8), ("opening_hours", '["Mo,Fr 09:00-21:00"]', 0.8), ("email_role", "person", 0.75)],
    [("name", "Bakery #N", 0.8), ("address", "#N MG Road, Pune, 411001", 0.8), ("city", "Pune", 0.8), ("postal_code", "411001", 0.8), ("country", "IN", 0.8), ("opening_hours", '["Mo-Su 08:00-20:00"]', 0.8)],
    [("name", "Tagline #N", 0.8), ("description", "All of #N", 0.8), ("email", "sales@site#S.in", 0.75), ("email_role", "role", 0.75), ("phone", "+912026#P", 0.75), ("phone_type", "fixed_line", 0.75)],
    [("email", "asha@site#S.in", 0.55), ("email_role", "person", 0.55), ("phone", "+9198765#P", 0.55), ("phone_type", "mobile", 0.75)],
    [("name", "Group #N", 0.8), ("email", "sales@site#S.in", 0.75), ("email_role", "role", 0.75), ("facebook", "group#N", 0.75)],
    [],
]
#: The values that a reader finds in each make, one row each, and the rows of a page.
FOUND = "(VALUES " + ", ".join(f"({k}, '{f}', '{v}', {c}::DOUBLE)" for k, vs in enumerate(VALUES) for f, v, c in vs) + ") AS v(make, field, value, confidence)"
OF_PAGE = "SELECT page_id, page_id // 3 AS s, field, replace(replace(replace(value, '#N', page_id::VARCHAR), '#S', (page_id // 3)::VARCHAR), '#P', lpad(CASE WHEN make = 2 THEN page_id % 1000000 ELSE page_id % 100000 END::VARCHAR, CASE WHEN make = 2 THEN 6 ELSE 5 END, '0')) AS value, confidence FROM pages JOIN {0} ON (page_id * 7 + page_id // 6) % 6 = make"


def pages_of(spark, sf_dir):
    i = F.col("page_id")
    make = (i * 7 + F.floor(i / 6)) % 6
    site = F.floor(i / 3).cast("string")
    html = F.element_at(F.array(*map(F.lit, MAKES)), (make + 1).cast("int"))
    digits = F.when(make == 2, F.lpad((i % 1_000_000).cast("string"), 6, "0")).otherwise(F.lpad((i % 100_000).cast("string"), 5, "0"))
    for mark, value in (("#N", i.cast("string")), ("#S", site), ("#P", digits)):
        html = F.replace(html, F.lit(mark), value)
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://site"), site, F.lit(".in/p"), i.cast("string")).alias("url"), html.alias("html"))


@query("ext_page_values", f"WITH v AS ({OF_PAGE.format(FOUND)}) SELECT 'site' || s || '.in' AS site, field, value, confidence, page_id FROM v QUALIFY row_number() OVER (PARTITION BY s, field ORDER BY confidence DESC, page_id) = 1")
def ext_page_values(spark, sf_dir):
    """The best evidence of each page, merged over its site."""
    return extract.merge_pages(extract.page_values(pages_of(spark, sf_dir), "IN"), N.site_domain(F.col("url")))


LINKS = [("/about-us", "Who we are"), ("contact", ""), ("/blog/our-team", "News"), ("/x?y=1", "Careers"), ("/login", "Contact"), ("https://other.org/contact", "Contact"), ("/services.pdf", "Services"), ("/services/", "What we do"), ("#top", "About")]


@query("ext_page_choice", """WITH p AS (SELECT page_id, page_id % 4 AS k FROM pages),
l AS (SELECT page_id, unnest([{'role': 'contact', 'at': 1, 'link': '/contact', 'k': 9}, {'role': 'about', 'at': 2, 'link': '/about-us', 'k': 0}, {'role': 'team', 'at': 3, 'link': '/blog/our-team', 'k': 1},
  {'role': 'services', 'at': 4, 'link': '/services', 'k': 2}, {'role': 'careers', 'at': 5, 'link': '/x?y=1', 'k': 3}]) AS x, k FROM p)
SELECT 'https://site' || page_id || '.in/home' AS url, x.role AS role, 'https://site' || page_id || '.in' || x.link AS link FROM l WHERE x.k <> k QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY x.at) <= 3 + k""")  # fmt: skip
def ext_page_choice(spark, sf_dir):
    """Pages with links to the site's own, to others, to files and to plumbing; each make lacks one, and reads a few."""
    i = F.col("page_id")
    shown = [F.when(i % 4 == lack, "").otherwise(f'<a href="{h}">{t}</a>') for (h, t), lack in zip(LINKS, (0, 9, 1, 3, 9, 9, 2, 2, 9))]
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://site"), i.cast("string"), F.lit(".in/home")).alias("url"), F.concat(*shown).alias("html"))
    rows = extract.links(extract.with_page_parts(pages))
    return extract.choose_pages(rows, (F.regexp_extract("url", r"(\d+)", 1).cast("long") % 4 + 4).cast("int"))
