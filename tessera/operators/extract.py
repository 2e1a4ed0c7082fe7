"""Facts from HTML pages: links, contacts, structured data; the best evidence of a page and of a site.

Parsing runs in Arrow batches inside the tasks; everything after it is DataFrame work.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.functions import normalize as N
from tessera.functions import text as TX
from tessera.shipping import map_in_arrow

#: Confidence of evidence by where it stood.
CONFIDENCE = {"structured": 0.8, "linked": 0.75, "text": 0.55}
#: Types of structured nodes that describe a business, most telling first.
BUSINESS_TYPES = [
    "Dentist", "MedicalClinic", "MedicalBusiness", "Hospital", "Physician", "Restaurant", "FoodEstablishment", "Store", "LegalService", "AccountingService",
    "HomeAndConstructionBusiness", "ProfessionalService", "HealthAndBeautyBusiness", "AutomotiveBusiness", "EducationalOrganization", "SportsActivityLocation",
    "LodgingBusiness", "LocalBusiness", "Organization", "Corporation",
]
#: Types that make a node one about the page, the site or its goods, whatever else it is.
OTHER_TYPES = ["WebSite", "WebPage", "BreadcrumbList", "SearchAction", "ItemList", "Product", "Offer"]
#: Kinds of business that are filed under a listed one (the vocabulary's own tree).
NARROWER = {
    "FoodEstablishment": ["Bakery", "BarOrPub", "Brewery", "CafeOrCoffeeShop", "FastFoodRestaurant", "IceCreamShop", "Winery"],
    "Store": ["BookStore", "ClothingStore", "ComputerStore", "ElectronicsStore", "Florist", "FurnitureStore", "GroceryStore", "HardwareStore", "JewelryStore", "PetStore", "ShoeStore", "SportingGoodsStore", "ToyStore"],
    "MedicalBusiness": ["Optician", "Pharmacy", "Physiotherapy", "DiagnosticLab"],
    "LegalService": ["Attorney", "Notary"],
    "HomeAndConstructionBusiness": ["Electrician", "GeneralContractor", "HVACBusiness", "HousePainter", "Locksmith", "MovingCompany", "Plumber", "RoofingContractor"],
    "HealthAndBeautyBusiness": ["BeautySalon", "DaySpa", "HairSalon", "HealthClub", "NailSalon", "TattooParlor"],
    "AutomotiveBusiness": ["AutoDealer", "AutoRepair", "AutoRental", "GasStation", "MotorcycleDealer"],
    "EducationalOrganization": ["CollegeOrUniversity", "HighSchool", "Preschool", "School"],
    "SportsActivityLocation": ["ExerciseGym", "GolfCourse", "StadiumOrArena", "TennisComplex"],
    "LodgingBusiness": ["BedAndBreakfast", "Hostel", "Hotel", "Motel", "Resort"],
    "LocalBusiness": ["ChildCare", "DryCleaningOrLaundry", "EmploymentAgency", "Library", "RealEstateAgent", "TravelAgency"],
}
OPENGRAPH = "OpenGraph"

LINK = pa.struct([("url", pa.string()), ("anchor", pa.string()), ("href", pa.string())])
_ONE = ["name", "description", "url", "street", "locality", "region", "postal_code", "country", "logo", "rating", "reviews"]
_MANY = ["types", "telephones", "emails", "same_as", "hours"]
NODE = pa.struct([("syntax", pa.string()), ("json", pa.string()), *((c, pa.string()) for c in _ONE), *((c, pa.list_(pa.string())) for c in _MANY)])
_STRING, _STRINGS = T.StringType(), T.ArrayType(T.StringType())
LINK_TYPE = T.StructType([T.StructField(c, _STRING) for c in ("url", "anchor", "href")])
NODE_TYPE = T.StructType([T.StructField(c, _STRING) for c in ("syntax", "json", *_ONE)] + [T.StructField(c, _STRINGS) for c in _MANY])
_EVIDENCE = "array<struct<field:string,value:string,confidence:double,pos:int>>"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Items:
    """Microdata: items, and properties that end with the tag that opened them."""

    def __init__(self):
        self.found: list[dict] = []
        self._open: list[list] = []  # tag, the item that it opens, the property of an outer item, that item, text

    def _item(self) -> dict | None:
        return next((o[1] for o in reversed(self._open) if o[1] is not None), None)

    def start(self, tag: str, a: dict) -> None:
        names = a.get("itemprop", "").split()
        outer = self._item()
        item = None
        if "itemscope" in a:
            kinds = [t.rsplit("/", 1)[-1].rsplit("#", 1)[-1] for t in a.get("itemtype", "").split()]
            item = {"@type": kinds} if kinds else {}
            if not names or outer is None:
                self.found.append(item)
        text = None
        if names and outer is not None:
            given = next((a[k] for k in ("content", "href", "src", "datetime") if k in a and not (k == "href" and tag not in ("a", "link", "area"))), None)
            if item is not None:
                self._add(outer, names, item)
            elif given is not None or tag in _VOID:
                self._add(outer, names, given or "")
            else:
                text = []
        if tag not in _VOID:
            self._open.append([tag, item, names, outer, text])

    @staticmethod
    def _add(item: dict, names: list[str], value) -> None:
        for name in names:
            item[name] = value if name not in item else [*(item[name] if isinstance(item[name], list) else [item[name]]), value]

    def text(self, data: str) -> None:
        for o in self._open:
            if o[4] is not None:
                o[4].append(data)

    def end(self, tag: str) -> None:
        """Closes the last open tag of the name, and those that were left open in it."""
        if any(o[0] == tag for o in self._open):
            while True:
                name, _, names, outer, text = self._open.pop()
                if text is not None:
                    self._add(outer, names, " ".join("".join(text).split()))
                if name == tag:
                    return


class _Page(HTMLParser):
    """Links with their text, JSON-LD blocks, microdata, OpenGraph entries and the base address."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.base, self.links, self.blocks, self.graph, self.items = None, [], [], {}, _Items()
        self._open: list | None = None
        self._block: list[str] | None = None
        self._hidden = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.items.start(tag, a)
        if tag == "base" and a.get("href") and self.base is None:
            self.base = a["href"].strip()
        elif tag == "a" and a.get("href"):
            self._open = [a["href"].strip(), [], a.get("aria-label") or a.get("title") or ""]
        elif tag == "script":
            self._hidden += 1
            if "ld+json" in a.get("type", ""):
                self._block = []
        elif tag == "meta" and a.get("property", "").startswith("og:"):
            self.graph.setdefault(a["property"][3:], a.get("content", ""))

    def handle_endtag(self, tag):
        self.items.end(tag)
        if tag == "a" and self._open:
            href, text, label = self._open
            self.links.append((href, " ".join("".join(text).split()) or " ".join(label.split())))
            self._open = None
        elif tag == "script":
            self._hidden = max(0, self._hidden - 1)
            if self._block is not None:
                self.blocks.append("".join(self._block))
                self._block = None

    def handle_data(self, data):
        if self._block is not None:
            self._block.append(data)
        elif not self._hidden:
            self.items.text(data)
            if self._open:
                self._open[1].append(data)


def _flatten(node) -> Iterator[dict]:
    """Every object of a document that has a type, an outer one before those inside it."""
    queue = [node]
    while queue:
        x = queue.pop(0)
        if isinstance(x, list):
            queue = x + queue
        elif isinstance(x, dict):
            if x.get("@type") or x.get("type"):
                yield x
            queue = [v for v in x.values() if isinstance(v, (list, dict))] + queue


def _texts(value) -> list[str]:
    """The texts of a value that may be one, an object that holds one, or a list of either; repeats once."""
    if isinstance(value, list):
        found = [t for v in value for t in _texts(v)]
    elif isinstance(value, dict):
        found = _texts(value.get("name") or value.get("@value") or value.get("value"))[:1]
    else:
        found = [] if value is None else [" ".join(str(value).split())]
    return [t for t in dict.fromkeys(found) if t]


def _first(value) -> str | None:
    return next(iter(_texts(value)), None)


def _hours(value) -> list[str]:
    """Opening hours as written, or in the same short form from objects with days and times."""
    out = []
    for v in value if isinstance(value, list) else [value]:
        if isinstance(v, dict) and v.get("dayOfWeek"):
            days, opens, closes = _texts(v["dayOfWeek"]), _first(v.get("opens")), _first(v.get("closes"))
            out += [f"{','.join(d.rsplit('/', 1)[-1][:2] for d in days)} {opens}-{closes}"] if days and opens and closes else []
        else:
            out += _texts(v)
    return list(dict.fromkeys(out))


def _facts(node: dict) -> dict:
    """The fields of a node whose shape differs from site to site, as text."""
    kinds = [k.rsplit("/", 1)[-1].rsplit("#", 1)[-1] for k in _texts(node.get("@type") or node.get("type"))]
    place = node.get("address")
    place = place[0] if isinstance(place, list) and place else place
    part = lambda key: _first(place.get(key)) if isinstance(place, dict) else None
    image = node.get("logo") or node.get("image")
    logo = _first((image.get("url") or image.get("@id")) if isinstance(image, dict) else image)
    stars = node.get("aggregateRating") if isinstance(node.get("aggregateRating"), dict) else {}
    country = part("addressCountry")
    return {
        "types": kinds, "name": _first(node.get("name") or node.get("legalName")), "description": _first(node.get("description")), "url": _first(node.get("url")),
        "telephones": _texts(node.get("telephone")), "emails": [e.removeprefix("mailto:") for e in _texts(node.get("email"))], "same_as": _texts(node.get("sameAs")),
        "hours": _hours(node.get("openingHours") or node.get("openingHoursSpecification")), "street": _first(place) if isinstance(place, str) else part("streetAddress"),
        "locality": part("addressLocality"), "region": part("addressRegion"), "postal_code": part("postalCode"), "country": country.upper() if country and len(country) == 2 else country,
        "logo": logo if logo and logo.lower().startswith(("http://", "https://", "//")) else None, "rating": _first(stars.get("ratingValue")), "reviews": _first(stars.get("reviewCount") or stars.get("ratingCount")),
    }


def _node(syntax: str, node: dict) -> dict:
    return {"syntax": syntax, "json": json.dumps(node, sort_keys=True, ensure_ascii=False), **_facts(node)}


def parse(text: str | None, url: str | None) -> tuple[list[dict], list[dict]]:
    """Links and structured nodes of one page; a broken block leaves the others alone. Survey: EXT5."""
    page = _Page()
    page.feed(text or "")
    base = urljoin(url or "", page.base) if page.base else url or ""
    links, nodes = [], []
    for href, anchor in page.links:
        href = unquote(html.unescape(href))
        if not href or href.startswith(("#", "javascript:", "data:")):
            continue
        try:
            links.append({"url": urljoin(base, href), "anchor": anchor, "href": href})
        except ValueError:
            continue
    for block in page.blocks:
        try:
            nodes += [_node("json-ld", n) for n in _flatten(json.loads(block))]
        except (ValueError, RecursionError):
            continue
    nodes += [_node("microdata", n) for n in _flatten(page.items.found)]
    if page.graph:
        g = page.graph
        nodes.append(_node("opengraph", {"@type": OPENGRAPH, "name": g.get("site_name") or g.get("title"), "description": g.get("description"), "url": g.get("url"), "image": g.get("image")}))
    return links, nodes


def with_page_parts(pages: DataFrame, more: list[str] = ()) -> DataFrame:
    """``pages`` (page_id, url, html) with links (url, anchor, href) and structured nodes in document order, and ``more`` columns."""
    base = pages.select("page_id", "url", *more, "html")
    schema = T.StructType(base.schema.fields[:-1]).add("links", T.ArrayType(LINK_TYPE)).add("nodes", T.ArrayType(NODE_TYPE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse(t.as_py(), u.as_py()) for u, t in zip(b.column(1), b.column(b.num_columns - 1))]
            parts = [pa.array([f[0] for f in found], pa.list_(LINK)), pa.array([f[1] for f in found], pa.list_(NODE))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *parts], schema.names)

    return map_in_arrow(base, run, schema)


def links(parts: DataFrame) -> DataFrame:
    """(page_id, url, pos, link, anchor, href) of every link. Survey: EXT1."""
    return parts.select("page_id", "url", F.posexplode("links").alias("pos", "l")).select("page_id", "url", "pos", F.col("l.url").alias("link"), "l.anchor", "l.href")


def choose_pages(link_rows: DataFrame, budget: Column) -> DataFrame:
    """(url, role, link) of the pages to read of each site: the first crawlable link of each role, in role order. Survey: WIN7, DED4, EXT9."""
    rows = link_rows.withColumn("link", N.canonical_url(F.col("link"))).withColumn("role", TX.page_role(F.col("link"), F.col("anchor")))
    rows = rows.where(F.col("role").isNotNull() & TX.is_crawlable(F.col("link"), F.col("url")) & (F.col("link") != N.canonical_url(F.col("url"))))
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("url", "role").orderBy("pos"))).where("_n = 1")
    rank = F.row_number().over(W.partitionBy("url").orderBy(F.array_position(F.array(*(F.lit(r) for r, _ in TX.PAGE_ROLES)), F.col("role"))))
    return rows.withColumn("_rank", rank).where(F.col("_rank") < budget).select("url", "role", "link")


def business_rank(types: Column) -> Column:
    """How much a node with these types says of a business, from 1, least first; null for one that is about none."""
    ranks = {t: i + 1 for i, t in enumerate(BUSINESS_TYPES)}
    ranks |= {narrow: ranks[t] for t, all_ in NARROWER.items() for narrow in all_} | {OPENGRAPH: len(BUSINESS_TYPES) + 1}
    listed = F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))
    other = F.arrays_overlap(types, F.array(*map(F.lit, OTHER_TYPES)))
    return F.when(~other, F.array_min(F.transform(types, lambda t: F.element_at(listed, t))))


def business_of(nodes: Column) -> Column:
    """The best node of a page: by type, the first on a tie; null without one. Survey: WIN6, EXT6."""
    ranked = F.transform(nodes, lambda n, i: F.struct(business_rank(n["types"]).alias("rank"), i.alias("at")))
    best = F.array_min(F.filter(ranked, lambda r: r["rank"].isNotNull()))
    return F.get(nodes, best["at"])


def business_nodes(parts: DataFrame) -> DataFrame:
    """(page_id, url, node): the best structured node of each page that has one."""
    return parts.select("page_id", "url", business_of(F.col("nodes")).alias("node")).where("node IS NOT NULL")


def _evidence(field: str | Column, value: Column, confidence: str, at: Column | int = 0) -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    at = F.lit(at) if isinstance(at, int) else at
    return F.struct(name.alias("field"), value.alias("value"), F.lit(CONFIDENCE[confidence]).alias("confidence"), at.cast("int").alias("pos"))


def mailto_addresses(href: Column) -> Column:
    """The usable addresses of a mailto link, which may hold several."""
    every = F.split(F.regexp_extract(href, r"(?is)^mailto:([^?]*)", 1), ",")
    return F.array_compact(F.transform(every, lambda x: N.email(F.trim(x))))


def page_values(pages: DataFrame, region: str) -> DataFrame:
    """(page_id, url, field, value, confidence, pos): the best evidence for each field of each page.

    Structured data beats links, links beat text; an unusable value never stands in the way of a usable one. A page is
    parsed once, and its evidence is weighed within its row: nothing is shuffled.

    Survey: DED5, DED6, EXT2, EXT5, EXT7.
    """
    text = TX.text_of(F.col("html"))
    read = pages.select("page_id", "url", "html", TX.emails_in(text).alias("text_emails"), TX.phones_in(text, region).alias("text_phones"))
    parts = with_page_parts(read, ["text_emails", "text_phones"]).withColumn("node", business_of(F.col("nodes")))
    n, at = F.col("node"), F.lit(region)
    told = lambda field, value: _evidence(field, value, "structured")
    line = F.nullif(F.concat_ws(", ", n["street"], n["locality"], n["region"], n["postal_code"]), F.lit(""))
    structured = F.array(
        told("name", n["name"]), told("description", n["description"]), told("email", N.email(F.get(n["emails"], 0))), told("phone", N.phone_e164(F.get(n["telephones"], 0), at)),
        told("address", line), told("city", n["locality"]), told("state", n["region"]), told("postal_code", n["postal_code"]), told("country", n["country"]),
        told("opening_hours", F.when(F.size(n["hours"]) > 0, F.to_json(n["hours"]))), told("logo", n["logo"]),
    )
    profiles = F.transform(n["same_as"], lambda u: _evidence(TX.social_platform(u), TX.social_handle(u), "structured"))
    mails = F.flatten(F.transform("links", lambda x, i: F.transform(mailto_addresses(x["href"]), lambda m: _evidence("email", m, "linked", i))))
    calls = F.transform("links", lambda x, i: _evidence("phone", F.when(F.lower(x["href"]).rlike("^(tel|callto):"), N.phone_e164(F.regexp_extract(x["href"], r"^[^:]*:(.*)$", 1), at)), "linked", i))
    linked = F.transform("links", lambda x, i: _evidence(TX.social_platform(x["url"]), TX.social_handle(x["url"]), "linked", i))
    seen = lambda field, c: F.transform(c, lambda v, i: _evidence(field, v, "text", i))
    usable = lambda c: F.coalesce(F.filter(c, lambda e: e["field"].isNotNull() & e["value"].isNotNull()), F.array().cast(_EVIDENCE))
    parts = parts.select("page_id", "url", usable(F.concat(structured, F.coalesce(profiles, F.array().cast(_EVIDENCE)))).alias("structured"), *(usable(c).alias(name) for name, c in (("mails", mails), ("calls", calls), ("linked", linked), ("text_mails", seen("email", "text_emails")), ("text_calls", seen("phone", "text_phones")))))
    # the kind of a contact is told of the first one that stands on the page itself
    mail, call = F.get(F.concat("mails", "text_mails"), 0), F.get(F.concat("calls", "text_calls"), 0)
    role = F.struct(F.lit("email_role").alias("field"), F.when(N.is_role_email(mail["value"]), "role").when(mail["value"].isNotNull(), "person").alias("value"), mail["confidence"].alias("confidence"), mail["pos"].alias("pos"))
    kind = F.struct(F.lit("phone_type").alias("field"), N.phone_type(call["value"]).alias("value"), F.lit(CONFIDENCE["linked"]).alias("confidence"), call["pos"].alias("pos"))
    every = F.concat("structured", "mails", "calls", "linked", "text_mails", "text_calls", usable(F.array(role, kind)))
    rows = parts.select("page_id", "url", every.alias("every"))
    first = F.filter("every", lambda e, i: F.size(F.filter(F.slice(F.col("every"), F.lit(1), i), lambda b: b["field"] == e["field"])) == 0)
    return rows.select("page_id", "url", F.explode(first).alias("e")).select("page_id", "url", "e.*")


def merge_pages(values: DataFrame, site: Column) -> DataFrame:
    """(site, field, value, confidence, page_id): the best evidence over a site's pages, earlier pages on ties. Survey: WIN5, EXT8."""
    best = F.row_number().over(W.partitionBy("site", "field").orderBy(F.desc("confidence"), "page_id"))
    return values.withColumn("site", site).withColumn("_n", best).where("_n = 1").select("site", "field", "value", "confidence", "page_id")


ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
NUMBER = r"\+[0-9][0-9 ().-]{8,}[0-9]"


def _replaced(text: Column, pattern: str, stand_in) -> Column:
    """The text with ``stand_in`` of every match in its place."""
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(stand_in(F.get(matches, i)), F.lit("")))), "")


def scrub(text: Column) -> Column:
    """Addresses and numbers replaced by made-up ones, the same for the same value; a number keeps its shape.

    A number's digits but for its first become those of a hash of it, with 555 in front, again and again in a long one;
    separators stay where they are.

    Survey: EXT11.
    """
    address = lambda m: F.concat(F.lit("user-"), F.substring(F.sha2(m, 256), 1, 8), F.lit("@example.org"))

    def number(m: Column) -> Column:
        own = F.concat(F.lit("555"), F.translate(F.md5(F.regexp_replace(m, "[^0-9]", "")), "abcdef", "012345"))
        swap = lambda s, c: F.when(
            F.regexp_like(c, F.lit("[0-9]")) & (s["n"] >= 0),
            F.struct(F.concat(s["out"], F.when(s["n"] == 0, c).otherwise(F.substr(own, (s["n"] - 1) % 35 + 1, F.lit(1)))).alias("out"), (s["n"] + 1).alias("n")),
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["n"].alias("n")))
        return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), swap)["out"]

    out = F.when(F.contains(text, F.lit("@")), _replaced(text, ADDRESS, address)).otherwise(text)
    return F.when(F.contains(out, F.lit("+")), _replaced(out, NUMBER, number)).otherwise(out)
