"""Normalisers of names, hosts, addresses and numbers as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.binding import bind
from tessera.functions.scripts import romanized

# Fixed values -----------------------------------------------------------------------------------------------

#: What a company is registered as, after punctuation became spaces.
LEGAL_SUFFIXES = [
    "pvt ltd", "pvt limited", "private ltd", "private limited", "p ltd", "ltd", "limited", "llp", "llc", "inc",
    "incorporated", "gmbh", "bv", "nv", "sa", "ag", "plc", "corp", "corporation",
]
#: Public suffixes of two labels.
MULTI_LABEL_SUFFIXES = [
    "co.in", "net.in", "org.in", "gen.in", "firm.in", "ind.in", "ac.in", "co.uk", "org.uk", "me.uk", "com.au", "net.au",
    "com.sg", "com.my", "co.nz", "co.za", "com.br", "co.jp", "com.mx", "com.tr", "ae.org",
]
#: Host labels of platforms on which many businesses have a page.
PLATFORM_HOSTS = [
    "sites", "business", "blogspot", "wordpress", "wixsite", "wix", "weebly", "squarespace", "webnode", "godaddysites",
    "mystrikingly", "strikingly", "webflow", "facebook", "instagram", "linkedin", "twitter", "x", "youtube", "whatsapp",
    "wa", "linktr", "bio", "t", "telegram", "pinterest", "tumblr", "medium",
]
#: Mailboxes of a role, not of a person.
ROLE_LOCAL_PARTS = [
    "info", "contact", "enquiry", "enquiries", "inquiry", "inquiries", "hello", "hi", "sales", "support", "help",
    "admin", "office", "mail", "email", "care", "reception", "frontdesk", "appointments", "booking", "bookings",
    "service", "team", "hr", "careers", "jobs", "accounts", "billing", "finance", "noreply", "no-reply", "donotreply",
]
#: Hosts and mailboxes of templates and page plumbing.
IGNORED_MAIL_HOSTS = [
    "example.com", "example.org", "example.net", "sentry.io", "wixpress.com", "sentry-next.wixpress.com", "domain.com",
    "yourdomain.com", "email.com", "company.com", "godaddy.com", "wordpress.com",
]
IGNORED_LOCAL_PARTS = ["you", "your", "name", "email", "someone", "user", "username"]
#: Words after a place's name that say which unit of government it is.
ADMIN_SUFFIXES = [
    "sub district", "sub-district", "subdistrict", "district", "tehsil", "taluk", "taluka", "mandal", "block",
    "municipal corporation", "municipality", "nagar palika", "nagar panchayat", "urban agglomeration",
]
#: Query parameters that only track.
TRACKING_PARAMETERS = r"(?i)^(utm_[a-z_]+|gclid|fbclid|msclkid|mc_[a-z]+|ref|source)$"
#: Separators that pages print inside numbers.
VISUAL_SEPARATORS = " ·•‧‐‑‒–—―"
MAX_EMAIL = 254

# Top-level domains are a parameter. Without one, two letters count, and these common generic names.
GENERIC_TLDS = [
    "academy", "accountants", "africa", "agency", "app", "architect", "art", "asia", "associates", "attorney", "bank", "bar", "beauty",
    "best", "bike", "bio", "biz", "blog", "boutique", "broker", "build", "business", "cafe", "camp", "capital", "care", "careers",
    "cars", "casa", "catering", "center", "city", "cleaning", "clinic", "clothing", "cloud", "club", "coach", "codes", "coffee", "com",
    "community", "company", "computer", "construction", "consulting", "coop", "dance", "dental", "dentist", "design", "dev", "digital",
    "direct", "directory", "doctor", "edu", "education", "email", "energy", "engineer", "engineering", "enterprises", "equipment",
    "estate", "events", "exchange", "expert", "express", "family", "fan", "farm", "fashion", "film", "finance", "financial", "fit",
    "fitness", "foundation", "fun", "fund", "furniture", "gallery", "games", "garden", "gift", "gifts", "global", "gmbh", "gov",
    "graphics", "green", "group", "guide", "guru", "hair", "health", "healthcare", "help", "holdings", "holiday", "homes", "hospital",
    "host", "house", "inc", "industries", "info", "insure", "int", "international", "jewelry", "jobs", "kitchen", "land", "law",
    "lawyer", "legal", "life", "limited", "link", "live", "loan", "london", "love", "ltd", "management", "market", "marketing",
    "media", "medical", "mil", "mobi", "money", "museum", "name", "net", "network", "news", "ngo", "ong", "online", "org", "partners",
    "photo", "photography", "plus", "press", "pro", "properties", "property", "pub", "realty", "rent", "rentals", "repair", "report",
    "restaurant", "run", "sale", "salon", "school", "services", "shop", "site", "social", "software", "solutions", "space", "store",
    "studio", "support", "surgery", "systems", "tax", "team", "tech", "technology", "tel", "today", "tools", "top", "trade",
    "training", "travel", "university", "vet", "video", "vip", "watch", "website", "wiki", "work", "works", "world", "xyz",
]

#: Numbering rules by region: country code, trunk prefix, national number, mobile prefix (null: cannot be told).
#: A number of a region that is not listed is not validated and becomes null.
PHONE_RULES = {
    "IN": ("91", "0", "[1-9][0-9]{9}", "[6-9]"),
    "US": ("1", "1", "[2-9][0-9]{2}[2-9][0-9]{6}", None),
    "CA": ("1", "1", "[2-9][0-9]{2}[2-9][0-9]{6}", None),
    "GB": ("44", "0", "[1-9][0-9]{8,9}", "7"),
    "AU": ("61", "0", "[2-478][0-9]{8}", "4"),
    "SG": ("65", "", "[3689][0-9]{7}", "[89]"),
    "AE": ("971", "0", "[2-79][0-9]{7,8}", "5"),
    "FR": ("33", "0", "[1-9][0-9]{8}", "[67]"),
    "DE": ("49", "0", "[1-9][0-9]{5,10}", "1[567]"),
    "ES": ("34", "", "[679][0-9]{8}", "[67]"),
    "IT": ("39", "", "(?:0[0-9]{5,10}|3[0-9]{8,9})", "3"),
    "NL": ("31", "0", "[1-9][0-9]{8}", "6"),
    "BE": ("32", "0", "[1-9][0-9]{7,8}", "4[5-9][0-9]"),
    "CH": ("41", "0", "[2-9][0-9]{8}", "7[4-9]"),
    "AT": ("43", "0", "[1-9][0-9]{6,12}", "6[5-9]"),
    "SE": ("46", "0", "[1-9][0-9]{6,8}", "7[02369]"),
    "NO": ("47", "", "[2-9][0-9]{7}", "[49]"),
    "DK": ("45", "", "[2-9][0-9]{7}", None),
    "FI": ("358", "0", "[1-9][0-9]{5,10}", "(?:4|50)"),
    "IE": ("353", "0", "[1-9][0-9]{6,8}", "8[35679]"),
    "PT": ("351", "", "[29][0-9]{8}", "9"),
    "PL": ("48", "", "[1-9][0-9]{8}", "(?:4[5]|5[0137]|6[069]|7[23589]|88)"),
    "NZ": ("64", "0", "[2-9][0-9]{7,9}", "2"),
    "ZA": ("27", "0", "[1-8][0-9]{8}", "[6-8]"),
    "BR": ("55", "0", "[1-9][1-9](?:9[0-9]{8}|[2-5][0-9]{7})", "[1-9][1-9]9"),
    "MX": ("52", "", "[2-9][0-9]{9}", None),
    "JP": ("81", "0", "[1-9][0-9]{8,9}", "[789]0"),
    "MY": ("60", "0", "(?:1[0-9]{8,9}|[3-9][0-9]{7,8})", "1"),
    "PK": ("92", "0", "(?:3[0-9]{9}|[2-9][0-9]{7,9})", "3"),
    "BD": ("880", "0", "(?:1[3-9][0-9]{8}|[2-9][0-9]{5,9})", "1"),
    "LK": ("94", "0", "[1-9][0-9]{8}", "7"),
    "NP": ("977", "0", "(?:9[678][0-9]{8}|[1-9][0-9]{6,7})", "9[678]"),
    "SA": ("966", "0", "(?:5[0-9]{8}|1[1-7][0-9]{7})", "5"),
    "QA": ("974", "", "[3-7][0-9]{7}", "[3567]"),
    "KE": ("254", "0", "(?:[17][0-9]{8}|[2-6][0-9]{6,8})", "[17]"),
    "NG": ("234", "0", "(?:[789][01][0-9]{8}|[1-9][0-9]{6,8})", "[789][01]"),
}


def one_of(c: Column, values: list[str]) -> Column:
    return c.isin(values)


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


#: Letters that no decomposition turns into ASCII, or only into several letters.
LONG_FOLDS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ð": "d", "þ": "th"}


def _latin_fold() -> tuple[str, str]:
    """Characters that decompose to one ASCII character, and those characters, as strings for translate."""
    old, new = [], []
    for lo, hi in ((0xA0, 0x250), (0x1E00, 0x1F00), (0x1D400, 0x1D800), (0xFF01, 0xFF5F)):
        for ch in map(chr, range(lo, hi)):
            flat = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x)).lower()
            if len(flat) == 1 and flat.isascii():
                old.append(ch)
                new.append(flat)
    return "".join(old), "".join(new)


def ascii_fold(c: Column) -> Column:
    """Lower-cased, with accents, full-width and mathematical letters as plain letters; other scripts stay."""
    out = F.translate(F.lower(c), *_latin_fold())
    for a, b in LONG_FOLDS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def matching_key(name: Column) -> Column:
    """The key that names are blocked on: folded, in Latin letters, punctuation to spaces, legal suffixes off unless nothing is left. Survey: NRM1."""
    spaced = F.trim(F.regexp_replace(bind(ascii_fold(name), romanized), r"[^\p{L}\p{N}]+", " "))
    suffixes = "|".join(sorted(LEGAL_SUFFIXES, key=lambda s: (-len(s), s)))
    bare = F.trim(F.regexp_replace(spaced, rf"(?:\s+(?:{suffixes}))+$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), spaced)


def slugify(c: Column) -> Column:
    """Survey: NRM10."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def host_of(url: Column) -> Column:
    """Host without user, port and ``www.``; empty where there is none. Survey: NRM4."""
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    where = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    host = F.regexp_replace(F.regexp_replace(where, r"^.*@", ""), r":.*$", "")
    return F.coalesce(F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^\.+|\.+$", ""), F.lit(""))


def registrable_domain(url: Column) -> Column:
    """The bare host, null where it cannot be a domain."""
    host = host_of(url)
    return F.when(F.contains(host, F.lit(".")) & ~F.contains(host, F.lit(" ")), host)


def _suffix_labels(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(MULTI_LABEL_SUFFIXES), 2).otherwise(1)


def site_domain(url: Column) -> Column:
    """The registered name with its public suffix; null where there is none. Survey: NRM5."""
    host = host_of(url)
    n = _suffix_labels(host)
    short = F.size(F.split(host, r"\.")) <= n
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(F.contains(host, F.lit(".")) & ~F.contains(host, F.lit(" ")) & ~short, F.when(n == 2, three).otherwise(two))


def registrable_stem(url: Column) -> Column:
    """The registered label alone, without hyphens."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    at = F.size(labels) - _suffix_labels(host)
    stem = F.when(F.size(labels) < 2, host).when(at < 1, F.lit("")).otherwise(F.get(labels, at - 1))
    return F.replace(stem, F.lit("-"), F.lit(""))


def is_platform_host(url: Column) -> Column:
    """Whether any label of the host is a platform's. Survey: NRM6."""
    return F.arrays_overlap(F.split(host_of(url), r"\."), F.array(*map(F.lit, PLATFORM_HOSTS)))


def has_real_tld(domain: Column, tlds: list[str] | None = None) -> Column:
    """Survey: NRM7."""
    tld = F.lower(F.regexp_extract(domain, r"\.([^.]+)\.?$", 1))
    return tld.isin(tlds) if tlds else (tld.isin(GENERIC_TLDS) | F.regexp_like(tld, F.lit("^(?:[a-z]{2}|xn--[a-z0-9-]+)$")))


def email(address: Column, tlds: list[str] | None = None) -> Column:
    """The one spelling of a usable address, or null. Survey: NRM3."""
    raw = F.trim(F.regexp_replace(F.trim(address), r"^<+|>+$", ""))
    local = F.trim(F.regexp_extract(raw, r"^(.*)@[^@]*$", 1))
    domain = F.regexp_replace(F.trim(F.regexp_extract(raw, r"@([^@]*)$", 1)), r"^\.+|\.+$", "")
    hosts = "|".join(h.replace(".", r"\.") for h in IGNORED_MAIL_HOSTS)
    shaped = F.regexp_like(local, F.lit(r"^[A-Za-z0-9!#$%&'+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'+/=?^_`{|}~-]+)*$"))
    shaped &= F.regexp_like(domain, F.lit(r"^([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$"))
    bad = F.lower(local).isin(IGNORED_LOCAL_PARTS) | F.regexp_like(domain, F.lit(rf"(?i)(^|\.)({hosts})$"))
    usable = (F.length(raw) <= MAX_EMAIL) & shaped & ~bad & has_real_tld(domain, tlds)
    return F.when(usable, F.lower(F.concat(local, F.lit("@"), domain)))


def is_role_email(address: Column) -> Column:
    return F.lower(F.substring_index(address, "@", 1)).isin(ROLE_LOCAL_PARTS)


def lookup_name(city: Column) -> Column:
    """A city's name without repeated administrative suffixes, unless nothing is left. Survey: NRM8."""
    whole = F.nullif(collapse(city), F.lit(""))
    words = sorted((r"[\s-]+".join(s.replace("-", " ").split()) for s in ADMIN_SUFFIXES), key=lambda s: (-len(s), s))
    bare = F.regexp_replace(F.regexp_replace(whole, rf"(?i)(?:[\s,-]+(?:{'|'.join(words)}))+$", ""), r"^[ ,-]+|[ ,-]+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), whole)


def country(c: Column) -> Column:
    """ISO country code of two letters, or null. Survey: NRM12."""
    code = F.upper(F.trim(c))
    return F.when(F.regexp_like(code, F.lit("^[A-Z]{2}$")), code)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, tracking parameters or trailing slash. Survey: NRM13."""
    bare = F.regexp_replace(url, r"#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r"/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.regexp_like(F.substring_index(p, "=", 1), F.lit(TRACKING_PARAMETERS)))
    query = F.array_join(pairs, "&")
    return F.when(head == "", url).otherwise(F.concat(head, F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))))


def homepage_of(url: Column) -> Column:
    """Survey: NRM18."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^(https?://[^/?#]+)", 1), F.lit(""))


def phone_e164(raw: Column, region: Column) -> Column:
    """``+`` and digits of a valid number, or null; without ``+`` the region's rules read it. Survey: NRM2."""
    spaced = F.translate(raw, VISUAL_SEPARATORS, " " * len(VISUAL_SEPARATORS))
    digits = F.regexp_replace(spaced, r"[^0-9]", "")
    codes = F.create_map(*(F.lit(x) for code, rule in PHONE_RULES.items() for x in (code, rule[0])))
    readings = F.create_map(*(F.lit(x) for code, (_, trunk, national, _) in PHONE_RULES.items() for x in (code, f"^(?:{trunk})?({national})$")))
    whole = "|".join(dict.fromkeys(f"{cc}(?:{national})" for cc, _, national, _ in PHONE_RULES.values()))
    at = F.upper(region)
    foreign = F.when(F.regexp_like(digits, F.lit(f"^(?:{whole})$")), F.concat(F.lit("+"), digits))
    local = F.concat(F.lit("+"), F.element_at(codes, at), F.nullif(F.call_function("regexp_extract", digits, F.element_at(readings, at), F.lit(1)), F.lit("")))
    number = F.when(F.regexp_like(spaced, F.lit(r"^\s*\+")), foreign).otherwise(local)
    return F.when(F.regexp_like(spaced, F.lit(r"^[+0-9().\s/-]+$")), number)


def phone_type(e164: Column) -> Column:
    """mobile, fixed_line, or fixed_line_or_mobile where the numbering plan does not tell them apart."""
    pattern = lambda rules: f"^\\+(?:{'|'.join(dict.fromkeys(rules))})$"
    mobile = pattern(f"{cc}(?={own})(?:{national})" for cc, _, national, own in PHONE_RULES.values() if own)
    either = pattern(f"{cc}(?:{national})" for cc, _, national, own in PHONE_RULES.values() if not own)
    known = pattern(f"{cc}(?:{national})" for cc, _, national, _ in PHONE_RULES.values())
    kind = lambda x: F.when(x.rlike(mobile), "mobile").when(x.rlike(either), "fixed_line_or_mobile").when(x.rlike(known), "fixed_line").when(x.isNotNull(), "unknown")
    return bind(e164, kind)


def looks_like_phone(c: Column) -> Column:
    """Survey: FLT13."""
    n = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return F.coalesce(n.between(7, 15) & F.regexp_like(c, F.lit(r"^[0-9+()\- ./x,]*$")), F.lit(False))


def looks_like_email(c: Column) -> Column:
    return F.coalesce((F.length(c) <= MAX_EMAIL) & F.regexp_like(c, F.lit(r"^[^@]+@[^@.]([^@]*[^@.])?$")) & F.contains(F.substring_index(c, "@", -1), F.lit(".")), F.lit(False))


def looks_like_url(c: Column) -> Column:
    """Survey: FLT14."""
    low = F.lower(F.trim(c))
    web = F.regexp_like(low, F.lit("^https?://"))
    bare = F.contains(low, F.lit(".")) & ~F.contains(low, F.lit(" ")) & ~F.regexp_like(low, F.lit(r"^[0-9.]*$"))
    return F.coalesce(F.when(web, F.contains(F.regexp_replace(low, "^https?://", ""), F.lit("."))).otherwise(bare), F.lit(False))


def one_line(*parts: Column) -> Column:
    """An address on one line: the parts that say something, comma-joined. Survey: NRM21."""
    return F.nullif(F.array_join(F.filter(F.array(*map(collapse, parts)), lambda p: p != ""), ", "), F.lit(""))


def rating(c: Column) -> Column:
    """A rating from 0 to 5, or null."""
    x = c.cast("string").try_cast("double")
    return F.when(x.between(0, 5), x)


def count_of(c: Column) -> Column:
    """A whole number printed with separators, or null."""
    return F.regexp_replace(c, r"[,\s]", "").try_cast("bigint")
