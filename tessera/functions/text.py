"""Text rules as column expressions: redaction, CSV cells, page roles, crawl rules, socials, contacts in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions.binding import bind

# Fixed values -----------------------------------------------------------------------------------------------

#: Redactions in their order.
REDACTIONS = [
    (r"(?s)\[parameters: .*?\](?=\s*(?:\(|\[|$))", "[parameters: [redacted]]"),
    (r"(\bKey \([^)]*\)=\()[^)]*\)", "$1[redacted])"),
    (r"(https?://[^\s?#'\"]+)[?#][^\s'\"]*", "$1?[redacted]"),
    (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    (r"(?i)(bearer|token|key|secret|password)([=: ]+)(?!\()[^\s,;'\"&]+", "$1$2[redacted]"),
    (r"(?i)(\bcode=)[^\s,;'\"&]+", "$1[redacted]"),
]
MAX_ERROR_TEXT = 500
#: What a text must hold before a redaction is tried, by its place in the list.
REDACTION_SIGNS = {0: "[parameters: ", 1: "Key (", 2: "://", 3: "@"}
#: Page roles in the order in which they are tried.
PAGE_ROLES = [
    ("contact", r"(?i)\b(contact|contacts|contact-us|contactus|reach-us|enquiry|enquire|sampark)\b"),
    ("about", r"(?i)\b(about|about-us|aboutus|who-we-are|our-story|company|overview)\b"),
    ("team", r"(?i)\b(team|our-team|people|leadership|management|doctors|staff|faculty)\b"),
    ("services", r"(?i)\b(services|service|treatments|what-we-do|solutions|offerings|products)\b"),
    ("careers", r"(?i)\b(careers|career|jobs|vacancies|join-us|hiring)\b"),
]
PAGE_BUDGETS = {"quick": 1, "standard": 6, "deep": 15}
SKIP_PATH = (
    r"(?i)(^|/)(wp-admin|wp-login|wp-json|admin|login|signin|sign-in|register|signup|cart|checkout"
    r"|account|my-account|basket|feed|rss|atom|amp|print|search|tag|tags|category|categories"
    r"|author|archive|archives|page|comment|comments|wp-content|cdn-cgi|xmlrpc)(/|$|\.)"
)
SKIP_SUFFIX = (
    r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|rar|7z|gz|tar|csv|jpe?g|png|gif|webp|avif|svg|ico|bmp|tiff?"
    r"|mp[34]|m4[av]|mov|avi|webm|wav|ogg|woff2?|ttf|eot|css|js|json|xml|rss)$"
)
SOCIAL_HOSTS = [
    ("facebook", r"(^|\.)(facebook\.com|fb\.com|fb\.me)$"),
    ("instagram", r"(^|\.)(instagram\.com|instagr\.am)$"),
    ("linkedin", r"(^|\.)linkedin\.com$"),
    ("x", r"(^|\.)(twitter\.com|x\.com|t\.co)$"),
    ("youtube", r"(^|\.)(youtube\.com|youtu\.be)$"),
    ("whatsapp", r"(^|\.)(wa\.me|whatsapp\.com|api\.whatsapp\.com)$"),
]
SOCIAL_NOISE = r"(?i)^/(sharer|share|intent|dialog|plugins|tr|login|signup|help|about|legal|policies|privacy|terms|home|watch|embed|oembed)(/|$|\?)"
NOT_A_PHONE_LINE = r"(?i)\b(gstin?|pan|cin|pin ?code|invoice|order|reg\.? ?no)\b"
PHONE_CANDIDATE = r"\+?[0-9][0-9\s().-]{6,20}[0-9]"
#: Signs that a response keeps its reader out.
CHALLENGE_HEADERS = ["cf-mitigated", "x-datadome", "x-akamai-bot"]
BLOCKING_STATUS = {401: "http_401", 403: "http_403", 407: "http_407", 451: "legal_block"}
SUSPICIOUS_STATUS = [401, 403, 407, 429, 451, 503]
STRONG_MARKERS = [
    (
        "bot_challenge",
        r"(?i)(cf-browser-verification|__cf_chl|challenge-platform|checking your browser before accessing"
        r"|attention required!\s*\|\s*cloudflare|verify (you are|yourself as) (a )?human"
        r"|enable javascript and cookies to continue|(unusual|suspicious) traffic from your (computer|network)"
        r"|automated queries|access to this page has been denied|(your )?request (was |has been )?blocked)",
    )
]
WEAK_MARKERS = [
    ("captcha", r"(?i)\b(captcha|recaptcha|hcaptcha|turnstile)\b"),
    ("login_required", r"(?i)(<input[^>]+type=[\"']password[\"']|please (log|sign) ?in to continue|login required)"),
    ("paywall", r"(?i)(subscribe to (continue|read)|this (article|content) is for subscribers|paywall)"),
]
HEAD_CHARS, TAIL_CHARS, SMALL_BODY = 32 * 1024, 16 * 1024, 8 * 1024


def _redacted(c: Column, pattern: str, with_: str, sign: str | None) -> Column:
    if sign is None:
        return F.regexp_replace(c, pattern, with_)
    return bind(c, lambda x: F.when(F.contains(x, F.lit(sign)), F.regexp_replace(x, pattern, with_)).otherwise(x))


def redact(c: Column) -> Column:
    """Error text without parameters, keys, queries, addresses and credentials, cut to MAX_ERROR_TEXT. Survey: JSN7."""
    for i, (pattern, with_) in enumerate(REDACTIONS):
        c = _redacted(c, pattern, with_, REDACTION_SIGNS.get(i))
    return F.substring(c, 1, MAX_ERROR_TEXT)


def csv_cell(c: Column) -> Column:
    """A CSV cell that no spreadsheet takes for a formula, quoted where it must be."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    guarded = F.when(F.regexp_like(text, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), text)).otherwise(text)
    quoted = F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.regexp_like(guarded, F.lit(r'[",\r\n]')), quoted).otherwise(guarded)


def display(c: Column, digits: int = 4) -> Column:
    """A number with grouped thousands. Survey: JSN8."""
    return F.format_number(c, digits)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def page_role(url: Column, anchor: Column | None = None) -> Column:
    """The role that the anchor text names, else the path; null for none. Survey: NRM14."""
    out = F.lit(None).cast("string")
    path = url_path(url)
    for role, pattern in reversed(PAGE_ROLES):
        out = F.when(F.regexp_like(path, F.lit(pattern)), role).otherwise(out)
    if anchor is not None:
        for role, pattern in reversed(PAGE_ROLES):
            out = F.when(F.coalesce(F.regexp_like(anchor, F.lit(pattern)), F.lit(False)), role).otherwise(out)
    return out


def page_budget(depth: Column) -> Column:
    out = F.lit(PAGE_BUDGETS["standard"])
    for name, n in PAGE_BUDGETS.items():
        out = F.when(depth == name, n).otherwise(out)
    return out


def same_site(url: Column, site: Column) -> Column:
    return F.coalesce(N.site_domain(url) == N.site_domain(site), F.lit(False))


def is_crawlable(url: Column, site: Column) -> Column:
    """An http(s) page of the same site that is neither a file nor plumbing. Survey: FLT18."""
    path = url_path(url)
    skip = F.regexp_like(path, F.lit(SKIP_SUFFIX)) | F.regexp_like(path, F.lit(SKIP_PATH))
    return F.coalesce(F.regexp_like(url, F.lit("(?i)^https?://")) & same_site(url, site) & ~skip, F.lit(False))


def social_platform(url: Column) -> Column:
    """Survey: EXT4."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i:https?)://([^/?#]*)", 1)), ":.*$", "")
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SOCIAL_HOSTS):
        out = F.when(F.regexp_like(host, F.lit(pattern)), name).otherwise(out)
    return out


def social_handle(url: Column) -> Column:
    """The profile's handle on its platform, or null where the url names none. Survey: NRM15."""
    platform, path = social_platform(url), url_path(url)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    first, second = F.lower(F.get(parts, F.lit(0))), F.lower(F.get(parts, F.lit(1)))
    digits = F.regexp_replace(path, "[^0-9]", "")
    asked = F.regexp_replace(F.regexp_extract(url, r"(?i)phone=(\+?[0-9]+)", 1), "[^0-9]", "")
    handle = (
        F.when(platform == "whatsapp", F.coalesce(F.nullif(digits, F.lit("")), F.nullif(asked, F.lit(""))))
        .when(platform == "linkedin", F.when(first.isin("company", "in", "school", "showcase") & second.isNotNull(), F.concat(first, F.lit("/"), second)))
        .otherwise(F.nullif(F.regexp_replace(first, "^@+", ""), F.lit("")))
    )
    return F.when(platform.isNotNull() & ~F.regexp_like(F.when(path == "", F.lit("/")).otherwise(path), F.lit(SOCIAL_NOISE)), handle)


def emails_in(text: Column) -> Column:
    """Distinct usable addresses of a text, also those written with (at) and (dot), in no order. Survey: DED2, EXT2."""
    at = r"\s*(?:@|\(\s*at\s*\)|\[\s*at\s*\]|\{\s*at\s*\})\s*"
    dot = r"\s*(?:\.|\(\s*dot\s*\)|\[\s*dot\s*\]|\{\s*dot\s*\})\s*"
    pattern = rf"(?i)[a-z0-9!#$%&'*+/=?^_`|~-]+(?:\.[a-z0-9!#$%&'*+/=?^_`|~-]+)*{at}(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?{dot})+[a-z]{{2,24}}"
    clear = lambda m: N.email(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, rf"(?i){at}", "@"), rf"(?i){dot}", "."), r"\s+", ""))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), clear)
    return F.when(F.regexp_like(text, F.lit(r"(?i)@|[(\[{]\s*at\s*[)\]}]")), F.array_distinct(F.array_compact(found))).otherwise(F.array().cast("array<string>"))


def phones_in(text: Column, region: str) -> Column:
    """Distinct valid numbers of a text in E.164, in no order; lines about tax or orders are left out. Survey: EXT3."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.regexp_like(x, F.lit("[0-9]{2}")) & ~F.regexp_like(x, F.lit(NOT_A_PHONE_LINE)))
    raw = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(PHONE_CANDIDATE), F.lit(0))))
    return F.array_distinct(F.array_compact(F.transform(raw, lambda x: N.phone_e164(x, F.lit(region)))))


def reduce_page(html: Column) -> Column:
    """HTML without scripts (JSON-LD stays), comments, styles and embedded data. Survey: EXT10."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<style\b[^>]*>.*?</style\s*>", "")
    out = F.regexp_replace(out, r"(?is)<script\b(?![^>]*application/ld\+json)[^>]*>.*?</script\s*>", "")
    return F.regexp_replace(out, r"(?i)(src|href)=([\"'])data:[^\"']*\2", "$1=$2$2")


def text_of(html: Column) -> Column:
    """The words between a page's tags."""
    out = F.regexp_replace(reduce_page(html), r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#64;", "@"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return N.collapse(out)


def sitemap_urls(xml: Column, most: int = 2000) -> Column:
    """Survey: SRC22."""
    return F.slice(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), 1, most)


def restriction_reason(status: Column, headers: Column, body: Column, weak: bool = True) -> Column:
    """Why a response counts as kept from us, or null. ``headers``: array of names, lower-cased. Survey: FLT20."""
    window = F.when(F.length(body) <= HEAD_CHARS + TAIL_CHARS, body).otherwise(F.concat(F.substring(body, 1, HEAD_CHARS), F.lit("\n"), F.right(body, F.lit(TAIL_CHARS))))
    out = F.lit(None).cast("string")
    if weak:
        odd = status.isin(SUSPICIOUS_STATUS) | (F.length(body) <= SMALL_BODY)
        for name, pattern in reversed(WEAK_MARKERS):
            out = F.when(odd & F.regexp_like(window, F.lit(pattern)), name).otherwise(out)
    for name, pattern in reversed(STRONG_MARKERS):
        out = F.when(F.regexp_like(window, F.lit(pattern)), name).otherwise(out)
    out = F.when(F.coalesce(body, F.lit("")) == "", None).otherwise(out)
    for code, name in BLOCKING_STATUS.items():
        out = F.when(status == code, name).otherwise(out)
    for name in reversed(CHALLENGE_HEADERS):
        out = F.when(F.array_contains(headers, name), F.when(status == 429, "rate_limit_challenge").otherwise(f"bot_challenge:{name}")).otherwise(out)
    return out


def provenance_kind(method: Column, derivation: Column, model: Column) -> Column:
    """user, ai, derived or found. Survey: JSN5."""
    return F.when(method == "user", "user").when(model.isNotNull(), "ai").when(derivation.isNotNull(), "derived").otherwise("found")


def retry_after(header: Column, now: Column, most: int = 3600) -> Column:
    """Seconds to wait by a Retry-After header, a number or an HTTP date, between 0 and ``most``. Survey: DAT2."""
    at = F.try_to_timestamp(F.regexp_extract(header, r"^[A-Za-z]{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(F.trim(header).try_cast("double"), (F.unix_micros(at) - F.unix_micros(now)) / 1e6)
    return F.when(seconds.isNotNull(), F.least(F.greatest(seconds, F.lit(0.0)), F.lit(float(most))))


def is_own_site(url: Column, listings: list[str]) -> Column:
    """Whether a url is a business's own host: no listing's, no platform's, and no host below its registered name. Survey: FLT22, PLN8."""
    host = N.host_of(url)
    return F.coalesce((host == N.site_domain(url)) & ~N.is_platform_host(url) & ~N.registrable_stem(url).isin(listings), F.lit(False))


def decode_entities(c: Column) -> Column:
    """Common entities and percent escapes of addresses decoded, fancy dashes made plain. Survey: NRM16."""
    for entity, plain in (("&#64;", "@"), ("&commat;", "@"), ("&#46;", "."), ("&period;", "."), ("&nbsp;", " "), ("&amp;", "&"), ("%40", "@"), ("%2E", "."), ("%2e", "."), ("%20", " ")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return F.translate(c, "\u2010\u2011\u2012\u2013\u2014\u2015", "------")


def distinct_in_order(values: Column, fold: bool = False) -> Column:
    """The distinct elements of an array in their first order; ``fold``: whatever their case, as first written (DED2)."""
    if not fold:
        return F.array_distinct(values)
    lowered = F.transform(values, F.lower)
    return F.filter(values, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def shown(value: Column, kind: str) -> Column:
    """A value as people read it (JSN8): a dash for none, grouped numbers, yes or no, joined lists, rounded places.

    ``kind``: string, number, boolean, strings (an array) or place (a struct of lat and lng).
    """
    if kind == "number":
        out = F.regexp_replace(F.format_number(value, 3), r"\.?0+$", "")
    elif kind == "boolean":
        out = F.when(value, "Yes").otherwise("No")
    elif kind == "strings":
        out = F.array_join(F.transform(value, lambda x: F.coalesce(x, F.lit("—"))), " · ")
    elif kind == "place":
        out = F.format_string("%.4f, %.4f", value["lat"], value["lng"])
    else:
        out = value
    return F.when(value.isNull(), "—").otherwise(out)


#: The states that a history may be narrowed to, and the longest term.
KNOWN_STATUSES, MAX_TERM = ["queued", "running", "completed", "failed", "cancelled"], 200


def allowed_filters(status: Column, term: Column) -> Column:
    """(status, term) of a query string as a struct: unknown states are dropped, terms trimmed and cut (FLT24)."""
    return F.struct(F.when(status.isin(KNOWN_STATUSES), status).alias("status"), F.nullif(F.substring(F.trim(term), 1, MAX_TERM), F.lit("")).alias("term"))


def opening_hours(specifications: Column) -> Column:
    """Opening hours on one line of an array of (days, opens, closes); incomplete ones are left out (NRM21)."""
    day = lambda d: F.substring(F.substring_index(d, "/", -1), 1, 2)
    line = lambda s: F.when((F.size(s["days"]) > 0) & (s["opens"] != "") & (s["closes"] != ""), F.concat(F.array_join(F.transform(s["days"], day), ","), F.lit(" "), s["opens"], F.lit("-"), s["closes"]))
    return F.nullif(F.array_join(F.transform(specifications, line), "; "), F.lit(""))
