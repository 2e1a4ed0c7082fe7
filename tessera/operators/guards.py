"""Decision functions: tenants, roles, addresses that may be fetched, robots rules."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.binding import bind
from tessera.shipping import ship

#: What each role may do.
ROLES = {
    "owner": ["read", "research", "export", "billing", "members", "settings", "delete", "audit"],
    "admin": ["read", "research", "export", "members", "settings", "audit"],
    "member": ["read", "research", "export"],
    "viewer": ["read"],
    "billing": ["read", "billing"],
}
METADATA_HOSTS = ["169.254.169.254", "metadata.google.internal", "100.100.100.200", "fd00:ec2::254"]


def tenant_rows(df: DataFrame, org_id: str | None) -> DataFrame:
    """Rows of the current tenant; without a tenant, none. Survey: FLT25."""
    return df.where(F.lit(False)) if org_id is None else df.where(F.col("org_id") == org_id)


def allowed(role: Column, permission: Column) -> Column:
    """Survey: FLT26."""
    grants = F.create_map(*(x for r, ps in ROLES.items() for x in (F.lit(r), F.array(*map(F.lit, ps)))))
    return F.coalesce(F.array_contains(F.element_at(grants, role), permission), F.lit(False))


def _rejection(url: str | None) -> str | None:
    try:
        parts = urlsplit(url or "")
        host = parts.hostname
    except ValueError:
        return "unparsable"
    if parts.scheme.lower() not in ("http", "https"):
        return "scheme"
    if parts.username or parts.password:
        return "userinfo"
    if not host:
        return "host"
    if host in METADATA_HOSTS:
        return "metadata"
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return "local" if host == "localhost" or host.endswith((".localhost", ".internal", ".local")) else None
    inner = getattr(address, "ipv4_mapped", None) or getattr(address, "sixtofour", None)
    return None if (inner or address).is_global else "address"


def with_url_rejection(df: DataFrame, url: Column, out: str = "reason") -> DataFrame:
    """Adds why a url may not be fetched, or null. Survey: FLT19."""

    @F.pandas_udf(T.StringType())
    def rejection(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in urls:
            yield s.map(_rejection, na_action=None).astype(object)

    ship(df.sparkSession)
    return df.withColumn(out, rejection(url))


RULES = "array<struct<allow:boolean,path:string>>"


def robots_rules(text: Column, agent: str) -> Column:
    """(rules, crawl_delay) that a robots file holds for an agent, as a struct (FLT21).

    Lines of user agents that follow each other share the rules after them. The groups that name the agent count, all
    of them; without any, the groups for ``*``. Comments, blank lines and unknown lines part no group.
    """
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    pairs = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("value")))
    none, no_delay = F.array().cast(RULES), F.lit(None).cast("double")
    start = F.struct(
        F.lit(False).alias("naming"), F.lit(False).alias("mine"), F.lit(False).alias("every"), F.lit(False).alias("named"),
        none.alias("own"), none.alias("star"), no_delay.alias("own_delay"), no_delay.alias("star_delay"),
    )

    def step(s: Column, p: Column) -> Column:
        is_agent, is_rule, is_delay = p["key"] == "user-agent", p["key"].isin("allow", "disallow") & (p["value"] != ""), p["key"] == "crawl-delay"
        hit = is_agent & (p["value"] != "") & (p["value"] != "*") & F.startswith(F.lit(agent.lower()), F.lower(p["value"]))
        mine = F.when(is_agent, hit | (s["naming"] & s["mine"])).otherwise(s["mine"])
        every = F.when(is_agent, (p["value"] == "*") | (s["naming"] & s["every"])).otherwise(s["every"])
        rule = F.struct((p["key"] == "allow").alias("allow"), p["value"].alias("path"))
        seconds = p["value"].try_cast("double")
        other = ~is_agent & ~p["key"].isin("allow", "disallow", "crawl-delay")
        return F.struct(
            F.when(other, s["naming"]).otherwise(is_agent).alias("naming"), mine.alias("mine"), every.alias("every"), (s["named"] | hit).alias("named"),
            F.when(is_rule & mine, F.array_append(s["own"], rule)).otherwise(s["own"]).alias("own"), F.when(is_rule & every, F.array_append(s["star"], rule)).otherwise(s["star"]).alias("star"),
            F.when(is_delay & mine, F.coalesce(s["own_delay"], seconds)).otherwise(s["own_delay"]).alias("own_delay"), F.when(is_delay & every, F.coalesce(s["star_delay"], seconds)).otherwise(s["star_delay"]).alias("star_delay"),
        )

    end = lambda s: F.struct(F.when(s["named"], s["own"]).otherwise(s["star"]).alias("rules"), F.when(s["named"], s["own_delay"]).otherwise(s["star_delay"]).alias("crawl_delay"))
    return F.aggregate(pairs, start, step, end)


def robots_decision(status: Column, text: Column, agent: str, path: Column) -> Column:
    """(allowed, reason, crawl_delay) for a path with its query, as a struct (FLT21).

    2xx: the longest pattern that fits decides, allow wins a tie; ``*`` stands for anything, ``$`` for the end. 4xx:
    no rules, so allowed. Anything else: not known, so not allowed.
    """
    regex = lambda p: F.concat(F.lit("^\\Q"), F.replace(F.regexp_replace(p, r"\$$", ""), F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E"), F.when(F.endswith(p, F.lit("$")), "$").otherwise(""))
    fits = lambda found: F.filter(found["rules"], lambda r: F.regexp_like(path, regex(r["path"])))
    best = lambda rules: F.array_max(F.transform(rules, lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow"))))
    verdict = lambda allowed, reason, delay: F.struct(allowed.alias("allowed"), F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"), delay.alias("crawl_delay"))
    none = F.lit(None).cast("double")

    def judged(found: Column) -> Column:
        allowed = F.coalesce(best(fits(found))["allow"], F.lit(True))
        return verdict(allowed, F.when(allowed, "robots_allow").otherwise("robots_disallow"), found["crawl_delay"])

    known = bind(robots_rules(text, agent), judged)
    return F.when(status.between(200, 299), known).when(status.between(400, 499), verdict(F.lit(True), "robots_absent", none)).otherwise(verdict(F.lit(False), "robots_unavailable", none))
