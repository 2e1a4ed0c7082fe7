"""Health, usage, dashboard and billing reports as conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """Rounded to a whole number, halves away from zero."""
    return F.round(c).cast("long")


def health_by_type(tasks: DataFrame, since: Column) -> DataFrame:
    """Tasks of each type since a time: counts by status, mean duration and last end.

    ``tasks``: type, status, attempts, error_class, started_at, finished_at, created_at.

    Survey: AGG1.
    """
    recent = tasks.where(F.col("created_at") >= since)
    ms = F.unix_millis("finished_at") - F.unix_millis("started_at")
    state = lambda *s: F.count_if(F.col("status").isin(*s))
    return recent.groupBy("type").agg(
        F.count("*").alias("total"), state("succeeded").alias("succeeded"), state("failed").alias("failed"),
        state("queued").alias("queued"), state("running").alias("running"), state("cancelled").alias("cancelled"),
        F.count_if(F.col("attempts") > 1).alias("retried"), F.count_if(F.col("error_class") == "rate_limited").alias("rate_limited"),
        F.count_if(F.col("error_class") == "transient").alias("transient"),
        half_up(F.avg(ms)).alias("avg_ms"), F.max("finished_at").alias("last_finished"),
    )


def usage_by_meter(events: DataFrame, since: Column) -> DataFrame:
    """Events, units, credits, cost and tenants of each meter, dearest first. Survey: AGG2."""
    return (
        events.where(F.col("created_at") >= since)
        .groupBy("meter")
        .agg(F.count("*").alias("events"), F.sum("units").alias("units"), F.sum("credits").alias("credits"), F.sum("cost_micros").alias("cost_micros"), F.countDistinct("org_id").alias("orgs"), F.max("created_at").alias("last_at"))
        .orderBy(F.desc("cost_micros"), F.desc("events"), "meter")
    )


def usage_rollup(events: DataFrame) -> DataFrame:
    """Totals by tenant, meter and day, with the sums over each and all (level 0 is the finest). Survey: AGG21."""
    day = events.withColumn("day", F.to_date("created_at"))
    return day.rollup("org_id", "meter", "day").agg(F.count("*").alias("events"), F.sum("cost_micros").alias("cost_micros"), F.grouping_id().alias("level"))


def _usage_totals() -> list[Column]:
    return [F.count("*").alias("events"), F.sum("cost_micros").alias("cost_micros")]


def usage_cube(events: DataFrame, keys: list[str]) -> DataFrame:
    """Totals by every combination of the keys (of org_id, meter, day), with the level that tells which (AGG21)."""
    return events.withColumn("day", F.to_date("created_at")).cube(*keys).agg(*_usage_totals(), F.grouping_id().alias("level"))


def usage_sets(events: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Totals by each of several sets of keys (AGG21); keys that a set lacks are null."""
    day = events.withColumn("day", F.to_date("created_at"))
    keys = list(dict.fromkeys(k for keys in sets for k in keys))
    return day.groupingSets([[F.col(k) for k in keys] for keys in sets], *keys).agg(*_usage_totals())


#: log2 of the registers of distinct sketches, and the size parameter of quantile sketches.
DISTINCT_BITS, QUANTILE_K = 12, 400
#: Errors that these sizes keep with near certainty: three standard errors of a count; of a rank, as a share of all.
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.01


def usage_sketches(events: DataFrame, keys: list[str], who: str = "user_id", value: str = "cost_micros") -> DataFrame:
    """(day, keys, n, total, users, costs): a row for each day and key, to be kept as a table and merged for any range.

    ``users`` is a sketch of the distinct ``who``, ``costs`` one of the quantiles of ``value``; both have a bounded size
    and merge without the events (AGG21).
    """
    day = events.withColumn("day", F.to_date("created_at"))
    return day.groupBy("day", *keys).agg(
        F.count("*").alias("n"), F.sum(value).cast("long").alias("total"), F.hll_sketch_agg(who, F.lit(DISTINCT_BITS)).alias("users"),
        F.kll_sketch_agg_bigint(F.col(value).cast("long"), F.lit(QUANTILE_K)).alias("costs"),
    )


def sketched_usage(sketches: DataFrame, keys: list[str], first: Column, last: Column, shares: list[float] = (0.5, 0.95)) -> DataFrame:
    """(keys, n, total, users, q50, q95 ...) of the days ``first`` to ``last``, from kept sketches alone."""
    merged = sketches.where(F.col("day").between(first, last)).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), F.kll_merge_agg_bigint("costs").alias("costs")
    )
    quantiles = [F.kll_sketch_get_quantile_bigint("costs", F.lit(q)).alias(f"q{round(100 * q)}") for q in shares]
    return merged.select(*keys, "n", "total", "users", *quantiles)


def crawl_health(tasks: DataFrame, documents: DataFrame, spend: DataFrame, leads: DataFrame, exact: bool = False) -> DataFrame:
    """One row of crawl figures (AGG3); rates without a denominator are null.

    The 95th percentile is within a ten-thousandth of its rank, from a summary of bounded size; ``exact`` interpolates
    between values as the report's SQL does, at the price of a count for each distinct duration in one task.

    ``tasks``: status, pages_read, values_found, started_at, finished_at. ``documents``: access_status, storage_key,
    content_hash, bytes. ``spend``: cost_micros.

    Survey: JN17.
    """
    ms = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000
    state = lambda s: F.count_if(F.col("status") == s)
    pages, found = F.coalesce("pages_read", F.lit(0)), F.coalesce("values_found", F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    task = tasks.agg(
        F.count("*").alias("tasks"), state("completed").alias("completed"), state("failed").alias("failed"), state("running").alias("running"), total(pages).alias("pages_read"),
        F.count_if((pages == 0) & (F.col("status") == "completed")).alias("read_nothing"), F.count_if((pages > 0) & (found == 0)).alias("found_nothing"), total(found).alias("values_found"),
        half_up(F.avg(ms)).alias("avg_ms"), half_up(F.percentile(ms, 0.95) if exact else F.percentile_approx(ms, 0.95, 10_000)).alias("p95_ms"), F.max("finished_at").alias("last_finished"),
    )
    stored, access = F.col("storage_key").isNotNull(), lambda s: F.count_if(F.col("access_status") == s)
    document = documents.agg(
        F.count("*").alias("documents"), access("ok").alias("ok"), access("restricted").alias("restricted"), access("error").alias("error"), F.count_if(stored).alias("stored"),
        F.count_if(F.col("content_hash").isNotNull() & ~stored).alias("deduplicated"), total(F.when(stored, F.col("bytes"))).alias("stored_bytes"),
    )
    one = task.crossJoin(document).crossJoin(spend.agg(total(F.col("cost_micros")).alias("cost_micros"))).crossJoin(leads.agg(F.count("*").alias("leads")))  # four single rows
    return one.withColumn("cost_per_lead", half_up(F.try_divide("cost_micros", "leads")))


def lead_counts(leads: DataFrame, channels: DataFrame, now: Column) -> DataFrame:
    """Leads in all, today, in 7 and 30 days, and how many have each contact channel.

    ``channels``: company_id and one boolean column for each channel, one row for each company.

    Survey: AGG4, DAT1.
    """
    names = [c for c in channels.columns if c != "company_id"]
    joined = leads.join(channels, "company_id", "left")
    since = lambda days: F.count_if(F.col("created_at") >= F.date_trunc("day", now) - F.make_dt_interval(F.lit(days)))
    return joined.agg(
        F.count("*").alias("total"), since(0).alias("today"), since(7).alias("last_7_days"), since(30).alias("last_30_days"),
        *(F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(f"with_{c}") for c in names),
    )


def channel_marks(values: DataFrame, channels: list[str]) -> DataFrame:
    """(company_id, one boolean for each channel) in one pass over current values. Survey: JN8."""
    return values.where("is_current").groupBy(F.col("entity_id").alias("company_id")).agg(*(F.bool_or(F.col("field") == c).alias(c) for c in channels))


def job_counts(jobs: DataFrame) -> DataFrame:
    """Jobs by state on the dashboard; a cancelled one counts as failed. Survey: AGG5."""
    state = lambda *s: F.count_if(F.col("status").isin(*s))
    return jobs.agg(
        F.count("*").alias("total"), state("queued").alias("queued"), state("running").alias("running"), state("completed").alias("completed"),
        state("failed", "cancelled").alias("failed"), F.max("finished_at").alias("last_finished"),
    )


def credits_spent(ledger: DataFrame, since: Column) -> DataFrame:
    """Survey: AGG6."""
    return ledger.where((F.col("reason") == "consume") & (F.col("created_at") >= since)).groupBy("org_id").agg(F.coalesce(-F.sum("delta"), F.lit(0)).alias("spent"))


def reserved_for(ledger: DataFrame) -> DataFrame:
    """Credits still reserved for each job. Survey: AGG8."""
    held = F.col("reason").isin("reserve", "release")
    return ledger.where(held).groupBy("org_id", F.col("ref_id").alias("job_id")).agg((-F.sum("delta")).alias("reserved"))


def settle(jobs: DataFrame, ledger: DataFrame, usage: DataFrame) -> DataFrame:
    """(job_id, org_id, reserved, used, delta, released, balance_effect) of all jobs at once.

    used is the usage within the reservation; delta what was not booked before; a reservation is released once.

    Survey: AGG9.
    """
    entries = ledger.where(F.col("ref_type") == "job").groupBy(F.col("ref_id").alias("job_id")).agg(
        F.coalesce(F.sum(F.when(F.col("reason") == "reserve", -F.col("delta"))), F.lit(0)).alias("reserved"),
        F.coalesce(F.sum(F.when(F.col("reason") == "consume", -F.col("delta"))), F.lit(0)).alias("consumed"),
        F.count_if(F.col("reason") == "release").alias("releases"),
    )
    credits = usage.groupBy("job_id").agg(F.sum("credits").alias("credits"))
    rows = jobs.select("job_id", "org_id").join(entries, "job_id").join(credits, "job_id", "left")
    used = F.least(F.coalesce("credits", F.lit(0)), F.col("reserved"))
    rows = rows.withColumn("used", used).withColumn("delta", F.greatest(F.col("used") - F.col("consumed"), F.lit(0)))
    released = F.when(F.col("releases") == 0, F.col("reserved")).otherwise(0)
    return rows.select("job_id", "org_id", "reserved", "used", "delta", (F.col("reserved") - F.col("used")).alias("released"), (released - F.col("delta")).alias("balance_effect"))


def counters(progress: DataFrame, names: list[str]) -> DataFrame:
    """(job_id, counters): sums of a closed set of named counters, as a map. Survey: AGG13."""
    sums = progress.where(F.col("counter").isin(names)).groupBy("job_id", "counter").agg(F.sum("n").alias("n"))
    return sums.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("counter", "n")))).alias("counters"))


def delivered(links: DataFrame) -> DataFrame:
    """Leads of each job, and those that were new: one lead, one charge. Survey: AGG12."""
    return links.groupBy("job_id").agg(F.countDistinct("lead_id").alias("found"), F.countDistinct(F.when(F.col("is_new"), F.col("lead_id"))).alias("new"))


def recall_by_field(labels: DataFrame) -> DataFrame:
    """Found, missed, wrong and other values of each field, and recall; null where nothing was expected.

    ``labels``: field, expected, extracted.

    Survey: AGG18.
    """
    e, x = F.col("expected"), F.col("extracted")
    counts = labels.groupBy("field").agg(
        F.count_if(e.isNotNull() & (e == x)).alias("found"), F.count_if(e.isNotNull() & x.isNull()).alias("missed"),
        F.count_if(e.isNotNull() & x.isNotNull() & (e != x)).alias("wrong"), F.count_if(e.isNull() & x.isNotNull()).alias("other"),
    )
    return counts.withColumn("recall", F.try_divide("found", F.col("found") + F.col("missed") + F.col("wrong")))


def eval_report(cases: DataFrame) -> DataFrame:
    """Pass rate, field accuracy and cost for a thousand of each task's cases. Survey: AGG17."""
    return cases.groupBy("task").agg(
        F.count("*").alias("cases"), F.avg(F.col("passed").cast("double")).alias("pass_rate"),
        F.try_divide(F.sum("fields_right"), F.sum("fields")).alias("field_accuracy"), F.try_divide(F.sum("cost_micros") * 1000, F.count("*")).alias("cost_micros_per_1k"),
    )


def sources_of(values: DataFrame, key: str) -> DataFrame:
    """Survey: AGG16."""
    return values.groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def members_by_org(members: DataFrame) -> DataFrame:
    """Survey: AGG14."""
    return members.groupBy("org_id").agg(F.countDistinct("user_id").alias("members"), F.count_if(F.col("role") == "owner").alias("owners"))


def due_jobs(jobs: DataFrame, settled: DataFrame, states: list[str], limit: int) -> DataFrame:
    """(at, job_id, org_id): finished jobs that are not settled yet, the oldest first, up to a batch's limit. Survey: AGG20, STR16."""
    open_ = jobs.where(F.col("status").isin(states)).join(settled.select("job_id").distinct(), "job_id", "left_anti")
    return open_.orderBy("created_at", "job_id").limit(limit).select("job_id", "org_id", "created_at")


def workspace_members(memberships: DataFrame, users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Members with their addresses, and names where they gave any. Survey: JN16."""
    return memberships.join(users, "user_id").join(profiles, "user_id", "left")
