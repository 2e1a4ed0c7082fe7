"""Writing the company graph: set-based (state, batch) -> new state operators over snapshots.

Identity keys that are null are never joined or grouped on; their rows are split off first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import normalize as N
from tessera.scratch import Scratch


def resolve_companies(candidates: DataFrame, known_places: DataFrame, known_domains: DataFrame) -> DataFrame:
    """Adds company_id and is_new_company to a batch (ordinal, place_id, url, name).

    A known place keeps its company. Otherwise the first candidate of a place leads it; leaders with a domain of
    their own share its company, an existing one first; all others get a company of their own. Ids of new companies
    are hashes of what identifies them.

    Survey: JN12, UPS1.
    """
    domain = F.when(~N.is_platform_host(F.col("url")), N.registrable_domain(F.col("url")))
    rows = candidates.withColumn("domain", domain)
    alone = F.concat(F.lit("#"), "ordinal")  # a key of its own for every row without a place or domain
    rows = rows.withColumn("_place", F.coalesce(F.concat(F.lit("p"), "place_id"), alone))
    rows = rows.join(known_places.select(F.concat(F.lit("p"), "place_id").alias("_place"), F.col("company_id").alias("_by_place")), "_place", "left")
    lead = W.partitionBy("_place").orderBy("ordinal").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("_domain", F.first("domain").over(lead)).withColumn("_key", F.coalesce(F.concat(F.lit("d"), "_domain"), alone))
    rows = rows.join(known_domains.select(F.concat(F.lit("d"), "domain").alias("_key"), F.col("company_id").alias("_by_domain")), "_key", "left")
    own = F.sha2(F.when(F.col("_domain").isNotNull(), F.concat(F.lit("d"), "_domain")).otherwise(F.col("_place")), 256)
    return rows.withColumn("company_id", F.coalesce("_by_place", "_by_domain", own)).withColumn("is_new_company", F.col("_by_place").isNull() & F.col("_by_domain").isNull()).drop("_by_place", "_by_domain", "_place", "_domain", "_key")


def upsert(state: DataFrame, batch: DataFrame, key: str, newer: list[str], kept: list[str] = ()) -> DataFrame:
    """Full outer join on the key: ``newer`` columns take the batch's value unless null, ``kept`` the state's. Survey: UPS2."""
    joined = state.alias("s").join(batch.alias("b"), key, "full_outer")
    columns = [F.coalesce(F.col(f"b.{c}"), F.col(f"s.{c}")).alias(c) for c in newer]
    columns += [F.coalesce(F.col(f"s.{c}"), F.col(f"b.{c}")).alias(c) for c in kept]
    return joined.select(key, *columns)


def insert_new(state: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The batch's rows whose key the state lacks, one for each key. Survey: UPS7."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return batch.withColumn("_rank", rank).where("_rank = 1").drop("_rank").join(state.select(*keys).distinct(), keys, "left_anti")


def record_domains(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """New (company_id, domain, is_primary, is_platform) rows of (company_id, url). Survey: UPS3."""
    rows = pairs.select("company_id", N.registrable_domain(F.col("url")).alias("domain"), N.is_platform_host(F.col("url")).alias("is_platform")).where(F.col("domain").isNotNull())
    rows = rows.dropDuplicates(["company_id", "domain"]).withColumn("is_primary", ~F.col("is_platform"))
    return rows.join(state.select("company_id", "domain"), ["company_id", "domain"], "left_anti")


def deliver(pending: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key of ``pending`` with is_new: whether the tenant did not hold it yet. Survey: JN13, UPS6."""
    mine = held.select(*keys).distinct().withColumn("_held", F.lit(True))
    return pending.select(*keys).distinct().join(mine, keys, "left").withColumn("is_new", F.col("_held").isNull()).drop("_held")


def upsert_tasks(state: DataFrame, tasks: DataFrame) -> DataFrame:
    """(job_id, task_key, inserted) for each planned task; a key that is there already is not inserted. Survey: UPS8."""
    there = state.select("job_id", "task_key", F.lit(True).alias("_there")).distinct()
    return tasks.select("job_id", "task_key").distinct().join(there, ["job_id", "task_key"], "left").select("job_id", "task_key", F.col("_there").isNull().alias("inserted"))


def claim_units(events: DataFrame, claimed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Usage events that count: the first of each unit key that was not claimed before. Survey: DED7."""
    return insert_new(claimed, events, keys, [F.asc(c) for c in order])


def finished_jobs(tasks: DataFrame, open_states: list[str]) -> DataFrame:
    """(job_id) of jobs without a task in an open state. Survey: UPS10."""
    return tasks.groupBy("job_id").agg(F.bool_and(~F.col("status").isin(open_states)).alias("done")).where("done").select("job_id")


def guarded_status(current: Column, wanted: Column, terminal: list[str]) -> Column:
    """The wanted status, unless the current one is final. Survey: UPS11."""
    return F.when(current.isin(terminal), current).otherwise(wanted)


def expired(values: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Values older than their source's retention. Survey: JN9."""
    joined = values.join(sources.where(F.col("retention_days").isNotNull()), "source_id")
    return joined.where(F.col("observed_at") < now - F.make_dt_interval(F.col("retention_days")))


def fully_exported(leads: DataFrame, cutoff: Column) -> DataFrame:
    """(company_id) of companies all of whose leads were exported before the cutoff. Survey: JN10, AGG11."""
    done = F.bool_and(F.col("exported_at").isNotNull() & (F.col("exported_at") < cutoff))
    return leads.groupBy("company_id").agg(done.alias("done")).where("done").select("company_id")


def prune(values: DataFrame, companies: DataFrame) -> DataFrame:
    """Values of the companies that stay. Survey: UPS12."""
    return values.join(companies, values["entity_id"] == companies["company_id"], "left_anti")


def change_role(members: DataFrame, user_id: str, role: str) -> DataFrame:
    """Memberships with one role changed; the last owner of an organisation keeps theirs. Survey: AGG15, UPS13."""
    owners = F.count_if(F.col("role") == "owner").over(W.partitionBy("org_id"))
    last = (F.col("role") == "owner") & (owners == 1) & (F.lit(role) != "owner")
    return members.withColumn("role", F.when((F.col("user_id") == user_id) & ~last, F.lit(role)).otherwise(F.col("role")))


def duplicates_by_content(fetches: DataFrame) -> DataFrame:
    """Adds owner_id and deduplicated: of fetches of one url with equal content, the first owns the body. Survey: SNK3, DED3."""
    w = W.partitionBy("url_hash", "content_hash").orderBy("fetched_at", "id")
    owner = F.when(F.col("content_hash").isNotNull(), F.first("id").over(w)).otherwise(F.col("id"))
    return fetches.withColumn("owner_id", owner).withColumn("deduplicated", F.col("owner_id") != F.col("id"))


def task_tree(tasks: DataFrame) -> DataFrame:
    """(id, root_id, level) of tasks (id, parent_id); orphans and their own parents are roots.

    Pointers double their reach with each pass, so a tree of any depth takes the logarithm of it in joins. What no
    root reaches, a longer cycle and what hangs on it, is left out. ``id`` is unique.

    Survey: JSN6.
    """
    scratch = Scratch(tasks.sparkSession, "tree")
    ids = tasks.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    real = tasks.where(F.col("parent_id").isNotNull() & (F.col("parent_id") != F.col("id"))).join(ids, "parent_id")
    up = tasks.select("id").join(real.select("id", "parent_id"), "id", "left").select("id", F.col("parent_id").alias("up"), F.coalesce("parent_id", "id").alias("root_id"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("level"))
    up = scratch.save(up)
    n, waiting = up.agg(F.count("*"), F.count("up")).first()
    for _ in range(n.bit_length()):
        if not waiting:
            break
        far = up.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("root_id").alias("root2"), F.col("level").alias("level2"))
        done = up.where(F.col("up").isNull())  # apart from the join: a null key would meet in one task
        after = scratch.save(up.where(F.col("up").isNotNull()).join(far, "up").select("id", F.col("up2").alias("up"), F.col("root2").alias("root_id"), (F.col("level") + F.col("level2")).alias("level")).unionByName(done))
        scratch.drop(up)
        up, waiting = after, after.agg(F.count("up")).first()[0]
    return up.where(F.col("up").isNull()).select("id", "root_id", "level")


def bootstrap_org(requests: DataFrame, signup_credits: int) -> dict[str, DataFrame]:
    """Rows of each table that a new organisation needs, for requests (user_id, org_name): ids are hashes of both. Survey: UPS14."""
    rows = requests.withColumn("org_id", F.sha2(F.concat_ws("\x1f", "user_id", "org_name"), 256))
    rows = rows.withColumn("workspace_id", F.sha2(F.concat("org_id", F.lit("/workspace")), 256)).withColumn("slug", N.slugify(F.col("org_name")))
    return {
        "organizations": rows.select(F.col("org_id").alias("id"), F.col("org_name").alias("name"), "slug"),
        "workspaces": rows.select(F.col("workspace_id").alias("id"), "org_id", F.lit("Default").alias("name")),
        "memberships": rows.select("org_id", "user_id", F.lit("owner").alias("role")),
        "audit": rows.select("org_id", F.col("user_id").alias("actor"), F.lit("org.created").alias("action"), F.col("org_id").alias("target")),
        "credit_ledger": rows.select("org_id", F.lit(signup_credits).cast("long").alias("delta"), F.lit("grant").alias("reason")),
    }


def audit_entries(changes: DataFrame, actor: Column, action: str, target: Column, meta: Column) -> DataFrame:
    """Audit rows of a set of changes: who did what to what, with details as JSON; appended, never updated. Survey: SNK10."""
    return changes.select(actor.alias("actor"), F.lit(action).alias("action"), target.cast("string").alias("target"), F.to_json(meta).alias("meta"))


def stamp_exported(leads: DataFrame, exported: DataFrame, at: Column) -> DataFrame:
    """``leads`` with exported_at set on those that a file held (``exported``: lead_id), once it was sent (SNK7).

    A lead that was exported before keeps its first time.
    """
    sent = exported.select("lead_id", F.lit(True).alias("_sent")).distinct()
    joined = leads.join(sent, "lead_id", "left")
    return joined.withColumn("exported_at", F.coalesce("exported_at", F.when(F.col("_sent"), at))).drop("_sent")
