"""Entity resolution: which records are one company, merged with a log from which every merge can be taken back.

``candidate_pairs`` files each record under several keys at once and compares it with its neighbours inside a block:
blocks are sorted by name, and a record meets the next WINDOW records of its block, so a block of any size gives at most
WINDOW pairs a record. The order over all blocks is one range-partitioned sort, cut into stretches of SPAN records that
overlap by a window, so a hot block spreads over as many tasks as it has stretches.

``features`` and ``decide`` turn a pair into agreements and a probability by weighted log-likelihoods; ``cluster`` joins
the pairs that are sure into companies; ``record_merges``, ``repoint`` and ``undo`` keep the log. Rows of other tables keep
the id that they were observed under: the owner of a row follows from the merges that stand, so a merge can be
taken back in any order, and the tables are then what they would be without it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import geo
from tessera.functions import normalize as N
from tessera.functions.similarity import jaro_winkler, token_set
from tessera.operators.components import components
from tessera.scratch import Scratch

WINDOW = 10
SPAN = 5_000
AUTO_MERGE = 0.92
REVIEW = 0.70
#: Mailbox providers: a shared mail domain says nothing there.
SHARED_MAIL = ["gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.in", "outlook.com", "hotmail.com", "live.com", "icloud.com", "rediffmail.com", "proton.me", "protonmail.com"]

FIELDS = ["name", "website", "phone", "email", "lat", "lon", "registry_id"]


@dataclass(frozen=True)
class Weights:
    """log2 likelihood ratios: what an agreement, and what a disagreement, says for one company. A missing value says nothing."""

    prior: float = -6.0
    domain: tuple[float, float] = (9.0, -3.0)
    phone: tuple[float, float] = (10.0, -2.5)
    mail: tuple[float, float] = (7.0, -2.0)
    #: (least similarity, weight), the first that is met counts.
    name: list[tuple[float, float]] = field(default_factory=lambda: [(0.93, 7.0), (0.85, 2.5), (0.0, -4.0)])
    words: list[tuple[float, float]] = field(default_factory=lambda: [(0.99, 2.0), (0.5, 0.5), (0.0, -1.5)])
    #: (kilometres at most, weight).
    distance: list[tuple[float, float]] = field(default_factory=lambda: [(0.25, 6.0), (5.0, 0.5), (1e9, -3.0)])


def prepared(entities: DataFrame) -> DataFrame:
    """(id, name_key, domain, phone, mail_domain, lat, lon, place, registry_id) of records with an id and FIELDS.

    Names are folded and lose legal suffixes; hosts of platforms and of mailbox providers are no domains.
    """
    site = F.when(~N.is_platform_host(F.col("website")), N.site_domain(F.col("website")))
    mail = F.lower(F.regexp_extract("email", r"@([^@\s]+)$", 1))
    key = F.nullif(N.matching_key(F.col("name")), F.lit(""))
    return entities.select(
        "id", key.alias("name_key"), site.alias("domain"), "phone", F.when((mail != "") & ~mail.isin(SHARED_MAIL), mail).alias("mail_domain"),
        "lat", "lon", geo.geohash(F.col("lat"), F.col("lon"), 7).alias("place"), "registry_id",
    )


def blocking_keys(records: DataFrame) -> DataFrame:
    """(kind, key, sort, id): the blocks of each prepared record; a missing value gives no block."""
    keys = {
        "domain": F.col("domain"),
        "phone": F.col("phone"),
        "mail": F.col("mail_domain"),
        "place": F.concat("place", F.lit(":"), F.substring("name_key", 1, 3)),
        "registry": F.col("registry_id").cast("string"),
        "name": F.substring("name_key", 1, 1),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in keys.items()))
    blocks = records.select("id", F.coalesce("name_key", F.lit("")).alias("sort"), F.explode(pairs).alias("block"))
    return blocks.select("block.kind", "block.key", "sort", "id").where("key IS NOT NULL AND id IS NOT NULL")


def candidate_pairs(blocks: DataFrame, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """(a, b, kinds): pairs a < b that stand at most ``window`` places apart in a block sorted by ``sort``, then id.

    ``blocks`` (kind, key, sort, id) should hold a record once in each block.
    """
    spark, scratch = blocks.sparkSession, Scratch(blocks.sparkSession, "blocks")
    order = ["kind", "key", "sort", "id"]
    # in the sorted table, the place within its partition is the low part of the row's number
    number = F.monotonically_increasing_id()
    ordered = scratch.save(blocks.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", number))
    part = F.shiftright("number", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a partition
    before, at = [], 0
    for part_id, n in sizes:
        before.append((part_id, at))
        at += n
    start = spark.createDataFrame(before, "part long, start long")
    placed = ordered.withColumn("part", part).join(F.broadcast(start), "part").select(*order, (F.col("start") + F.col("number").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))
    stretch = F.floor(F.col("place") / span)
    last = F.col("place") % span >= span - window
    spread = placed.withColumn("stretch", F.explode(F.when(last, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))))
    after = W.partitionBy("stretch").orderBy("place").rowsBetween(1, window)
    row = F.struct("kind", "key", "id", F.col("place").alias("at"))
    met = spread.withColumn("next", F.collect_list(row).over(after))
    # two rows that are both copies from the stretch before have met there
    fresh = F.filter("next", lambda x: (x["kind"] == F.col("kind")) & (x["key"] == F.col("key")) & (x["id"] != F.col("id")) & (x["at"] >= F.col("stretch") * span))
    pairs = met.select("kind", "id", F.explode(fresh).alias("other"))
    a, b = F.least("id", "other.id"), F.greatest("id", "other.id")
    return pairs.groupBy(a.alias("a"), b.alias("b")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(entities: DataFrame) -> DataFrame:
    """The records with an id, dealt out over all tasks: a small file of very many records is one task's else."""
    return entities.where("id IS NOT NULL").repartition(_tasks(entities), "id")


def features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs with what their prepared records say: equal values, name similarities, distance; null where one lacks the value.

    Neighbours in a block often bear the same names, so names are compared once for each two unlike ones, not for each pair.
    """
    pairs = Scratch(pairs.sparkSession, "features").save(pairs)
    side = lambda s: records.select(*(F.col(c).alias(f"{c}_{s}") for c in records.columns))
    both = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    c = F.col
    names = ["name_key_a", "name_key_b"]
    unlike = both.where(c("name_key_a") != c("name_key_b")).select(*names).distinct()
    # few bytes, much work: as many tasks as the shuffle has, which are not merged
    likeness = unlike.repartition(_tasks(pairs), *names).select(*(c(n).alias(f"{n}_") for n in names), jaro_winkler(*map(c, names)).alias("jw"), token_set(*map(c, names)).alias("words"))
    both = both.join(likeness, (c("name_key_a") == c("name_key_a_")) & (c("name_key_b") == c("name_key_b_")), "left")
    same = c("name_key_a") == c("name_key_b")
    return both.select(
        "a", "b", "kinds",
        (c("domain_a") == c("domain_b")).alias("domain_equal"), (c("phone_a") == c("phone_b")).alias("phone_equal"), (c("mail_domain_a") == c("mail_domain_b")).alias("mail_equal"),
        F.when(same, 1.0).otherwise(c("jw")).alias("name_jw"), F.when(same, F.when(F.trim("name_key_a") != "", 1.0).otherwise(0.0)).otherwise(c("words")).alias("name_words"),
        geo.haversine_km(c("lat_a"), c("lon_a"), c("lat_b"), c("lon_b")).alias("km"), (c("registry_id_a") == c("registry_id_b")).alias("registry_equal"),
    )


def probability(weights: Weights = Weights()) -> Column:
    """How likely a pair with ``features`` is one company; 0 for two registry ids, 1 for one."""

    def says(c: str, w: tuple[float, float]) -> Column:
        return F.when(F.col(c), w[0]).when(~F.col(c), w[1]).otherwise(0.0)

    def steps(c: str, levels: list[tuple[float, float]], least: bool) -> Column:
        out = F.when(F.col(c).isNull(), 0.0)
        for bound, w in levels:
            out = out.when(F.col(c) >= bound if least else F.col(c) <= bound, w)
        return out.otherwise(0.0)

    total = F.lit(weights.prior) + says("domain_equal", weights.domain) + says("phone_equal", weights.phone) + says("mail_equal", weights.mail)
    total += steps("name_jw", weights.name, True) + steps("name_words", weights.words, True) + steps("km", weights.distance, False)
    return F.when(F.col("registry_equal"), 1.0).when(~F.col("registry_equal"), 0.0).otherwise(1 / (1 + F.pow(F.lit(2.0), -total)))


def decide(pairs: DataFrame, known: DataFrame | None = None, weights: Weights = Weights(), auto: float = AUTO_MERGE, review: float = REVIEW) -> DataFrame:
    """Adds ``score`` and ``decision``: merge, branch, review or separate.

    A branch shares domain and name with the other, at another place and phone: a location of its own, no merge. ``known``
    (a, b, same) has what people decided; it overrides the score.
    """
    branch = F.col("domain_equal") & (F.col("name_jw") >= 0.85) & (F.col("km") > 0.5) & ~F.coalesce("phone_equal", F.lit(False))
    by_score = F.when(F.col("score") == 0, "separate").when(branch & ~F.coalesce("registry_equal", F.lit(False)), "branch")
    by_score = by_score.when(F.col("score") >= auto, "merge").when(F.col("score") >= review, "review").otherwise("separate")
    scored = pairs.withColumn("score", F.round(probability(weights), 9))
    if known is None:
        return scored.withColumn("decision", by_score)
    said = known.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.bool_and("same").alias("same"))  # a no outweighs
    return scored.join(said, ["a", "b"], "left").withColumn("decision", F.when(F.col("same"), "merge").when(~F.col("same"), "separate").otherwise(by_score)).drop("same")


def cluster(decided: DataFrame, records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, winner_id, score, held) of the records that merge: the winner is the fullest record, then the smallest id.

    A cluster in which two registry ids, or a pair that people keep apart, meet by way of others is ``held`` for review.
    """
    scratch = Scratch(decided.sparkSession, "clusters")
    sure = scratch.save(decided.where("decision = 'merge'").select("a", "b", "score"))
    groups = scratch.save(components(sure.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch))
    full = sum((F.col(c).isNotNull().cast("int") for c in records.columns if c != "id"), F.lit(0))
    members = scratch.save(groups.join(records, "id").select("id", "component", "registry_id", full.alias("full")))
    winners = members.groupBy("component").agg(
        F.min(F.struct(-F.col("full"), "id"))["id"].alias("winner_id"), (F.min("registry_id") != F.max("registry_id")).alias("mixed")
    )
    apart = members.select("component").where("false").withColumn("apart", F.lit(True))
    if known is not None:
        side = lambda s: groups.select(F.col("id").alias(s), F.col("component").alias(f"of_{s}"))
        met = known.where("NOT same").join(side("a"), "a").join(side("b"), "b").where("of_a = of_b")
        apart = met.select(F.col("of_a").alias("component")).distinct().withColumn("apart", F.lit(True))
    best = sure.select(F.explode(F.array("a", "b")).alias("id"), "score").groupBy("id").agg(F.max("score").alias("score"))
    held = F.coalesce("mixed", F.lit(False)) | F.coalesce("apart", F.lit(False))
    return members.select("id", "component").join(winners, "component").join(apart, "component", "left").join(best, "id").select("id", "winner_id", "score", held.alias("held"))


# ------------------------------------------------------------------------------------------------------------------
# The log

LOG = "merge_id string, winner_id long, loser_id long, score double, merged_at timestamp, undone_at timestamp"


def owners(log: DataFrame) -> DataFrame:
    """(id, owner) of each record that a standing merge gave to another: the end of its chain of merges."""
    scratch = Scratch(log.sparkSession, "owners")
    now = scratch.save(log.where("undone_at IS NULL").select(F.col("loser_id").alias("id"), F.col("winner_id").alias("owner")))
    while True:
        of = now.select(F.col("id").alias("of"), F.col("owner").alias("next"))
        joined = now.join(of, F.col("owner") == F.col("of"), "left")
        after = scratch.save(joined.select("id", F.coalesce("next", "owner").alias("owner"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(now)
        if after.where("moved").isEmpty():
            return after.select("id", "owner")
        now = scratch.save(after.select("id", "owner"))
        scratch.drop(after)


def record_merges(log: DataFrame, clusters: DataFrame, run: str, at: Column) -> DataFrame:
    """The log with a row for each merged record of ``clusters`` (id, winner_id, score, held); repeats add nothing.

    Ids stand for their owners; a record that already belongs to the winner, or lost before, is not merged again.
    """
    owner = owners(log)
    side = lambda c: owner.select(F.col("id").alias(c), F.col("owner").alias(f"owner_{c}"))
    wanted = clusters.where("NOT held AND id <> winner_id").join(side("id"), "id", "left").join(side("winner_id"), "winner_id", "left")
    ends = wanted.select(F.coalesce("owner_winner_id", "winner_id").alias("winner_id"), F.coalesce("owner_id", "id").alias("loser_id"), "score").where("winner_id <> loser_id")
    # a record may be the winner of one merge or the loser of one, or chains could close
    once = ends.groupBy("loser_id").agg(F.min_by("winner_id", F.struct(-F.col("score"), "winner_id")).alias("winner_id"), F.max("score").alias("score"))
    taken = once.select(F.col("loser_id").alias("winner_id")).join(once.select("winner_id").distinct(), "winner_id", "left_semi").select(F.col("winner_id").alias("loser_id"))
    new = once.join(taken, "loser_id", "left_anti")
    merge_id = F.sha2(F.concat_ws(":", F.lit(run), "winner_id", "loser_id"), 256)
    rows = new.select(merge_id.alias("merge_id"), "winner_id", "loser_id", "score", at.cast("timestamp").alias("merged_at"), F.lit(None).cast("timestamp").alias("undone_at"))
    return log.unionByName(rows.join(log.select("merge_id"), "merge_id", "left_anti"))


def undo(log: DataFrame, merge_ids: DataFrame, at: Column) -> DataFrame:
    """The log in which the merges ``merge_ids`` (merge_id) no longer stand; merges taken back before stay as they are."""
    hit = merge_ids.select("merge_id").distinct().withColumn("hit", F.lit(True))
    undone = F.when(F.col("undone_at").isNull() & F.col("hit"), at.cast("timestamp")).otherwise(F.col("undone_at"))
    return log.join(hit, "merge_id", "left").withColumn("undone_at", undone).drop("hit")


def kept_apart(log: DataFrame) -> DataFrame:
    """(a, b, same): pairs whose merge was taken back, as decisions for the next run."""
    return log.where("undone_at IS NOT NULL").select(F.col("winner_id").alias("a"), F.col("loser_id").alias("b"), F.lit(False).alias("same")).distinct()


def repoint(rows: DataFrame, log: DataFrame, key: str = "company_id", out: str = "owner_id") -> DataFrame:
    """Adds the record that owns each row now: ``key`` is the id that the row was observed under, and stays."""
    own = owners(log).select(F.col("id").alias("_id"), F.col("owner").alias("_owner"))
    return rows.join(own, F.col(key) == F.col("_id"), "left").withColumn(out, F.coalesce("_owner", key)).drop("_id", "_owner")


def standing(entities: DataFrame, log: DataFrame) -> DataFrame:
    """The records that no standing merge gave to another."""
    lost = log.where("undone_at IS NULL").select(F.col("loser_id").alias("id")).distinct()
    return entities.join(lost, "id", "left_anti")


def resolve(entities: DataFrame, log: DataFrame | None = None, run: str = "run", at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(decided pairs, the log with this run's merges) of the records that stand; pairs whose merge was undone stay apart."""
    spark, scratch = entities.sparkSession, Scratch(entities.sparkSession, "resolution")
    log = spark.createDataFrame([], LOG) if log is None else log
    apart = scratch.save(kept_apart(log))
    records = scratch.save(prepared(spread(standing(entities, log))))
    decided = scratch.save(decide(features(candidate_pairs(blocking_keys(records)), records), apart))
    return decided, record_merges(log, cluster(decided, records, apart), run, F.current_timestamp() if at is None else at)
