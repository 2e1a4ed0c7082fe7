"""URL filtering by fixed host/path rules and by mined association rules, all in DataFrame operations.

``with_parts`` takes a url apart, ``with_rule`` finds the longest fixed rule that fits, ``mine_rules`` runs Spark's
FP-growth over the token sets of labelled urls, and ``match_rules`` finds the mined rules of each distinct url
through an inverted index: a mined rule is filed under its rarest token, so a url meets only the rules that are
filed under one of its tokens, and one set test decides.

A mined rule must say more than the labels' base rate: besides support and confidence it needs ``MIN_LIFT`` and a
chi-square test of its antecedent against the label at ``ALPHA``, divided by the number of antecedents that were
tested. Where labels have nothing to do with urls, all mined rules together block anything with probability ALPHA.

FP-growth lists every frequent set, so what it gets is bounded before. Exact: tokens that are in too few labelled
urls, or in so few that even if all of these were blocked the test could not succeed, are in no rule at all; tokens
of the same labelled urls stand for each other, and one of them (the smallest) speaks for all. FP-growth cannot be
held to short sets, so it sees the ``MAX_WIDTH`` tokens of each url that tell most. Sets that reach beyond these in any
blocked url are counted level by level instead (``sets_beyond``): all frequent sets of up to ``MAX_ANTECEDENT`` tokens, the
length of a rule, are listed, however wide urls are. What is listed is counted anew over the whole token sets of all
labelled urls, so support, confidence, lift and test of every rule are exact.

Null urls and urls without ``://`` have an empty host and path and no tokens; they are allowed unless a rule says
otherwise. Repeated rows are each judged; equal urls get equal verdicts. An empty label table mines no rule, an empty
url table gives an empty result. Columns named host, path, rule, verdict or confidence are replaced; other columns
stay, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import Scratch, ascii_lower, unused

MIN_SUPPORT = 0.002
MIN_URLS = 20
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.5
ALPHA = 0.01
MAX_ANTECEDENT = 3
MAX_WIDTH = 12
BLOCKED = "label=block"


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path, both empty where the url has no ``://``."""
    after = unused([*df.columns, "host", "path"], "_rest")[0]
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    return (
        df.withColumn(after, rest)
        .withColumn("host", ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0)))
        .withColumn("path", F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1))
        .drop(after)
    )


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``rule`` (host and path of the longest rule that fits, else null) and ``rule_verdict``.

    ``rules`` are (verdict, host, path): a short list given by hand. A rule fits its host and every subdomain.
    """
    name = verdict = F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return df.withColumn("rule", name).withColumn("rule_verdict", verdict)


def tokens(url: str = "url") -> Column:
    """Distinct tokens of a url with host and path columns: scheme, host labels and words, path words, query keys."""
    host = F.array_compact(F.transform(F.split("host", r"\."), lambda x: F.when(x != "", F.concat(F.lit("h:"), x))))
    words = F.transform(F.filter(F.split("host", r"[^a-z]+"), lambda x: F.length(x) > 2), lambda x: F.concat(F.lit("w:"), x))
    steps = F.filter(F.split(ascii_lower(F.col("path")), r"[^a-z]+"), lambda x: x != "")
    keys = F.regexp_extract_all(F.coalesce(F.col(url), F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1))
    return F.array_distinct(
        F.concat(host, words, F.transform(steps, lambda x: F.concat(F.lit("p:"), x)), F.transform(keys, lambda x: F.concat(F.lit("q:"), x)))
    )


def critical_value(tests: int, alpha: float = ALPHA) -> float:
    """The chi-square value (one degree) that chance exceeds upwards with probability alpha in any of so many tests."""
    return NormalDist().inv_cdf(1 - alpha / max(1, tests)) ** 2


def _chi(hits: Column, n: Column, blocked: int, total: int) -> Column:
    """The chi-square statistic of n urls, hits of them blocked, against all labelled urls."""
    hits, n = hits.cast("double"), n.cast("double")
    return total * (hits * total - n * blocked) ** 2 / (n * (total - n) * float(blocked) * float(total - blocked) + 1e-9)


def telling_tokens(labelled: DataFrame, least: int, blocked: int, total: int) -> DataFrame:
    """(token, chi) that a rule of ``labelled`` (tokens, label) may use: see the module's text on what is left out."""
    hit = F.col("label") == "block"
    key = F.xxhash64("tokens", F.monotonically_increasing_id())
    spread = labelled.select(hit.alias("hit"), key.alias("key"), F.explode("tokens").alias("token"))
    counts = spread.groupBy("token").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.sum(F.col("key").cast("decimal(38,0)")).alias("sum"), F.bit_xor("key").alias("xor")
    )
    # no set with the token has more hits than the token, and none tells more than its hits alone would
    within = (F.col("hits") >= least) & (_chi(F.col("hits"), F.col("hits"), blocked, total) >= critical_value(1))
    same = counts.where(within).groupBy("n", "hits", "sum", "xor").agg(F.min("token").alias("token"))
    return same.select("token", _chi(F.col("hits"), F.col("n"), blocked, total).alias("chi"))


def recounted(sets: DataFrame, labelled: DataFrame) -> DataFrame:
    """(antecedent, n, hits): in how many rows of ``labelled`` each set stands, and in how many blocked ones.

    A set is filed under its rarest token, so a row meets only the sets that are filed under one of its tokens.
    """
    spread = labelled.select((F.col("label") == "block").alias("hit"), "tokens", F.explode("tokens").alias("token"))
    counts = spread.groupBy("token").agg(F.count("*").alias("n"))
    index = sets.select("antecedent", F.explode("antecedent").alias("token")).join(counts, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    met = spread.join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return met.groupBy("antecedent").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


def sets_beyond(ranked: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """(antecedent): sets of up to MAX_ANTECEDENT tokens in ``least`` blocked urls that some blocked url holds with a token beyond its narrow ones.

    ``ranked`` (id, label, token, rank) are the telling tokens of all labelled urls. A set can only be frequent if all but
    its last and all but its last but one token are, so each level joins a url's frequent sets that begin alike.
    """
    own = ranked.where("label = 'block'").select("id", F.array("token").alias("antecedent"), (F.col("rank") > MAX_WIDTH).alias("beyond"))
    level, found = scratch.save(own), []
    for size in range(1, MAX_ANTECEDENT + 1):
        counts = scratch.save(level.groupBy("antecedent").agg(F.count("*").alias("n"), F.bool_or("beyond").alias("beyond")).where(F.col("n") >= least))
        found.append(counts.where("beyond").select("antecedent"))
        if size == MAX_ANTECEDENT:
            scratch.drop(level)
            break
        sets = level.join(counts.select("antecedent"), "antecedent").select("id", F.slice("antecedent", 1, size - 1).alias("start"), F.element_at("antecedent", -1).alias("last"), "beyond")
        other = sets.select("id", "start", F.col("last").alias("next"), F.col("beyond").alias("next_beyond"))
        longer = sets.join(other, ["id", "start"]).where("last < next")
        after = scratch.save(longer.select("id", F.concat("start", F.array("last", "next")).alias("antecedent"), (F.col("beyond") | F.col("next_beyond")).alias("beyond")))
        scratch.drop(level)
        level = after
    return scratch.save(reduce(DataFrame.unionByName, found))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """(antecedent, confidence, support, verdict) from ``labelled`` (tokens array<string>, label block or allow).

    Only rules that conclude on the block label; support counts their blocked urls, at least MIN_URLS. Of two rules one
    of which contains the other, the longer stays only if it is the more confident.
    """
    spark = labelled.sparkSession
    scratch = Scratch(spark, "url-rules")
    labelled = scratch.save(labelled.select("tokens", "label"))
    total, blocked = labelled.agg(F.count("*"), F.count_if(F.col("label") == "block")).first()
    least = max(MIN_URLS, -int(-min_support * total // 1))
    if blocked < least or blocked == total:
        return spark.sql("SELECT CAST(array() AS array<string>) antecedent, 0D confidence, 0D support, '' verdict WHERE false")
    telling = scratch.save(telling_tokens(labelled, least, blocked, total))
    rows = labelled.withColumn("id", F.monotonically_increasing_id())
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("chi"), "token"))
    ranked = scratch.save(rows.select("id", "label", F.explode("tokens").alias("token")).join(telling, "token").withColumn("rank", rank).drop("chi"))
    narrow = ranked.where(F.col("rank") <= MAX_WIDTH)
    baskets = scratch.save(narrow.groupBy("id", "label").agg(F.array_sort(F.collect_list("token")).alias("tokens")))
    items = F.when(F.col("label") == "block", F.array_append("tokens", F.lit(BLOCKED))).otherwise(F.col("tokens"))
    n = baskets.count()
    if not n:
        return spark.sql("SELECT CAST(array() AS array<string>) antecedent, 0D confidence, 0D support, '' verdict WHERE false")
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(baskets.select(items.alias("items")))
    listed = scratch.save(model.freqItemsets.select(F.array_sort(F.array_remove("items", BLOCKED)).alias("antecedent"), F.array_contains("items", BLOCKED).alias("with_label")))
    sets = listed.where(F.size("antecedent").between(1, MAX_ANTECEDENT) & F.col("with_label")).select("antecedent")
    wide = not ranked.where((F.col("rank") > MAX_WIDTH) & (F.col("label") == "block")).isEmpty()
    if wide:
        sets = sets.unionByName(sets_beyond(ranked, least, scratch)).distinct()
    both = scratch.save(recounted(sets, labelled))
    tested = both.count()
    sure = (F.col("hits") / F.col("n") >= min_confidence) & (F.col("hits") / F.col("n") >= min_lift * blocked / total)
    sure &= (F.col("hits") >= least) & (_chi(F.col("hits"), F.col("n"), blocked, total) >= critical_value(tested))
    rules = scratch.save(both.where(sure).select("antecedent", (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / total).alias("support")))
    subsets = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"))
    shorter = (
        rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
        .join(subsets.select("*", F.element_at("part", 1).alias("token")), "token")
        .where((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0) & (F.col("part_confidence") >= F.col("confidence")))
        .select("antecedent")
        .distinct()
    )
    found = scratch.save(rules.join(shorter, "antecedent", "left_anti").withColumn("verdict", F.lit("block")))
    scratch.drop(labelled, telling, ranked, baskets, listed, both, rules)
    return found


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, verdict, confidence): the most confident mined rule of each distinct url of ``urls`` (url, tokens)."""
    spread = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    counts = rules.select(F.explode("antecedent").alias("token")).distinct().join(spread.groupBy("token").agg(F.count("*").alias("n")), "token", "left")
    index = (
        rules.select("*", F.explode("antecedent").alias("token"))
        .join(counts, "token")
        .groupBy("antecedent", "confidence", "support", "verdict")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )
    met = spread.join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max_by("verdict", F.struct("confidence", "support", "antecedent"))
    return met.groupBy("url").agg(best.alias("verdict"), F.max("confidence").alias("confidence"))


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame, url: str = "url", **mining) -> DataFrame:
    """Adds host, path, rule, verdict and confidence to ``df``.

    ``labels`` (url, label): urls known to be wanted (allow) or not (block); rules are mined from these alone. A fixed
    rule outranks a mined one. Urls that neither kind of rule reaches are allowed.
    """
    df = df.drop("host", "path", "rule", "rule_verdict", "verdict", "confidence")
    key, found = unused(df.columns, "_url", "_mined")
    scratch = Scratch(df.sparkSession, "urls")
    judged = with_rule(with_parts(df, url), rules)
    urls = judged.where(F.col("host") != "").select(F.col(url).alias("url"), "host", "path", "rule_verdict").distinct()
    urls = scratch.save(urls.select("url", "rule_verdict", tokens("url").alias("tokens")))
    known = labels.groupBy("url").agg(F.max("label").alias("label"))  # a url with both labels is blocked
    mined = mine_rules(urls.join(known.where(F.col("label").isNotNull()), "url").select("tokens", "label"), **mining)
    mined = scratch.save(match_rules(urls.where(F.col("rule_verdict").isNull()).select("url", "tokens"), mined))
    scratch.drop(urls)
    mined = mined.select(F.col("url").alias(key), F.col("verdict").alias(found), "confidence")
    out = judged.join(mined, judged[url] == F.col(key), "left")
    return out.withColumn("verdict", F.coalesce("rule_verdict", found, F.lit("allow"))).drop(key, found, "rule_verdict")
