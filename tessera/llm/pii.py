"""Personal data: fixed patterns plus bootstrapped contextual extraction, all in DataFrame operations.

The fixed patterns give the base spans. The bootstrap starts from seeds: tokens that a fixed pattern matches, and keys
as machines write them (``SECRET``). Every token with enough digits or an ``@`` is a mention; the one word and the two
words on each side of it, with the side, are its lexical patterns, and a label glued to a token (``id=123``) counts as
the word before it. Spark scores the graph of patterns and instances in turns: a pattern's score is the sum of its
instances' scores over all places where its words stand in the corpus, whatever fills them; an instance's is the
noisy-or of its patterns' (seeds stay at 1). So a word that only happens to precede seeds scores next to nothing, and
one that hardly ever precedes anything else scores high. Patterns with ``MIN_SEEDS`` distinct seeds and ``MIN_SCORE``
label what else stands in their place: with the kind that a token's shape proves, else with the pattern's commonest
seed kind if the token's shape allows it, else ``id``. Seeds of kind secret are reported only in such a place.

Positions are code points, ends exclusive. Per kind, matches are the leftmost, non-overlapping ones; one that fails
its test is dropped. Null texts count as empty. Rows with the same id and text get the same spans; repeated rows stay.
Ties between a pattern's kinds go to the kind listed first. Empty tables give empty results, and columns of the input
may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, let, unused

KINDS = ["email", "ip", "card", "phone"]
#: Kinds that only the bootstrap gives.
FOUND_KINDS = [*KINDS, "secret", "id"]
#: The contract's patterns, written so that no run of characters is scanned twice: possessive repeats, and starts
#: only where a run starts or the match before ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"

MENTION = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: What a key looks like: 32 or more hexadecimal digits, letters and digits among them.
SECRET = r"^(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}$|^(?=[0-9]*[A-F])(?=[A-F]*[0-9])[0-9A-F]{32,}$"
#: A label glued to what it names.
LABEL = r"^([A-Za-z_][A-Za-z_.-]*[=:])(?=.)"
MIN_DIGITS = 5
CONTEXT = 64  # characters beside a token in which its neighbour words are looked for
ROUNDS = 3
MIN_SEEDS = 3
MIN_SCORE = 0.6
CHUNK = 512
BROADCAST_GRAMS = 500_000


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]+", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(d)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda s, i: s + let(F.substr(d, n - i + 1, F.lit(1)).cast("int") * (2 - i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)),
    )
    return total % 10 == 0


def _card(m: Column) -> Column:
    return let(digits(m), lambda d: F.length(d).between(14, 19) & F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda x: F.regexp_like(x, F.lit(BYTE))),
    "card": _card,
    "phone": lambda m: F.length(digits(m)).between(10, 15),
}


def _running(sizes: Column) -> Column:
    """Sums of the elements before each element, in chunks so that no long array is copied for each element."""

    def inner(chunk: Column) -> Column:
        grown = F.aggregate(chunk, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("all")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["all"], s["at"]).alias("all")))
        return grown

    n = F.size(sizes)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: inner(F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK))))
    joined = F.aggregate(
        chunks,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<long>>").alias("all")),
        lambda s, c: F.struct((s["at"] + c["at"]).alias("at"), F.array_append(s["all"], F.transform(c["all"], lambda x: x + s["at"])).alias("all")),
    )
    return F.when(n > 0, F.flatten(joined["all"])).otherwise(F.array().cast("array<long>"))


def located(text: Column, pattern: str) -> Column:
    """Array of (start, match, before, after): every match with its place and the text pieces beside it."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(m: Column) -> Column:
        pieces = F.split(text, pattern, -1)

        def zipped(p: Column) -> Column:
            sizes = F.transform(m, lambda x, i: (F.length(F.get(p, i)) + F.length(x)).cast("long"))
            return let(let(sizes, _running), lambda at: F.transform(m, lambda x, i: F.struct((F.get(at, i) + F.length(F.get(p, i))).alias("start"), x.alias("match"), F.get(p, i).alias("before"), F.get(p, i + 1).alias("after"))))

        return let(pieces, zipped)

    kind = "array<struct<start:bigint,match:string,before:string,after:string>>"
    return let(matches, lambda m: F.when(F.size(m) > 0, place(m)).otherwise(F.array().cast(kind)))


SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def base_spans(text: Column, kind: str) -> Column:
    """Array of (start, kind number, end) of the valid matches of one kind."""
    there = F.regexp_like(text, F.lit("[0-9]")) if kind != "email" else F.contains(text, F.lit("@"))
    if kind == "phone":
        there = F.contains(text, F.lit("+")) & there
    found = F.filter(located(text, PATTERNS[kind]), lambda m: VALID[kind](m["match"]))
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (m["start"] + F.length(m["match"])).alias("end")))
    return F.when(there, spans).otherwise(F.array().cast(SPANS))


def written(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    name = F.array(*map(F.lit, FOUND_KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def _words(text: Column) -> Column:
    """The lower-cased words of a text, an empty one where it begins or ends with space; labels part from what follows."""
    return F.split(F.regexp_replace(F.lower(text), r"([a-z_.-][=:])(?=\S)", "$1 "), r"\s+")


def _grams(words: Column) -> Column:
    """The words and the pairs of neighbours, space-joined; null for the last word's."""
    pairs = lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda x, y: F.concat(x, F.lit(" "), y))
    return let(words, lambda w: F.concat(w, pairs(w)))


def _mentions(text: Column) -> Column:
    """Array of (start, end, token, seed, left, right) of the tokens that may identify someone.

    left and right hold the grams beside it: one word, and two where there are two.
    """
    there = F.regexp_like(text, F.lit("[0-9@]"))
    # what stands around a token: brackets, quotes and symbols
    edge = lambda x: F.regexp_replace(x, r"^[^0-9A-Za-z+\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}]++$", "")
    said = lambda text: F.filter(_words(text), lambda w: w != "")
    beside = lambda w, near, far: F.when(F.size(w) > 1, F.array(F.element_at(w, near), F.concat_ws(" ", F.element_at(w, min(near, far)), F.element_at(w, max(near, far))))).otherwise(w)

    def one(m: Column) -> Column:
        label = F.regexp_extract(m["match"], LABEL, 1)

        def build(t: Column) -> Column:
            start = m["start"] + F.length(label) + F.position(t, F.substr(m["match"], F.length(label) + 1)) - 1
            seed = F.coalesce(*(F.when(F.regexp_like(t, F.lit(f"^(?:{PATTERNS[k]})$")) & VALID[k](t), F.lit(KINDS.index(k))) for k in KINDS), F.when(F.regexp_like(t, F.lit(SECRET)), F.lit(FOUND_KINDS.index("secret"))))
            near = F.concat(F.substr(m["before"], F.greatest(F.length(m["before"]) - CONTEXT + 1, F.lit(1))), F.lit(" "), label)
            left = let(said(near), lambda w: beside(w, -1, -2))
            right = let(F.slice(said(F.substr(m["after"], F.lit(1), F.lit(CONTEXT))), F.lit(1), F.lit(2)), lambda w: beside(w, 1, 2))
            return F.struct(start.alias("start"), (start + F.length(t)).alias("end"), t.alias("token"), seed.alias("seed"), left.alias("left"), right.alias("right"))

        return let(edge(F.substr(m["match"], F.length(label) + 1)), build)

    wanted = F.filter(located(text, MENTION), lambda m: (F.length(digits(m["match"])) >= MIN_DIGITS) | F.contains(m["match"], F.lit("@")))
    kind = "array<struct<start:bigint,end:bigint,token:string,seed:int,left:array<string>,right:array<string>>>"
    return F.when(there, F.filter(F.transform(wanted, one), lambda x: x["token"] != "").cast(kind)).otherwise(F.array().cast(kind))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, mentions) of every row; key tells texts apart that share an id."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))
    return docs.select("doc_id", "key", F.concat(*(base_spans(F.col("text"), k) for k in KINDS)).alias("base"), _mentions(F.col("text")).alias("mentions"))


def _sides() -> Column:
    """The patterns of a mention: each gram beside it, with the side."""
    mark = lambda side: F.transform(side, lambda w: F.concat(F.lit(f"{side[0].upper()} "), w))
    return F.explode(F.concat(mark("left"), mark("right")))


def gram_counts(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, total): in how many places of all ``texts`` (text) each gram of one or two words stands."""
    every = texts.select(F.explode(_grams(_words(F.coalesce("text", F.lit(""))))).alias("gram"))
    if grams.count() <= BROADCAST_GRAMS:
        every = every.join(F.broadcast(grams), "gram", "left_semi")
        return every.groupBy("gram").agg(F.count("*").alias("total"))
    return every.groupBy("gram").agg(F.count("*").alias("total")).join(grams, "gram", "left_semi")


def patterns_of(mentions: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(pattern, kind, score) of the high-confidence patterns, from (token, seed, left, right) and all texts."""
    edges = mentions.select(_sides().alias("pattern"), "token", "seed")
    edges = scratch.save(edges.groupBy("pattern", "token").agg(F.max("seed").alias("seed"), F.count("*").alias("n")))
    enough = edges.groupBy("pattern").agg(F.count("seed").alias("seeds")).where(F.col("seeds") >= MIN_SEEDS).select("pattern", F.substring("pattern", 3, 1 << 20).alias("gram"))
    enough = scratch.save(enough)
    totals = scratch.save(gram_counts(texts, enough.select("gram").distinct()))
    totals = scratch.save(enough.join(totals, "gram").select("pattern", "total"))
    # what precedes or follows mentions in too small a part of its places even if each of them counts in full is done with
    hopeful = edges.groupBy("pattern").agg(F.sum("n").alias("all")).join(totals, "pattern").where(F.col("all") >= MIN_SCORE * F.col("total")).select("pattern", "total")
    edges = scratch.save(edges.join(hopeful, "pattern").withColumn("score", F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0)))
    rate = F.least(F.lit(1.0), F.sum(F.col("n") * F.col("score")) / F.max("total"))
    for _ in range(ROUNDS):
        scores = edges.groupBy("pattern").agg(rate.alias("p"))
        lifted = edges.where(F.col("seed").isNull()).join(scores, "pattern")
        tokens = lifted.groupBy("token").agg((1 - F.exp(F.sum(F.log1p(-F.least("p", F.lit(0.999)))))).alias("lifted"))
        edges = scratch.save(edges.join(tokens, "token", "left").select("pattern", "token", "seed", "n", "total", F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.coalesce("lifted", F.lit(0.0))).alias("score")))
    kinds = edges.where(F.col("seed").isNotNull()).groupBy("pattern", "seed").agg(F.sum("n").alias("n")).groupBy("pattern").agg(F.max_by("seed", F.struct("n", -F.col("seed"))).alias("kind"))
    strong = edges.groupBy("pattern").agg(rate.alias("score"), F.avg(F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0)).alias("share"))
    return strong.where((F.col("score") >= MIN_SCORE) & (F.col("share") >= 0.5)).join(kinds, "pattern").select("pattern", "kind", "score")


def _found_kind() -> Column:
    """The kind of a token (token, seed) in a pattern's place (kind): what its shape proves, or allows."""
    like = lambda p: F.regexp_like("token", F.lit(p))
    number = {k: i for i, k in enumerate(FOUND_KINDS)}
    proved = F.when(F.col("seed").isNotNull(), F.col("seed")).when(like(r"^[^@]+@[^@]+\.[^@]+$"), number["email"])
    allowed = (
        F.when((F.col("kind") == number["ip"]) & like(r"^[0-9]+(\.[0-9]+){3}$"), number["ip"])
        .when((F.col("kind") == number["card"]) & like(r"^[0-9]{12,19}$"), number["card"])
        .when((F.col("kind") == number["phone"]) & like(r"^\+?[0-9().-]{7,20}$"), number["phone"])
        .when(F.col("kind") == number["secret"], number["secret"])
    )
    return F.coalesce(proved, allowed, F.lit(number["id"]))


def discover(scanned: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, key, found): what stands in the place of a strong pattern, for the rows that have any."""
    mentions = scratch.save(scanned.select("doc_id", "key", F.inline("mentions")))
    strong = scratch.save(patterns_of(mentions, texts, scratch))
    hits = mentions.select("doc_id", "key", "start", "end", "token", "seed", _sides().alias("pattern")).join(strong, "pattern")
    best = F.max_by(F.struct("token", "seed", "kind"), F.struct("score", -F.col("kind")))
    spans = hits.groupBy("doc_id", "key", "start", "end").agg(best.alias("b")).select("doc_id", "key", "start", "end", "b.*").withColumn("kind", _found_kind())
    return spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "kind", "end")).alias("found"))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, found): base spans and the bootstrap's spans that touch none of them, of every row."""
    scratch = Scratch(docs.sparkSession, "pii")
    scanned = scratch.save(scan(docs.select("doc_id", "text")))
    own = Scratch(docs.sparkSession, "pii-graph")
    found = scratch.save(discover(scanned, docs.select("text"), own)).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "found")
    own.clear()
    out = scanned.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    free = F.filter("found", lambda f: ~F.exists("base", lambda b: (b["start"] < f["end"]) & (b["end"] > f["start"])))
    return out.select("doc_id", "key", "base", F.coalesce(free, F.array().cast(SPANS)).alias("found"))


def _masked(text: Column, kind: str) -> Column:
    """The text with each valid match of one kind replaced by its label."""
    parts = located(text, PATTERNS[kind])
    label = F.lit(f"[{kind.upper()}]")
    return let(parts, lambda m: F.when(F.size(m) == 0, text).otherwise(F.concat(F.array_join(F.transform(m, lambda x: F.concat(x["before"], F.when(VALID[kind](x["match"]), label).otherwise(x["match"]))), ""), F.element_at(m, -1)["after"])))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in text replaced by ``[KIND]``; null texts stay null, other columns as they are."""
    row, key, spans = unused(docs.columns, "_id", "_key", "_found")
    found = find_pii(docs).where(F.size("found") > 0).groupBy("doc_id", "key").agg(F.first("found").alias("found"))
    found = Scratch(docs.sparkSession, "pii-found").save(found).select(F.col("doc_id").alias(row), F.col("key").alias(key), F.col("found").alias(spans))
    text, names = F.col("text"), F.array(*map(F.lit, FOUND_KINDS))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col(row)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(key)), "left")

    def cut(found: Column) -> Column:
        pieces = F.transform(found, lambda s, i: F.concat(
            let(F.when(i > 0, F.get(found, i - 1)["end"]).otherwise(F.lit(0)), lambda at: F.substr(text, (at + 1).cast("int"), F.greatest(s["start"] - at, F.lit(0)).cast("int"))),
            F.lit("["), F.upper(F.get(names, s["kind"])), F.lit("]"),
        ))
        return F.concat(F.array_join(pieces, ""), F.substr(text, (F.element_at(found, -1)["end"] + 1).cast("int")))

    out = joined.withColumn("text", F.when(F.col(spans).isNull(), text).otherwise(let(F.array_sort(spans), cut)))
    for kind in KINDS:
        there = F.contains(F.col("text"), F.lit("@")) if kind == "email" else F.regexp_like("text", F.lit("[0-9]"))
        out = out.withColumn("text", F.when(there, _masked(F.col("text"), kind)).otherwise(F.col("text")))
    return out.select(*docs.columns)
