"""SimHash near-duplicates by pigeonring filtering.

``fingerprints`` gives every whole text a 64-bit fingerprint. Two fingerprints link at ``RADIUS`` = 2 or fewer
differing bits. The bits form a ring of ``BOXES`` = 5 segments. By the pigeonring principle a pair within the radius
has a start on the ring from which every chain of l consecutive segments differs in at most l * 2 / 5 bits, that is
0, 0, 1, 1, 2 bits for l = 1..5. So both first segments of such a chain are equal: they are the key of a bucket
(25 or 26 bits, five buckets for each distinct fingerprint), and the longer chains prune the bucket's pairs before
the full Hamming test.

A bucket of more than ``LARGE`` distinct fingerprints is not paired up. Its members agree in the key's segments, so a
link there means at most 2 differing bits among the other 38 or 39, and then some bit string lies within one bit of
both. Every member is filed under its 39 or 40 strings within one bit, and all members under one string, at most
40, link to the smallest of them: rows grow linearly with the bucket, and no link is lost to the components.

``components`` joins links to groups by alternating large-star and small-star passes.

Fingerprints of short shingles drift apart by more than 2 bits when a few words of a text change. ``keep_one`` with a
similarity therefore also links texts by the Jaccard similarity of their word shingles. Pairs come from a prefix
filter: with one order of all hashes, two sets of similarity t share one of their first n - ceil(t * n) + 1 hashes.
The order puts hashes that are frequent in a sample last. Texts of different groups under one key are compared by short
parity sketches where they meet, so that rows are made of pairs that these cannot tell apart, not of all pairs. Proposed
pairs are then compared by parity sketches whose size follows the set's, and whole sets travel only for the pairs that
these leave. Two sets differ in at least as many hashes as their sketches, so no pair at the bound is lost to the groups.

Null texts count as empty. Texts without words have the fingerprint 0 and link like any other. Copies share their
fingerprint's row, whatever their number. Rows without a doc_id get the group of their fingerprint, and null where no
row with an id has it. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.llm.common import Scratch, others, quoted, unused
from tessera.shipping import map_in_arrow

SHINGLE = 3
RADIUS = 2
BOXES = 5
LARGE = 64
BLOCK = 32_768
KNOWN_WORDS = 100_000
SAMPLE_TEXTS = 20_000
SLOTS = 1 << 19
TEXTS = 128
LEAST_SKETCH = 256  # bits
MET_SKETCH = 1024  # bits, of texts that meet under a key
BROADCAST_IDS = 500_000
EDGES = [0, 13, 26, 39, 52, 64]  # the segments' borders


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : min(at + BLOCK, n)].tolist(), ends[at + width - 1 : min(at + BLOCK, n) + width - 1].tolist())
        hashes = np.fromiter((digest(joined[s:e], 42) for s, e in spans), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = SHINGLE, out: str = "fp") -> DataFrame:
    """``df`` without its text, with the fingerprint as a long; a column named like ``out``, in any case, is replaced."""
    keep = others(df.columns, text, out)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], fps], [*keep, out])

    return map_in_arrow(df.select(text, *quoted(keep)), scan, schema)


class _Words(dict):
    """64-bit hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 0)
        return value


def _hash_set(text: str | None, shingle: int, known: _Words) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    width = min(shingle, len(words))
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, width, np.uint64)
    for k in range(width):  # each step is a bijection of the word's hash
        mixed = (mixed ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """Distinct 64-bit hashes of a text's word shingles (the whole text if it has fewer words), in ascending order."""
    return _hash_set(text, shingle, _Words()).tolist()


def _few(ids: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if a count shows at most BROADCAST_IDS of them (8 bytes each), else shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _parities(hashes: np.ndarray) -> np.ndarray:
    """The parity of the hashes in each class modulo a power of two between 4 and 8 times their number, as longs."""
    classes = LEAST_SKETCH
    while classes < 4 * len(hashes):
        classes *= 2
    return np.packbits((np.bincount(hashes & (classes - 1), minlength=classes) & 1).astype(np.uint8)).view(np.int64)


def _per_text(df: DataFrame, shingle: int, name: str, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, n, ``name``) of rows (doc_id, text): the number of a text's hashes, and longs made from them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            sets = [_hash_set(t.as_py(), shingle, known) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(of, sets)), pa.list_(pa.int64()))], ["id", "n", name])

    return map_in_arrow(df.select("doc_id", "text"), cut, f"id long, n int, {name} array<long>", TEXTS)


def _hashed(df: DataFrame, shingle: int) -> DataFrame:
    """(id, n, hashes) of rows (doc_id, text)."""
    return _per_text(df, shingle, "hashes", lambda x: x)


def _sketched(df: DataFrame, shingle: int) -> DataFrame:
    """(id, n, bits) of rows (doc_id, text)."""
    return _per_text(df, shingle, "bits", _parities)


def _met_sketches(df: DataFrame, shingle: int) -> DataFrame:
    """(id, bits) of rows (doc_id, text): the parity of the hashes in each of MET_SKETCH classes."""
    of = lambda x: np.packbits((np.bincount(x & (MET_SKETCH - 1), minlength=MET_SKETCH) & 1).astype(np.uint8)).view(np.int64)
    return _per_text(df, shingle, "bits", of).select("id", "bits")


def _met_apart(a: str, b: str) -> Column:
    """In how many classes two sketches of MET_SKETCH bits differ."""
    return reduce(Column.__add__, (F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(MET_SKETCH // 64)))


def _apart(a: Column, b: Column) -> Column:
    """In how many classes two parity sketches differ: no more than the sets differ in hashes.

    Classes modulo a power of two fold into those modulo half of it, so sketches of two sizes compare in the smaller.
    """
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2 + 1).cast("int"), (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    fitted = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(x)
    return F.aggregate(F.zip_with(fitted(a, b), fitted(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)


def prefix_size(n: int, similarity: float) -> int:
    """So many of a set's n hashes, first in any order common to all sets, meet those of every set that is as similar."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def _levels(df: DataFrame, shingle: int, rows: int) -> np.ndarray:
    """How frequent the hashes of a slot are, as the log2 of their count in SAMPLE_TEXTS texts or so, drawn by a hash of the id.

    A hash's slot is its lowest bits: SLOTS bytes tell of all hashes, however many of them are frequent.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Words(), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                np.add.at(total, _hash_set(t.as_py(), shingle, known) & (SLOTS - 1), 1)
        (slot,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "n"])

    share = max(1, -(-rows // SAMPLE_TEXTS))
    sample = df.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    counted = map_in_arrow(sample, count, "slot long, n long", TEXTS).groupBy("slot").agg(F.sum("n").alias("n")).where("n > 2").toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[counted.column("slot").to_numpy()] = np.log2(counted.column("n").to_numpy()).astype(np.uint8)
    return out


def _prefixes(df: DataFrame, similarity: float, shingle: int, rows: int) -> DataFrame:
    """(key, id, place): the first hashes of each of the ``rows`` texts of (doc_id, text), frequent ones last.

    place holds the text's number of hashes (upper half) and where the key stands in their order (lower half).

    How frequent hashes are comes from a sample and changes the number of proposals, never the pairs found.
    """
    shared = df.sparkSession.sparkContext.broadcast(_levels(df, shingle, rows))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, levels = _Words(), shared.value
        for batch in batches:
            firsts, sizes = [], []
            for t in batch.column(1):
                hashes = _hash_set(t.as_py(), shingle, known)
                sizes.append(len(hashes))
                hashes = hashes[np.argsort(levels[hashes & (SLOTS - 1)], kind="stable")]
                firsts.append(hashes[: prefix_size(len(hashes), similarity)])
            if firsts:
                each = [len(x) for x in firsts]
                ids, n = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), each), np.repeat(np.array(sizes, np.int64), each)
                place = (n << 32) + np.concatenate([np.arange(k, dtype=np.int64) for k in each])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts)), pa.array(ids), pa.array(place)], ["key", "id", "place"])

    return map_in_arrow(df.select("doc_id", "text"), file, "key long, id long, place long", TEXTS)


def _verified(df: DataFrame, proposed: DataFrame, scratch: Scratch, similarity: float, shingle: int) -> DataFrame:
    """The pairs (u, v) of ``proposed`` whose texts' shingles reach the Jaccard similarity."""
    side = lambda t, at: t.select(F.col("id").alias(at), *(F.col(c).alias(f"{c}_{at}") for c in t.columns if c != "id"))
    texts = lambda ids: df.select("doc_id", "text").join(_few(ids), "doc_id", "left_semi")
    of = lambda pairs: scratch.save(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    # two sets differ in at least as many hashes as their parities: pairs too far apart need no comparison of all hashes
    named = of(proposed)
    sketches = scratch.save(_sketched(texts(named), shingle))
    close = _apart(F.col("bits_u"), F.col("bits_v")) * (1 + similarity) <= (1 - similarity) * (F.col("n_u") + F.col("n_v")) + 1e-6
    near = scratch.save(proposed.join(side(sketches, "u"), "u").join(side(sketches, "v"), "v").where(close).select("u", "v").distinct())
    scratch.drop(named, sketches)
    named = of(near)
    sets = scratch.save(_hashed(texts(named), shingle).select("id", "hashes"))
    both = F.size(F.array_intersect("hashes_u", "hashes_v"))
    joined = near.join(side(sets, "u"), "u").join(side(sets, "v"), "v")
    out = scratch.save(joined.where(both >= similarity * (F.size("hashes_u") + F.size("hashes_v") - both) - 1e-9).select("u", "v"))
    scratch.drop(named, near, sets)
    return out


def similar_groups(df: DataFrame, linked: DataFrame, scratch: Scratch, similarity: float, shingle: int) -> DataFrame:
    """(id, component) of the groups that ``linked`` (u, v) and all pairs of texts (doc_id, text) as similar make.

    A pair at the similarity shares a key of both prefixes. First every text meets the smallest one under each of its
    keys; then, under keys that still hold several groups, all texts of different groups meet whose sizes and places
    of the key allow the similarity. Pairs left out are within a group already, so no link is lost to the groups.
    """
    texts = df.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    copies = texts.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"))
    ids = scratch.save(copies.select("doc_id").distinct())
    texts = texts.join(_few(ids), "doc_id", "left_semi")

    filed = scratch.save(_prefixes(texts, similarity, shingle, ids.count()))
    hubs = filed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("key", "hub")
    shared = scratch.save(filed.join(hubs, "key").withColumns({"n": F.shiftright("place", 32).cast("int"), "pos": F.col("place").bitwiseAND(F.lit(2**32 - 1)).cast("int")}).drop("place"))
    scratch.drop(filed)
    alike = lambda n, m: F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9

    def labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
        groups = scratch.save(components(links, scratch))
        for c, out in (("id", "group"), ("hub", "hub_group")):
            rows = rows.join(_few(groups.select(F.col("id").alias(c), F.col("component").alias(out))), c, "left").withColumn(out, F.coalesce(out, c))
        return rows

    stars = labelled(shared, linked).where(F.col("group") != F.col("hub_group")).select(F.col("id").alias("u"), F.col("hub").alias("v"), "n").distinct()
    sizes = shared.where("id = hub").select(F.col("id").alias("v"), F.col("n").alias("m")).distinct()
    stars = scratch.save(stars.join(sizes, "v").where(alike(F.col("n"), F.col("m"))).select("u", "v").distinct())
    found = _verified(texts, stars, scratch, similarity, shingle)
    scratch.drop(stars)
    linked = linked.select("u", "v").unionByName(found)

    rows = labelled(shared, linked)
    several = scratch.save(rows.where(F.col("group") != F.col("hub_group")).select("key").distinct())
    rows = scratch.save(rows.join(_few(several), "key", "left_semi").select("key", "id", "n", "pos", "group"))
    scratch.drop(shared)
    named = scratch.save(rows.select(F.col("id").alias("doc_id")).distinct())
    sketches = scratch.save(_met_sketches(texts.join(_few(named), "doc_id", "left_semi"), shingle))
    dealt = rows.join(sketches, "id")
    other = dealt.select("key", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("group").alias("group2"), F.col("bits").alias("bits2"))
    most = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))  # that two sets can share from their first common hash on
    fit = alike(F.col("n"), F.col("n2")) & (most * (1 + similarity) >= similarity * (F.col("n") + F.col("n2")) - 1e-6)
    fit &= _met_apart("bits", "bits2") * (1 + similarity) <= (1 - similarity) * (F.col("n") + F.col("n2")) + 1e-6
    met = dealt.join(other, "key").where((F.col("id") > F.col("id2")) & (F.col("group") != F.col("group2")) & fit)
    met = scratch.save(met.select(F.col("id").alias("u"), F.col("id2").alias("v")).distinct())
    scratch.drop(rows, named, sketches)
    found = _verified(texts, met, scratch, similarity, shingle)
    scratch.drop(met)
    return components(linked.unionByName(found), scratch)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _chain(start: int, length: int) -> int:
    """The bits of ``length`` segments from ``start`` on, around the ring, as a signed mask."""
    mask = 0
    for k in range(length):
        lo, hi = EDGES[(start + k) % BOXES], EDGES[(start + k) % BOXES + 1]
        mask |= (1 << hi) - (1 << lo)
    return _signed(mask)


def _masks(length: int) -> Column:
    """The mask of the chain of that length for the row's ``start``."""
    return F.element_at(F.array(*(F.lit(_chain(i, length)).cast("long") for i in range(BOXES))), F.col("start") + 1)


def _small_buckets(filed: DataFrame, keys: list[str]) -> DataFrame:
    """(u, v), u > v: pairs within buckets (keys, fp, rep) whose chains and whole fingerprints stay in their budgets."""
    other = filed.select(*keys, F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    pruned = F.col("rep") > F.col("rep2")
    for length in range(3, BOXES):
        pruned &= F.bit_count(x.bitwiseAND(_masks(length))) <= length * RADIUS // BOXES
    pruned &= F.bit_count(x) <= RADIUS
    return filed.join(other, keys).where(pruned).select(F.col("rep").alias("u"), F.col("rep2").alias("v"))


def links(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v), u > v: links between classes (fp, rep) of equal fingerprints, enough for their components."""
    starts = F.explode(F.array(*(F.lit(i) for i in range(BOXES))))
    filed = classes.select("fp", "rep", starts.alias("start")).withColumn("key", F.col("fp").bitwiseAND(_masks(2)))
    sizes = filed.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    filed = scratch.save(filed.join(sizes, ["start", "key"]))

    near = _small_buckets(filed.where(F.col("n") <= LARGE).drop("n"), ["start", "key"])
    free = F.bitwise_not(_masks(2))
    bits = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)).cast("long") for i in range(64)))
    usable = F.filter(bits, lambda bit: bit.bitwiseAND(free) == bit)
    large = filed.where(F.col("n") > LARGE).repartition("fp")
    around = large.select("start", "rep", F.explode(F.transform(usable, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("string"))
    hub = F.min("rep").over(W.partitionBy("start", "string"))
    stars = around.withColumn("v", hub).where(F.col("rep") > F.col("v")).select(F.col("rep").alias("u"), "v")
    return near.unionByName(stars).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (u, v): component is the smallest id that it reaches."""

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = state(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        big = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        rest = big.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = state(after)
        scratch.drop(e)
        e = after
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``df``; component_id is the smallest doc_id of the group."""
    scratch = Scratch(df.sparkSession, "simhash")
    docs = scratch.save(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle=shingle))
    classes = scratch.save(docs.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = components(links(classes, scratch), scratch)
    labels = classes.join(groups, F.col("rep") == F.col("id"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return docs.join(scratch.save(labels), "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float | None = None, wide_shingle: int = 5) -> DataFrame:
    """``df`` with one row of each near-duplicate group: the one with the smallest id.

    With a ``similarity``, groups are those of both links: fingerprints, and shingles of ``wide_shingle`` words that are
    that similar, over all rows. Rows that share their id count as one document there.

    Rows that share their id and text are copies as well: one of them stays. Rows without an id stay where no row
    with an id is in their group, one for each fingerprint.
    """
    found = near_duplicates(df, doc_id, text, shingle)
    scratch = Scratch(df.sparkSession, "kept")
    if similarity is None:
        best = scratch.save(found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(doc_id)).distinct())
    else:
        found = scratch.save(found)
        texts = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        # of several rows with one id, one that is the smallest of its group keeps the id
        linked = found.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("u")).agg(F.max("component_id").alias("v")).where("u <> v")
        groups = similar_groups(texts, scratch.save(linked), scratch, similarity, wide_shingle)
        worse = groups.where("id <> component").select(F.col("id").alias("doc_id"))
        ids = found.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
        best = scratch.save(ids.join(worse, "doc_id", "left_anti").select(F.col("doc_id").alias(doc_id)))
    kept = df.join(_few(best), doc_id, "left_semi")
    # a repeated id can bring in other rows: one row for each id
    twice = df.groupBy(doc_id).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(doc_id).isNull()).select(doc_id)
    if twice.isEmpty():
        return kept
    once = kept.join(twice, doc_id, "left_anti")
    again = kept.join(twice, doc_id, "left_semi").dropDuplicates([doc_id])
    body, fp = unused(df.columns, "_text", "_fp")
    nameless = df.where(F.col(doc_id).isNull())
    nameless = fingerprints(nameless.withColumn(body, F.col(text)), body, shingle, fp)
    nameless = nameless.join(found.where("component_id IS NOT NULL").select(F.col("fp").alias(fp)).distinct(), fp, "left_anti")
    return once.unionByName(again).unionByName(nameless.dropDuplicates([fp]).select(df.columns))
