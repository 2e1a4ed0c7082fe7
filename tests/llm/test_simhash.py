"""SimHash near-duplicates against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, simhash
from tessera.llm.common import Scratch
from tests.llm import brute
from tests.llm.data import HARD_TEXTS, documents, folder


def test_query_on_hard_texts_and_documents(spark, tmp_path):
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()] + HARD_TEXTS + HARD_TEXTS
    got = {r["doc_id"]: r for r in queries.op10_simhash(spark, folder(spark, tmp_path, documents=documents(texts))).collect()}
    fps = {i: brute.fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute.groups(fps)


@pytest.mark.parametrize("large", [64, 4, 0])
def test_links_small_and_large_buckets(spark, monkeypatch, large):
    """Random clouds of near fingerprints: every bucket size goes either way without losing a link."""
    monkeypatch.setattr(simhash, "LARGE", large)
    rnd = random.Random(3)
    fps = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rnd.randrange(7)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = {1000 - i: f for i, f in enumerate(sorted(fps))}
    classes = spark.createDataFrame([(simhash._signed(f), i) for i, f in fps.items()], "fp long, rep long")
    scratch = Scratch(spark, "test")
    found = simhash.components(simhash.links(classes, scratch), scratch)
    got = {i: i for i in fps} | {r["id"]: r["component"] for r in found.collect()}
    assert got == brute.groups(fps)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (70, 71), (70, 71)]
    scratch = Scratch(spark, "test")
    got = {r["id"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long"), scratch).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 1000 for i in range(1000, 1100)} | {70: 70, 71: 70}


def test_fingerprint_of_long_text_and_blocks(monkeypatch):
    text = " ".join(f"w{i % 977} É{i}" for i in range(40_000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 1000)
    assert simhash.fingerprint(text) == whole


def test_keep_one(spark):
    text = "one two three four five six"
    rows = [(3, text), (2, text), (2, "other text entirely here for once"), (None, text), (None, "no id but unique words"), (None, "no id but unique words"), (9, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in got.collect()) == [-1, 2, 8]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_keep_one_by_similarity(spark):
    """Texts with a few words changed go where their five-word shingles are 0.8 alike; less alike ones stay."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(60):
        base = [rnd.choice(words) for _ in range(300)]
        rows.append((3 * i, " ".join(base)))
        near, far = list(base), list(base)
        near[rnd.randrange(300)] = near[rnd.randrange(300)] = "changed"
        for _ in range(60):
            far[rnd.randrange(300)] = "other"
        rows += [(3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
    df = spark.createDataFrame(rows + [(None, "none"), (999, None)], "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.keep_one(df, similarity=0.8).collect()}
    sets = {i: set(simhash.shingle_hashes(t, 5)) for i, t in rows}
    assert all(len(sets[3 * i] & sets[3 * i + 1]) >= 0.8 * len(sets[3 * i] | sets[3 * i + 1]) for i in range(60))
    assert {3 * i for i in range(60)} | {3 * i + 2 for i in range(60)} | {None, 999} <= got
    assert not any(3 * i + 1 in got for i in range(60))


def test_shingles():
    assert len(simhash.shingle_hashes("a b c d e f", 5)) == 2 and len(simhash.shingle_hashes("a", 5)) == 1


def test_every_alike_pair_is_proposed(spark):
    """Extended and shortened texts and those with one passage replaced go, whatever fingerprints say."""
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    rows = []
    for i in range(40):
        base, at = prose(200), rnd.randrange(180)
        rows += enumerate(map(" ".join, (base, base + prose(20), base[:170], base[:at] + prose(14) + base[at + 14 :], base[:100] + prose(100))), 5 * i)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.keep_one(df, similarity=0.8).collect()}
    sets = {i: set(simhash.shingle_hashes(t, 5)) for i, t in rows}
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert all(alike(5 * i, 5 * i + k) == (k < 4) for i in range(40) for k in range(1, 5))
    assert got == {5 * i for i in range(40)} | {5 * i + 4 for i in range(40)}


def test_members_unlike_the_smallest_still_meet(spark):
    """Texts of one word set share all views; pairs among them count even if the smallest id is unlike each of them.

    So do pairs under one hot key: a common opening of 100 texts whose ends are alike in twos only.
    """
    rnd = random.Random(13)
    words = [f"w{i}" for i in range(150)]
    mixed = rnd.sample(words, 150)
    rows = [(0, " ".join(words)), (1, " ".join(mixed)), (2, " ".join(mixed[1:] + mixed[:1]))]
    opening = " ".join(f"same{i}" for i in range(60))
    for i in range(50):
        ending = [f"e{i}x{k}" for k in range(60)]
        rows += [(10 + 2 * i, f"{opening} {' '.join(ending)}"), (11 + 2 * i, f"{opening} {' '.join(ending[:-4])}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.keep_one(df, similarity=0.8).collect()}
    assert got == {0, 1} | {10 + 2 * i for i in range(50)}


def test_links_over_the_whole_input(spark):
    """B goes for A by fingerprint, C is alike B but not A: one group, of which A stays."""
    rnd = random.Random(14)
    words = [f"w{i}" for i in range(3000)]
    sets = lambda t: set(simhash.shingle_hashes(t, 5))
    alike = lambda a, b: len(sets(a) & sets(b)) >= 0.8 * len(sets(a) | sets(b))
    found = []
    while len(found) < 3:
        a = [rnd.choice(words) for _ in range(60)]
        b = a[:-2] + [rnd.choice(words) for _ in range(2)]
        c = [rnd.choice(words) for _ in range(6)] + b[6:]
        a, b, c = map(" ".join, (a, b, c))
        near = lambda x, y: bin((simhash.fingerprint(x) ^ simhash.fingerprint(y)) % 2**64).count("1") <= simhash.RADIUS
        if near(a, b) and alike(b, c) and not alike(a, c) and not near(a, c) and not near(b, c):
            found.append((a, b, c))
    rows = [(3 * i + k, t) for i, abc in enumerate(found) for k, t in enumerate(abc)]
    got = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()}
    assert got == {0, 3, 6}


def test_sketches_never_exceed_the_difference(spark):
    """Sketches of equal and of different sizes differ in at most as many classes as the sets in hashes."""
    rnd = random.Random(15)
    rows, want = [], []
    for n, gone in ((3, 1), (60, 4), (63, 8), (70, 10), (900, 150), (1100, 200)):
        a = [rnd.getrandbits(64) - 2**63 for _ in range(n)]
        b = a[gone:] + [rnd.getrandbits(64) - 2**63 for _ in range(gone // 2)]
        rows.append((len(rows), *(simhash._parities(np.array(x, np.int64)).tolist() for x in (a, b))))
        want.append(len(set(a) ^ set(b)))
    df = spark.createDataFrame(rows, "k int, a array<long>, b array<long>")
    assert len({len(r[1]) for r in rows}) > 3 and any(len(r[1]) != len(r[2]) for r in rows)
    got = {r["k"]: r["d"] for r in df.select("k", simhash._apart(F.col("a"), F.col("b")).alias("d")).collect()}
    assert all(0.8 * w <= got[k] <= w for k, w in enumerate(want))
    assert spark.createDataFrame(rows, df.schema).where(simhash._apart(F.col("a"), F.col("a")) == 0).count() == len(rows)


def test_keep_one_leaves_clashing_columns_alone(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (None, "f g h")], "doc_id long, text string").withColumn("_fp", F.lit("x")).withColumn("_TEXT", F.lit("y")).withColumn("component", F.lit("z"))
    got = simhash.keep_one(df, similarity=0.8).collect()
    assert {(r["doc_id"], r["_fp"], r["_TEXT"], r["component"]) for r in got} == {(1, "x", "y", "z"), (None, "x", "y", "z")}


@pytest.mark.parametrize("kinds", [1, 40])
def test_boilerplate_of_any_number_of_kinds_proposes_few_pairs(spark, kinds):
    """Twenty of sixty words are one of many boilerplates: keys of prefixes are the texts' own words."""
    rnd = random.Random(16)
    shared = [[f"b{k}x{i}" for i in range(20)] for k in range(kinds)]
    counts = []
    for n in (400, 800):
        rows = [(i, " ".join([*shared[i % kinds], *(f"w{rnd.getrandbits(40)}" for _ in range(40))])) for i in range(n)]
        keys = simhash._prefixes(spark.createDataFrame(rows, "doc_id long, text string"), 0.8, 5, n)
        sizes = [r["count"] for r in keys.groupBy("key").count().collect()]
        counts.append(sum(s * (s - 1) // 2 for s in sizes))
    assert counts[1] <= 800 and max(counts) <= 2 * max(1, min(counts)) + 800


def test_unlike_texts_under_a_key_make_no_pairs(spark, monkeypatch):
    """Every text holds one passage, whose hashes stand in prefixes: pairs of unlike texts end where they meet, alike ones stay."""
    rnd = random.Random(17)
    passage = [f"b{i}" for i in range(16)]
    rows = [(i, " ".join([*passage, *(f"w{rnd.getrandbits(40)}" for _ in range(44))])) for i in range(150)]
    rows += [(1000 + i, rows[i][1].replace(rows[i][1].split()[-1], "changed")) for i in range(100, 110)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "_levels", lambda *_: np.zeros(simhash.SLOTS, np.uint8))
    counts, verified = [], simhash._verified

    def counted(df, proposed, *rest):
        counts.append(proposed.count())
        return verified(df, proposed, *rest)

    monkeypatch.setattr(simhash, "_verified", counted)
    kept = {r["doc_id"] for r in simhash.keep_one(df, similarity=0.8).collect()}
    assert kept == set(range(150)) and counts[1] <= 20
    monkeypatch.setattr(simhash, "_met_apart", lambda a, b: F.lit(0))
    assert {r["doc_id"] for r in simhash.keep_one(df, similarity=0.8).collect()} == kept and counts[3] > 2000
