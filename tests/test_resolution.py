"""Entity resolution: similarities, blocks of any size, decisions, the merge log."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import geo, similarity
from tessera.functions.similarity import jaro_winkler, token_set
from tessera.operators import resolution as R
from tessera.operators.components import components
from tessera.queries.resolution import entities
from tessera.scratch import Scratch

SF = "/root/testdata/sf0.001"
RECORD = "id long, name string, website string, phone string, email string, lat double, lon double, registry_id string"


def test_jaro_winkler(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcé ") for _ in range(rnd.randrange(9)))
    pairs = [("martha", "marhta"), ("dixon", "dicksonx"), ("abcd", "abcd"), ("a", "b"), ("abcdef", "abcdfe"), *((word(), word()) for _ in range(400))]
    df = spark.createDataFrame(pairs + [(None, "a"), ("", "")], "a string, b string")
    got = {(r[0], r[1]): r[2] for r in df.select("a", "b", jaro_winkler(F.col("a"), F.col("b"))).collect()}
    assert got[None, "a"] is None and got["", ""] == 1
    for a, b in pairs:
        if a.isascii() and b.isascii() and a and b:
            assert got[a, b] == pytest.approx(duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0], abs=1e-9), (a, b)
    assert got["martha", "marhta"] == pytest.approx(0.961, abs=1e-3)


def test_token_set(spark):
    row = spark.sql("SELECT 'a b b' x, 'b c' y, '' z, CAST(null AS string) n").select(token_set(F.col("x"), F.col("y")), token_set(F.col("z"), F.col("z")), token_set(F.col("x"), F.col("n"))).first()
    assert tuple(row) == (1 / 3, 0.0, None)


@pytest.mark.parametrize("lat, lon, code", [(57.64911, 10.40744, "u4pruyd"), (-90.0, -180.0, "0000000"), (90.0, 180.0, "zzzzzzz"), (None, 1.0, None)])
def test_geohash(spark, lat, lon, code):
    df = spark.createDataFrame([(lat, lon)], "lat double, lon double")
    assert df.select(geo.geohash(F.col("lat"), F.col("lon"))).first()[0] == code


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 80)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (300, 301), (301, 300), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()}
    assert got == {i: 1 for i in range(1, 81)} | {i: 1000 for i in range(1000, 1200)} | {300: 300, 301: 300}


@pytest.mark.parametrize("window, span", [(1, 2), (3, 5), (10, 11), (10, 5000)])
def test_blocks_give_neighbours_only(spark, window, span):
    """One block holds half of the rows: it gives ``window`` pairs a row, over many tasks, and loses none at the edges."""
    rnd = random.Random(2)
    rows = [("k", "hot" if i % 2 else f"b{i % 7}", "".join(rnd.choice("ab") for _ in range(4)), i) for i in range(300)]
    blocks = {}
    for kind, key, sort, i in rows:
        blocks.setdefault(key, []).append((sort, i))
    want = {(min(a, b), max(a, b)) for block in blocks.values() for at, (_, a) in enumerate(sorted(block)) for _, b in sorted(block)[at + 1 : at + 1 + window]}
    df = spark.createDataFrame(rows + rows[:50], "kind string, key string, sort string, id long").repartition(7)
    got = R.candidate_pairs(df, window, span)
    assert {(r["a"], r["b"]) for r in got.collect()} == want and got.count() == len(want)


def test_no_cross_product_in_plans(spark):
    records = R.prepared(entities(spark, SF))
    plan = R.features(R.candidate_pairs(R.blocking_keys(records)), records)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan and "Arrow" not in plan


def test_recall_against_all_pairs(spark):
    """Pairs of one company in the planted records, and pairs that all-pairs scoring would merge, are nearly all found."""
    records = R.prepared(entities(spark, SF)).persist()
    decided = R.decide(R.features(R.candidate_pairs(R.blocking_keys(records)), records))
    got = {(r["a"], r["b"]) for r in decided.where("decision = 'merge'").collect()}
    every = records.select(F.col("id").alias("a")).crossJoin(records.select(F.col("id").alias("b"))).where("a < b").withColumn("kinds", F.array(F.lit("all")))
    want = {(r["a"], r["b"]) for r in R.decide(R.features(every, records)).where("decision = 'merge'").collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    true = {(a, b) for a, b in want if a // 4 == b // 4}
    assert len(got & true) >= 0.95 * len(true) and len(got & true) >= 0.97 * len(got)
    records.unpersist()


def records(spark, *rows):
    full = [(i, name, None, phone, None, 1.0, 1.0, registry) for i, name, phone, registry in rows]
    return spark.createDataFrame(full, RECORD)


def owners(spark, df, log):
    return {r["id"]: r["owner_id"] for r in R.repoint(df, log, "id").collect()}


def test_merges_can_be_taken_back_in_any_order(spark):
    df = records(spark, (1, "Acme Foods", "+1", None), (2, "Acme Foods Ltd", "+1", None), (3, "Acme Food", "+1", None), (9, "Other", "+2", None))
    decided, log = R.resolve(df, run="one", at=F.lit("2026-01-01"))
    assert owners(spark, df, log) == {1: 1, 2: 1, 3: 1, 9: 9}
    # the winner later loses to another record: a chain of merges
    more = spark.createDataFrame([(1, 9, 1.0, False)], "id long, winner_id long, score double, held boolean")
    log = R.record_merges(log, more, "two", F.lit("2026-01-02"))
    assert owners(spark, df, log) == {1: 9, 2: 9, 3: 9, 9: 9}
    rows = {(r["winner_id"], r["loser_id"]): r["merge_id"] for r in log.collect()}
    assert set(rows) == {(1, 2), (1, 3), (9, 1)}
    take = lambda log, *pairs: R.undo(log, spark.createDataFrame([(rows[p],) for p in pairs], "merge_id string"), F.lit("2026-01-03"))
    first = take(log, (1, 2))
    assert owners(spark, df, first) == {1: 9, 2: 2, 3: 9, 9: 9}
    assert owners(spark, df, take(log, (9, 1))) == {1: 1, 2: 1, 3: 1, 9: 9}
    nothing = take(take(first, (9, 1)), (1, 3))
    assert owners(spark, df, nothing) == {i: i for i in (1, 2, 3, 9)} and R.standing(df, nothing).count() == 4
    assert owners(spark, df, take(log, *rows)) == owners(spark, df, nothing)


def test_undone_pairs_stay_apart_and_runs_repeat(spark):
    df = records(spark, (1, "Acme Foods", "+1", None), (2, "Acme Foods Ltd", "+1", None))
    _, log = R.resolve(df, run="one")
    _, again = R.resolve(df, log, run="two")
    assert again.count() == log.count() == 1
    log = R.undo(log, log, F.current_timestamp())
    decided, after = R.resolve(df, log, run="three")
    assert [r["decision"] for r in decided.collect()] == ["separate"] and after.count() == 1
    assert owners(spark, df, after) == {1: 1, 2: 2}


def test_clusters_with_two_registries_or_a_no_are_held(spark):
    df = records(spark, (1, "Acme Foods", "+1", "A"), (2, "Acme Foods Ltd", "+1", None), (3, "Acme Foods", "+1", "B"))
    decided, log = R.resolve(df)
    assert {(r["a"], r["b"]): r["decision"] for r in decided.collect()} == {(1, 2): "merge", (2, 3): "merge", (1, 3): "separate"} and log.count() == 0
    df = records(spark, (1, "Acme Foods", "+1", None), (2, "Acme Foods Ltd", "+1", None), (3, "Acme Foods", "+1", None))
    prepared = R.prepared(df)
    known = spark.createDataFrame([(3, 1, False)], "a long, b long, same boolean")
    decided = R.decide(R.features(R.candidate_pairs(R.blocking_keys(prepared)), prepared), known)
    assert all(r["held"] for r in R.cluster(decided, prepared, known).collect())


def test_branches_reviews_and_missing_values(spark):
    site, mail = "https://acme.in", "a@gmail.com"
    rows = [(1, "Acme Foods", site, "+1", mail, 10.0, 10.0, None), (2, "Acme Foods", site, "+2", mail, 11.0, 10.0, None), (3, None, None, None, None, None, None, None), (None, "Acme Foods", site, "+1", None, None, None, None)]
    decided, log = R.resolve(spark.createDataFrame(rows, RECORD))
    assert [(r["a"], r["b"], r["decision"]) for r in decided.collect()] == [(1, 2, "branch")] and log.count() == 0
    none = spark.createDataFrame([], RECORD)
    assert [df.count() for df in R.resolve(none)] == [0, 0]


def test_jaro_in_unlike_alphabets_and_lengths(spark):
    """Against a plain loop: common starts of any length, letters beyond the BMP, texts longer than a word."""

    def jaro(a, b):
        if not a and not b:
            return 1.0
        reach, rest, taken = max(max(len(a), len(b)) // 2 - 1, 0), list(b), []
        for i, letter in enumerate(a):
            at = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if rest[j] == letter), None)
            if at is not None:
                rest[at] = None
                taken.append(letter)
        if not taken:
            return 0.0
        other = [x for x, r in zip(b, rest) if r is None]
        swaps = sum(x != y for x, y in zip(taken, other)) // 2
        return (len(taken) / len(a) + len(taken) / len(b) + (len(taken) - swaps) / len(taken)) / 3

    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abé\U0001d402 ") for _ in range(rnd.randrange(n)))
    pairs = [(start + word(20), start + word(20)) for start in (word(80) for _ in range(300))] + [("", ""), ("", "a"), ("a", "")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.jaro(F.col("a"), F.col("b"))).collect()
    for a, b, s in got:
        assert s == pytest.approx(jaro(a, b), abs=1e-12), (a, b)


def test_names_are_compared_once_for_each_two_unlike_ones(spark, monkeypatch):
    """The columns are those of a comparison of each pair, blanks and missing names included; equal names need none."""
    names = ["acme foods", "acme foods", "acme food", "", "", " ", " ", None, None, "amce foods", "acme  foods"]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    prepared = R.prepared(frame.select("id", *(F.lit(None).cast("double" if c in ("lat", "lon") else "string").alias(c) for c in R.FIELDS))).drop("name_key").join(frame.withColumnRenamed("name", "name_key"), "id")
    pairs = [(a, b) for a in range(len(names)) for b in range(a + 1, len(names))]
    every = spark.createDataFrame(pairs, "a long, b long").withColumn("kinds", F.array(F.lit("all")))
    got = {(r["a"], r["b"]): (r["name_jw"], r["name_words"]) for r in R.features(every, prepared).collect()}
    both = spark.createDataFrame([(a, b, names[a], names[b]) for a, b in pairs], "a long, b long, x string, y string")
    want = {(r[0], r[1]): (r[2], r[3]) for r in both.select("a", "b", jaro_winkler(F.col("x"), F.col("y")), token_set(F.col("x"), F.col("y"))).collect()}
    assert got == want
    monkeypatch.setattr(R, "jaro_winkler", lambda a, b: F.raise_error(F.lit("compared")).cast("double"))
    equal = every.where("a = 0 AND b = 1")
    assert [r["name_jw"] for r in R.features(equal, prepared).collect()] == [1.0]
