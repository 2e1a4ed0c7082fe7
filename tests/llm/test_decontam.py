"""Benchmark decontamination against brute-force alignment, and planted passages with edits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, queries
from tests.llm import brute
from tests.llm.data import HARD_TEXTS, documents, folder

rnd = random.Random(5)
WORDS = ["".join(rnd.choice("abcdefghijklmnoé") for _ in range(rnd.randrange(2, 8))) for _ in range(300)]


def prose(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def edited(text, n):
    for _ in range(n):
        i = rnd.randrange(len(text))
        text = rnd.choice([text[:i] + "x" + text[i:], text[:i] + text[i + 1 :], text[:i] + "z" + text[i + 1 :]])
    return text


def test_gram_hashes_tell_grams_apart():
    text = prose(400)
    h = decontam.gram_hashes(decontam.codes(text))
    grams = [text[i : i + decontam.Q] for i in range(len(text) - decontam.Q + 1)]
    assert len(h) == len(grams)
    first = {}
    assert all(first.setdefault(g, x) == x for g, x in zip(grams, h.tolist())) and len(set(first.values())) == len(first)


def test_alignment_is_the_best_place():
    for _ in range(40):
        item = prose(6)
        start = rnd.randrange(5)
        text = prose(1)[:start] + edited(item, rnd.randrange(4)) + prose(1)
        want, k = brute.best_place(item, text), 6
        got = decontam.alignment(decontam.codes(item).astype(np.int64), decontam.codes(text).astype(np.int64), k, -12, len(text))
        assert (got[0] if got else k + 1) == min(want, k + 1)


@pytest.mark.parametrize("piece", [1_000_000, 700])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(decontam, "PIECE", piece)
    items = [(i, prose(n)) for i, n in enumerate([6, 9, 20, 30, 45])] + [(90, None), (91, ""), (92, "Short one!"), (93, "É" * 30), (94, WORDS[0]), (95, f"{WORDS[1]}, {WORDS[2]} {WORDS[3]}"), (None, WORDS[4])]
    texts = list(HARD_TEXTS)
    for i in range(70):
        _, item = items[i % 5]
        n = rnd.randrange(0, int(0.13 * len(item)))
        planted = edited(item, n) if i % 7 else " ".join(w + "***\n" for w in item.upper().split())
        texts.append(f"{prose(rnd.randrange(60))} {planted} {prose(rnd.randrange(60))}")
    texts.append(f"{prose(40)} {items[3][1]} {prose(500)} {items[4][1]}")
    texts += [f"x{WORDS[0]} a short one {prose(3)}", f"{prose(3)} {WORDS[1]} ({WORDS[2]}) {WORDS[3]}", f"{WORDS[1]} {WORDS[2]} {WORDS[3]}s"]
    sf_dir = folder(spark, tmp_path, documents=documents(texts), benchmark=(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.op8_decontamination(spark, sf_dir).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, item in items:
            a, b = decontam.normal(item), decontam.normal(t)
            if len(a) < decontam.SHORT:
                if a and f" {a} " in f" {b} ":
                    want[d, i] = 0
            elif (e := brute.best_place(a, b)) <= decontam.edits_allowed(len(a)):
                want[d, i] = e
    assert got == want and len(want) > 40 and {94, 95, None} <= {i for _, i in want}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit(c) for c in ("_leak_id", "item_id", "text_KEY")})
    kept = decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 400)
    items = spark.createDataFrame([(i, prose(20)) for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(r["item_id"], f"{prose(9)} {r['text']}") for r in items.collect()], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items).collect()} == {(i, i) for i in range(12)}
    assert decontam.find_leaks(docs, items.limit(0)).count() == 0
    assert decontam.find_leaks(docs.limit(0), items).count() == 0
    assert decontam.drop_leaks(docs, items).count() == 0
    mixed = docs.unionByName(docs.select("doc_id", F.lit("nothing of the kind stands here").alias("text"))).unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), "text"))
    assert sorted(r["doc_id"] for r in decontam.drop_leaks(mixed.withColumn("_leak_id", F.lit(0)), items).collect()) == list(range(12))
    assert decontam.find_leaks(docs, items).where("edits = 0").count() == 12


def test_long_items_are_held_by_their_parts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "LONG", 300)
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 500)
    whole = prose(200)
    items = spark.createDataFrame([(1, whole), (2, prose(30))], "item_id long, text string")
    texts = [f"{prose(9)} {whole[100:800]} {prose(9)}", f"{prose(9)} {whole[:120]} {prose(30)}", f"{prose(5)} {edited(whole, 30)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["item_chars"]) for r in decontam.find_leaks(docs, items).collect()}
    assert got == {(0, 1, len(decontam.normal(whole))), (2, 1, len(decontam.normal(whole)))}
    assert "".join(decontam.parts(whole)) == whole and max(map(len, decontam.parts(whole))) <= 300


def suite(n, tail=27, seed=3, front=True):
    """Items with one preamble (or one ending), as multiple-choice suites have, and their texts."""
    own = random.Random(seed)
    shared = "choose the one right answer to the question below and give its letter: "
    tails = ["".join(own.choice("abcdefghij klmnop") for _ in range(tail)) for _ in range(n)]
    return shared, [f"{shared}{t}" if front else f"{t} {shared}" for t in tails]


@pytest.mark.parametrize("front", [True, False])
@pytest.mark.parametrize("hits, cells, few", [(2_000_000, 500_000, 8), (300, 40, 0), (5_000, 500, 1)])
def test_items_with_shared_text_against_brute_force(monkeypatch, hits, cells, few, front):
    monkeypatch.setattr(decontam, "HITS", hits)
    monkeypatch.setattr(decontam, "CELLS", cells)
    monkeypatch.setattr(decontam, "FEW", few)
    shared, items = suite(30, front=front)
    items += [shared, prose(20)]
    index = decontam.Index(list(enumerate(items)))
    texts = [f"{prose(9)} {shared} {prose(4)} {edited(items[i], i % 9)} {prose(3)} {shared}" for i in range(12)] + [" ".join(items), shared * 4, items[31]]
    got = index.search_all(texts)
    for t, found in zip(texts, got):
        want = {i: brute.best_place(decontam.normal(x), decontam.normal(t)) for i, x in enumerate(items)}
        assert {i: e for i, (e, _, _) in found.items()} == {i: e for i, e in want.items() if e <= decontam.edits_allowed(len(decontam.normal(items[i])))}


def test_many_items_with_one_preamble_take_seconds():
    import time

    shared, items = suite(5_000)
    index = decontam.Index(list(enumerate(items)))
    text = f" {prose(4)} ".join([shared] * 100) + prose(5) + items[77]
    began = time.process_time()
    (found,) = index.search_all([text])
    assert found[77][0] == 0 and len(found) < 50 and time.process_time() - began < 30
