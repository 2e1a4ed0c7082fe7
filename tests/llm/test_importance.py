"""Importance resampling against brute force; borders, blocks and ties."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest

from tessera.llm import importance, queries
from tests.llm.data import HARD_TEXTS, documents, folder


def features(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(rows, target, percent=10, least=20, buckets=10_000):
    """rows: (doc_id, text); (doc_id, n_features, weight, score) of all, and the drawn ones in order."""
    s, t = [0] * buckets, [0] * buckets
    for of, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for w in features(text):
                of[zlib.crc32(w.encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        found = features(text)
        weight = sum(gain[zlib.crc32(w.encode()) % buckets] for w in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, order[: percent * len(order) // 100]


def test_query_against_brute_force(spark, tmp_path):
    texts = HARD_TEXTS + [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()]
    rows = list(enumerate(texts))
    want, drawn = brute(rows, [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/benchmark.parquet'").fetchall()])
    got = queries.op11_importance_resampling(spark, folder(spark, tmp_path, documents=documents(texts))).collect()
    assert sorted((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == sorted(want) and drawn
    assert [r["doc_id"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [r[0] for r in drawn]


@pytest.mark.parametrize("range_rows, block, run", [(7, 3, 11), (50, 2048, 100_000), (1, 1, 1)])
def test_draw_does_not_depend_on_ranges_blocks_and_runs(spark, monkeypatch, range_rows, block, run):
    monkeypatch.setattr(importance, "BLOCK_ROWS", block)
    monkeypatch.setattr(importance, "RUN_ROWS", run)
    rnd = random.Random(5)
    rows = [(rnd.randrange(60) if rnd.random() < 0.7 else None if rnd.random() < 0.2 else i, " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(18, 30))), "x") for i in range(200)]
    rows += [(77, "a b c " * 10, "x")] * 100  # a third of all rows are equal
    docs = spark.createDataFrame(rows, "doc_id long, text string, SCORE string").repartition(5)
    target = spark.createDataFrame([("a a b",), (None,)], "text string")
    got = importance.resample(docs, target, percent=40, range_rows=range_rows).collect()
    want, drawn = brute([r[:2] for r in rows], ["a a b", None], percent=40)
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got), key=str) == sorted(want, key=str)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["score"], r["doc_id"]) for r in ranked] == [(r[3], r[0]) for r in drawn], key


def test_ranges_are_near_their_size(spark):
    rows = [(i, f"w{i % 97} " * 25) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    weights = importance.gains(importance.bucket_counts(docs), importance.bucket_counts(docs.limit(10)))
    blocks = importance.sorted_runs(docs, weights, "doc_id", "text", 1, 1, 20)
    cuts = importance.borders(blocks, 3000, 300)
    sizes = [r[0] for r in importance._in_ranges(blocks, cuts).groupBy("range").agg({"n": "sum"}).select("sum(n)").collect()]
    assert len(sizes) == 10 and sum(sizes) == 3000 and max(sizes) <= 600


def test_word_runs_are_features():
    found, words = importance.Features(1 << 30, 3).of("A b, c".encode())
    names = ["a", "b", "c", "a b", "b c", "a b c"]
    assert sorted(found) == sorted(zlib.crc32(n.encode()) % (1 << 30) for n in names) and words == 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two " * 20)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert [tuple(r)[:2] for r in importance.resample(some, none, percent=100).collect()] == [(1, 40)]


def test_tournament_tree_merges_streams():
    rnd = random.Random(1)
    runs = [sorted((rnd.randrange(50), False, rnd.randrange(9), i * 1000 + k) for k in range(rnd.randrange(1, 40))) for i in range(30)]
    blocks = [r[at : at + 4] for r in runs for at in range(0, len(r), 4)]
    make = lambda keys: importance.Block(keys, {c: [k[3] for k in keys] for c in importance._ROW})
    everything = sorted(k for r in runs for k in r)
    for most in (0, 1, 57, len(everything), len(everything) + 5):
        got, rest = [], 0
        for rows, first in importance.merge((make(b) for b in sorted(blocks)), most):
            if first is None:
                rest += len(rows["place"])
            else:
                assert first == len(got)
                got += rows["place"]
        assert got == [k[3] for k in everything[:most]] and len(got) + rest == len(everything)
