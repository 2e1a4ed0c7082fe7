"""Columns whose names differ from the operators' own only by case, or hold dots; wide urls; long repetitive texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import language_model, licenses, packing, simhash, token_counts, toxicity, url_filter, vector_codes
from tests.llm import brute
from tests.llm.data import folder

NAMES = ["Start", "N_Words", "N_Tokens", "FP", "Score", "BIN_ID", "Labels", "License_Spans", "Code", "a.b", "_Row"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["all rights reserved by them", None, "", "some other text " * 9])], "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in NAMES})


@pytest.mark.parametrize(
    "operator, own",
    [
        (packing.pack_documents, ["Start", "N_Tokens", "BIN_ID"]),
        (lambda d: licenses.summary(licenses.scan_licenses(d)), ["N_Words", "License_Spans", "Labels", "Score"]),
        (token_counts.count_tokens, ["N_Tokens"]),
        (simhash.fingerprints, ["FP"]),
        (lambda d: toxicity.score(d, ({"other": 1.0}, 0.0)), ["Score"]),
        (lambda d: toxicity.score(d, None), ["Score"]),
        (lambda d: language_model.score(d, language_model.train(d)), ["N_Tokens", "Score"]),
    ],
)
def test_clashes_by_case(docs, operator, own):
    out = operator(docs)
    kept = set(NAMES) - set(own)
    assert kept <= set(out.columns) and not set(own) & set(out.columns)
    assert {r["doc_id"] for r in out.collect()} == {0, 1, 2, 3}
    assert all(r[c] == "x" for r in out.collect() for c in kept)
    assert operator(docs.limit(0)).count() == 0


def test_pipeline_with_clashing_columns(spark, docs, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, Start string, FP string, Score string, N_Words string"
    rows = [(i, f"text number {i} of a kind that is its own {i * 7}", "en", "s", 30, "x", "x", "x", "x") for i in range(12)]
    got = corpus_pipeline.run(spark, folder(spark, tmp_path, documents=(rows, kinds))).collect()
    assert {r["doc_id"] for r in got} == set(range(12)) and all(r["Score"] == r["FP"] == r["N_Words"] == "x" for r in got)


def test_rules_of_wide_urls_have_their_true_confidence(spark):
    """350 urls hold z, 200 of them blocked; the others hold thirteen more telling tokens, which leave z no room."""
    rows = [(["p:z", f"p:u{i}"], "block") for i in range(200)] + [(["p:z", *(f"p:t{k}" for k in range(13))], "allow") for _ in range(150)]
    rows += [([f"p:t{k}"], "allow") for k in range(13) for _ in range(40 + k)] + [([f"p:v{i}"], "allow") for i in range(100)]
    df = spark.createDataFrame([(sorted(t), y) for t, y in rows], "tokens array<string>, label string")
    assert not [r for r in url_filter.mine_rules(df).collect() if "p:z" in r["antecedent"]]
    assert [r["antecedent"] for r in url_filter.mine_rules(df, min_confidence=0.5).collect()] == [["p:z"]]


def test_wide_baskets_against_brute_force(spark):
    rnd = random.Random(12)
    tokens = [f"p:{c}" for c in "abcdefghijklmnopqrst"]
    rows = []
    for _ in range(500):
        own = sorted(rnd.sample(tokens, rnd.randrange(10, 19)))
        rows.append((own, "block" if rnd.random() < (0.95 if {"p:a", "p:b"} <= set(own) else 0.1) else "allow"))
    blocked = sum(y == "block" for _, y in rows)
    found = url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, label string")).collect()
    assert ["p:a", "p:b"] in [r["antecedent"] for r in found]
    for r in found:
        having = [y for t, y in rows if set(r["antecedent"]) <= set(t)]
        hits = sum(y == "block" for y in having)
        assert r["confidence"] == pytest.approx(hits / len(having)) and r["support"] == pytest.approx(hits / len(rows))
        assert hits / len(having) >= max(url_filter.MIN_CONFIDENCE, url_filter.MIN_LIFT * blocked / len(rows))


def test_a_long_text_of_repeated_notices_takes_time_in_proportion():
    scanner = licenses.LicenseScanner(licenses.BASE, licenses.NOTICES)
    notice = next(t for label, t in licenses.NOTICES if len(t.split()) < 30)
    taken = []
    for n in (1500, 6000):
        began = time.process_time()
        words, _, spans = scanner.scan((notice + " and then some words of another kind ") * n)
        taken.append(time.process_time() - began)
        assert len(spans) >= n and words > 8 * n
    assert taken[1] < 10 * taken[0]


def test_vector_codes_keep_other_columns(spark):
    df = spark.createDataFrame([(1, [0.5] * 16, "x")], "vec_id long, embedding array<float>, ERROR string").withColumn("a.b", F.lit(1))
    books = vector_codes.fit(df)
    assert vector_codes.encode(df, books).columns == ["vec_id", "a.b", "code", "error"]


@pytest.mark.parametrize("most", [14, 19])
def test_all_rules_of_wide_urls_against_brute_force(spark, most):
    """Blocked urls hold twelve tokens that tell more, so the rules of x and y lie beyond what FP-growth sees."""
    rnd = random.Random(most)
    rows = []
    for _ in range(260):
        own = {f"p:b{k:02}" for k in range(12) if rnd.random() < 0.97} | {f"p:x{k}" for k in range(most - 12) if rnd.random() < 0.9}
        rows.append((sorted(own), "block"))
    for _ in range(300):
        own = {f"p:b{k:02}" for k in range(12) if rnd.random() < 0.02} | {f"p:x{k}" for k in range(most - 12) if rnd.random() < 0.4} | {"p:z"}
        rows.append((sorted(own), "allow"))
    assert any(len(t) > url_filter.MAX_WIDTH for t, _ in rows)
    found = url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, label string")).collect()
    got = {tuple(r["antecedent"]): (round(r["confidence"], 9), round(r["support"], 9)) for r in found}
    assert got == brute.rules(rows, url_filter) and any({"p:x0", "p:x1"} <= set(a) for a in got)
