"""The pipeline's stages, each against brute force on what the stage before it kept."""

import random
import re

import corpus_pipeline
from tessera.llm import decontam, packing, simhash, toxicity
from tests.llm import brute
from tests.llm.data import folder

rnd = random.Random(11)
WORDS = ["".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def tables():
    texts = [prose(rnd.randrange(30, 120)) for _ in range(150)]
    texts += [f"{prose(20)} idiot {prose(10)} moron scum {prose(20)}" for _ in range(40)]
    bench = [(i, prose(30)) for i in range(5)]
    texts += [f"{prose(20)} {bench[i % 5][1]} {prose(30)}" for i in range(10)]
    texts += texts[:20] + [t + " tail" for t in texts[20:40]]
    texts += [f"{prose(10)} mail u{i}@x.org or 10.0.0.{i} {prose(30)}" for i in range(10)] + [None, "", ""]
    docs = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)] + [(None, prose(40), None, None, None)]
    labels = [(i, 1, int("moron" in (t or ""))) for i, t in enumerate(texts) if i % 3]
    return docs, labels, bench


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels, bench = tables()
    sf_dir = folder(
        spark, tmp_path,
        documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        labels=(labels, "doc_id long, quality int, toxic int"), benchmark=(bench, "item_id long, text string"),
    )
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept, outs = now.columns, [], {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"out{k}")
        stage(spark, now, sf_dir).write.parquet(path)
        now = spark.read.parquet(path)
        if k < 4:
            assert now.columns == columns
            outs[name] = {r["doc_id"]: r["text"] for r in now.collect()}
            kept.append(len(outs[name]))
    texts = {d[0]: d[1] for d in docs}
    toxic = {i for i, t in texts.items() if "moron" in (t or "")}
    assert set(outs["toxicity"]) == set(texts) - toxic

    before = outs["toxicity"]
    groups = brute.groups({i: brute.fingerprint(t) for i, t in before.items() if i is not None})
    first, kept_ids = {i for i, g in groups.items() if i == g}, set(outs["near_duplicates"]) - {None}
    sets = {i: set(simhash.shingle_hashes(before[i], 5)) for i in first}
    alike = lambda i, j: len(sets[i] & sets[j]) >= corpus_pipeline.SIMILARITY * len(sets[i] | sets[j])
    assert None in outs["near_duplicates"] and kept_ids <= first
    assert all(any(alike(i, j) for j in first if j < i) for i in first - kept_ids)  # nothing else goes
    left = [i for i in kept_ids if any(alike(i, j) for j in kept_ids if j < i)]
    assert len(left) <= 2 and first - kept_ids

    before = outs["near_duplicates"]
    items = [decontam.normal(t) for _, t in bench]
    leaks = {i for i, t in before.items() if any(brute.best_place(x, decontam.normal(t)) <= decontam.edits_allowed(len(x)) for x in items)}
    assert leaks and set(outs["decontamination"]) == set(before) - leaks

    before, after = outs["decontamination"], outs["pii"]
    assert set(after) == set(before)
    for i, t in before.items():
        want = t and re.sub(r"10\.0\.0\.[0-9]+", "[IP]", re.sub(r"u[0-9]+@x\.org", "[EMAIL]", t))
        assert after[i] == want

    packed = now.collect()
    again = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r["doc_id"] or -1, r["piece"], r["text"] or "")
    assert [key(r) for r in sorted(packed, key=key)] == [key(r) for r in sorted(again, key=key)]
    assert {r["doc_id"]: r["text"] for r in packed} == after
    assert all(r["capacity"] in packing.SIZES for r in packed if r["text"])
    assert toxicity.FOLDS == 5


def test_empty_tables(spark, tmp_path):
    sf_dir = folder(
        spark, tmp_path,
        documents=([], "doc_id long, text string, lang string, source string, n_chars long"),
        labels=([], "doc_id long, quality int, toxic int"), benchmark=([], "item_id long, text string"),
    )
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
