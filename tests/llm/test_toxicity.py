"""Toxicity: held-out accuracy on the tables, the risk estimator, and awkward rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import queries, toxicity
from tests.llm.data import HARD_TEXTS, documents, folder


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = queries.op3_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").select("doc_id", "toxic", "score", "predicted").collect()
    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    toxic = [r for r in rows if r["toxic"]]
    hits = sum(r["predicted"] for r in toxic)
    assert hits / len(toxic) >= 0.75 and hits / max(1, sum(r["predicted"] for r in rows)) >= 0.85


def test_nnpu_learns_from_contaminated_unlabelled():
    """Half of the unlabelled documents are positive; word 0 marks positives, word 1 all."""
    rng = np.random.default_rng(0)
    truth = rng.random(2000) < 0.5
    rows = [np.array([0, 1, 2 + rng.integers(20)] if t else [1, 2 + rng.integers(20)]) for t in truth]
    confirmed = truth & (rng.random(2000) < 0.3)
    use = [*np.flatnonzero(confirmed), *range(2000)]
    positive = np.array([True] * confirmed.sum() + [False] * 2000)
    w, bias = toxicity.fit_nnpu([rows[i] for i in use], positive, 22, prior=0.5)
    predicted = np.array([w[r].sum() + bias > 0 for r in rows])
    assert (predicted == truth).mean() > 0.95


def test_awkward_rows(spark, tmp_path):
    texts = [*HARD_TEXTS, *["you moron idiot scum now"] * 30, *["a fine day with words"] * 90]
    rows, schema = documents(texts)
    rows += [rows[-1], (None, "idiot moron", None, None, None)]
    labels = [(r[0], None, None if r[0] % 3 else int("moron" in (r[1] or ""))) for r in rows if r[0] is not None]
    sf_dir = folder(spark, tmp_path, documents=(rows, schema), labels=(labels, "doc_id long, quality int, toxic int"))
    got = queries.op3_toxicity(spark, sf_dir)
    assert got.count() == len(rows)
    assert got.where("score is null or predicted is null or held_out is null").count() == 0
    docs, none = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs.select("doc_id", "text"), none) is None
    assert toxicity.score(docs.withColumn("score", F.lit("clash")), None).where("score = 0").count() == len(rows)
    assert toxicity.fit(docs.limit(0), spark.read.parquet(f"{sf_dir}/labels.parquet")) is None


def corpus(n=600):
    """A fifth of the documents is toxic; every document has an id of its own."""
    rnd = random.Random(4)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in ("ane", "ome", "ist", "urk", "elp")]
    texts = []
    for i in range(n):
        said = [rnd.choice(vocab) for _ in range(30)]
        texts.append(" ".join(said + ([rnd.choice(["moron", "scum"]), "idiot"] if i % 5 == 0 else [])))
    return texts


def test_confirmed_positives_alone_are_enough(spark):
    """No label of 0 and most toxic documents unlabelled: the scores still tell the classes apart."""
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, len(texts), 10)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert sum((got[i] >= 0.5) == (i % 5 == 0) for i in got) >= 0.98 * len(texts)


def test_the_model_does_not_depend_on_the_layout(spark):
    texts = corpus(300)
    rows = list(enumerate(texts)) + [(0, texts[0])] * 40
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 300, 2)], "doc_id long, toxic int")
    models = []
    for parts, order in ((1, rows), (7, rows[::-1])):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
        models.append(toxicity.fit(docs, labels.repartition(parts)))
    assert models[0] == models[1]


def test_class_prior_of_a_known_mixture():
    rng = np.random.default_rng(3)
    for share in (0.05, 0.2, 0.6):
        truth = np.concatenate([np.ones(400, bool), rng.random(4000) < share])
        confirmed = np.arange(len(truth)) < 400
        rows = [np.append(rng.choice(20, 3, replace=False), [20] if t and rng.random() < 0.8 else []).astype(np.int64) for t in truth]
        order = rng.permutation(len(truth))
        prior = toxicity.class_prior([rows[i] for i in order], confirmed[order], 21)
        assert 0.7 * share <= prior <= 1.4 * share, (share, prior)
    assert toxicity.class_prior(rows[:3], np.array([True, False, False]), 21) == 0.5
