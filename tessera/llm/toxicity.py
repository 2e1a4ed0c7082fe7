"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all documents is the unlabelled set. Spark counts in how
many documents of either set each word occurs and picks the words that tell them apart best; numpy then fits
linear classifiers on those words with the non-negative risk estimator: with class prior p,

    risk = p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)]),

where the bracket, the negatives' risk corrected for the positives among the unlabelled, may not go below zero; while
it would, the step undoes it instead. The classifiers differ in the part of the unlabelled set that they see, and
their scores' logits are averaged.

The prior is a parameter, or is estimated from positives and unlabelled alone: half of either set fits a classifier
that tells them apart, and on the other half, the least ratio of the unlabelled share to the positive share above a
threshold of its scores is the prior, for above it hardly any negative stands. Labels of 0 are not needed.

The fit sees at most about ``MAX_POSITIVE`` confirmed documents, chosen by a hash of doc_id, one row for each id, and
``MAX_UNLABELLED`` other rows, chosen by a hash of id and text, and ``MAX_WORDS`` words. Everything else covers all
rows. All draws and orders are by hashes of the rows, so the model does not depend on how files are split.

Null and empty texts have no words and get the score of the bias. Labels that are null count as unlabelled; an id with
several labels is toxic if one is. Without a confirmed toxic document every score is 0. Repeated rows are each scored,
equal texts alike, and count once in the fit. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, others, quoted
from tessera.shipping import map_in_arrow

MAX_POSITIVE = 6_000
MAX_UNLABELLED = 20_000
MAX_WORDS = 2_048
MIN_DOCS = 4
MIN_CHI = 20.0
CLASSIFIERS = 3
STEPS = 400
RATE = 0.05
L2 = 1e-4
FOLDS = 5
LEAST_PRIOR, MOST_PRIOR = 0.001, 0.9
CONFIDENCE = 0.1  # chance of a wrong bound in the choice of the prior's threshold

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that labels are never learnt from: crc32 of the id's text divisible by FOLDS."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _share(n: int, most: int) -> Column:
    """True for a hash-chosen share of the ids that leaves about ``most`` of ``n``."""
    return F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, most / max(n, 1)))


def training_sample(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(draw, positive, words) of the sample, in one pass over the texts; None without a confirmed document."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_toxic = known.where(F.col("toxic") == 1).count()
    if not n_toxic:
        return None
    positives = known.where(F.col("toxic") == 1).where(_share(n_toxic, MAX_POSITIVE)).select("doc_id", F.lit(True).alias("confirmed"))
    train = docs.select("doc_id", "text").where(~held_out())
    share = math.ceil(1_000_000 * min(1.0, MAX_UNLABELLED / max(train.count(), 1)))
    draw = F.xxhash64("doc_id", "text", F.lit(17))
    rows = train.withColumn("draw", draw).join(F.broadcast(positives), "doc_id", "left").withColumn("drawn", F.pmod("draw", F.lit(1_000_000)) < share)
    rows = rows.where(F.coalesce("confirmed", F.lit(False)) | F.col("drawn"))
    # a row that repeats without end counts once, and of an id's confirmed rows one counts
    once = rows.groupBy("doc_id", "draw").agg(F.min("text").alias("text"), F.max(F.coalesce("confirmed", F.lit(False))).alias("confirmed"), F.max("drawn").alias("drawn"))
    once = scratch.save(once)
    confirmed = once.where("confirmed").groupBy("doc_id").agg(F.min(F.struct("draw", "text")).alias("r")).select("r.draw", F.lit(True).alias("positive"), "r.text")
    sample = confirmed.unionByName(once.where("drawn").select("draw", F.lit(False).alias("positive"), "text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(words(t.as_py())) for t in b.column(2)], pa.list_(pa.string()))], ["draw", "positive", "words"])

    out = scratch.save(map_in_arrow(sample, split, "draw long, positive boolean, words array<string>"))
    scratch.drop(once)
    return out


def vocabulary(sample: DataFrame, n_positive: int, n_unlabelled: int) -> list[str]:
    """The words whose document counts differ most between the two sets, by the chi-square statistic."""
    counts = sample.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("positive").alias("a"), F.count_if(~F.col("positive")).alias("b"))
    a, b, n, m = F.col("a").cast("double"), F.col("b").cast("double"), float(n_positive), float(n_unlabelled)
    chi = (n + m) * (a * (m - b) - b * (n - a)) ** 2 / (n * m * (a + b) * (n + m - a - b) + 1e-9)
    top = counts.where(F.col("a") + F.col("b") >= MIN_DOCS).select("word", chi.alias("chi")).where(F.col("chi") > MIN_CHI).orderBy(F.desc("chi"), "word").limit(MAX_WORDS)
    return [r[0] for r in top.collect()]


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, n_words: int, prior: float, bounded: bool = True) -> tuple[np.ndarray, float]:
    """Weights and bias of one linear classifier. ``rows`` hold each document's word numbers.

    Not ``bounded``, it takes the unlabelled for negatives.
    """
    lengths = np.array([len(r) for r in rows])
    index = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    share = np.where(positive, 1.0 / max(positive.sum(), 1), 1.0 / max((~positive).sum(), 1))
    w, bias = np.zeros(n_words), math.log(max(prior, 1e-4) / max(1 - prior, 1e-4))
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for step in range(1, STEPS + 1):
        s = np.bincount(owner, weights=w[index], minlength=len(rows)) + bias
        p = 1.0 / (1.0 + np.exp(-np.clip(s, -30, 30)))
        loss_neg = np.logaddexp(0, s) * share
        among = prior if bounded else 0.0  # positives among the unlabelled
        negatives = loss_neg[~positive].sum() - among * loss_neg[positive].sum()
        d_neg = share * np.where(positive, -among * p, p)
        if negatives < 0:
            d = -d_neg
        else:
            d = d_neg + np.where(positive, -prior * share * (1 - p), 0.0)
        g = np.append(np.bincount(index, weights=d[owner], minlength=n_words) + L2 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def class_prior(rows: list[np.ndarray], positive: np.ndarray, n_words: int, half: np.ndarray | None = None) -> float:
    """The share of positives among the unlabelled, between LEAST_PRIOR and MOST_PRIOR; ``half`` marks rows to fit on."""
    half = np.arange(len(rows)) % 2 == 0 if half is None else half
    if min((half & positive).sum(), (half & ~positive).sum(), (~half & positive).sum(), (~half & ~positive).sum()) < 2:
        return 0.5
    fitted, kept = np.flatnonzero(half), np.flatnonzero(~half)
    # a prior of one half weighs the two sets alike: the classifier tells confirmed from unlabelled documents
    w, _ = fit_nnpu([rows[i] for i in fitted], positive[fitted], n_words, 0.5, bounded=False)
    scores = np.array([w[rows[i]].sum() for i in kept])
    pos, unl = np.sort(scores[positive[kept]]), np.sort(scores[~positive[kept]])
    at = np.unique(pos)
    in_pos, in_unl = 1 - np.searchsorted(pos, at) / len(pos), 1 - np.searchsorted(unl, at) / len(unl)
    slack = math.sqrt(math.log(4 / CONFIDENCE) / 2) * (1 / math.sqrt(len(pos)) + 1 / math.sqrt(len(unl)))
    best = int(np.argmin((in_unl + slack) / in_pos))
    return float(min(MOST_PRIOR, max(LEAST_PRIOR, in_unl[best] / in_pos[best])))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, prior: float | None = None) -> tuple[dict[str, float], float] | None:
    """Word weights and bias; None where no document is confirmed toxic. ``docs``: doc_id, text.

    ``prior``: the share of toxic documents, below 1, where it is known.
    """
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    sample = training_sample(docs, labels, scratch)
    if sample is None:
        return None
    n_positive, n_unlabelled = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n_positive or not n_unlabelled:
        return None
    vocab = vocabulary(sample, n_positive, n_unlabelled)
    number = {w: i for i, w in enumerate(vocab)}
    chosen = sample.select("draw", "positive", F.array_sort(F.array_intersect("words", F.array(*map(F.lit, vocab)).cast("array<string>"))).alias("words")).collect()
    scratch.drop(sample)
    chosen.sort(key=lambda r: (r["draw"], r["positive"], r["words"]))
    rows = [np.array([number[w] for w in r["words"]], np.int64) for r in chosen]
    positive = np.array([r["positive"] for r in chosen])
    prior = class_prior(rows, positive, len(vocab), np.array([r["draw"] % 2 == 0 for r in chosen])) if prior is None else prior
    part = np.where(positive, -1, np.cumsum(~positive) % CLASSIFIERS)
    weights, biases = [], []
    for k in range(CLASSIFIERS):
        # each classifier leaves out one part of the unlabelled set
        use = np.flatnonzero((part != k) | positive) if (~positive).sum() >= 10 * CLASSIFIERS else np.arange(len(rows))
        w, b = fit_nnpu([rows[i] for i in use], positive[use], len(vocab), prior)
        weights.append(w)
        biases.append(b)
    return dict(zip(vocab, np.mean(weights, axis=0).tolist())), float(np.mean(biases))


def score(df: DataFrame, model: tuple[dict[str, float], float] | None, text: str = "text", out: str = "score", with_text: bool = True) -> DataFrame:
    """``df``, with or without its text, with the probability that the whole text is toxic.

    A column named like ``out``, in any case, is replaced.
    """
    keep = others(df.columns, text, out) + ([text] if with_text else [])
    if model is None:
        return df.select(*quoted(keep), F.lit(0.0).alias(out))
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        known = weights.keys()
        for batch in batches:
            found = [bias + sum(weights[w] for w in sorted(words(t.as_py()) & known)) for t in batch.column(-1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in found], pa.float64())], [*keep, out])

    judged = map_in_arrow(df.select(*quoted(keep)) if with_text else df.select(*quoted(keep), text), judge, schema)
    return judged.select(*quoted([c for c in df.columns if c in keep]), out)
