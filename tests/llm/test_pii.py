"""Personal data: base spans against brute force, the bootstrap on a planted context, redaction."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import pii, queries
from tessera.llm.common import Scratch
from tests.llm import brute
from tests.llm.data import HARD_TEXTS, documents, folder

CASES = [
    "a@b.c@d.e f_x@y.z.. a@b.c_x@d.e .@-.- x@y é@b.co a.b+c%d@e-f.g.h,",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 0000255.0.0.0 1.2.3 9999999999999.1.1.1 1.2.3.4",
    "4111111111111111 4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111111111 4111111111111112",
    "+1 415 555-0123 +44 (0)20.7946-0958 ++1234567890 +1 2 +12345678901234567890 +1(2)3(4)5(6)7(8)9(0)1) +123 456 7890 4111111111111111",
    "😀 me@x.org 😀 +1 415 555 0123 ü 10.0.0.1",
    "a" * 30_000 + " " + "1" * 30_000 + " " + "1." * 10_000 + " " + "x@" * 5_000 + "+1" * 5_000 + " end",
    " ".join(f"{i % 256}.1.2.3 u{i}@x.org" for i in range(1500)),
]


def check(got, texts):
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        spans = brute.pii(t)
        g = got[i]
        assert tuple(g[f"n_{k}"] for k in pii.KINDS) == tuple(sum(s[1] == n for s in spans) for n in range(4)), (t or "")[:200]
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert g["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), (t or "")[:200]
        assert set(filter(None, base.split(","))) <= set(g["spans"].split(","))


def test_base_spans(spark, tmp_path):
    texts = CASES + HARD_TEXTS + [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()]
    check({r["doc_id"]: r for r in queries.op4_pii(spark, folder(spark, tmp_path, documents=documents(texts))).collect()}, texts)


@pytest.fixture(scope="module")
def planted():
    known = [f"Write to account holder u{i}@example.org today please" for i in range(12)]
    unseen = ["ask account holder X-99887766-Q soon", "account holder 12345678901 said", "the year 2024123 was fine", "account holder new@host.example.net too"]
    keys = [f'set token = "{hashlib.sha1(str(i).encode()).hexdigest()}" there' for i in range(5)]
    return known + unseen + keys + ['use token = "pk-88-77-66-55" now', "the 4111111111111112 is no card", f"commit {hashlib.sha1(b'x').hexdigest()} alone", "user id=555001 and id=555002"]


def spans(docs):
    return {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).select("doc_id", pii.written(F.col("found")).alias("spans")).collect()}


def test_bootstrap_discovers_unseen_identifiers(spark, planted):
    got = spans(spark.createDataFrame([*enumerate(planted), (99, planted[12])], "doc_id long, text string"))
    assert got[12] == f"id:19:{19 + len('X-99887766-Q')}" and got[13] == "id:15:26" and got[14] == ""
    assert got[15] == "" and all(got[i] == "" for i in range(12))  # base spans already
    assert all(got[i] == "secret:13:53" for i in range(16, 21)) and got[21] == "secret:13:27"
    assert got[22] == got[23] == got[24] == ""  # no seed context, a key out of place, a label without seeds
    assert got[99] == got[12]


def test_common_words_before_seeds_prove_nothing(spark):
    """The word before ten seeds also precedes a hundred ordinary words: what else follows it is no identifier."""
    texts = [f"the u{i}@x.org came" for i in range(10)] + ["the cat " * 10] * 10 + ["the 1234567 dogs", "id: 10.0.0.1", "id: 10.0.0.2", "id: 10.0.0.3", "id:777888999 x"]
    got = spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got[20] == "" and got[24] == "id:3:12"


def test_pattern_scores_against_brute_force(spark):
    rnd = random.Random(6)
    texts = []
    for i in range(400):
        words = [rnd.choice(["red", "blue", "mail", "to", "no", "x"]) for _ in range(12)]
        for _ in range(2):
            at = rnd.randrange(len(words))
            words[at] = rnd.choice([f"a{rnd.randrange(40)}@b.org", f"{rnd.randrange(10**6, 10**6 + 60)}"])
        if i % 3 == 0:
            words += ["send", f"s{i}@b.org"] if i % 9 else ["send", f"{10**6 + i}"]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scratch = Scratch(spark, "test")
    mentions = scratch.save(pii.scan(df).select("doc_id", "key", F.inline("mentions")))
    got = {r["pattern"]: (r["kind"], r["score"]) for r in pii.patterns_of(mentions, df.select("text"), scratch).collect()}
    want = brute.patterns(texts, pii.ROUNDS, pii.MIN_SEEDS, pii.MIN_SCORE)
    assert set(got) == set(want) and "L send" in got and len(got) < 40
    assert all(got[p][0] == 0 and abs(got[p][1] - want[p]) < 1e-9 for p in got)


def test_redact(spark, planted):
    rows = [(i, t, "x") for i, t in enumerate(planted)] + [(None, "mail me@x.org now", "y"), (99, None, None), (99, "card 4111 1111 1111 1111, ip 1.2.3.4 and 300.1.1.1", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string").withColumns({c: F.lit(c) for c in ("_id", "_KEY", "_found", "found", "key")})
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {(r["doc_id"], r["base"]): r["text"] for r in out.collect()}
    assert len(got) == len(rows)
    assert got[12, "x"] == "ask account holder [ID] soon" and got[None, "y"] == "mail [EMAIL] now" and got[99, None] is None
    assert got[16, "x"] == 'set token = "[SECRET]" there'
    assert got[99, "z"] == "card [CARD], ip [IP] and 300.1.1.1"
    assert pii.redact(docs.limit(0)).count() == 0
