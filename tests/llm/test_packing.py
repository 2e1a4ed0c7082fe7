"""Best-fit packing: the bins against a plain best fit, pieces' exact round trip, invariants of the query."""

import random

import duckdb
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, queries, token_counts
from tests.llm.data import HARD_TEXTS, documents, folder


def plain(lengths, opened, sizes):
    """Used tokens of the bins of a best fit that may open the lengths ``opened``."""
    bins, left = [], sum(lengths)
    for n in sorted(lengths, reverse=True):
        open_ = [b for b in bins if b[0] - b[1] >= n]
        if open_:
            b = min(open_, key=lambda b: b[0] - b[1])
        else:
            fit = [s for s in opened if s >= n] or [min(s for s in sizes if s >= n)]
            bins.append(b := [packing.open_size(n, left, tuple(fit)), 0])
        b[1] += n
        left -= n
    return [u for _, u in bins]


def cost_of(used, sizes):
    return sum(packing.cost(min(s for s in sizes if s >= u)) for u in used)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_bins_are_the_cheapest_best_fit(lengths):
    sizes = (8, 16, 32, 64)
    bins = packing.best_fit(lengths, sizes)
    assert sorted(i for b in bins for i in b.items) == list(range(len(lengths)))
    for b in bins:
        assert b.used == sum(lengths[i] for i in b.items) and b.size == min(s for s in sizes if s >= b.used)
    for s in sizes:
        assert packing.total_cost(bins) <= cost_of(plain(lengths, (s,), sizes), sizes) + 64 * packing.PER_BIN * (len(set(lengths)) < len(lengths))
    if len(set(lengths)) == len(lengths):  # without ties the plain version makes the same choices
        runs = [sizes[i:j] for i in range(4) for j in range(i + 1, 5)]
        assert abs(packing.total_cost(bins) - min(cost_of(plain(lengths, r, sizes), sizes) for r in runs)) < 1e-6 or not lengths


def test_lengths_chosen_together_cost_less_than_any_alone():
    rnd = random.Random(3)
    lengths = [int(min(8191, rnd.lognormvariate(6.2, 1.1) + 20)) for _ in range(1500)]
    one = {s: packing.total_cost(packing._pack(lengths, sorted(range(1500), key=lambda i: -lengths[i]), (s,), packing.SIZES)) for s in packing.SIZES}
    best = packing.best_fit(lengths)
    assert packing.total_cost(best) <= min(one.values()) < max(one.values())
    mixed = [500] * 100 + [1500] * 30
    alone = [packing.total_cost(packing._pack(mixed, list(range(100, 130)) + list(range(100)), (s,), packing.SIZES)) for s in packing.SIZES]
    assert packing.total_cost(packing.best_fit(mixed)) <= min(alone)


def test_open_size_is_the_least_cost():
    assert packing.open_size(100, 10**9, packing.SIZES) == 1024
    assert packing.open_size(100, 120, packing.SIZES) == 512
    assert packing.open_size(1500, 10**9, packing.SIZES) == 2048


def test_pieces_round_trip():
    counter = token_counts.TokenCounter(token_counts.model_path())
    rnd = random.Random(2)
    texts = [t for t in HARD_TEXTS if t] + ["x" * 5000, "word " * 700, "  two  spaces " * 90, "a" * 300 + " " + "É😀" * 300 + " tail "]
    for text in texts:
        for most in (16, 40, 333):
            cuts = packing.pieces(text, counter, most)
            at = 0
            for start, end, n in cuts:
                assert at == start < end and 0 <= n <= most
                assert n == len(counter.processor.encode(text[start:end])), (text[:40], most, start, end)
                at = end
            assert at == len(text)
    assert packing.pieces("", counter, 9) == packing.pieces(None, counter, 9) == []
    assert rnd


def test_query(spark, tmp_path, monkeypatch):
    texts = HARD_TEXTS + [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()] + ["long text " * 9000]
    rows = queries.op1_packing(spark, folder(spark, tmp_path, documents=documents(texts))).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    bins, by_doc = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        if t:
            assert [r["start"] for r in own] == [0, *(r["end"] for r in own[:-1])] and own[-1]["end"] == len(t)
            assert all(r["n_tokens"] == len(sp.encode(t[r["start"] : r["end"]])) for r in own)
        else:
            assert [(r["n_tokens"], r["bin_id"]) for r in own] == [(0, None)]
    for own in bins.values():
        used = sum(r["n_tokens"] + packing.SEPARATOR for r in own)
        assert {r["capacity"] for r in own} == {min(s for s in packing.SIZES if s >= used)}
        at = 0
        for r in sorted(own, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["n_tokens"] + packing.SEPARATOR
    full = sum(r["n_tokens"] + 1 for o in bins.values() for r in o) / sum(o[0]["capacity"] for o in bins.values())
    assert full > 0.8


def test_text_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUFFER_TOKENS", 50)
    df = spark.createDataFrame([(i, f"text number {i} " * 9, "x", [1.5]) for i in range(40)] + [(None, None, None, None)], "doc_id long, text string, bin_id string, extra array<double>")
    rows = packing.pack_documents(df, sizes=(16, 32)).collect()
    assert {r["doc_id"] for r in rows} == {None, *range(40)} and all(r["extra"] == [1.5] for r in rows if r["doc_id"] is not None)
    for i in range(40):
        assert "".join(r["text"] for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])) == f"text number {i} " * 9
    assert packing.pack_documents(df.limit(0)).count() == 0
