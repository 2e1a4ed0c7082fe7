"""Licence scans: base places against brute force, the automaton against all substrings, spans on known texts."""

import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import licenses, queries
from tests.llm import brute
from tests.llm.data import HARD_TEXTS, documents, folder

CASES = [
    "Licensed under CC BY-NC 4.0.",
    "cc BY cc by CC. by; general public LICENSE General Public License",
    "All rights\nreserved. all rights reserved, ALL RIGHTS RESERVEDx",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed, as we said elsewhere, under the Apache License, Version 2.0",
    "cc éby cc by é",
    "all rights all rights reserved " * 50,
    "Code licensed under the GNU General Public License, version 3, or later.",
    "Licensed under CC BY-NC-SA 4.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "under a Creative Commons Attribution 4.0 International License today",
    next(text for label, text in licenses.NOTICES if label == "mit" and len(text) > 500),
]


def test_query_base_columns(spark, tmp_path):
    texts = CASES + HARD_TEXTS + [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()]
    got = {r["doc_id"]: r for r in queries.op2_license_scan(spark, folder(spark, tmp_path, documents=documents(texts))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        g = got[i]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == brute.licenses(t, licenses.BASE), t
        assert set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1
    assert got[0]["labels"] == "cc-by,cc-by-nc-4.0" and got[0]["score"] == 1
    assert got[3]["labels"] == "gpl,gpl-3.0"
    assert got[7]["labels"] == "gpl,gpl-3.0" and got[8]["labels"] == "cc-by,cc-by-nc-sa-4.0" and got[9]["labels"] == "bsd"
    assert got[10]["labels"] == "cc-by-4.0" and got[11]["labels"] == "mit"
    assert got[4]["labels"] == "apache-2.0"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=7), min_size=1, max_size=4), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=20))
def test_matching_statistics(sequences, text):
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    auto = licenses.SuffixAutomaton(sequences)
    got = {i: n for i, _, n in auto.statistics(text)}
    for i in range(len(text)):
        assert got.get(i, 0) == max((n for n in range(1, i + 2) if tuple(text[i - n + 1 : i + 1]) in runs), default=0)
    for i, state, n in auto.statistics(text):
        run = text[i - n + 1 : i + 1]
        assert {(k, e) for k, s in enumerate(sequences) for e in range(n, len(s) + 1) if s[e - n : e] == run} == set(auto.ends[state])
        whole = {k for m, k in auto.whole[state] if m <= n}
        assert whole == {k for k, s in enumerate(sequences) if len(s) <= n and run[n - len(s) :] == s}


def brute_spans(templates, text):
    """Runs by comparing every place of the text with every place of every template, chained and chosen by the rules."""
    spans = []
    for label, seq in templates:
        longest = []
        for i in range(len(text)):
            n = max((n for n in range(1, i + 2) for e in range(n, len(seq) + 1) if seq[e - n : e] == text[i - n + 1 : i + 1]), default=0)
            longest.append(n)
        runs = [(i, n) for i, n in enumerate(longest) if (n >= licenses.MIN_MATCH or 0 < n == len(seq)) and (i + 1 == len(text) or longest[i + 1] != n + 1)]
        chain = None
        for i, n in runs:
            ends = [e for e in range(n, len(seq) + 1) if seq[e - n : e] == text[i - n + 1 : i + 1]]
            fits = None
            if chain:
                for e in ends:
                    again = max(0, chain["end"] - (i - n + 1), chain["at"] - (e - n))
                    if again < n and i - n + 1 - chain["end"] <= licenses.MAX_GAP and e - n + again >= chain["at"]:
                        fits = {**chain, "end": i + 1, "at": e, "n": chain["n"] + n - again}
                        break
                if not fits:
                    spans.append((label, chain["first"], chain["end"], chain["n"] / len(seq)))
            chain = fits or {"first": i - n + 1, "end": i + 1, "at": ends[0], "n": n}
        if chain:
            spans.append((label, chain["first"], chain["end"], chain["n"] / len(seq)))
    kept = []
    for s in sorted(spans, key=lambda s: (-s[3], s[1] - s[2], s[0], s[1])):
        if all(2 * len(set(range(s[1], s[2])) & set(range(k[1], k[2]))) < s[2] - s[1] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: (s[1], s[0]))


LETTERS = [b"a", b"b", b"c", b"d"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(LETTERS), min_size=2, max_size=9), min_size=1, max_size=4), st.lists(st.sampled_from(LETTERS), max_size=25))
def test_spans_against_brute_force(sequences, text):
    scanner = licenses.LicenseScanner({}, [(f"t{i}", b" ".join(s).decode()) for i, s in enumerate(sequences)])
    assert scanner.scan(b" ".join(text).decode())[2] == brute_spans(scanner.templates, text)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, CASES[3])], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n_words", "license_spans", "base_places", "labels_", "SPAN")})
    out = licenses.scan_licenses(df)
    assert set(out.columns) == {"doc_id", "n_words", "license_spans", "base_places", "labels_", "SPAN"} and out.first()["SPAN"] == "x" and out.first()["n_words"] == 12
    assert licenses.summary(licenses.scan_licenses(df.limit(0))).count() == 0


def test_spans_survive_small_edits():
    rnd = random.Random(1)
    scanner = licenses.LicenseScanner(licenses.BASE, licenses.NOTICES)
    label, notice = next(x for x in licenses.NOTICES if x[0] == "mit" and 15 < len(x[1].split()) < 30)
    noise = [f"w{rnd.randrange(99)}" for _ in range(40)]
    edited = notice.split()
    edited[8] = "changed"
    _, _, spans = scanner.scan(" ".join(noise + edited + noise))
    best = max(spans, key=lambda s: s[3])
    assert best[0] == label and best[1] == 40 and best[2] == 40 + len(edited) and best[3] >= 0.9
