"""Vector codes against brute force on Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, vector_codes
from tests.llm.data import folder

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    if not kept:
        return {}, None
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign(v):
        return [min((far(cut(v, p), c), k) for k, c in enumerate(books[p])) for p in range(parts)]

    for _ in range(rounds):
        found = [(v, assign(v)) for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v, p) for v, a in found if a[p][1] == k]
                if mine:
                    books[p] = [*books[p][:k], [sum(x) // len(mine) for x in zip(*mine)], *books[p][k + 1 :]]
    out = {i: ("".join(f"{k:02x}" for _, k in assign(v)), sum(d for d, _ in assign(v)), y) for i, v, y in kept}
    sums = {}
    for _, error, y in out.values():
        sums[y] = sums.get(y, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return {i: (code, error, sums[y]) for i, (code, error, y) in out.items()}, digest


def vectors(n, seed=1, dims=64):
    rnd = random.Random(seed)
    return [(i, [rnd.choice((-1, 0, 1)) * rnd.random() for _ in range(dims)], rnd.choice((None, 0, 1, 2))) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 40, 300])
def test_query_against_brute_force(spark, tmp_path, n):
    rows = vectors(n)
    rows += [(1000, None, 1), (1001, [None] * 64, 1), (1002, [math.nan] * 64, None), (1003, [math.inf] + [0.0] * 63, 1), (-5, [-math.inf] * 64, 2)]
    rows += [(2000 + i, rows[0][1] if n else [0.25] * 64, 7) for i in range(n // 3)]  # many copies, ties between entries
    got = queries.op12_vector_codes(spark, folder(spark, tmp_path, embeddings=(rows, SCHEMA))).collect()
    want, digest = brute(rows)
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got} == want
    assert {r["codebooks_sha256"] for r in got} <= {digest}


def test_other_columns_lengths_and_large_components(spark):
    rows = [(1, [0.5, 1.0], "a", "x"), (2, [1e30, -1e30], "a", "y"), (3, [0.5], "b", "z"), (None, [0.5, 1.0], "b", "w")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, Code string, `a.b` string")
    books = vector_codes.fit(df, parts=2, entries=2, rounds=1)
    out = vector_codes.encode(df, books)
    assert out.columns == ["vec_id", "a.b", "code", "error"]
    got = {r["vec_id"]: (r["code"], r["error"]) for r in out.collect()}
    assert got == {1: ("0000", 0), None: ("0000", 0), 2: ("0101", 0)}  # the vector of another length has no code
    assert books.decode("0000").tolist() == [0.5, 1.0]
    most = vector_codes.limit(2)
    assert books.entries[:, 1, 0].tolist() == [most, -most] and 2 * (2 * most) ** 2 < 2**63


def test_codes_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(vectors(200, 3), SCHEMA)
    a = sorted(map(tuple, vector_codes.compress(df.repartition(1)).collect()))
    b = sorted(map(tuple, vector_codes.compress(df.orderBy(F.desc("vec_id")).repartition(7)).collect()))
    assert a == b and len(a) == 200


def test_rounds_lower_the_error(spark):
    df = spark.createDataFrame(vectors(400, 4), SCHEMA)
    errors = [vector_codes.encode(df, vector_codes.fit(df, entries=8, rounds=r)).agg(F.sum("error")).first()[0] for r in (0, 1, 4)]
    assert errors[0] > errors[1] > errors[2]
