"""Product codes of vectors: each of ``parts`` equal stretches of a vector is replaced by the index of its nearest entry.

All arithmetic is on integers, so that a codebook does not depend on the order of rows, tasks or repeats. A component x
becomes floor(SCALE * x). ``fit`` starts each part's codebook with that part of the vectors of smallest ids and improves
it in rounds: codebooks are broadcast (parts * entries * width integers, whatever the number of rows), each task finds
the nearest entries of Arrow batches by |x|^2 - 2 x.c + |c|^2 in exact int64 matrix products (the first of equally near
entries), keeps one sum for each entry, and a grouped shuffle merges these. No vector is shuffled.

Kept are vectors that are not null and hold neither null nor non-finite components (``usable``), have as many components
as the kept vector of smallest id, and at least one a part; others get no code and count nowhere. Integer components
beyond +-``limit(dims)`` (over 700,000 before scaling for 64 of them) are held to it, where squared distances would leave
int64. Repeated rows are coded each and count each; a null id is the last of the ids, equal ids go by their vectors.
Fewer kept vectors than entries give shorter codebooks; empty tables give an empty result. Columns named code or error,
in any case, are replaced; other columns stay, whatever their names. Null labels are one label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, unused, without
from tessera.shipping import map_in_arrow

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Labels whose sums may be broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 100_000


def limit(dims: int) -> int:
    """The largest integer component for which squared distances of so many components fit into int64."""
    return isqrt((2**63 - 1) // max(1, dims)) // 2


def usable(vec: str) -> Column:
    """Whether a vector has only finite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec).isNotNull() & F.coalesce(~bad, F.lit(False))


def integers(batch_column: pa.Array, dims: int) -> np.ndarray:
    """The scaled integer components of a batch of usable vectors, one row each."""
    flat = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    most = float(limit(dims))
    return np.clip(np.floor(SCALE * flat), -most, most).astype(np.int64).reshape(-1, dims)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``points`` its nearest row of ``entries`` (the first of equals) and the squared distance."""
    distances = (points * points).sum(1)[:, None] - 2 * (points @ entries.T) + (entries * entries).sum(1)[None, :]
    index = distances.argmin(1)
    return index, distances[np.arange(len(points)), index]


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, index]`` is an integer vector of one part's width."""

    entries: np.ndarray

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices by vector and part, and the squared distances summed over parts."""
        parts, _, width = self.entries.shape
        index, error = np.empty((len(points), parts), dtype=np.int64), np.zeros(len(points), dtype=np.int64)
        for p in range(parts):
            index[:, p], near = nearest(points[:, p * width : (p + 1) * width], self.entries[p])
            error += near
        return index, error

    def sha256(self) -> str:
        """Digest of all entries' components, comma-joined by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector, in the scale of the input, that a code stands for."""
        index = [int(code[i : i + 2], 16) for i in range(0, len(code), 2)]
        return np.concatenate([self.entries[p, k] for p, k in enumerate(index)]) / SCALE


def kept(df: DataFrame, vec: str, dims: int) -> DataFrame:
    return df.where(usable(vec) & (F.size(vec) == dims))


def _sums(df: DataFrame, vec: str, books: Codebooks) -> DataFrame:
    """(part, entry, n, sums) over all vectors: one row for each entry and task, merged by a grouped shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(books)
    width = books.entries.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, entries, width = books.entries.shape
        total, n = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            points = integers(batch.column(0), books.dims)
            index, _ = books.assign(points)
            for p in range(parts):
                np.add.at(total[p], index[:, p], points[:, p * width : (p + 1) * width])
                n[p] += np.bincount(index[:, p], minlength=entries)
        part, entry = np.nonzero(n)
        columns = [part.astype(np.int32), entry.astype(np.int32), n[part, entry], *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["part", "entry", "n", *(f"s{i}" for i in range(width))])

    named = [f"s{i}" for i in range(width)]
    each = map_in_arrow(df.select(vec), sums, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in named), rows=4096)
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in named))


def fit(df: DataFrame, id: str = "vec_id", vec: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``df``; None if it has no usable vector. ``entries`` is at most 256."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part")
    order = (F.col(id).asc_nulls_last(), F.col(vec))
    first = df.where(usable(vec) & (F.size(vec) >= parts)).select(id, vec)
    smallest = first.orderBy(*order).limit(1).collect()
    if not smallest:
        return None
    dims = len(smallest[0][1])
    if dims % parts:
        raise ValueError(f"{dims} components are no {parts} equal parts")
    rows = kept(first, vec, dims).orderBy(*order).limit(entries).collect()
    points = integers(pa.array([r[1] for r in rows], pa.list_(pa.float64())), dims)
    books = Codebooks(np.ascontiguousarray(points.reshape(len(rows), parts, -1).transpose(1, 0, 2)))
    for _ in range(rounds):
        moved = books.entries.copy()
        for part, entry, n, *sums in _sums(kept(df, vec, dims), vec, books).collect():  # parts * entries rows at most
            moved[part, entry] = [s // n for s in sums]
        books = Codebooks(moved)
    return books


def encode(df: DataFrame, books: Codebooks, vec: str = "embedding", with_vector: bool = False) -> DataFrame:
    """The kept rows of ``df`` with ``code`` (hexadecimal) and ``error`` (squared distance in scaled units)."""
    shared = df.sparkSession.sparkContext.broadcast(books)
    rest = without(df, "code", "error") if vec.lower() not in ("code", "error") else df
    keep = [c for c in rest.columns if c != vec or with_vector]
    (column,) = unused(df.columns, "_vector")
    digits = np.array([f"{i:02x}" for i in range(256)])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            index, error = books.assign(integers(batch.column(0), books.dims))
            code = pa.array(["".join(row) for row in digits[index]], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], code, pa.array(error)], [*keep, "code", "error"])

    schema = T.StructType([*(rest.schema[c] for c in keep), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    rows = kept(rest, vec, books.dims).select(F.col(vec).alias(column), *(F.col(f"`{c}`") for c in keep))
    return map_in_arrow(rows, codes, schema, rows=4096)


def compress(df: DataFrame, id: str = "vec_id", vec: str = "embedding", label: str = "label", **fitting) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each kept vector; label_error sums over equal labels."""
    books = fit(df, id, vec, **fitting)
    if books is None:
        return df.where("false").select(id, *(F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    scratch = Scratch(df.sparkSession, "codes")
    rows = df.select(F.col(id).alias("_id"), F.col(vec).alias("_vec"), F.col(label).alias("_label"))
    coded = scratch.save(encode(rows, books, "_vec"))
    sums = scratch.save(coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error")))
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return coded.join(sums, F.col("_label").eqNullSafe(F.col("_of"))).select(
        F.col("_id").alias(id), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
