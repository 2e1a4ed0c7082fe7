"""Importance resampling towards a target distribution, drawn by sorted runs and tournament merges.

``bucket_counts`` hashes the words (or word runs) of all texts of a table into a fixed number of buckets; ``gains`` turns
the counts of corpus and target into one integer for each bucket, so a document's weight is an array lookup and a sum.
``draw`` adds Gumbel noise that depends on the seed and the id alone and takes the highest scores, without replacement:

* tasks sort their rows into runs of RUN_ROWS and write these as blocks of BLOCK_ROWS to the shared folder;
* keys at regular places of all runs give borders that cut the order of all rows into ranges of about RANGE_ROWS rows;
  ties go by id, then by the row's place in the runs, so the borders also cut a group of equal rows;
* each range that holds a drawn row is merged in a task of its own: its blocks arrive by their first keys (Spark sorts
  and spills them), a block enters the tournament tree when the order has come to it, and memory holds only blocks that
  overlap there. Ranks start after the rows of the ranges before, which are counted; the merge stops at the last drawn
  row. Ranges beyond that, and rows that may not be drawn, pass by without a shuffle.

To the driver come the bucket counts, at most SAMPLES keys and one a run, and one count for each range.

Null texts count as empty: no features, weight 0. A null id takes part with the noise of the empty text and comes after
equal scores; ids are integers. Rows of one id are ranked each. Empty tables give empty results; without a target, or
without a corpus, gains follow from the counts that there are. Only id and text are read, so other columns, whatever their
names, change nothing. Texts are worked on whole, at their own size.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark import TaskContext

from tessera.llm.common import Scratch
from tessera.shipping import map_in_arrow

BUCKETS = 10_000
NGRAMS = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
RUN_ROWS = 262_144
BLOCK_ROWS = 2_048
RANGE_ROWS = 100_000
SAMPLES = 50_000
CACHE_WORDS = 400_000

#: Letters and digits of ASCII and all bytes beyond it stand for themselves, A-Z for a-z, others for a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Features(dict):
    """Buckets of features, kept by the worker for words that come again."""

    def __init__(self, buckets: int, ngrams: int):
        super().__init__()
        self.buckets, self.ngrams = buckets, ngrams

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(feature) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[feature] = bucket
        return bucket

    def of(self, text: bytes | None) -> tuple[np.ndarray, int]:
        """The buckets of a text's features, repeats included, and its number of words."""
        words = text.translate(FOLD).split() if text else []
        found = list(map(self.__getitem__, words))
        for n in range(2, self.ngrams + 1):
            found += [self[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
        return np.array(found, dtype=np.int64), len(words)


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, ngrams: int = NGRAMS) -> np.ndarray:
    """How many features of all texts fall into each bucket; each task sends at most one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets, ngrams), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                found, _ = features.of(t.as_py())
                total += np.bincount(found, minlength=buckets)
        (some,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    each = map_in_arrow(df.select(F.col(text).cast("binary")), count, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target against its share of the corpus."""
    size = len(corpus)
    all_corpus, all_target = int(corpus.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (all_corpus + size) / ((s + 1) * (all_target + size)))) for s, t in zip(corpus.tolist(), target.tolist())],
        dtype=np.int64,
    )


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths that depends on seed and id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


# ------------------------------------------------------------------------------------------------------------------
# Keys are tuples that sort as rows are ranked: higher scores first, then smaller ids, null ids last, then the place.

_ROW = ["doc_id", "n_features", "n_words", "weight", "score", "place"]
_BLOCK = "eligible boolean, run long, n int, " + ", ".join(f"{c} array<long>" for c in _ROW)


def _keys(block: dict) -> list[tuple]:
    ids = block["doc_id"]
    return [(-s, i is None, 0 if i is None else i, p) for s, i, p in zip(block["score"], ids, block["place"])]


def _cut(rows: dict, at: int, to: int) -> dict:
    return {c: rows[c][at:to] for c in _ROW}


def _arrow(blocks: list[dict], more: dict[str, list]) -> pa.RecordBatch:
    columns = {**more, **{c: pa.array([b[c] for b in blocks], pa.list_(pa.int64())) for c in _ROW}}
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], list(columns))


def sorted_runs(docs: DataFrame, weights: np.ndarray, id: str, text: str, ngrams: int, seed: int, min_words: int) -> DataFrame:
    """Blocks of sorted runs of all rows; rows with fewer words than ``min_words`` stand in runs that are not eligible."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        features, task = Features(len(weights), ngrams), TaskContext.get().partitionId() << 40
        place = run = 0
        held: dict[bool, list[tuple]] = {True: [], False: []}

        def blocks(eligible: bool) -> Iterator[pa.RecordBatch]:
            nonlocal run
            rows, held[eligible] = held[eligible], []
            rows.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[5]))
            columns = dict(zip(_ROW, map(list, zip(*rows))))
            for at in range(0, len(rows), BLOCK_ROWS):
                part = _cut(columns, at, at + BLOCK_ROWS)
                yield _arrow([part], {"eligible": [eligible], "run": pa.array([task + run], pa.int64()), "n": pa.array([len(part["place"])], pa.int32())})
            run += 1

        for batch in batches:
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, n_words = features.of(t.as_py())
                weight = int(weights[found].sum())
                eligible = n_words >= min_words
                held[eligible].append((doc_id, len(found), n_words, weight, weight + noise(doc_id, seed), task + place))
                place += 1
                if len(held[eligible]) >= RUN_ROWS:
                    yield from blocks(eligible)
        for eligible in (True, False):
            if held[eligible]:
                yield from blocks(eligible)

    rows = docs.select(F.col(id).cast("long"), F.col(text).cast("binary"))
    return map_in_arrow(rows, runs, _BLOCK)


def borders(blocks: DataFrame, rows: int, range_rows: int = RANGE_ROWS) -> list[tuple]:
    """Keys that cut all eligible rows into ranges of about ``range_rows``: every so many rows of a run give one sample."""
    wanted = -(-rows // range_rows) - 1
    if wanted < 1:
        return []
    step = max(1, rows // SAMPLES)

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                keys = _keys(block)[zlib.crc32(str(block["place"][0]).encode()) % step :: step]
                yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.bool_() if i == 1 else pa.int64()) for i in range(4)], list("abcd"))

    found = sorted(map(tuple, map_in_arrow(blocks, samples, "a long, b boolean, c long, d long", rows=32).collect()))
    return sorted({found[(i + 1) * len(found) // (wanted + 1)] for i in range(wanted)}) if found else []


def _in_ranges(blocks: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Blocks cut at the borders: (range, first key, n, rows)."""
    shared = blocks.sparkSession.sparkContext.broadcast(cuts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for batch in batches:
            for block in batch.to_pylist():
                keys = _keys(block)
                at, low = 0, bisect_left(cuts, keys[0]) if keys[0] not in cuts else cuts.index(keys[0]) + 1
                while at < len(keys):
                    to = bisect_left(keys, cuts[low], at) if low < len(cuts) else len(keys)
                    if to > at:
                        part = _cut(block, at, to)
                        first = keys[at]
                        more = {"range": pa.array([low], pa.int32()), "n": pa.array([to - at], pa.int32())}
                        more |= {c: pa.array([x], pa.bool_() if c == "k1" else pa.int64()) for c, x in zip(("k0", "k1", "k2", "k3"), first)}
                        yield _arrow([part], more)
                    at, low = to, low + 1

    schema = "range int, n int, k0 long, k1 boolean, k2 long, k3 long, " + ", ".join(f"{c} array<long>" for c in _ROW)
    return map_in_arrow(blocks, cut, schema, rows=32)


@dataclass
class Block:
    """A sorted block on its way through the tournament."""

    keys: list[tuple]
    rows: dict
    at: int = 0


class Tournament:
    """A binary tree whose leaves are open blocks; each inner node knows which block below it has the first key."""

    def __init__(self):
        self.size = 1
        self.leaves: list[Block | None] = [None]
        self.nodes = [0, 0]
        self.free = [0]
        self.count = 0

    def _head(self, leaf: int):
        block = self.leaves[leaf]
        return None if block is None else block.keys[block.at]

    def _better(self, a: int, b: int) -> int:
        x, y = self._head(a), self._head(b)
        return a if y is None or (x is not None and x <= y) else b

    def _replay(self, leaf: int) -> None:
        node = (leaf + self.size) // 2
        while node:
            self.nodes[node] = self._better(self._winner(2 * node), self._winner(2 * node + 1))
            node //= 2

    def _winner(self, node: int) -> int:
        return node - self.size if node >= self.size else self.nodes[node]

    def add(self, block: Block) -> None:
        if not self.free:
            self.free = list(range(2 * self.size - 1, self.size - 1, -1))
            self.leaves += [None] * self.size
            self.size *= 2
            self.nodes = [0] * self.size
            for node in range(self.size - 1, 0, -1):
                self.nodes[node] = self._better(self._winner(2 * node), self._winner(2 * node + 1))
        leaf = self.free.pop()
        self.leaves[leaf] = block
        self.count += 1
        self._replay(leaf)

    def first(self) -> int:
        return self._winner(1)

    def head(self):
        """The first key of all open blocks, or None."""
        return self._head(self.first())

    def runner_up(self):
        """The first key of the open blocks other than the winner's: the best of those that lost against it."""
        best, node = None, self.first() + self.size
        while node > 1:
            other = self._head(self._winner(node ^ 1))
            if other is not None and (best is None or other < best):
                best = other
            node //= 2
        return best

    def take(self, below, most: int) -> tuple[Block, int, int]:
        """The winner's next rows: those before ``below`` and before all other blocks, ``most`` at most."""
        leaf = self.first()
        block, start = self.leaves[leaf], self.leaves[leaf].at
        other = self.runner_up()
        stop = min((k for k in (below, other) if k is not None), default=None)
        to = len(block.keys) if stop is None else max(start + 1, bisect_left(block.keys, stop, start))
        block.at = to = min(to, start + most)
        if block.at == len(block.keys):
            self.leaves[leaf] = None
            self.free.append(leaf)
            self.count -= 1
        self._replay(leaf)
        return block, start, to


def merge(blocks: Iterator[Block], most: int) -> Iterator[tuple[dict, int | None]]:
    """Rows of blocks that come by their first keys, in order, each stretch with the place of its first row.

    After ``most`` rows the order no longer matters: what is left comes with None.
    """
    tree, done = Tournament(), 0
    pending = next(blocks, None)
    while pending is not None or tree.count:
        while pending is not None and done < most and (not tree.count or pending.keys[0] <= tree.head()):
            tree.add(pending)
            pending = next(blocks, None)
        if done >= most:
            for block in (*(b for b in tree.leaves if b is not None), *([pending] if pending else []), *blocks):
                yield _cut(block.rows, block.at, len(block.keys)), None
            return
        block, start, to = tree.take(pending.keys[0] if pending is not None else None, most - done)
        yield _cut(block.rows, start, to), done
        done += to - start


_RANKED = "doc_id long, n_features long, n_words long, weight long, score long, rank long"


def _ranked(rows: dict, first: int | None) -> pa.RecordBatch:
    n = len(rows["place"])
    rank = pa.nulls(n, pa.int64()) if first is None else pa.array(range(first, first + n), pa.int64())
    return pa.RecordBatch.from_arrays([*(pa.array(rows[c], pa.int64()) for c in _ROW[:5]), rank], [*_ROW[:5], "rank"])


def _unranked(blocks: DataFrame) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                yield _ranked(block, None)

    return map_in_arrow(blocks, spread, _RANKED, rows=32)


def draw(blocks: DataFrame, percent: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All rows of ``sorted_runs`` with ``rank``: 1, 2, 3 ... for the drawn ones, else null."""
    eligible = blocks.where("eligible")
    rows = eligible.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = percent * rows // 100
    cuts = borders(eligible, rows, range_rows)
    sizes = dict(_in_ranges(eligible, cuts).groupBy("range").agg(F.sum("n")).collect())
    before, at = {}, 0
    for k in sorted(sizes):
        before[k], at = at, at + sizes[k]
    last = max((k for k in before if before[k] < wanted), default=-1)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for k, group in groupby(rows, key=lambda r: r["range"]):
            for part, first in merge((Block(_keys(b), b) for b in group), wanted - before[k]):
                yield _ranked(part, None if first is None else before[k] + first + 1)

    ranged = _in_ranges(eligible, cuts)
    drawn = ranged.where(F.col("range") <= last).repartition("range").sortWithinPartitions("range", "k0", "k1", "k2", "k3")
    return map_in_arrow(drawn, in_order, _RANKED, rows=32).union(_unranked(ranged.where(F.col("range") > last))).union(_unranked(blocks.where("NOT eligible")))


def resample(
    docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT,
    min_words: int = MIN_WORDS, buckets: int = BUCKETS, ngrams: int = NGRAMS, seed: int = SEED, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank) of each row; ``percent`` of those with ``min_words`` words get a rank.

    The result reads a table in the shared folder.
    """
    weights = gains(bucket_counts(docs, text, buckets, ngrams), bucket_counts(target, target_text, buckets, ngrams))
    blocks = Scratch(docs.sparkSession, "runs").save(sorted_runs(docs, weights, id, text, ngrams, seed, min_words))
    return draw(blocks, percent, range_rows)
