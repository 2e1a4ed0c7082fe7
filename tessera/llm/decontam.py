"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared as lower-cased words joined by single spaces. A document holds an item if some region of it is
within k edits of the whole item, k being ``MAX_EDITS`` of the item's length (less for very short ones). Such a
region shares at least L + 1 - Q - k * Q of the item's character q-grams, all on diagonals (place in the text less
place in the item) that lie within k of each other. So the shared q-grams of an item are counted in overlapping
bands of diagonals, k + 1 wide and overlapping by half, bands that meet the bound are kept, and a banded alignment
verifies each. Items that share text meet the bound together wherever it stands, so alignments first run for many bands
at once, from that end of each item whose q-grams fewer items share, and a band goes as soon as all its cells are beyond
k edits; the few that are left are aligned one by one. Texts with very many shared q-grams are searched by stretches.

Items of fewer than ``SHORT`` characters allow no edits and are found where their words stand as whole words. Items
of more than ``LONG`` characters are cut into equal parts of at most that length, and a document holds the item if it
holds a part: a region within the share of edits of the whole has a part within it too. Items without any word are
held by nothing.

The item index goes to the executors in blocks of at most ``BLOCK_CHARS`` characters. A larger benchmark takes one
pass over the documents for each block, one after the other, so no task ever holds two blocks; what each pass finds is
kept in scratch tables. Documents are never shuffled; long texts are searched in overlapping pieces.

Null and empty texts hold nothing. Items without an id are searched for like others. Of items with equal id and text
one counts; of regions with equally few edits one is reported. Repeated rows are each searched. Empty tables give
empty results; other columns stay, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, unused
from tessera.shipping import map_in_arrow

Q = 10
MAX_EDITS = 0.08
SHORT = 24
LONG = 4_000
BLOCK_CHARS = 2_000_000
PIECE = 1_000_000
SLOTS = 1 << 20
HITS = 2_000_000  # shared q-grams that are spread out at once
CELLS = 500_000  # cells of alignments that run at once
FEW = 8  # bands that are aligned one by one at once

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join(_WORD.findall(text.lower())) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """A hash of the Q characters from each place on (fewer places than characters)."""
    if len(c) < Q:
        return np.zeros(0, np.uint64)
    out, done, step, part, power = None, 0, 1, c.astype(np.uint64) + np.uint64(1), _BASE
    rest = Q
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                tail = part[done : done + len(c) - Q + 1]
                out = tail.copy() if out is None else out * power + tail
                done += step
            rest >>= 1
            if rest:
                part = part[:-step] * power + part[step:]
                step, power = 2 * step, power * power
    return out


def edits_allowed(length: int) -> int:
    return max(0, min(int(MAX_EDITS * length), (length - Q) // Q))


def alignment(item: np.ndarray, text: np.ndarray, k: int, low: int, high: int) -> tuple[int, int] | None:
    """(edits, end) of the best place of the whole item in text along diagonals low..high; None beyond k edits."""
    width = high - low + 1
    at = np.arange(width)
    row = np.where((at + low >= 0) & (at + low <= len(text)), 0, k + 1)  # free start: no edits before the first character
    padded = np.full(len(item) + len(text) + 2 * width + 2, -1, np.int64)
    shift = width + len(item)
    padded[shift : shift + len(text)] = text
    for i, ch in enumerate(item):
        first = i + low  # column of the band's first cell before this row
        window = padded[shift + first : shift + first + width]
        new = row + (window != ch)  # same diagonal
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # the item's character left out
        new = np.minimum.accumulate(new - at) + at  # characters of the text left out
        columns = at + first + 1
        new[(columns < 0) | (columns > len(text))] = k + 1
        if new.min() > k:
            return None
        row = new
    best = int(row.argmin())
    return (int(row[best]), len(item) + low + best) if row[best] <= k else None


def may_align(items: np.ndarray, lengths: np.ndarray, text: np.ndarray, k: int, low: np.ndarray, width: int) -> np.ndarray:
    """Which of many items, row by row in ``items``, can lie within k edits along their ``width`` diagonals from ``low``.

    Cells beyond the text's ends cost as much as leaving characters out, so no place that ``alignment`` finds is refused.
    """
    longest = items.shape[1]
    pad = longest + width + 1
    padded = np.concatenate([np.full(pad, -1, np.int32), text.astype(np.int32), np.full(pad, -1, np.int32)])
    cell = np.arange(width, dtype=np.int16)
    alive, may = np.arange(len(items)), np.ones(len(items), bool)
    at = np.clip(low, -pad + 1, len(text)) + pad
    row = np.zeros((len(items), width), np.int16)
    for i in range(longest):
        inside = i < lengths[alive]
        if not inside.any():
            break
        window = padded[np.minimum(at[alive, None] + (i + cell)[None, :], len(padded) - 1)]
        new = row + (window != items[alive, i, None])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        new = np.minimum.accumulate(new - cell, axis=1) + cell
        row = np.where(inside[:, None], new, row).astype(np.int16)
        if i % 4 == 3 or i == longest - 1:
            good = row.min(1) <= k
            may[alive[~good]] = False
            alive, row = alive[good], row[good]
            if not len(alive):
                break
    return may


def parts(text: str) -> list[str]:
    """A normal text as one part, or in equal parts of at most LONG characters."""
    n = -(-len(text) // LONG) or 1
    return [text[len(text) * i // n : len(text) * (i + 1) // n] for i in range(n)]


class Index:
    """The q-grams of a block of items, and the words of the short ones."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [(i, normal(t)) for i, t in items]
        self.names: list[tuple[int | None, int]] = [(i, len(t)) for i, t in texts]  # id and length of each item
        self.short: dict[str, list[tuple[list[str], int]]] = {}
        for at, (_, t) in enumerate(texts):
            if 0 < len(t) < SHORT:
                self.short.setdefault(t.split(" ", 1)[0], []).append((t.split(" "), at))
        known = [(at, codes(p)) for at, (_, t) in enumerate(texts) if len(t) >= SHORT for p in parts(t)]
        self.ids, self.items = [at for at, _ in known], [c.astype(np.int64) for _, c in known]
        lengths = np.array([len(c) for _, c in known], np.int64)
        self.lengths = lengths
        self.k = np.array([edits_allowed(n) for n in lengths], np.int64)
        self.bound = np.maximum(1, lengths + 1 - Q - self.k * Q)
        self.reach = int((lengths + 2 * self.k).max()) + Q if known else Q
        grams = [gram_hashes(c) for _, c in known]
        item = np.repeat(np.arange(len(known)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams] + [np.zeros(0, np.int64)])
        grams = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(grams, kind="stable")
        self.grams, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        # whether an item's last half is the one that tells it from others
        shared = np.zeros(len(grams))
        shared[order] = np.repeat(np.log(self.count), self.count) if len(grams) else shared
        late = 2 * place >= np.maximum(1, lengths - Q + 1)[item] if len(grams) else np.zeros(0, bool)
        mean = lambda of: np.bincount(item[of], shared[of], len(known)) / np.maximum(1, np.bincount(item[of], minlength=len(known)))
        self.backwards = mean(late) <= mean(~late) if len(grams) else np.zeros(len(known), bool)
        self.slots = np.zeros(SLOTS, bool)
        self.slots[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def short_places(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of the first place of each short item in a normal text, on word borders."""
        words, at, seen = text.split(" "), 0, set()
        for i, w in enumerate(words):
            for item, number in self.short.get(w, ()):
                if number not in seen and words[i : i + len(item)] == item:
                    seen.add(number)
                    yield number, at, at + sum(map(len, item)) + len(item) - 1
            at += len(w) + 1

    def shared(self, c: np.ndarray) -> np.ndarray:
        """How many q-grams of items each place of a text shares."""
        h = gram_hashes(c)
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.slots[(h >> np.uint64(44)).astype(np.int64)])
        if len(maybe) and len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, h[maybe]), len(self.grams) - 1)
            same = self.grams[at] == h[maybe]
            out[maybe[same]] = self.count[at[same]]
        return out

    def stretches(self, c: np.ndarray) -> list[tuple[int, int]]:
        """A text in overlapping stretches of about HITS shared q-grams; each region lies whole in one of them."""
        total = np.cumsum(self.shared(c))
        out, at = [], 0
        while at < len(c):
            before = total[at - 1] if at else 0
            end = max(int(np.searchsorted(total, before + HITS)) + Q, at + 3 * self.reach)
            if end >= len(total):
                return [*out, (at, len(c))]
            out.append((at, end))
            at = end - self.reach
        return out

    def candidates(self, c: np.ndarray, k: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Which of the bands ``band`` of the items ``k`` can hold their item, by alignments of many at once."""
        may = np.ones(len(k), bool)
        edits, lengths = self.k[k], self.lengths[k]
        low, width = band * (edits + 1) - edits, 4 * edits + 2
        back, turned = self.backwards[k], c[::-1]
        order = np.lexsort((lengths, edits, back))
        for group in np.split(order, np.flatnonzero(np.diff(2 * edits[order] + back[order])) + 1):
            e, b, w = int(edits[group[0]]), bool(back[group[0]]), int(width[group[0]])
            for at in range(0, len(group), max(1, CELLS // w)):
                some = group[at : at + max(1, CELLS // w)]
                chars = np.full((len(some), int(lengths[some].max())), -2, np.int32)
                for i, item in enumerate(k[some].tolist()):
                    chars[i, : lengths[some[i]]] = self.items[item][::-1] if b else self.items[item]
                start = len(c) - lengths[some] - (low[some] + w - 1) if b else low[some]
                may[some] = may_align(chars, lengths[some], turned if b else c, e, start, w)
        return may

    def hits(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in text, item, place in item) of every shared q-gram."""
        h = gram_hashes(c)
        maybe = np.flatnonzero(self.slots[(h >> np.uint64(44)).astype(np.int64)])
        if not len(maybe) or not len(self.grams):
            return (np.zeros(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.grams, h[maybe]), len(self.grams) - 1)
        same = self.grams[at] == h[maybe]
        maybe, at = maybe[same], at[same]
        n = self.count[at]
        rows = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
        return np.repeat(maybe, n), self.item[rows].astype(np.int64), self.place[rows].astype(np.int64)

    def search(self, c: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(part number, edits, start, end) of the regions of one text that hold a part of an item; start is about right."""
        for at, to in self.stretches(c):
            for k, edits, start, end in self._search(c[at:to]):
                yield k, edits, start + at, end + at

    def _search(self, c: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        p, item, r = self.hits(c)
        if not len(p):
            return
        enough = np.bincount(item, minlength=len(self.ids)) >= self.bound
        keep = enough[item]
        if not keep.any():
            return
        p, item, r = p[keep], item[keep], r[keep]
        width = self.k[item] + 1
        band = (p - r) // width
        lowest = band.min() - 1
        span = int(band.max() - lowest + 1)
        keys, counts = np.unique(np.concatenate([item * span + band - lowest, item * span + band - 1 - lowest]), return_counts=True)
        done: dict[int, tuple[int, int, int]] = {}
        keys = keys[counts >= self.bound[keys // span]]
        if len(keys) > FEW:
            keys = keys[self.candidates(c, keys // span, keys % span + lowest)]
        for key in keys:
            k, b = int(key // span), int(key % span + lowest)
            w, edits = int(self.k[k]) + 1, int(self.k[k])
            if k in done and done[k][0] == 0:
                continue
            low, high = b * w - edits, (b + 2) * w - 1 + edits
            start, end = max(0, low - 1), min(len(c), high + int(self.lengths[k]) + 1)
            found = alignment(self.items[k], c[start:end].astype(np.int64), edits, low - start, high - start)
            if found and (k not in done or found[0] < done[k][0]):
                done[k] = (found[0], max(0, start + found[1] - int(self.lengths[k])), start + found[1])
        for k, (edits, start, end) in done.items():
            yield k, edits, start, end

    def search_all(self, texts: list[str | None]) -> list[dict[int, tuple[int, int, int]]]:
        """Per text: item number to (edits, start, end). Short texts are searched together first."""
        out: list[dict] = [{} for _ in texts]
        group: list[tuple[int, np.ndarray]] = []
        size = 0

        def note(i: int, part: int, edits: int, start: int, end: int) -> None:
            number = self.ids[part]
            if number not in out[i] or edits < out[i][number][0]:
                out[i][number] = (edits, start, end)

        def flush() -> None:
            nonlocal group, size
            if not group:
                return
            gap = np.zeros(1, np.uint32)
            joined = np.concatenate([x for _, c in group for x in (c, gap)])
            starts = np.cumsum([0] + [len(c) + 1 for _, c in group])
            if self.shared(joined).sum() > HITS:
                for i, c in group:
                    for found in self.search(c):
                        note(i, *found)
                group, size = [], 0
                return
            p, item, _ = self.hits(joined)
            owner = np.searchsorted(starts, p, side="right") - 1
            pairs, n = np.unique(owner * max(1, len(self.ids)) + item, return_counts=True)
            for g in np.unique(pairs[n >= self.bound[pairs % max(1, len(self.ids))]] // max(1, len(self.ids))) if len(pairs) else ():
                i, c = group[g]
                for found in self.search(c):
                    note(i, *found)
            group, size = [], 0

        for i, t in enumerate(texts):
            t = normal(t)
            if self.short and t:
                for number, start, end in self.short_places(t):
                    out[i][number] = (0, start, end)
            c = codes(t)
            if len(c) < Q or not self.ids:
                continue
            if len(c) > PIECE:
                for at in range(0, len(c), PIECE):
                    for k, edits, start, end in self.search(c[at : at + PIECE + self.reach]):
                        note(i, k, edits, start + at, end + at)
                continue
            if size + len(c) > PIECE:
                flush()
            group.append((i, c))
            size += len(c) + 1
        flush()
        return out


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of about BLOCK_CHARS characters; an item that is longer is a block of its own."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = math.ceil(chars / (BLOCK_CHARS / 2)) if chars > BLOCK_CHARS else 1
    for i in range(n):
        rows = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        block, size = [], 0
        for item_id, text in rows.toLocalIterator():
            if block and size + len(text) > BLOCK_CHARS:
                yield block
                block, size = [], 0
            block.append((item_id, text))
            size += len(text)
        if block or n == 1:
            yield block


def _search(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """The items of one block found in rows (doc_id, text): see ``find_leaks``; with the broadcast as ``_shared``."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(items))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("item_id", "item_chars", "edits", "start", "end", "text_key"))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found = index.search_all(batch.column(0).to_pylist())
            rows = [(i, *index.names[k], *spot) for i, hits in enumerate(found) for k, spot in sorted(hits.items())]
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [pa.array([None if r[j] is None else int(r[j]) for r in rows], pa.int64()) for j in range(1, 6)]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(at), *columns, batch.column(2).take(at)], schema.names)

    out = map_in_arrow(docs.select("text", "doc_id", F.xxhash64("text").alias("text_key")), search, schema)
    out._shared = shared
    return out


def _all_found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What ``find_leaks`` gives, with text_key: one pass for each block, kept in scratch tables if there are several."""
    found: list[DataFrame] = []
    scratch = None
    ahead = blocks(benchmark)
    block = next(ahead, [])
    while block is not None:
        after = next(ahead, None)
        part = _search(docs, block)
        if after is not None or found:
            scratch = scratch or Scratch(docs.sparkSession, "leaks")
            shared = part._shared
            part = scratch.save(part)
            shared.destroy()
        found.append(part)
        block = after
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_chars, edits, start, end): items found in each row, places in its normal form."""
    return _all_found(docs, benchmark).drop("text_key")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are."""
    ahead = blocks(benchmark)
    items = next(ahead, [])
    if next(ahead, None) is None:
        shared = docs.sparkSession.sparkContext.broadcast(Index(items))

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shared.value.search_all(batch.column("text").to_pylist())
                yield batch.filter(pa.array([not hits for hits in found], pa.bool_()))

        return map_in_arrow(docs, clean, docs.schema)
    # several blocks: rows go by id and text, as equal texts hold the same
    row, key = unused(docs.columns, "_leak_id", "_leak_key")
    leaks = _all_found(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias(row), F.col("text_key").alias(key)).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(F.col(row)) & (F.xxhash64(docs["text"]) == F.col(key)), "left_anti")
