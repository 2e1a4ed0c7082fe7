"""Variable-capacity best-fit packing of documents into training sequences.

Every text is counted in tokens; texts beyond the largest permitted length are cut between pre-tokens into pieces
that fit. A buffer of pieces is packed by best-fit decreasing: a piece goes into the open bin that it leaves the
fullest; if none has room, a bin of the permitted length with the least cost per token is opened, where the tokens
still to place limit what a large bin can hold. At last every bin shrinks to the smallest permitted length that
holds its contents. ``SEPARATOR`` tokens follow each piece.

The lengths are chosen together: a buffer is packed once for every run of neighbouring lengths that bins may open with
(a single one among them), and the packing of the least total cost is taken. A piece too long for the run opens the
least length that holds it.

Packing runs inside the partitions as they are read: nothing is shuffled, a buffer holds at most ``BUFFER_TOKENS``
tokens and one more document, and a lost task repeats its own bins. Only a partition's last buffer packs less than a
full one.

The pieces of a text, one after the other, are the text. Null and empty texts have no tokens: they get one row without
a bin. Repeated rows are packed again. Of pieces of equal length the first goes first; of equally cheap runs of
lengths the shorter one, then the one of smaller lengths, is taken. Rows of an empty table: none. Columns named like the results are replaced,
others stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import others, quoted
from tessera.llm.token_counts import TokenCounter, model_path, pre_tokens
from tessera.shipping import map_in_arrow

SIZES = (512, 1024, 2048, 4096, 8192)
SEPARATOR = 1
BUFFER_TOKENS = 2_000_000
PER_BIN = 64  # cost of a sequence besides its tokens, in tokens
ATTENTION = 16_384  # length at which attention costs as much as the rest


def cost(size: int) -> float:
    return PER_BIN + size + size * size / ATTENTION


@dataclass
class Bin:
    size: int
    used: int
    items: list[int]


def open_size(need: int, left: int, sizes: tuple[int, ...]) -> int:
    """The permitted length with the least cost for each token that it can come to hold."""
    return min((s for s in sizes if s >= need), key=lambda s: (cost(s) / min(s, left), s))


def _pack(lengths: list[int], order: list[int], opened: tuple[int, ...], sizes: tuple[int, ...]) -> list[Bin]:
    """Best fit in the given order; bins open with one of ``opened``, or the least of ``sizes`` where none is enough."""
    left = sum(lengths)
    bins: list[Bin] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if an open bin has r tokens of room
    for i in order:
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            bins.append(Bin(open_size(n, left, opened if opened[-1] >= n else (min(s for s in sizes if s >= n),)), 0, []))
            k, room = len(bins) - 1, bins[-1].size
        bins[k].items.append(i)
        bins[k].used += n
        left -= n
        if room > n:
            by_room.setdefault(room - n, []).append(k)
            rooms |= 1 << (room - n)
    for b in bins:
        b.size = min(s for s in sizes if s >= b.used)
    return bins


def total_cost(bins: list[Bin]) -> float:
    return sum(cost(b.size) for b in bins)


def best_fit(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> list[Bin]:
    """Bins of item numbers; no length may exceed the largest size. The cheapest packing over all runs of lengths."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    runs = [sizes[i : i + k] for k in range(1, len(sizes) + 1) for i in range(len(sizes) - k + 1)]
    return min((_pack(lengths, order, opened, sizes) for opened in runs), key=total_cost, default=[])


def pieces(text: str | None, counter: TokenCounter, most: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the cuts of a text, in code points; each begins where the one before ends."""
    if not text:
        return []
    step = max(1, (most - 1) // 4)  # a character takes at most four tokens
    by_length = lambda a, b: [(at, min(at + step, b), counter.count(text[at : min(at + step, b)])) for at in range(a, b, step)]
    if counter.whole:
        n = counter.count(text)
        return [(0, len(text), n)] if n <= most else by_length(0, len(text))
    parts = pre_tokens(text)
    counts = list(map(counter.lengths.__getitem__, parts))
    if sum(counts) <= most:
        return [(0, len(text), sum(counts))]
    cuts: list[tuple[int, int, int]] = []
    start = end = total = 0  # the piece that grows: where it starts and ends, and its tokens
    for k, (part, n) in enumerate(zip(parts, counts)):
        after = end + len(part) + (k > 0)
        if total and total + n > most:
            cuts.append((start, end, total))
            start, total = end, 0
        if not total:
            # a piece that begins within the text keeps the space before its first word
            n = counter.count(text[start:after])
        if n > most:
            cuts += by_length(start, after)
            start, total = after, 0
        else:
            total += n
        end = after
    if end > start:
        cuts.append((start, end, total))
    return cuts


def pack_documents(df: DataFrame, text: str = "text", sizes: tuple[int, ...] = SIZES, model: str | None = None, with_text: bool = True) -> DataFrame:
    """One row for each piece: the columns of ``df`` (text cut to the piece, or left out) and

    piece (number within its text), start, end (code points), n_tokens, bin_id, capacity (the bin's final length) and
    bin_offset (its first token's place in the bin). Columns of those names, in any case, are replaced.
    """
    model, sizes = model or model_path(), tuple(sorted(sizes))
    added = ["piece", "start", "end", "n_tokens", "bin_id", "capacity", "bin_offset"]
    keep = others(df.columns, text, *added)
    fields = [*(df.schema[c] for c in keep), *([df.schema[text]] if with_text else []), *(T.StructField(c, T.LongType()) for c in added)]
    schema = T.StructType(fields)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter.of_worker(model)
        context = TaskContext.get()
        next_bin = (context.partitionId() if context else 0) << 32
        held: list[tuple] = []  # rows' other columns, text, piece, start, end, tokens
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, next_bin
            packed = [i for i, h in enumerate(held) if h[5]]
            out = [(*held[i], None, None, None) for i, h in enumerate(held) if not h[5]]
            for b in best_fit([held[i][5] + SEPARATOR for i in packed], sizes):
                offset = 0
                for k in b.items:
                    out.append((*held[packed[k]], next_bin, b.size, offset))
                    offset += held[packed[k]][5] + SEPARATOR
                next_bin += 1
            columns = [pa.array([r[0][j] for r in out], arrow.field(j).type) for j in range(len(keep))]
            if with_text:
                columns.append(pa.array([r[1] for r in out], pa.string()))
            columns += [pa.array([r[j] for r in out], pa.int64()) for j in range(2, 9)]
            held, size = [], 0
            return pa.RecordBatch.from_arrays(columns, schema.names)

        arrow = None
        for batch in batches:
            arrow = batch.schema
            rest = list(zip(*(c.to_pylist() for c in batch.columns[:-1]))) if keep else [()] * batch.num_rows
            for row, t in zip(rest, batch.column(-1)):
                t = t.as_py()
                cuts = pieces(t, counter, sizes[-1] - SEPARATOR) or [(0, len(t or ""), 0)]
                for k, (a, b, n) in enumerate(cuts):
                    held.append((row, t[a:b] if with_text and t is not None else t, k, a, b, n))
                    size += n
                if size >= BUFFER_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return map_in_arrow(df.select(*quoted(keep), text), pack, schema)
