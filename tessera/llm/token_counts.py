"""Token counts by a two-tier lookup on the map side.

A text is cut into pre-tokens that the tokenizer never merges across, so the count of a text is the sum of
the counts of its pre-tokens. Tier one is a broadcast table of the corpus's frequent pre-tokens with their
token counts; tier two is a dictionary in each Python worker, which encodes what tier one lacks. No pre-token
is shuffled: each task sends only its own heavy hitters, at most ``PER_TASK`` of them, to build tier one.

The broadcast table has at most ``TABLE_ROWS`` entries of at most ``MAX_KEY`` characters, whatever the corpus.
Which pre-tokens it holds changes the speed and never a count.

Null texts count as empty (0 tokens); empty tables give empty results; repeated rows are kept as they are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import others, quoted
from tessera.shipping import map_in_arrow

TABLE_ROWS = 65_536
PER_TASK = 4_096
MAX_KEY = 32
COUNTER_ROWS = 200_000
CACHE_ROWS = 400_000
CACHE_KEY = 128
DEFAULT_MODEL = "piece_bpe_32k.model"

_RUNS = re.compile(" +[^ ]*")
_STATE: dict = {}


def model_path(name: str = DEFAULT_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_tokens(text: str) -> list[str]:
    """Arguments whose separate encodings make up the encoding of ``text``; '' stands for a lone space mark."""
    text = text.replace("▁", " ")
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return [run[1:] for run in _RUNS.findall(" " + text)]


def separable(processor) -> bool:
    """Whether no piece holds a space mark after another character and white space is kept as it is."""
    inner = re.compile("[^▁]▁")
    if any(inner.search(processor.id_to_piece(i)) for i in range(processor.get_piece_size())):
        return False
    probe = "  ﬁ A b  Ａ "
    return processor.decode(processor.encode(probe)) in (probe, probe[1:], " " + probe)


class _Lengths(dict):
    """Counts of pre-tokens: the broadcast ones, then those met by this worker."""

    def __init__(self, processor, frequent: dict):
        super().__init__(frequent)
        self.processor, self.frequent = processor, frequent
        lone = len(processor.encode("a ")) - len(processor.encode("a"))
        self.frequent[""] = self[""] = lone

    def __missing__(self, key: str) -> int:
        n = len(self.processor.encode(key))
        if len(key) <= CACHE_KEY:
            if len(self) >= CACHE_ROWS:
                self.clear()
                self.update(self.frequent)
            self[key] = n
        return n


class TokenCounter:
    """Counts tokens of texts in one Python worker."""

    def __init__(self, model: str, table: tuple[bytes, bytes] | None = None):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        self.whole = not separable(self.processor)
        self.lengths = _Lengths(self.processor, unpack(table) if table else {})

    @classmethod
    def of_worker(cls, model: str, table_id: int = -1, table=None) -> TokenCounter:
        key = (model, table_id)
        if key not in _STATE:
            _STATE.clear()
            _STATE[key] = cls(model, table.value if table is not None else None)
        return _STATE[key]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.whole:
            return len(self.processor.encode(text))
        return sum(map(self.lengths.__getitem__, pre_tokens(text)))


def pack(rows: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    """The table as one compressed run of keys and one array of 16-bit counts."""
    keys = zlib.compress(" ".join(k for k, _ in rows).encode())
    return keys, np.array([n for _, n in rows], dtype=np.uint16).tobytes()


def unpack(table: tuple[bytes, bytes]) -> dict[str, int]:
    keys = zlib.decompress(table[0]).decode()
    counts = np.frombuffer(table[1], dtype=np.uint16).tolist()
    return dict(zip(keys.split(" "), counts)) if counts else {}


def _trim(counts: Counter, most: int) -> Counter:
    return counts if len(counts) <= most else Counter(dict(counts.most_common(most)))


def frequent_pre_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """(key, n) of the corpus's frequent pre-tokens, from the heavy hitters of every task over all rows."""

    def hitters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                if t:
                    counts.update(pre_tokens(t))
            if len(counts) > COUNTER_ROWS:
                counts = _trim(counts, COUNTER_ROWS // 4)
        top = [(k, n) for k, n in counts.most_common(2 * PER_TASK) if 0 < len(k) <= MAX_KEY and " " not in k][:PER_TASK]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["key", "n"])

    parts = map_in_arrow(df.select(F.col(text)), hitters, "key string, n long")
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


def frequent_table(df: DataFrame, model: str, text: str = "text") -> tuple[bytes, bytes]:
    """Tier one, bounded by TABLE_ROWS rows of MAX_KEY characters."""
    keys = [r[0] for r in frequent_pre_tokens(df, text).orderBy(F.desc("n"), "key").limit(TABLE_ROWS).select("key").collect()]
    counter = TokenCounter(model)
    return pack([(k, counter.lengths[k]) for k in keys] if not counter.whole else [])


def count_tokens(df: DataFrame, text: str = "text", model: str | None = None, out: str = "n_tokens") -> DataFrame:
    """``df`` without its text, with ``out``: the tokens that the model gives each whole text.

    A column of ``df`` named like ``out``, in any case, is replaced.
    """
    model = model or model_path()
    table = df.sparkSession.sparkContext.broadcast(frequent_table(df, model, text))
    keep = others(df.columns, text, out)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType())])
    table_id = table._jbroadcast.id() if hasattr(table, "_jbroadcast") and table._jbroadcast else id(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter.of_worker(model, table_id, table)
        for batch in batches:
            n = pa.array([counter.count(t.as_py()) for t in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], n], [*keep, out])

    return map_in_arrow(df.select(text, *quoted(keep)), count, schema)
