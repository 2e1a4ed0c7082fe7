"""Event streams: windows, idempotency, rate limits and budgets; each as a stream and as its batch twin.

The transformations take a DataFrame that is a stream or a table, so one definition serves both. Streams start from
files (or any Spark source), keep their offsets in a checkpoint, and run to the end with ``availableNow``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import money
from tessera.shipping import map_in_arrow, ship


def read_events(spark: SparkSession, path: str, schema, kind: str = "parquet", **options) -> DataFrame:
    """A stream of the files in a folder. Survey: SRC23."""
    return spark.readStream.format(kind).schema(schema).options(**options).load(path)


def tumbling(events: DataFrame, size: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Count and sum of values in windows of ``size``; with ``late``, rows later than that are dropped. Survey: STR18."""
    df = events.withWatermark("ts", late) if late else events
    return df.groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", F.col("total").cast("double").alias("total"))


def sliding(events: DataFrame, size: str, step: str, keys: list[str], late: str | None = None) -> DataFrame:
    df = events.withWatermark("ts", late) if late else events
    return df.groupBy(F.window("ts", size, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Runs of a key's events with less than ``gap`` between them."""
    df = events.withWatermark("ts", late) if late else events
    return df.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once(events: DataFrame, key: str, memory: str | None = None) -> DataFrame:
    """The first event of each key: within the watermark on a stream, over all rows on a table. Survey: STR2, STR7."""
    if events.isStreaming:
        return events.withWatermark("ts", memory or "7 days").dropDuplicatesWithinWatermark([key])
    rank = F.row_number().over(W.partitionBy(key).orderBy("ts"))
    return events.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def in_turn(rows: DataFrame, key: str, inputs: list[str], added: dict[str, T.DataType], fresh: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple]]) -> DataFrame:
    """``rows`` with the columns ``added``, each key's rows replayed by ts and event_id with a carried state.

    ``step(state, values of inputs)`` gives the next state and the added values. Rows pass in batches, sorted within
    their partition, and only the current key's state is held, so a key may have any number of rows.
    """
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in added.items())])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for b in batches:
            out = []
            for k, *values in zip(b.column(key).to_pylist(), *(b.column(c).to_pylist() for c in inputs)):
                if k != now:
                    now, state = k, fresh()
                state, result = step(state, tuple(values))
                out.append(result)
            made = [pa.array([r[i] for r in out], kinds[i]) for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], schema.names)

    kinds = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[t.simpleString().replace("bigint", "long")] for t in added.values()]
    return map_in_arrow(rows.repartition(key).sortWithinPartitions(key, "ts", "event_id"), replay, schema)


def sliding_counter(events: DataFrame, key: str, limit: int) -> DataFrame:
    """Adds used and limited to every call: its number within its key's minute, plus the part of the minute before
    that still weighs, which is the part of this minute that is yet to come.

    Survey: STR9.
    """
    minute = F.floor(F.unix_micros("ts") / 60_000_000)
    left = 60_000_000 - F.pmod(F.unix_micros("ts"), F.lit(60_000_000))
    now = F.row_number().over(W.partitionBy(key, "_minute").orderBy("ts", "event_id"))
    before = F.count("*").over(W.partitionBy(key).orderBy("_minute").rangeBetween(-1, -1))
    used = now + F.expr("div(_before * _left, 60000000)")
    rows = events.withColumn("_minute", minute).withColumn("_before", before).withColumn("_left", left)
    return rows.withColumn("used", used.cast("long")).withColumn("limited", F.col("used") > limit).drop("_minute", "_before", "_left")


def monthly_allowance(events: DataFrame, key: str, allowance: int) -> DataFrame:
    """Adds free: whether a call is within its key's allowance of the calendar month. Survey: STR10."""
    month = F.date_trunc("month", "ts")
    rank = F.row_number().over(W.partitionBy(key, month).orderBy("ts", "event_id"))
    return events.withColumn("free", rank <= allowance)


def within_budget(events: DataFrame, key: str, cost: Column, cap: int) -> DataFrame:
    """Adds spent and accepted: a call is accepted if its cost still fits under the cap, else its claim is given back.

    A negative cost releases what was claimed before. ``spent`` is the total after the call.

    Survey: STR11.
    """

    def step(spent: int, values: tuple) -> tuple[int, tuple]:
        (micros,) = values
        accepted = micros <= 0 or spent + micros <= cap
        spent += micros if accepted else 0
        return spent, (spent, accepted)

    rows = events.withColumn("_cost", F.coalesce(cost, F.lit(0)).cast("long"))
    return in_turn(rows, key, ["_cost"], {"spent": T.LongType(), "accepted": T.BooleanType()}, lambda: 0, step).drop("_cost")


def host_slots(requests: DataFrame, host: str, cooldown: int) -> DataFrame:
    """Adds due_at: one request of each host at a time, ``cooldown`` seconds apart, none before it was made.

    due(i) = max(ts(i), due(i - 1) + cooldown) = max over j <= i of ts(j) + (i - j) * cooldown, a running maximum.

    Survey: STR6.
    """
    w = W.partitionBy(host).orderBy("ts", "event_id")
    at = F.row_number().over(w) - 1
    wait = F.lit(cooldown * 1_000_000).cast("long")
    base = F.unix_micros("ts") - at * wait
    rows = requests.withColumn("_at", at).withColumn("_base", base)
    due = F.max("_base").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("_at") * wait
    return rows.withColumn("due_at", F.timestamp_micros(due.cast("long"))).drop("_at", "_base")


BUCKET = "key string, event_id long, ts timestamp, tokens double, allowed boolean, wait_ms long"


def token_bucket(events: DataFrame, key: str, rate: float, burst: float) -> DataFrame:
    """(key, event_id, ts, tokens, allowed, wait_ms): a refilling bucket for each key, one token for each event.

    A key's state is its tokens and the time of its last event. On a stream, each trigger's rows of a key are replayed
    by time; on a table, rows pass in batches of sorted partitions.

    Survey: STR8.
    """

    def step(state: tuple, values: tuple) -> tuple[tuple, tuple]:
        (tokens, last), (now,) = state, values
        tokens = burst if last is None else min(burst, tokens + max(0, now - last) / 1_000_000 * rate)
        allowed = tokens >= 1
        tokens -= allowed
        return (tokens, now), (tokens, allowed, 0 if allowed else int((1 - tokens) / rate * 1000 + 0.5))

    def stateful(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (burst, None)
        frames = list(frames)
        if frames:
            rows = pd.concat(frames).sort_values(["ts", "event_id"], kind="stable")
            out = []
            for at in rows["us"]:
                now, result = step(now, (int(at),))
                out.append(result)
            state.update((float(now[0]), int(now[1])))
            made = pd.DataFrame(out, columns=["tokens", "allowed", "wait_ms"])
            yield pd.concat([pd.DataFrame({"key": str(k[0]), "event_id": rows["event_id"].to_numpy(), "ts": rows["ts"].to_numpy()}), made], axis=1)

    ship(events.sparkSession)
    slim = events.select(F.col(key).alias("_k"), "ts", "event_id", F.unix_micros("ts").alias("us"))
    if events.isStreaming:
        return slim.groupBy("_k").applyInPandasWithState(stateful, BUCKET, "tokens double, last long", "append", GroupStateTimeout.NoTimeout)
    out = in_turn(slim, "_k", ["us"], {"tokens": T.DoubleType(), "allowed": T.BooleanType(), "wait_ms": T.LongType()}, lambda: (burst, None), step)
    return out.select(F.col("_k").cast("string").alias("key"), "event_id", "ts", "tokens", "allowed", "wait_ms")


#: What went wrong, and whether trying again helps.
ERROR_CLASSES = {"transient": True, "rate_limited": True, "restricted": False, "invalid": False, "budget": False, "internal": False}


def routed(failures: DataFrame, most: int = 5) -> DataFrame:
    """Adds route: retry, paused or dead, by error class and attempts. Survey: STR4, STR5."""
    retryable = F.col("error_class").isin([k for k, v in ERROR_CLASSES.items() if v])
    return failures.withColumn("route", F.when(F.col("error_class") == "budget", "paused").when(retryable & (F.col("attempts") < most), "retry").otherwise("dead"))


def due_retries(failures: DataFrame, now: Column, base: float = 2.0, most: float = 300.0) -> DataFrame:
    """Failures to try again whose back-off has passed, with the time at which each fell due.

    Each trigger of a stream of failures, kept as a table, puts the due ones back on the job stream.

    Survey: STR3.
    """
    due = F.timestamp_micros((F.unix_micros("failed_at") + F.round(money.backoff_seconds(F.col("attempts"), base, most) * 1_000_000)).cast("long"))
    return routed(failures).where("route = 'retry'").withColumn("due_at", due).where(F.col("due_at") <= now)


def not_cancelled(tasks: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Tasks whose job was not cancelled; a stream's rows against a table. Survey: STR13."""
    return tasks.join(cancelled.select("job_id").distinct(), "job_id", "left_anti")


def latest_progress(progress: DataFrame) -> DataFrame:
    """The newest state of each job. Survey: STR14."""
    return progress.groupBy("job_id").agg(F.max_by(F.struct("stage", "percent"), "ts").alias("p"), F.max("ts").alias("ts")).select("job_id", "p.stage", "p.percent", "ts")


def fresh(cache: DataFrame, now: Column, ttl: str, version: int) -> DataFrame:
    """Cached answers that are young enough and of this version. Survey: STR12."""
    return cache.where((F.col("version") == version) & (F.col("stored_at") > now - F.expr(f"INTERVAL {ttl}")))


def drain(stream: DataFrame, checkpoint: str, sink, mode: str = "append"):
    """Runs a stream over everything there is now; ``sink(batch, id)`` must bear repeats of a batch. Survey: STR1."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
