"""Claims, retries and allowances with keyed state: one fold for streams and for tables.

A fold is a function from a key's state and an event to the next state and what came of the event. On a table events are
replayed in the order of time (``events.in_turn``); on a stream ``transformWithState`` keeps the state of each key in the
state store, replays each trigger's rows of a key in the order of time, brings failures back by event-time timers when
their back-off is over, and forgets keys whose claims have run out. Late events are folded when they come, at their own
time. A key's state is a few numbers, whatever the number of its events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.shipping import ship
from tessera.streaming.events import in_turn

#: How long a claim holds without a sign of life, and how long a done job is remembered.
CLAIM_SECONDS = 600
DONE_SECONDS = 7 * 24 * 3600
MOST_ATTEMPTS = 5
BASE_SECONDS, MOST_SECONDS = 2.0, 300.0

#: owner: the message that holds the claim, or ``done``; until: when that runs out (microseconds); failures: so far.
CLAIM_STATE = "owner string, until long, failures int"
OUTCOMES = ["acquired", "busy", "done", "kept", "lost", "completed", "released", "dead"]


def backoff_micros(failures: int, base: float = BASE_SECONDS, most: float = MOST_SECONDS) -> int:
    """The wait after so many failures: doubled each time, to a bound."""
    return int(min(most, base * 2 ** min(62, max(0, failures - 1))) * 1_000_000)


def claim_step(state: tuple | None, event: tuple[int, str, str], claim_seconds: int = CLAIM_SECONDS) -> tuple[tuple | None, str, int | None]:
    """(next state, outcome, when to try again) of an event (time in microseconds, kind, message) of one job.

    deliver: acquired by the first message, and again by the message that holds it; busy for others while it holds; done
    after success. alive: keeps a claim that is the message's own. done: ends the job, whoever says so. failed: gives the
    claim back if it is the message's own, and comes back after a wait that doubles, until MOST_ATTEMPTS.
    """
    now, kind, message = event
    owner, until, failures = state if state is not None and now < state[1] else (None, 0, 0)
    if kind == "deliver":
        if owner is None or owner == message:
            return (message, now + claim_seconds * 1_000_000, failures), "acquired", None
        return (owner, until, failures), "done" if owner == "done" else "busy", None
    if kind == "alive":
        return (message, now + claim_seconds * 1_000_000, failures) if owner == message else state, "kept" if owner == message else "lost", None
    if kind == "done":
        return ("done", now + DONE_SECONDS * 1_000_000, 0), "completed", None
    if kind == "failed":
        if owner != message:
            return state, "lost", None
        failures += 1
        after = (None, now + DONE_SECONDS * 1_000_000, failures)
        return (after, "released", now + backoff_micros(failures)) if failures < MOST_ATTEMPTS else (after, "dead", None)
    return state, "lost", None


RESULT = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("message", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("due_at", T.TimestampType())]
)


def _processor(claim_seconds: int):
    """The processor of a stream; made where it is used, as tables need none of its parts."""
    from datetime import datetime, timedelta, timezone

    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    zero = datetime(1970, 1, 1, tzinfo=timezone.utc)
    at = lambda us: zero + timedelta(microseconds=us)

    class Claims(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.claim = handle.getValueState("claim", CLAIM_STATE)
            #: What comes back, by the millisecond in which it is due.
            self.waiting = handle.getMapState("waiting", "due long", "message string, due_us long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            state = tuple(self.claim.get()) if self.claim.exists() else None
            for row in sorted(rows, key=lambda r: (r["us"], r["event_id"])):
                state, outcome, due = claim_step(state, (row["us"], row["kind"], row["message"]), claim_seconds)
                if due is not None:
                    self._wait(due, row["message"])
                yield Row(key=str(key[0]), event_id=row["event_id"], ts=at(row["us"]), message=row["message"], outcome=outcome, due_at=None if due is None else at(due))
            if state is not None:
                self.claim.update(state)
                # once its time is over, the state says nothing
                self.handle.registerTimer(-(-state[1] // 1000))

        def _wait(self, due: int, message: str) -> None:
            ms = -(-due // 1000)
            while self.waiting.containsKey((ms,)):
                ms += 1
            self.waiting.updateValue((ms,), (message, due))
            self.handle.registerTimer(ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            ms = expiredTimerInfo.getExpiryTimeInMs()
            if self.waiting.containsKey((ms,)):
                message, due = self.waiting.getValue((ms,))
                self.waiting.removeKey((ms,))
                yield Row(key=str(key[0]), event_id=None, ts=at(due), message=message, outcome="retry", due_at=at(due))
            if self.claim.exists() and self.claim.get()[1] <= ms * 1000:
                self.claim.clear()

        def close(self) -> None:
            pass

    return Claims()


def claims(events: DataFrame, key: str, late: str = "10 minutes", claim_seconds: int = CLAIM_SECONDS, until: Column | None = None) -> DataFrame:
    """(key, event_id, ts, message, outcome, due_at) of events (ts, event_id, kind, message): what each one found.

    A failure that is to be tried again comes back as a row with outcome retry, without event_id, when its wait is over: on
    a stream when the watermark has passed it, on a table for those due before ``until``. Streams need the RocksDB state
    store. Survey: STR2, STR3.
    """
    slim = events.select(F.col(key).alias("_k"), "ts", "event_id", "kind", "message", F.unix_micros("ts").alias("us"))
    if events.isStreaming:
        ship(events.sparkSession)
        timed = slim.withWatermark("ts", late).groupBy("_k")
        return timed.transformWithState(_processor(claim_seconds), RESULT, "Append", "EventTime")

    def step(state, values):
        state, outcome, due = claim_step(state, values, claim_seconds)
        return state, (outcome, due)

    told = in_turn(slim, "_k", ["us", "kind", "message"], {"outcome": T.StringType(), "due": T.LongType()}, lambda: None, step)
    due = F.timestamp_micros("due")
    rows = told.select(F.col("_k").cast("string").alias("key"), "event_id", "ts", "message", "outcome", due.alias("due_at"))
    if until is None:
        return rows
    again = rows.where(F.col("due_at").isNotNull() & (F.col("due_at") <= until))
    return rows.unionByName(again.select("key", F.lit(None).cast("long").alias("event_id"), F.col("due_at").alias("ts"), "message", F.lit("retry").alias("outcome"), "due_at"))


# ------------------------------------------------------------------------------------------------------------------


def allowance_step(state: tuple | None, event: tuple[int, int], limit: int) -> tuple[tuple, tuple]:
    """(month and calls used, (used, allowed)) after an event (month, calls): reserved if positive, given back if negative."""
    month, calls = event
    used = state[1] if state is not None and state[0] == month else 0
    if calls <= 0:
        used = max(0, used + calls)
        return (month, used), (used, True)
    allowed = used + calls <= limit
    used += calls if allowed else 0
    return (month, used), (used, allowed)


def reserved(events: DataFrame, key: str, calls: Column, limit: int, headroom: int = 0) -> DataFrame:
    """``events`` (ts, event_id, ...) with used and allowed: calls claimed from, and given back to, a month's allowance.

    A claim that does not fit is refused as a whole and changes nothing; giving back never goes below zero; a new calendar
    month starts anew. Survey: STR10.
    """
    month = (F.year("ts") * 12 + F.month("ts")).cast("long")
    rows = events.withColumn("_month", month).withColumn("_calls", F.coalesce(calls, F.lit(0)).cast("long"))
    most = max(0, limit - headroom)
    step: Callable = lambda state, values: allowance_step(state, values, most)
    return in_turn(rows, key, ["_month", "_calls"], {"used": T.LongType(), "allowed": T.BooleanType()}, lambda: None, step).drop("_month", "_calls")
