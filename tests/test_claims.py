"""Claims, retries and allowances: the fold by hand, tables, and real streams with late and repeated events."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.queries.claims import ROCKS
from tessera.streaming import claims as C
from tessera.streaming import events as S

S_ = 1_000_000


def fold(events, seconds=600):
    state, out = None, []
    for e in events:
        state, outcome, due = C.claim_step(state, e, seconds)
        out.append((outcome, due))
    return out


def test_one_worker_at_a_time():
    got = fold([(0, "deliver", "a"), (1 * S_, "deliver", "b"), (2 * S_, "deliver", "a"), (3 * S_, "done", "a"), (4 * S_, "deliver", "b"), (4 * S_ + C.DONE_SECONDS * S_, "deliver", "b")])
    assert [o for o, _ in got] == ["acquired", "busy", "acquired", "completed", "done", "acquired"]


def test_a_claim_without_signs_of_life_runs_out():
    got = fold([(0, "deliver", "a"), (500 * S_, "alive", "a"), (900 * S_, "deliver", "b"), (1100 * S_, "deliver", "b"), (1101 * S_, "alive", "a"), (1102 * S_, "failed", "a"), (1103 * S_, "nonsense", "a")])
    assert [o for o, _ in got] == ["acquired", "kept", "busy", "acquired", "lost", "lost", "lost"]


def test_failures_wait_longer_and_end():
    events, at = [], 0
    for _ in range(5):
        events += [(at, "deliver", "a"), (at + 1, "failed", "a")]
        at += 400 * S_
    got = fold(events)
    waits = [due - events[i][0] for i, (o, due) in enumerate(got) if o == "released"]
    assert waits == [2 * S_, 4 * S_, 8 * S_, 16 * S_] and got[-1] == ("dead", None)
    assert [C.backoff_micros(n) for n in (0, 1, 8, 9, 2000)] == [2 * S_, 2 * S_, 256 * S_, 300 * S_, 300 * S_]


def test_allowance_by_hand():
    state, out = None, []
    for event in [(1, 5), (1, 6), (1, 5), (1, -20), (1, 10), (2, 3), (2, 0)]:
        state, result = C.allowance_step(state, event, 10)
        out.append(result)
    assert out == [(5, True), (5, False), (10, True), (0, True), (10, True), (3, True), (3, True)]


FIELDS = "job string, ts timestamp, event_id long, kind string, message string"
T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


BATCHES = [
    [("x", at(0), 1, "deliver", "a"), ("x", at(1), 2, "failed", "a"), ("x", at(1), 2, "failed", "a"), ("y", at(0), 3, "deliver", "a"), (None, at(0), 4, "deliver", "a")],
    [("x", at(3), 5, "deliver", "b"), ("x", at(2), 6, "deliver", "a"), ("y", at(30), 7, "deliver", "b")],
    [("x", at(1.5), 8, "failed", "a"), ("z", at(31), 9, "deliver", "a")],  # late: the watermark is at 20
    [("z", at(90), 10, "done", "a"), ("x", at(91), 11, "deliver", "c")],
    [("w", at(24 * 60 * 30), 12, "deliver", "a")],
]


def test_a_stream_of_claims(spark, tmp_path):
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = S.read_events(spark, str(tmp_path / "in/*"), spark.createDataFrame([], FIELDS).schema, maxFilesPerTrigger=1)
        out = C.claims(stream, "job", late="10 minutes")
        S.drain(out, str(tmp_path / "checkpoint"), lambda df, i: df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={i}")))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if was is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    got = [tuple(r) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out/*")).select("key", "event_id", "message", "outcome").collect()]
    assert sorted(g for g in got if g[1] is not None) == sorted([
        ("x", 1, "a", "acquired"), ("x", 2, "a", "released"), ("x", 2, "a", "lost"), ("y", 3, "a", "acquired"), ("None", 4, "a", "acquired"),
        ("x", 6, "a", "acquired"), ("x", 5, "b", "busy"), ("y", 7, "b", "acquired"), ("z", 9, "a", "acquired"), ("z", 10, "a", "completed"), ("x", 11, "c", "acquired"), ("w", 12, "a", "acquired"),
        ("x", 8, "a", "released"),  # the claim of event 6 is a's: a late event is folded when it comes
    ])
    assert [g for g in got if g[3] == "retry"] == [("x", None, "a", "retry")] * 2


def test_tables_and_bounds(spark):
    rows = [r for b in BATCHES for r in b]
    df = spark.createDataFrame(rows, FIELDS).repartition(3)
    got = C.claims(df, "job", until=F.lit(at(2))).collect()
    assert len(got) == len(rows) + 1 and [r["message"] for r in got if r["outcome"] == "retry"] == ["a"]
    assert {r["outcome"] for r in got} <= {*C.OUTCOMES, "retry"}
    assert C.claims(df.limit(0), "job").count() == 0
    empty = C.reserved(spark.createDataFrame([], "ts timestamp, event_id long, job string, n long"), "job", F.col("n"), 5)
    assert empty.count() == 0 and empty.columns[-2:] == ["used", "allowed"]


@pytest.mark.parametrize("headroom, allowed", [(0, [True, True]), (3, [True, False]), (99, [False, False])])
def test_headroom(spark, headroom, allowed):
    df = spark.createDataFrame([(at(0), 1, "k", 5), (at(1), 2, "k", 5)], "ts timestamp, event_id long, job string, n long")
    assert [r["allowed"] for r in C.reserved(df, "job", F.col("n"), 10, headroom).orderBy("event_id").collect()] == allowed
