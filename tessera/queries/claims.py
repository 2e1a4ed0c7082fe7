"""Claims of jobs, retries and allowances over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.queries.streams import streamed
from tessera.registry import query, table
from tessera.streaming import claims as C

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOLD = 2 * 24 * 3600
#: A user is a job; what an event says of it follows from its number, and two messages take turns.
KINDS = "CASE WHEN event_id % 11 = 0 THEN 'done' WHEN event_id % 3 = 1 THEN 'failed' WHEN event_id % 7 = 2 THEN 'alive' ELSE 'deliver' END"
CLAIM_SQL = f"""WITH RECURSIVE e AS (SELECT user_id AS k, event_id, ts, epoch_us(ts) AS us, {KINDS} AS kind, 'm' || (event_id // 2 % 2) AS message, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
s AS (SELECT k, 0::BIGINT AS pos, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS message, NULL::VARCHAR AS outcome, NULL::BIGINT AS due, NULL::VARCHAR AS owner, 0::BIGINT AS until, 0 AS failures FROM (SELECT DISTINCT user_id AS k FROM events)
  UNION ALL SELECT k, pos, event_id, ts, message, outcome, CASE WHEN outcome = 'released' THEN us + least(300, 2 * 2 ** (now_failures)) * 1000000 END::BIGINT,
    CASE outcome WHEN 'acquired' THEN message WHEN 'completed' THEN 'done' WHEN 'released' THEN NULL WHEN 'dead' THEN NULL ELSE owner END,
    CASE WHEN outcome IN ('acquired', 'kept') THEN us + {HOLD * 1_000_000} WHEN outcome IN ('completed', 'released', 'dead') THEN us + 604800000000 ELSE until END,
    CASE WHEN outcome IN ('released', 'dead') THEN now_failures + 1 WHEN outcome = 'completed' THEN 0 ELSE now_failures END
  FROM (SELECT *, CASE kind WHEN 'done' THEN 'completed' WHEN 'alive' THEN CASE WHEN owner = message THEN 'kept' ELSE 'lost' END WHEN 'failed' THEN CASE WHEN owner IS DISTINCT FROM message THEN 'lost' WHEN now_failures + 1 < 5 THEN 'released' ELSE 'dead' END
          ELSE CASE WHEN owner IS NULL OR owner = message THEN 'acquired' WHEN owner = 'done' THEN 'done' ELSE 'busy' END END AS outcome
        FROM (SELECT e.k, e.pos, e.event_id, e.ts, e.us, e.kind, e.message, CASE WHEN e.us < s.until THEN s.owner END AS owner, s.until, CASE WHEN e.us < s.until THEN s.failures ELSE 0 END AS now_failures FROM s JOIN e ON e.k = s.k AND e.pos = s.pos + 1)))
SELECT k::VARCHAR AS key, event_id, message, outcome, make_timestamp(due) AS due_at FROM s WHERE event_id IS NOT NULL
UNION ALL SELECT k::VARCHAR, NULL, message, 'retry', make_timestamp(due) FROM s WHERE due <= (SELECT epoch_us(max(ts)) - 600000000 FROM events)"""


def _messages(events):
    i = F.col("event_id")
    return events.withColumns({"kind": F.expr(KINDS), "message": F.concat(F.lit("m"), (F.floor(i / 2) % 2).cast("string"))})


@query("str_claims", CLAIM_SQL)
def str_claims(spark, sf_dir):
    """A stream with keyed state and timers: who holds a job, and which failures are tried again."""
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        out = streamed(spark, sf_dir, lambda s: C.claims(_messages(s), "user_id", claim_seconds=HOLD))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if was is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return out.drop("ts")


@query("str_claims_twin", CLAIM_SQL)
def str_claims_twin(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    until = F.lit(events.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 10 MINUTES")
    return C.claims(_messages(events), "user_id", claim_seconds=HOLD, until=until).drop("ts")


@query("str_reserved", """WITH RECURSIVE e AS (SELECT user_id AS k, event_id, date_trunc('month', ts) AS m, CASE WHEN event_id % 4 = 3 THEN -(event_id % 3) ELSE event_id % 5 END AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
s AS (SELECT k, 0::BIGINT AS pos, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS m, 0::BIGINT AS used, true AS allowed FROM (SELECT DISTINCT user_id AS k FROM events)
  UNION ALL SELECT k, pos, event_id, m, CASE WHEN c <= 0 THEN greatest(0, was + c) WHEN was + c <= 18 THEN was + c ELSE was END, c <= 0 OR was + c <= 18
  FROM (SELECT e.*, CASE WHEN s.m = e.m THEN s.used ELSE 0 END AS was FROM s JOIN e ON e.k = s.k AND e.pos = s.pos + 1))
SELECT event_id, used, allowed FROM s WHERE event_id IS NOT NULL""")  # fmt: skip
def str_reserved(spark, sf_dir):
    """Calls claimed from a month's allowance of twenty with two in hand, and calls given back."""
    i = F.col("event_id")
    calls = F.when(i % 4 == 3, -(i % 3)).otherwise(i % 5)
    return C.reserved(table(spark, sf_dir, "events"), "user_id", calls, 20, 2).select("event_id", "used", "allowed")
