"""The same questions asked of a stream: drained, they equal the batch queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.risk import severity_score
from ..session import shared_dir
from ..streaming.gate import keyed_state, stateful_gate
from ..streaming.live import drained, stream_sessions, stream_threshold
from ..streaming.ordered import stream_fed_chain, stream_peaks, stream_unordered_chain
from .base import EV, Registry, ntz, severity_of
from .detection import BEST_SQL, DAY, DEDUP_CTE, HOUR, ORDERED_SQL, UNORDERED_SQL, _threshold_sql

reg = Registry()


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("usr"))


reg.add("stream_threshold", lambda s, d: ntz(drained(stream_threshold(event_stream(s, d).where("action = 'error'"), "usr", DAY, 3)), "last_seen"), _threshold_sql(">=", 3))
reg.add("stream_dedup", lambda s, d: ntz(drained(stream_sessions(event_stream(s, d), ["action", "usr"], "12 hours"), "complete"), "first_seen", "last_seen"),
        f"WITH {DEDUP_CTE} SELECT action, usr, first_seen, last_seen, occurrences FROM bursts")



def beating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of events with a heartbeat behind them: a row of no user, a year after the last, by
    which the watermark passes all."""
    path = f"{shared_dir(spark)}/beat-{uuid.uuid4().hex}"
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts").cast("timestamp").alias("ts"))
    beat = last.select(F.lit(-1).cast("long").alias("seq"), (F.col("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"), F.lit("beat").alias("action"), F.lit("").alias("usr"))
    beat.coalesce(1).write.parquet(path)
    return event_stream(spark, sf_dir).unionByName(spark.readStream.schema(beat.schema).parquet(path))


def _chain_rows(stream: DataFrame, n: int, *times: str) -> DataFrame:
    found = drained(stream)
    return ntz(found.select("usr", *(F.timestamp_micros(t).alias(t) for t in times), *(F.col("seqs")[k].alias(f"seq_{k + 1}") for k in range(n))), *times)


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last peak told of each user."""
    told = drained(stream_peaks(beating(spark, sf_dir), "usr", DAY, severity_score(severity_of(F.col("action"))))).where("usr <> ''")
    last = told.groupBy("usr").agg(F.max(F.struct("max_sum", "window_start", "window_end", "signals")).alias("x"))
    return ntz(last.select("usr", "x.max_sum", *(F.timestamp_micros(f"x.{t}").alias(t) for t in ("window_start", "window_end")), "x.signals"), "window_start", "window_end")



def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors told once a user and day."""
    with keyed_state(spark):
        told = drained(stateful_gate(event_stream(spark, sf_dir).where("action = 'error'").select("usr", "ts", "seq"), "usr", "ts", DAY))
    return ntz(told, "ts")


reg.add("stream_gate", _gated, f"""
    WITH RECURSIVE {EV}, e AS (SELECT usr, ts, min(seq) AS seq FROM ev WHERE action = 'error' GROUP BY usr, ts),
    g AS (SELECT usr, min(ts) AS ts FROM e GROUP BY usr UNION ALL
          SELECT g.usr, (SELECT min(e.ts) FROM e WHERE e.usr = g.usr AND e.ts > g.ts + INTERVAL 24 HOUR) FROM g WHERE g.ts IS NOT NULL)
    SELECT g.usr, g.ts, e.seq FROM g JOIN e USING (usr, ts)""")
reg.add("stream_chain", lambda s, d: _chain_rows(stream_fed_chain(beating(s, d), "usr", ["brute", "purchase"], DAY, F.col("action"), "error", "brute", DAY, 3), 2, "started", "fired").drop("seq_1"), ORDERED_SQL)
reg.add("stream_chain_unordered", lambda s, d: _chain_rows(stream_unordered_chain(beating(s, d), "usr", ["error", "purchase", "signup"], 6 * HOUR, F.col("action")), 3, "fired", "completed"), UNORDERED_SQL)
reg.add("stream_risk", _peaks, BEST_SQL)

QUERIES, ORACLE_SQL = reg.queries, reg.sql
