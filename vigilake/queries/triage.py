"""Triage of alerts as a log of actions derived from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import triage as T
from .base import EV, Registry, flat_events, ntz

reg = Registry()
STATUS = {"view": "new", "click": "acknowledged", "purchase": "in_progress", "signup": "closed_true_positive", "error": "closed_false_positive"}


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event moves its user's alert to a status; every fifth also assigns it; the first files it."""
    e = flat_events(spark, sf_dir)
    status = F.lit("new")
    for k, v in STATUS.items():
        status = F.when(F.col("action") == k, v).otherwise(status)
    base = [F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("uid"), F.col("ts").alias("at"), "seq"]
    moved = e.select(*base, F.lit("status").alias("kind"), status.alias("payload"))
    assigned = e.where("seq % 5 = 0").select(*base, F.lit("assign").alias("kind"), F.col("host").alias("payload"))
    filed = e.where("user_id % 3 = 0").select(*base, F.lit("incident").alias("kind"), F.concat(F.lit("i"), F.pmod("user_id", F.lit(10)).cast("string")).alias("payload"))
    return moved.unionByName(assigned).unionByName(filed)


_STATUS_SQL = "CASE action " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"
_ST = f"""{EV}, st AS (SELECT 'a' || user_id AS uid, max_by({_STATUS_SQL}, ts) AS status, max_by(host, ts) FILTER (seq % 5 = 0) AS assignee,
        CASE WHEN any_value(user_id) % 3 = 0 THEN 'i' || (any_value(user_id) % 10) END AS incident, min(ts) AS first_seen, max(ts) AS last_updated, max(ts) FILTER (action IN ('signup', 'error')) AS last_close FROM ev GROUP BY user_id),
    state AS (SELECT uid, status, assignee, incident, first_seen, last_updated, CASE WHEN status LIKE 'closed%' THEN last_close END AS closed_at FROM st)"""
reg.add("triage_state", lambda s, d: T.current(actions(s, d)), f"WITH {_ST} SELECT * FROM state")
reg.add("triage_stats", lambda s, d: T.stats(T.current(actions(s, d))), f"WITH {_ST} SELECT count(*) AS total, count(*) FILTER (status NOT LIKE 'closed%') AS open, count(*) FILTER (status LIKE 'closed%') AS closed, count(DISTINCT incident) AS incidents FROM state")
reg.add("triage_metrics", lambda s, d: T.outcome_metrics(T.current(actions(s, d))), f"""
    WITH {_ST} SELECT count(*) FILTER (status LIKE 'closed%') AS resolved, round(avg(epoch_us(closed_at) - epoch_us(first_seen)) FILTER (status LIKE 'closed%') / 1e6, 3) AS mttr_seconds,
        round(count(*) FILTER (status = 'closed_false_positive') / nullif(count(*) FILTER (status LIKE 'closed%'), 0), 4) AS fp_rate FROM state""")


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = flat_events(spark, sf_dir).select(F.concat_ws("-", "action", "usr").alias("uid"), "action").distinct()
    stored = e.where("action <> 'click'").withColumn("origin", F.lit("stored"))
    return T.upsert(stored, e.withColumn("origin", F.lit("incoming"))).select("uid", "origin")


_PAIRS = f"{EV}, pr AS (SELECT DISTINCT action, usr, action || '-' || usr AS uid FROM ev)"
reg.add("triage_upsert", _upsert, f"WITH {_PAIRS} SELECT uid, CASE WHEN action = 'click' THEN 'incoming' ELSE 'stored' END AS origin FROM pr")
reg.add("triage_sync_new", lambda s, d: T.new_alerts(flat_events(s, d).where("action <> 'click'").select(F.concat_ws("-", "action", "usr").alias("uid")), flat_events(s, d).select(F.concat_ws("-", "action", "usr").alias("uid"))),
        f"WITH {_PAIRS} SELECT uid FROM pr WHERE action = 'click'")


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = spark.range(12).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("incident_id"))
    return T.incident_counts(every, T.current(actions(spark, sf_dir)))


reg.add("incident_counts", _incidents, f"WITH {_ST} SELECT 'i' || r AS incident_id, count(state.uid) AS n_alerts FROM range(12) t(r) LEFT JOIN state ON state.incident = 'i' || r GROUP BY 1")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = flat_events(spark, sf_dir)
    uid = F.concat(F.lit("a"), F.col("user_id").cast("string"))
    notes = e.where("action = 'error' and user_id % 2 = 0").select(uid.alias("uid"), F.col("seq").alias("note_id"), F.concat(F.lit("n"), F.col("seq").cast("string")).alias("text"))
    return T.with_notes(e.select(uid.alias("uid")).distinct(), notes)


reg.add("alert_with_notes", _notes, f"""
    WITH {EV}, u AS (SELECT DISTINCT user_id FROM ev), n AS (SELECT user_id, string_agg('n' || seq, '|' ORDER BY seq) AS notes, count(*) AS k FROM ev WHERE action = 'error' AND user_id % 2 = 0 GROUP BY 1)
    SELECT 'a' || u.user_id AS uid, n.notes, coalesce(n.k, 0) AS n_notes FROM u LEFT JOIN n USING (user_id)""")


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert per host and day, with the addresses and users of its events as evidence."""
    e = flat_events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return e.groupBy(F.concat_ws("/", "host", "day").alias("uid"), F.col("host").alias("group_value")).agg(F.collect_set("ip").alias("ips"), F.collect_set("usr").alias("users"))


reg.add("pivot_entity", lambda s, d: T.pivot(grouped(s, d), "u3", "group_value", {"source.ip": "ips", "user.name": "users"}).select("uid"),
        f"WITH {EV} SELECT DISTINCT host || '/' || strftime(ts, '%Y-%m-%d') AS uid FROM ev WHERE usr = 'u3'")
reg.add("alert_pivots", lambda s, d: T.pivot_values(grouped(s, d), "uid", {"source.ip": "ips", "user.name": "users"}), f"""
    WITH {EV}, x AS (SELECT host || '/' || strftime(ts, '%Y-%m-%d') AS uid, ip, usr FROM ev) SELECT DISTINCT uid, 'source.ip' AS field, ip AS value FROM x UNION SELECT DISTINCT uid, 'user.name', usr FROM x""")
reg.add("alert_uid", lambda s, d: flat_events(s, d).select("seq", T.alert_uid(F.col("action"), F.when(F.col("user_id") % 3 != 0, F.col("usr")), F.col("seq")).alias("uid")),
        f"WITH {EV} SELECT seq, substr(sha1(action || '|' || CASE WHEN user_id % 3 <> 0 THEN usr ELSE 'None' END || '|' || seq), 1, 16) AS uid FROM ev")

QUERIES, ORACLE_SQL = reg.queries, reg.sql
