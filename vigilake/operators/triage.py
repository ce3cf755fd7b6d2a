"""Triage state as the latest of an append-only log of actions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The states of an alert.
STATUSES = ("new", "acknowledged", "in_progress", "closed_true_positive", "closed_false_positive")
CLOSED = ("closed_true_positive", "closed_false_positive")


def alert_uid(rule_id: Column, group_value: Column, timestamp: Column) -> Column:
    """16 digits that stay the same when an alert is ingested again; an absent part reads None."""
    text = [F.coalesce(c.cast("string"), F.lit("None")) for c in (rule_id, group_value, timestamp)]
    return F.substring(F.sha1(F.concat_ws("|", *text)), 1, 16)


def action(uid: Column, kind: str, payload: Column, actor: Column, at: Column) -> list[Column]:
    """A row of the log. Kinds: status, assign, note, incident, seen."""
    return [uid.alias("uid"), F.lit(kind).alias("kind"), payload.alias("payload"), actor.alias("actor"), at.alias("at")]


def check_status(status: str) -> str:
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    return status


#: What an analyst may do to an alert: the kinds of the log, but for ``seen``.
ACTIONS = ("status", "assign", "note", "incident")
LOG_DDL = "uid string, kind string, payload string, actor string, at timestamp, seq bigint"


def append_actions(spark: SparkSession, path: str, kind: str, uids: list[str], payload: str, actor: str, at: datetime.datetime | None = None) -> None:
    """Adds one action on each of some alerts to the log; ValueError for an unknown kind or status."""
    if kind not in ACTIONS:
        raise ValueError(f"unknown action {kind!r}")
    if kind == "status":
        check_status(payload)
    at = at or datetime.datetime.now(datetime.timezone.utc)
    rows = [(uid, kind, payload, actor, at, int(at.timestamp() * 1_000_000)) for uid in uids]
    spark.createDataFrame(rows, LOG_DDL).write.mode("append").parquet(path)


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """The log of actions; one that isn't there is empty."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], LOG_DDL)
    return spark.read.schema(LOG_DDL).parquet(path)


def group_into_incident(spark: SparkSession, path: str, alerts: DataFrame, incident: str, actor: str, at: datetime.datetime) -> None:
    """Puts all of ``alerts`` (uid) into one incident, however many there are."""
    rows = alerts.select(*action(F.col("uid"), "incident", F.lit(incident), F.lit(actor), F.lit(at).cast("timestamp")), F.lit(int(at.timestamp() * 1_000_000)).alias("seq"))
    rows.write.mode("append").parquet(path)


def triaged(alerts: DataFrame, actions: DataFrame, status: str | None = None, open_only: bool = False, incident: str | None = None) -> DataFrame:
    """Alerts of a store with uid, status, assignee and incident, of one status, open or of one
    incident where asked for. Alerts that nobody has acted on are new."""
    known = alerts.withColumn("uid", alert_uid(F.col("rule_id"), F.col("group_value"), F.col("timestamp")))
    held = known.join(current(actions).select("uid", "status", "assignee", "incident"), "uid", "left").withColumn("status", F.coalesce("status", F.lit("new")))
    if status is not None:
        held = held.where(F.col("status") == check_status(status))
    if open_only:
        held = held.where(~F.col("status").isin(*CLOSED))
    return held if incident is None else held.where(F.col("incident") == incident)


def current(actions: DataFrame, at: str = "at", seq: str = "seq") -> DataFrame:
    """uid, status, assignee, incident, first_seen, last_updated, closed_at: per alert the last
    action of each kind. Logs of any length per alert fold map-side."""
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct(at, seq, "payload")))
    closing = (F.col("kind") == "status") & F.col("payload").isin(*CLOSED)
    out = actions.groupBy("uid").agg(
        of("status").alias("s"), of("assign").alias("a"), of("incident").alias("i"), F.min(at).alias("first_seen"), F.max(at).alias("last_updated"),
        F.max(F.when(closing, F.col(at))).alias("closed_at"),
    )
    status = F.coalesce("s.payload", F.lit("new"))
    closed = F.when(status.isin(*CLOSED), F.col("closed_at"))
    return out.select("uid", status.alias("status"), F.col("a.payload").alias("assignee"), F.col("i.payload").alias("incident"), "first_seen", "last_updated", closed.alias("closed_at"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """Stored rows and the incoming ones no stored row has: ingesting twice changes nothing."""
    fresh = incoming.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")
    return stored.unionByName(fresh)


def new_alerts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return incoming.select("uid").distinct().join(stored.select("uid"), "uid", "left_anti")


def stats(state: DataFrame) -> DataFrame:
    """One row: total, open, closed and incidents in use."""
    closed = F.col("status").isin(*CLOSED)
    return state.agg(F.count("*").alias("total"), F.count_if(~closed).alias("open"), F.count_if(closed).alias("closed"), F.count_distinct("incident").alias("incidents"))


def outcome_metrics(state: DataFrame) -> DataFrame:
    """One row: resolved, mean seconds to resolve (by the closing action), false positive rate."""
    closed = F.col("status").isin(*CLOSED)
    seconds = (F.unix_micros(F.col("closed_at").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / 1e6
    fp = F.count_if(F.col("status") == "closed_false_positive")
    return state.agg(
        F.count_if(closed).alias("resolved"), F.round(F.avg(F.when(closed, seconds)), 3).alias("mttr_seconds"), F.round(F.try_divide(fp, F.count_if(closed)), 4).alias("fp_rate")
    )


def incident_counts(incidents: DataFrame, state: DataFrame) -> DataFrame:
    """Every incident with its number of alerts, those without any included."""
    rows = state.groupBy(F.col("incident").alias("incident_id")).agg(F.count("*").alias("n"))
    return incidents.join(rows, "incident_id", "left").withColumn("n_alerts", F.coalesce("n", F.lit(0).cast("long"))).drop("n")


def with_notes(alerts: DataFrame, notes: DataFrame) -> DataFrame:
    """Alerts with their notes' texts in order of id, parted by bars."""
    rows = notes.groupBy("uid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("note_id", "text"))), lambda x: x["text"]), "|").alias("notes"), F.count("*").alias("n_notes"))
    return alerts.join(rows, "uid", "left").withColumn("n_notes", F.coalesce("n_notes", F.lit(0).cast("long")))


def pivot(alerts: DataFrame, value: str, group_value: str, evidence: dict[str, str]) -> DataFrame:
    """Alerts whose group value or any evidence field is the value; ``evidence`` maps names to array columns."""
    test = F.coalesce(F.col(group_value) == value, F.lit(False))
    for column in evidence.values():
        test = test | F.coalesce(F.array_contains(column, value), F.lit(False))
    return alerts.where(test)


def pivot_values(alerts: DataFrame, uid: str, evidence: dict[str, str]) -> DataFrame:
    """Distinct (uid, field, value) to pivot on."""
    fields = F.array(*(F.struct(F.lit(k).alias("field"), F.col(v).alias("values")) for k, v in evidence.items()))
    rows = alerts.select(uid, F.explode(fields).alias("f")).select(uid, "f.field", F.explode("f.values").alias("value"))
    return rows.where(F.col("value").isNotNull()).distinct()
