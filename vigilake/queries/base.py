"""The shared tables seen as security events; the same expressions in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import event_columns

#: Networks of the derived addresses: the same list in Spark and in SQL.
NETS = ("10.0.0", "172.22.4", "61.4.88", "77.30.11", "130.44.3")
SEVERITIES = {"error": "critical", "purchase": "high", "signup": "medium", "click": "low", "view": "informational"}


def address(k: Column, host: Column) -> Column:
    return F.concat(F.get(F.array(*map(F.lit, NETS)), F.pmod(k, F.lit(5)).cast("int")), F.lit("."), F.pmod(host, F.lit(250)).cast("string"))


def severity_of(event_type: Column) -> Column:
    out = F.lit("medium")
    for name, level in SEVERITIES.items():
        out = F.when(event_type == name, level).otherwise(out)
    return out


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, action, usr, user_id, outcome, host, ip, ip_moving (another network with each event),
    severity, value, props."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("action"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("usr"), "user_id",
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"), F.concat(F.lit("h"), F.pmod("user_id", F.lit(7)).cast("string")).alias("host"),
        address(F.col("user_id"), F.col("user_id")).alias("ip"), address(F.col("event_id"), F.col("user_id")).alias("ip_moving"), severity_of(F.col("event_type")).alias("severity"), "value", "props",
    )


def normalized_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as nested events of the normalised schema."""
    e = flat_events(spark, sf_dir)
    return e.select(*event_columns({
        "@timestamp": F.col("ts").cast("timestamp"), "ingest_seq": F.col("seq"), "message": F.col("props"), "event.category": F.when(F.col("action") == "error", "authentication").otherwise("web"),
        "event.action": F.col("action"), "event.outcome": F.col("outcome"), "source.ip": F.col("ip"), "user.name": F.col("usr"), "host.name": F.col("host"), "log.source": F.lit("events"),
        "process.name": F.when(F.col("action") == "error", "sshd"),
    }))


_SEVERITY_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEVERITIES.items()) + " ELSE 'medium' END"
_NETS_SQL = "[" + ", ".join(f"'{n}'" for n in NETS) + "]"
EV = f"""ev AS (
    SELECT event_id AS seq, ts, event_type AS action, 'u' || user_id AS usr, user_id, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome,
           'h' || (user_id % 7) AS host, {_NETS_SQL}[user_id % 5 + 1] || '.' || (user_id % 250) AS ip, {_NETS_SQL}[event_id % 5 + 1] || '.' || (user_id % 250) AS ip_moving,
           {_SEVERITY_SQL} AS severity, value, props
    FROM events)"""


class Registry:
    """Collects queries and their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = query
        if sql:
            self.sql[name] = sql


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    """Times without a zone, as SQL engines without one compare them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})
