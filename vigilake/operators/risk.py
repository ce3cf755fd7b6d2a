"""Risk of entities: scores of alerts, shared among their entities, summed over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ip import is_ip
from .windows import max_window_sum

#: The score of each severity; an unknown one counts as medium.
SCORES = {"informational": 5, "low": 15, "medium": 30, "high": 60, "critical": 90}


def severity_score(severity: Column, override: Column | None = None) -> Column:
    score = F.lit(SCORES["medium"])
    for name, value in SCORES.items():
        score = F.when(F.lower(severity) == name, value).otherwise(score)
    return (score if override is None else F.coalesce(override, score)).cast("long")


def entity_scores(alerts: DataFrame, fields: dict[str, Column], base: str = "score", group_value: str | None = None) -> DataFrame:
    """A row (…, field, entity, share) for each entity of each alert.

    ``fields`` maps a field's name to an array of its values over the evidence. Of one field the
    distinct values share the score equally, rounded down and at least 1. A group value that is an
    address counts among source.ip.
    """
    parts = []
    for name, values in fields.items():
        values = F.filter(F.coalesce(values.cast("array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())
        if name == "source.ip" and group_value:
            own = F.col(group_value)
            values = F.when(is_ip(own), F.array_append(values, own)).otherwise(values)
        parts.append(F.struct(F.lit(name).alias("field"), F.array_distinct(values).alias("values")))
    rows = alerts.withColumn("_f", F.explode(F.array(*parts))).withColumn("_n", F.size("_f.values")).where("_n > 0")
    share = F.greatest(F.lit(1).cast("long"), F.floor(F.col(base) / F.col("_n")))
    return rows.withColumn("field", F.col("_f.field")).withColumn("share", share).withColumn("entity", F.explode("_f.values")).drop("_f", "_n")


def notables(scores: DataFrame, keys: list[str], ts: str, seq: str, window_us: int, threshold: int, score: str = "share") -> DataFrame:
    """Entities whose best window reaches the threshold; critical from twice the threshold, else high."""
    best = max_window_sum(scores, keys, ts, seq, score, window_us).where(F.col("max_sum") >= threshold)
    return best.withColumn("severity", F.when(F.col("max_sum") >= 2 * threshold, "critical").otherwise("high"))


def leaderboard(scores: DataFrame, keys: list[str], ts: str, seq: str, window_us: int, threshold: int, limit: int = 10, score: str = "share") -> DataFrame:
    """The entities with the largest best windows; ties by key."""
    best = max_window_sum(scores, keys, ts, seq, score, window_us)
    return best.withColumn("over_threshold", F.col("max_sum") >= threshold).orderBy(F.desc("max_sum"), *keys).limit(limit)
