"""Counts and rankings over alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ip import is_ip

#: Severities in display order, and ranks of the notification gate (unknown: 0).
SEVERITY_ORDER = ("critical", "high", "medium", "low")
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
TECHNIQUE = r"(?i)^attack\.t(\d{4})(?:\.(\d{3}))?$"


def severity_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(F.lower(severity) == name, value).otherwise(rank)
    return rank


def severity_gate(alerts: DataFrame, least: str, severity: str = "severity") -> DataFrame:
    """Alerts at or above a severity."""
    return alerts.where(severity_rank(F.col(severity)) >= SEVERITY_RANK.get(least, 0))


def display_order(severity: Column) -> Column:
    place = F.lit(len(SEVERITY_ORDER))
    for k, name in enumerate(SEVERITY_ORDER):
        place = F.when(severity == name, k).otherwise(place)
    return place.cast("long")


def counts_by(alerts: DataFrame, column: str) -> DataFrame:
    return alerts.groupBy(column).agg(F.count("*").alias("n"))


def all_counts(alerts: DataFrame, columns: tuple[str, ...] = ("severity", "source", "mode")) -> DataFrame:
    """(facet, value, n) of several columns in one pass."""
    sets = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return alerts.select(sets.alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def daily_volume(alerts: DataFrame, ts: str) -> DataFrame:
    """Alerts a day; undated ones have none."""
    return alerts.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def top_sources(alerts: DataFrame, group_value: str, event_ips: str, k: int = 10) -> DataFrame:
    """The addresses seen most: an alert counts for its group value if that is an address, else once
    for each of its events. Ties by address."""
    own = F.when(is_ip(F.col(group_value)), F.array(group_value)).otherwise(F.filter(event_ips, lambda x: x.isNotNull()))
    rows = alerts.select(F.explode(own).alias("source_ip"))
    return rows.groupBy("source_ip").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_ip").limit(k)


def technique(tag: Column) -> Column:
    """T1110 or T1110.001 of a tag, null for tags of tactics and others."""
    base, part = F.regexp_extract(tag, TECHNIQUE, 1), F.regexp_extract(tag, TECHNIQUE, 2)
    return F.when(base != "", F.concat(F.lit("T"), base, F.when(part != "", F.concat(F.lit("."), part)).otherwise("")))


def technique_url(name: Column) -> Column:
    return F.concat(F.lit("https://attack.mitre.org/techniques/"), F.replace(name, F.lit("."), F.lit("/")), F.lit("/"))


def coverage(rules: DataFrame) -> DataFrame:
    """technique, url, n_rules, rules (ids in order, parted by commas) of rules with tags."""
    rows = rules.select("rule_id", F.explode("tags").alias("tag")).select("rule_id", technique(F.col("tag")).alias("technique"))
    rows = rows.where(F.col("technique").isNotNull()).distinct()
    out = rows.groupBy("technique").agg(F.count("*").alias("n_rules"), F.array_join(F.sort_array(F.collect_list("rule_id")), ",").alias("rules"))
    return out.select("technique", technique_url(F.col("technique")).alias("url"), "n_rules", "rules")


def untagged(rules: DataFrame) -> DataFrame:
    """Rules without a technique."""
    tagged = rules.select("rule_id", F.explode("tags").alias("tag")).where(technique(F.col("tag")).isNotNull()).select("rule_id")
    return rules.join(tagged, "rule_id", "left_anti")


def navigator_layer(covered: DataFrame, name: str = "coverage") -> DataFrame:
    """One row with the layer document of the coverage, a score per technique."""
    entry = F.struct(F.col("technique").alias("techniqueID"), F.col("n_rules").alias("score"), F.col("rules").alias("comment"))
    layer = covered.agg(F.sort_array(F.collect_list(entry)).alias("techniques"))
    gradient = F.struct(F.array(F.lit("#ffffff"), F.lit("#ff6666")).alias("colors"), F.lit(0).alias("minValue"), F.lit(3).alias("maxValue"))
    return layer.select(F.to_json(F.struct(F.lit(name).alias("name"), F.lit("enterprise-attack").alias("domain"), "techniques", gradient.alias("gradient"))).alias("layer"))


def replay_verdict(lines: Column, events: Column, alerts: Column) -> list[Column]:
    """Columns lines, events, alerts, and false positives per thousand lines taken as benign."""
    return [lines.alias("n_lines"), events.alias("n_events"), alerts.alias("n_alerts"), F.round(F.coalesce(F.try_divide(alerts * 1000, lines), F.lit(0.0)), 4).alias("per_1k")]
