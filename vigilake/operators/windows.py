"""Sliding-window thresholds, sessions and maximal sums: one sort per key, no self-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

OPS = {">=": Column.__ge__, ">": Column.__gt__, "==": Column.__eq__, "<": Column.__lt__, "<=": Column.__le__}


def micros_of(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def from_the_end(keys: list[str], at: str) -> WindowSpec:
    """Each row, those of its instant and all that follow, sorted from the last on: such a frame only grows, while one up to
    an unbounded following is summed anew for every row."""
    return Window.partitionBy(*keys).orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, 0)


def counted(events: DataFrame, keys: list[str], ts: str, seq: str, window_us: int) -> DataFrame:
    """Adds _us, _rn and _cnt: how many events of the key, up to this one in (time, arrival), lie in
    the window ending with it. Counts rows, so that events of one instant count one after another."""
    spec = Window.partitionBy(*keys)
    ordered = spec.orderBy("_us", seq)
    ranged = spec.orderBy("_us").rangeBetween(-window_us, 0)
    rows = events.withColumn("_us", micros_of(ts)).withColumn("_rn", F.row_number().over(ordered).cast("long"))
    return rows.withColumn("_cnt", F.col("_rn") - F.min("_rn").over(ranged) + 1)


def threshold(events: DataFrame, keys: list[str], ts: str, seq: str, window_us: int, op: str, value: int) -> DataFrame:
    """One row per key (a null key is one) that crosses: its first crossing.

    Columns: the keys, first_seen and last_seen of the window's events, match_count, rn_from and
    rn_to (ranks in the key by time and arrival). Undated events are left out where the key has a
    dated one; a key of undated events alone is one window over all of them.
    """
    dated = events.withColumn("_dated", F.count(ts).over(Window.partitionBy(*keys)))
    crossing = OPS[op](F.col("_cnt"), F.lit(value))
    timed = counted(dated.where(F.col(ts).isNotNull()), keys, ts, seq, window_us).where(crossing)
    first = timed.groupBy(*keys).agg(F.min(F.struct("_rn", "_us", "_cnt")).alias("_x"))
    hit = first.select(*keys, F.col("_x._rn").alias("rn_to"), F.col("_x._us").alias("_us"), F.col("_x._cnt").alias("match_count"))
    hit = hit.select(*keys, F.timestamp_micros("_us").alias("last_seen"), "match_count", (F.col("rn_to") - F.col("match_count") + 1).alias("rn_from"), "rn_to")
    undated = dated.where("_dated = 0").groupBy(*keys).agg(F.count("*").alias("match_count")).where(OPS[op](F.col("match_count"), F.lit(value)))
    undated = undated.select(*keys, F.lit(None).cast("timestamp").alias("last_seen"), "match_count", F.lit(1).cast("long").alias("rn_from"), F.col("match_count").alias("rn_to"))
    return hit.unionByName(undated)


def threshold_evidence(events: DataFrame, keys: list[str], ts: str, seq: str, window_us: int, op: str, value: int) -> DataFrame:
    """The events of each key's first crossing window, with match_count and their rank in it."""
    if not keys:
        events, keys = events.withColumn("_all", F.lit(1)), ["_all"]
    dated = events.withColumn("_dated", F.count(ts).over(Window.partitionBy(*keys)))
    ranked = counted(dated, keys, ts, seq, window_us)
    undated = F.col("_dated") == 0
    within = ranked.where(undated | F.col(ts).isNotNull()).withColumn("_us", F.coalesce("_us", F.lit(0).cast("long")))
    own = Window.partitionBy(*keys)
    place = F.row_number().over(own.orderBy("_us", seq)).cast("long")
    within = within.withColumn("_rn", place)
    within = within.withColumn("_cnt", F.when(undated, F.count("*").over(own)).otherwise(F.col("_rn") - F.min("_rn").over(own.orderBy("_us").rangeBetween(-window_us, 0)) + 1))
    end = F.min(F.when(OPS[op](F.col("_cnt"), F.lit(value)), F.struct(F.when(undated, F.col("_cnt")).otherwise(F.col("_rn")).alias("rn"), F.col("_cnt").alias("cnt")))).over(own)
    chosen = within.withColumn("_end", end).where(F.col("_end").isNotNull())
    chosen = chosen.where((F.col("_rn") <= F.col("_end.rn")) & (F.col("_rn") > F.col("_end.rn") - F.col("_end.cnt")))
    out = chosen.withColumn("match_count", F.col("_end.cnt")).withColumn("evidence_rank", F.col("_rn") - F.col("_end.rn") + F.col("_end.cnt"))
    return out.drop("_us", "_rn", "_cnt", "_end", "_dated", "_all")


def dedup(alerts: DataFrame, keys: list[str], ts: str, seq: str, window_us: int) -> DataFrame:
    """One row per burst: the first alert of each, with occurrences and last_seen.

    An alert joins the burst of its key if it comes at most the window after the one before it;
    undated alerts never merge.
    """
    order = Window.partitionBy(*keys).orderBy("_us", seq)
    rows = alerts.withColumn("_us", micros_of(ts))
    gap = F.col("_us") - F.lag("_us").over(order)
    rows = rows.withColumn("_new", F.when(gap.isNull() | (gap > window_us), 1).otherwise(0))  # so does each undated one, which sort first
    rows = rows.withColumn("_session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rest = [c for c in alerts.columns if c not in keys]
    merged = rows.groupBy(*keys, "_session").agg(
        F.min_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct("_us", seq)).alias("_a"), F.count("*").alias("occurrences"), F.max(ts).alias("last_seen")
    )
    return merged.select(*keys, *(F.col(f"_a.`{c}`").alias(c) for c in rest), "occurrences", "last_seen")


def max_window_sum(scores: DataFrame, keys: list[str], ts: str, seq: str, score: str, window_us: int) -> DataFrame:
    """Per key the largest sum of a window and the earliest window that has it: keys, max_sum,
    window_start, window_end, signals."""
    spec = Window.partitionBy(*keys)
    ordered = spec.orderBy("_us", seq).rowsBetween(Window.unboundedPreceding, 0)
    ranged = spec.orderBy("_us").rangeBetween(-window_us, 0)
    rows = scores.withColumn("_us", micros_of(ts)).withColumn("_cum", F.sum(score).over(ordered)).withColumn("_rn", F.count("*").over(ordered))
    rows = rows.withColumn("_before", F.min(F.col("_cum") - F.col(score)).over(ranged)).withColumn("_first", F.min(F.struct("_rn", "_us")).over(ranged))
    rows = rows.withColumn("_sum", F.col("_cum") - F.col("_before"))
    best = rows.groupBy(*keys).agg(F.max(F.struct("_sum", (-F.col("_rn")).alias("_last"), "_us", "_first")).alias("_x"))
    return best.select(
        *keys, F.col("_x._sum").alias("max_sum"), F.timestamp_micros("_x._first._us").alias("window_start"), F.timestamp_micros("_x._us").alias("window_end"),
        (-F.col("_x._last") - F.col("_x._first._rn") + 1).alias("signals"),
    )
