"""Precision and recall of rules against labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(cases: DataFrame, rules: DataFrame, expected: DataFrame, fired: DataFrame) -> DataFrame:
    """rule_id, tp, fp, fn, tn over the whole grid of cases and rules.

    Counts need no grid: what fired or was expected is outer-joined per (case, rule), and the true
    negatives are the rest of the cases, so nothing grows with cases times rules.
    """
    e = expected.distinct().withColumn("e", F.lit(True))
    f = fired.distinct().withColumn("f", F.lit(True))
    both = e.join(f, ["case_id", "rule_id"], "full").groupBy("rule_id").agg(
        F.count_if(F.col("e") & F.col("f")).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn")
    )
    n = cases.agg(F.count("*").alias("n"))
    out = rules.join(both, "rule_id", "left").crossJoin(F.broadcast(n))  # one row
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("tp", "fp", "fn")]
    return out.select("rule_id", *counts, (F.col("n") - F.coalesce("tp", F.lit(0)) - F.coalesce("fp", F.lit(0)) - F.coalesce("fn", F.lit(0))).alias("tn"))


def metrics(matrix: DataFrame) -> DataFrame:
    """Adds precision, recall and f1, to four places."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return matrix.select("*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def micro(matrix: DataFrame, benign_cases: Column | int, benign_alerts: Column | int, benign_lines: Column | int) -> DataFrame:
    """One row over all rules; false positives of every case per thousand benign lines."""
    total = matrix.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return total.select(
        "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"),
        F.round(ratio(lit(benign_alerts), lit(benign_cases)), 4).alias("benign_fp_rate"), F.round(ratio(F.col("fp") * 1000, lit(benign_lines)), 4).alias("fp_per_1k"),
    )


def misses(expected: DataFrame, fired: DataFrame) -> DataFrame:
    return expected.distinct().join(fired.distinct(), ["case_id", "rule_id"], "left_anti")


def untested(rules: DataFrame, expected: DataFrame, matrix: DataFrame, feeders: DataFrame) -> DataFrame:
    """Rules that no case expects, that raised no false positive and that feed no correlation."""
    out = rules.join(expected.select("rule_id").distinct(), "rule_id", "left_anti")
    out = out.join(matrix.where("fp > 0").select("rule_id"), "rule_id", "left_anti")
    return out.join(feeders.select("rule_id"), "rule_id", "left_anti")


def universe(rules: DataFrame, expected: DataFrame, fired: DataFrame) -> DataFrame:
    return rules.select("rule_id").union(expected.select("rule_id")).union(fired.select("rule_id")).distinct()
