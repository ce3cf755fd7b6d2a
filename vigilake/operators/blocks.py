"""Sliding windows and chains without a key, or over keys that hold a great share of all rows: rows are
range-sorted over many partitions (blocks of time), and a block's sums carry on into the next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stages import Stages
from .windows import OPS, from_the_end, micros_of


def in_blocks(rows: DataFrame, order: list[str], stages: Stages) -> DataFrame:
    """``rows`` range-partitioned by ``order``, with the block's number; written, so that it stays."""
    return stages.save(rows.repartitionByRange(*(F.asc_nulls_first(c) for c in order)).withColumn("_block", F.spark_partition_id()), "blocks")


def carried(blocks: DataFrame, total: Column, add, start, backward: bool = False) -> tuple[dict, object]:
    """For each block what the blocks before it (behind it) come to, and the sum of all. A row for each
    block reaches the driver."""
    sums = sorted(((r[0], r[1]) for r in blocks.groupBy("_block").agg(total.alias("t")).collect()), reverse=backward)
    out, so_far = {}, start
    for block, value in sums:
        out[block] = so_far
        so_far = add(so_far, value)
    return out, so_far


def _per_block(values: dict, kind: str) -> Column:
    """The value of the row's block: a literal map, as long as there are blocks."""
    if not values:
        return F.lit(None).cast(kind)
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col("_block")).cast(kind)


def window_ranks(rows: DataFrame, keys: list[str], us: str, seq: str, window_us: int, stages: Stages) -> DataFrame:
    """(keys, us, seq, _rank, _cnt): each row's place in the order of keys, time and arrival, and how
    many rows of its key, up to it, lie in the window that ends with it.

    Every row stands in the order twice: as itself, and as a question at the start of its window.
    Rows before the question are the same for key and window, so the difference of the two counts is
    the window's; no row is copied into other blocks, however long the window.
    """
    own = rows.select(*keys, F.col(us).alias("_at"), F.col(seq).alias("_seq"), F.lit(1).alias("_tag"))
    asked = rows.select(*keys, (F.col(us) - window_us).alias("_at"), F.col(seq).alias("_seq"), F.lit(0).alias("_tag"))
    order = [*keys, "_at", "_tag", "_seq"]
    blocks = in_blocks(own.unionByName(asked), order, stages)
    base, _ = carried(blocks, F.sum("_tag"), lambda a, b: a + b, 0)
    earlier = Window.partitionBy("_block").orderBy(*(F.asc_nulls_first(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    counted = blocks.withColumn("_n", _per_block(base, "long") + F.sum("_tag").over(earlier)).withColumn("_us", F.col("_at") + F.when(F.col("_tag") == 0, window_us).otherwise(0))
    both = counted.groupBy(*keys, "_us", "_seq").agg(F.max(F.when(F.col("_tag") == 1, F.col("_n"))).alias("_rank"), F.max(F.when(F.col("_tag") == 0, F.col("_n"))).alias("_low"))
    return both.select(*keys, "_us", "_seq", "_rank", (F.col("_rank") - F.col("_low")).alias("_cnt"))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, (a[k].eqNullSafe(b[k]) for k in keys), F.lit(True))


def _ranked(events: DataFrame, keys: list[str], ts: str, seq: str, window_us: int, stages: Stages) -> DataFrame:
    """Ranks of the events that count, with _alone for keys of undated events only."""
    dated = events.where(F.col(ts).isNotNull()).select(*keys, micros_of(ts).alias("_when"), F.col(seq).alias("_id"), F.lit(False).alias("_alone"))
    some = dated.select(*keys).distinct() if keys else dated.limit(1).select(F.lit(1).alias("_some"))
    undated = events.where(F.col(ts).isNull()).select(*keys, F.lit(0).cast("long").alias("_when"), F.col(seq).alias("_id"), F.lit(True).alias("_alone"))
    alone = undated.join(some, _same(undated, some, keys), "left_anti")
    rows = dated.unionByName(alone)
    return window_ranks(rows, [*keys, "_alone"], "_when", "_id", window_us, stages)


def _first_crossings(ranks: DataFrame, keys: list[str], op: str, value: int) -> DataFrame:
    """(keys, _alone, _first, _x): the rank before the key's first row, and its first crossing."""
    crossing = OPS[op](F.col("_cnt"), F.lit(value))
    x = F.struct(F.col("_rank").alias("rank"), F.col("_us").alias("us"), F.col("_cnt").alias("cnt"))
    found = ranks.groupBy(*keys, "_alone").agg(F.min(F.when(crossing, x)).alias("_x"), (F.min("_rank") - 1).alias("_first"), F.max("_rank").alias("_last"))
    every = F.col("_last") - F.col("_first")
    # undated events have no window: all of a key's are one
    whole = F.when(OPS[op](every, F.lit(value)), F.struct(F.col("_last").alias("rank"), F.lit(None).cast("long").alias("us"), every.alias("cnt")))
    return found.withColumn("_x", F.when(F.col("_alone"), whole).otherwise(F.col("_x"))).where("_x is not null").drop("_last")


def threshold_in_blocks(events: DataFrame, keys: list[str], ts: str, seq: str, window_us: int, op: str, value: int) -> DataFrame:
    """What ``windows.threshold`` gives, for no key or for keys of any size: no window holds more than a
    block of rows. ``seq`` numbers the events. An eager step: the blocks are written."""
    ranks = _ranked(events, keys, ts, seq, window_us, Stages(events.sparkSession, "threshold"))
    hit = _first_crossings(ranks, keys, op, value)
    to = F.col("_x.rank") - F.col("_first")
    return hit.select(*keys, F.timestamp_micros("_x.us").alias("last_seen"), F.col("_x.cnt").alias("match_count"), (to - F.col("_x.cnt") + 1).alias("rn_from"), to.alias("rn_to"))


def evidence_in_blocks(events: DataFrame, keys: list[str], ts: str, seq: str, window_us: int, op: str, value: int) -> DataFrame:
    """What ``windows.threshold_evidence`` gives, as ``threshold_in_blocks`` finds it."""
    stages = Stages(events.sparkSession, "threshold")
    ranks = stages.save(_ranked(events, keys, ts, seq, window_us, stages), "ranks")
    hit = _first_crossings(ranks, keys, op, value)
    joined = ranks.join(hit, _same(ranks, hit, [*keys, "_alone"])).where((F.col("_rank") <= F.col("_x.rank")) & (F.col("_rank") > F.col("_x.rank") - F.col("_x.cnt")))
    chosen = joined.select("_seq", F.col("_x.cnt").alias("match_count"), (F.col("_rank") - F.col("_x.rank") + F.col("_x.cnt")).alias("evidence_rank"))
    return events.join(chosen, events[seq] == chosen["_seq"]).drop("_seq")


def ordered_chain_in_blocks(firings: DataFrame, rules: list[str], timespan_us: int, ts: str = "ts", rule: str = "rule_id", seq: str = "seq") -> DataFrame:
    """``correlation.ordered_chain`` without keys: one row at most. The least completion of what follows
    is a running minimum from the end, within a block by a window, across blocks by what is carried.
    Firings of one instant stay in one block."""
    stages = Stages(firings.sparkSession, "chain")
    rows = in_blocks(firings.where(F.col(ts).isNotNull() & F.col(rule).isin(list(rules))).select(micros_of(ts).alias("_us"), F.col(rule).alias("_rule"), F.col(seq).alias("_seq")), ["_us"], stages)
    ahead = from_the_end(["_block"], "_us")
    least = lambda a, b: b if a is None else a if b is None else min(a, b)
    n, chain = len(rules), None
    for k in range(n, 0, -1):
        here = F.array(F.col("_us"), F.col("_seq"))
        if k < n:
            later, _ = carried(rows, F.min("_chain"), least, None, backward=True)
            behind = {b: v for b, v in later.items() if v is not None}
            rest = F.coalesce(*(F.when(F.col("_block") == b, F.array(*map(F.lit, v))) for b, v in behind.items()), F.lit(None).cast("array<long>"))
            rows = rows.withColumn("_next", F.least(F.min("_chain").over(ahead), rest))
            here = F.concat(here, F.col("_next"))
        chain = F.when(F.col("_rule") == rules[k - 1], here if k == n else F.when(F.col("_next").isNotNull(), here))
        rows = stages.save(rows.select("_us", "_rule", "_seq", "_block", chain.cast("array<long>").alias("_chain")), f"chain{k}")
    best = rows.where(F.col("_chain").isNotNull() & (F.col("_chain")[2 * n - 2] - F.col("_us") <= timespan_us)).agg(F.min("_chain").alias("c")).where("c is not null")
    return best.select(F.timestamp_micros(F.col("c")[0]).alias("started"), F.timestamp_micros(F.col("c")[2 * n - 2]).alias("fired"), *(F.col("c")[2 * k - 1].alias(f"seq_{k}") for k in range(1, n + 1)))


def unordered_chain_in_blocks(firings: DataFrame, rules: list[str], timespan_us: int, ts: str = "ts", rule: str = "rule_id", seq: str = "seq") -> DataFrame:
    """``correlation.unordered_chain`` without keys: each rule's latest firing is a running maximum."""
    stages = Stages(firings.sparkSession, "chain")
    rows = in_blocks(firings.where(F.col(ts).isNotNull() & F.col(rule).isin(list(rules))).select(micros_of(ts).alias("_us"), F.col(rule).alias("_rule"), F.col(seq).alias("_seq")), ["_us", "_rule", "_seq"], stages)
    so_far = Window.partitionBy("_block").orderBy("_us", "_rule", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda a, b: b if a is None else a if b is None else max(a, b)
    marks = []
    for k, name in enumerate(rules):
        own = F.when(F.col("_rule") == name, F.array("_us", "_seq"))
        before, _ = carried(rows, F.max(own), latest, None)
        rest = F.coalesce(*(F.when(F.col("_block") == b, F.array(*map(F.lit, v))) for b, v in before.items() if v is not None), F.lit(None).cast("array<long>"))
        rows = rows.withColumn(f"_l{k}", F.greatest(F.max(own).over(so_far), rest))
        marks.append(F.col(f"_l{k}"))
    oldest = reduce(F.least, (m[0] for m in marks)) if len(marks) > 1 else marks[0][0]
    whole = rows.where(reduce(Column.__and__, (m.isNotNull() for m in marks)) & (F.col("_us") - oldest <= timespan_us))
    first = whole.agg(F.min_by(F.struct("_us", *(f"_l{k}" for k in range(len(rules)))), F.struct("_us", "_rule", "_seq")).alias("c")).where("c is not null")
    n = len(rules)
    return first.select(F.timestamp_micros(F.col("c")[f"_l{n - 1}"][0]).alias("fired"), F.timestamp_micros("c._us").alias("completed"), *(F.col("c")[f"_l{k}"][1].alias(f"seq_{k + 1}") for k in range(n)))
