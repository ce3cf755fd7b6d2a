"""Temporal correlations over rule firings, and sequences of logins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import from_the_end


def group_key(events: str, path: str) -> Column:
    """The first value that isn't null, of a field over an alert's evidence."""
    return F.get(F.filter(F.transform(events, lambda e: e.getField(path)), lambda x: x.isNotNull()), F.lit(0))


def ordered_chain(firings: DataFrame, keys: list[str], rules: list[str], timespan_us: int, ts: str = "ts", rule: str = "rule_id", seq: str = "seq") -> DataFrame:
    """Per key the first firing of the first rule from which each next rule fires at or after the one
    before, all within the timespan: keys, started, fired, and seq_1 .. seq_n of the firings.

    A backward pass of running minima: for each firing, the earliest completion of what follows.
    Firings without a time or a key take no part.
    """
    rows = _usable(firings, keys, ts)
    ahead = from_the_end(keys, "_us")
    chain: Column | None = None
    for k, name in list(enumerate(rules, 1))[::-1]:
        fields = [F.col("_us").alias(f"us_{k}"), F.col(seq).alias(f"seq_{k}")]
        if chain is not None:
            rows = rows.withColumn("_next", F.min(chain).over(ahead))
            fields += [F.col("_next").getField(f"{p}_{j}").alias(f"{p}_{j}") for j in range(k + 1, len(rules) + 1) for p in ("us", "seq")]
        here = F.col(rule) == name
        chain = F.when(here if chain is None else here & F.col("_next").isNotNull(), F.struct(*fields))
        rows = rows.withColumn("_chain", chain)
        chain = F.col("_chain")
    n = len(rules)
    whole = rows.where(F.col("_chain").isNotNull() & (F.col(f"_chain.us_{n}") - F.col("_chain.us_1") <= timespan_us))
    first = whole.groupBy(*keys).agg(F.min("_chain").alias("c"))
    return first.select(*keys, F.timestamp_micros("c.us_1").alias("started"), F.timestamp_micros(f"c.us_{n}").alias("fired"), *(F.col(f"c.seq_{k}") for k in range(1, n + 1)))


def unordered_chain(firings: DataFrame, keys: list[str], rules: list[str], timespan_us: int, ts: str = "ts", rule: str = "rule_id", seq: str = "seq") -> DataFrame:
    """Per key the first moment at which every rule has fired within the timespan: keys, fired (the
    time of the last-listed rule's firing), completed, and seq_1 .. seq_n, each rule's latest."""
    rows = _usable(firings, keys, ts).where(F.col(rule).isin(list(rules)))
    so_far = Window.partitionBy(*keys).orderBy("_us", rule, seq).rowsBetween(Window.unboundedPreceding, 0)
    for k, name in enumerate(rules, 1):
        rows = rows.withColumn(f"_l{k}", F.max(F.when(F.col(rule) == name, F.struct("_us", seq))).over(so_far))
    marks = [F.col(f"_l{k}") for k in range(1, len(rules) + 1)]
    seen = reduce(Column.__and__, (m.isNotNull() for m in marks))
    oldest = F.least(*(m.getField("_us") for m in marks))
    whole = rows.where(seen & (F.col("_us") - oldest <= timespan_us))
    first = whole.groupBy(*keys).agg(F.min_by(F.struct("_us", *(f"_l{k}" for k in range(1, len(rules) + 1))), F.struct("_us", rule, seq)).alias("c"))
    n = len(rules)
    return first.select(
        *keys, F.timestamp_micros(F.col("c").getField(f"_l{n}").getField("_us")).alias("fired"), F.timestamp_micros("c._us").alias("completed"),
        *(F.col("c").getField(f"_l{k}").getField(seq).alias(f"seq_{k}") for k in range(1, n + 1)),
    )


def _usable(firings: DataFrame, keys: list[str], ts: str) -> DataFrame:
    present = reduce(Column.__and__, (F.col(k).isNotNull() for k in [*keys, ts]))
    return firings.where(present).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))


def impossible_travel(logins: DataFrame, span_us: int, user: str = "user", country: str = "country", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Per user the first two successive logins from different countries within the span: user,
    from_country, to_country, previous_ts, ts, seq_1, seq_2. Logins without country, user or time
    are passed over."""
    rows = _usable(logins, [user, country], ts)
    order = Window.partitionBy(user).orderBy("_us", seq)
    rows = rows.withColumn("_prev", F.lag(F.struct("_us", F.col(country).alias("country"), F.col(seq).alias("seq"), F.col(ts).alias("ts"))).over(order))
    hits = rows.where((F.col("_prev.country") != F.col(country)) & (F.col("_us") - F.col("_prev._us") <= span_us))
    first = hits.groupBy(user).agg(F.min(F.struct("_us", F.col(seq).alias("seq"), F.col("_prev").alias("p"), F.col(country).alias("country"), F.col(ts).alias("ts"))).alias("h"))
    return first.select(
        user, F.col("h.p.country").alias("from_country"), F.col("h.country").alias("to_country"), F.col("h.p.ts").alias("previous_ts"), F.col("h.ts").alias("ts"),
        F.col("h.p.seq").alias("seq_1"), F.col("h.seq").alias("seq_2"),
    )
