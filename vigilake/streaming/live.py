"""Continuous detection: keyed state for thresholds and emission, and a rolling buffer for parity."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..durations import parse_duration
from ..plans.detect import TRAVEL, Risk, fired_alerts, with_evidence
from ..plans.rules import Correlation, Rule
from ..session import shared_dir
from ..sources.sinks import append_alerts
from ..stages import delete, exists, names, write_text

MOST_BUFFERED = 50_000


def horizon_seconds(rules: list[Rule], correlations: list[Correlation], alert_window: str = "5m", dedup_window: str = "5m", travel: bool = True) -> int:
    """How far back events matter: the longest window in use, and the dedup window on top."""
    windows = [parse_duration(alert_window), parse_duration(dedup_window)]
    windows += [r.window(alert_window) for r in rules] + [parse_duration(c.timespan) for c in correlations]
    if travel:
        windows.append(parse_duration(TRAVEL.timespan))
    return max(windows) + parse_duration(dedup_window)


def stream_threshold(events: DataFrame, key: str, window_us: int, value: int, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Each key's first crossing of ``value`` events within the window, as the batch operator gives it.

    State per key: the times inside the window, how many events came before, and whether it fired.
    Events of a key must come in order of time between batches; a watermark on ``ts`` bounds how late.
    """

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, seen, fired = state.get if state.exists else ([], 0, False)
        times, seen, fired = list(times), int(seen), bool(fired)
        rows = pd.concat(list(frames)).sort_values(["us", "seq"], kind="stable")
        out = []
        for us in rows["us"].tolist() if not fired else ():
            seen += 1
            times = [t for t in times if t >= us - window_us] + [us]
            if len(times) >= value:
                out.append((group[0], pd.Timestamp(us, unit="us"), len(times), seen - len(times) + 1, seen))
                fired, times = True, []
                break
        state.update((times, seen, fired))
        if out:
            yield pd.DataFrame(out, columns=[key, "last_seen", "match_count", "rn_from", "rn_to"])

    rows = events.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(seq).alias("seq"))
    return rows.groupBy("k").applyInPandasWithState(
        step, f"{key} string, last_seen timestamp, match_count long, rn_from long, rn_to long", "times array<long>, seen long, fired boolean", "append", GroupStateTimeout.NoTimeout
    )


def stream_sessions(alerts: DataFrame, keys: list[str], gap: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Bursts of a key with gaps up to ``gap``, merged as they grow: keys, first_seen, last_seen, occurrences."""
    rows = alerts.withWatermark(ts, late)
    out = rows.groupBy(F.session_window(ts, gap), *keys).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("occurrences"))
    return out.drop("session_window")


def emission_gate(alerts: DataFrame, key: str, ts: str, window_us: int, late: str = "1 hour") -> DataFrame:
    """Alerts of a stream whose key hasn't been emitted within the window before (nor after: an alert
    older than the last emission is silent too). Emissions, not suppressed alerts, move the window.

    A key's state goes when the watermark (``late`` behind the newest alert) has passed its window: no
    alert still to come could be silenced by it. Alerts later than that are dropped."""
    columns = alerts.columns

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("_us", kind="stable")
        keep = []
        for us in rows["_us"].tolist():
            keep.append(last is None or us - last > window_us)
            last = us if keep[-1] else last
        state.update((last,))
        state.setTimeoutTimestamp(max((last + window_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[keep, columns]

    rows = alerts.withWatermark(ts, late).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    return rows.groupBy(key).applyInPandasWithState(step, alerts.schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


class LiveMonitor:
    """Micro-batches into a rolling buffer, over which all rules run again; alerts not told before go to
    the store and the sinks.

    State is tables in ``folder``, a set for each batch: the buffer (events no older than the horizon
    before the newest, undated ones always, and the newest ``MOST_BUFFERED`` of all) and, for each alert
    key told within the horizon, when. A batch's last act is a marker with the counts so far. So a
    monitor of the same folder goes on where the last one ended and tells no alert twice, and a batch
    that is run again replaces what it had begun: the store takes each batch once, other sinks may see
    the alerts of a batch again that was cut short behind them.
    """

    def __init__(self, spark: SparkSession, rules: list[Rule], correlations: list[Correlation], sinks: Iterable[Callable[[DataFrame], object]] = (),
                 enrich: Callable[[DataFrame], DataFrame] = lambda e: e, alert_window: str = "5m", dedup_window: str = "5m", risk: Risk | None = None,
                 folder: str | None = None, parser: Callable[[DataFrame], DataFrame] | None = None, store: str | None = None):
        self.spark, self.rules, self.correlations, self.sinks, self.enrich = spark, rules, correlations, list(sinks), enrich
        self.alert_window, self.dedup_window, self.risk, self.parser, self.store = alert_window, dedup_window, risk, parser, store
        self.horizon = horizon_seconds(rules, correlations, alert_window, dedup_window)
        self.base = folder or f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
        self.done = {int(name.removeprefix("batch-")): f"{self.base}/state/{name}" for name in names(spark, f"{self.base}/state") if exists(spark, f"{self.base}/state/{name}/DONE")}
        last = self.spark.read.text(f"{self.done[max(self.done)]}/DONE").head()[0] if self.done else None
        self.counts = json.loads(last) if last else {"lines": 0, "events": 0, "alerts": 0, "newest": None}

    def _save(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _arrived(self, rows: DataFrame, path: str, batch: int) -> tuple[DataFrame, dict]:
        """The batch's events, written, with the counts that this one job has observed (in the session of
        the batch, a query's own: an observed session can't ship trained models)."""
        lines, seen = Observation(), Observation()
        count = F.count(F.lit(1)).alias("n")
        events = self.parser(rows.observe(lines, count)) if self.parser else rows
        saved = self._save(events.observe(seen, count, F.max("@timestamp").cast("string").alias("newest")).withColumn("_batch", F.lit(batch)), path)
        return saved, {"lines": lines.get["n"] if self.parser else 0, "events": seen.get["n"], "newest": seen.get["newest"]}

    def trimmed(self, events: DataFrame, newest: str | None) -> DataFrame:
        near = F.col("@timestamp").isNull() | (F.col("@timestamp") >= F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {self.horizon} SECONDS"))
        return events.where(near).orderBy(F.desc_nulls_first("@timestamp"), F.desc("_batch"), F.desc("ingest_seq")).limit(MOST_BUFFERED)

    def on_batch(self, rows: DataFrame, batch_id: int | None = None) -> DataFrame:
        """Takes new events (or lines, with a ``parser``) in, and returns the alerts not told before."""
        batch = max(self.done, default=-1) + 1 if batch_id is None else batch_id
        path = f"{self.base}/state/batch-{batch:09d}"
        if batch in self.done:
            return self.spark.read.parquet(f"{path}/fresh")
        before = self.done.get(max((b for b in self.done if b < batch), default=None))
        new, counted = self._arrived(rows, f"{path}/new", batch)
        newest = max(filter(None, (self.counts["newest"], counted["newest"])), default=None)
        whole = new if before is None else self.spark.read.schema(new.schema).parquet(f"{before}/buffer").unionByName(new)
        buffer = self._save(self.trimmed(whole, newest), f"{path}/buffer")
        # numbers of files and batches may meet: the buffer's order is one number, over no more than MOST_BUFFERED rows
        numbered = buffer.withColumn("ingest_seq", F.row_number().over(Window.orderBy("_batch", "ingest_seq")).cast("long")).drop("_batch")
        held = self._save(self.enrich(numbered), f"{path}/held")
        found = fired_alerts(held, self.rules, self.correlations, self.alert_window, risk=self.risk, dedup_window=self.dedup_window)
        found = found.withColumn("mode", F.lit("live")).withColumn("_key", F.concat_ws("|", "rule_id", F.coalesce("group_value", F.col("events")[0]["source"]["ip"], F.lit(""))))
        at = F.coalesce("timestamp", F.current_timestamp()).alias("at")
        told = None if before is None else self.spark.read.schema("_key string, at timestamp").parquet(f"{before}/told")
        if told is not None:
            quiet = F.expr(f"coalesce(timestamp, current_timestamp()) <= _last + INTERVAL {parse_duration(self.dedup_window)} SECONDS")
            found = found.join(told.withColumnRenamed("at", "_last"), "_key", "left").where(~F.coalesce(quiet, F.lit(False))).drop("_last")
        fresh = self._save(found, f"{path}/told_now")
        out = self._save(with_evidence(fresh, held).drop("_key"), f"{path}/fresh")
        now = fresh.select("_key", at)
        since = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {self.horizon + parse_duration(self.dedup_window)} SECONDS")
        kept = (now if told is None else told.unionByName(now)).groupBy("_key").agg(F.max("at").alias("at")).where(F.coalesce(F.col("at") >= since, F.lit(True)))
        self._save(kept, f"{path}/told")
        if self.store:
            append_alerts(out.drop("scope"), self.store, batch=f"live-{batch:09d}")
        for sink in self.sinks:
            sink(out)
        sums = {k: self.counts[k] + n for k, n in (("lines", counted["lines"]), ("events", counted["events"]), ("alerts", fresh.count()))}
        write_text(self.spark, f"{path}/DONE", json.dumps(sums | {"newest": newest}))
        self.counts, self.done[batch] = sums | {"newest": newest}, path
        for old in sorted(self.done)[:-2]:
            delete(self.spark, self.done.pop(old))
        return out

    def start(self, rows: DataFrame, checkpoint: str | None = None, **trigger):
        """A streaming query that feeds ``on_batch``; its checkpoint is in the monitor's folder."""
        writer = rows.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint or f"{self.base}/checkpoint")
        return (writer.trigger(**trigger) if trigger else writer).start()


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns its rows."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("append" if mode == "append" else "overwrite").parquet(f"{base}/out")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
