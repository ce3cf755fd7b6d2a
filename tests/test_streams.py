"""Streams: any order of arrival, restarts from checkpoints, rotation, batches run twice."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from vigilake.operators.correlation import ordered_chain, unordered_chain
from vigilake.operators.windows import max_window_sum
from vigilake.plans.rules import load_rules
from vigilake.sources.parsers import parse
from vigilake.sources.sinks import append_alerts, read_alerts
from vigilake.sources.tail import TailReader, TailSource
from vigilake.streaming.gate import keyed_state, stateful_gate
from vigilake.streaming.live import LiveMonitor, drained
from vigilake.streaming.ordered import FirstCrossing, OrderedChain, PeakSum, UnorderedChain, stream_ordered_chain, stream_peaks, stream_unordered_chain, undated

T0 = dt.datetime(2024, 3, 1, 10, 0, 0)
MINUTE = 60_000_000


def rows_of_three_keys(n=240):
    rng = random.Random(3)
    return [(f"k{rng.randrange(3)}", T0 + dt.timedelta(seconds=20 * rng.randrange(n)), rng.choice("abc"), k, rng.randrange(1, 9)) for k in range(n)]


def test_any_order_of_arrival_gives_the_batch_result(spark, tmp_path):
    rows = rows_of_three_keys()
    ddl = "key string, ts timestamp, rule_id string, seq long, score long"
    random.Random(5).shuffle(rows)
    for k in range(0, len(rows), 60):  # each file a batch of its own, in no order of time
        spark.createDataFrame(rows[k : k + 60], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # the last file holds a heartbeat, by which the watermark passes all, and rows without time or key
    beat = [("", T0 + dt.timedelta(days=30), "", -1, 0), (None, T0, "a", -2, 1), ("k1", None, "a", -3, 1)]
    spark.createDataFrame(beat, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batch, late = spark.createDataFrame(rows, ddl), "6 hours"

    def stamp(us):
        return dt.datetime.fromtimestamp(us / 1e6, dt.UTC).replace(tzinfo=None)

    got = {r["key"]: (stamp(r["started"]), stamp(r["fired"]), *r["seqs"]) for r in drained(stream_ordered_chain(stream, "key", ["a", "b", "c"], 30 * MINUTE, F.col("rule_id"), late=late)).collect()}
    want = {r["key"]: (r["started"], r["fired"], r["seq_1"], r["seq_2"], r["seq_3"]) for r in ordered_chain(batch, ["key"], ["a", "b", "c"], 30 * MINUTE).collect()}
    assert got == want and want
    got = {r["key"]: (stamp(r["fired"]), stamp(r["completed"]), *r["seqs"]) for r in drained(stream_unordered_chain(stream, "key", ["c", "a", "b"], 4 * MINUTE, F.col("rule_id"), late=late)).collect()}
    want = {r["key"]: (r["fired"], r["completed"], r["seq_1"], r["seq_2"], r["seq_3"]) for r in unordered_chain(batch, ["key"], ["c", "a", "b"], 4 * MINUTE).collect()}
    assert got == want and want
    told = drained(stream_peaks(stream, "key", 5 * MINUTE, F.col("score"), late=late)).where("key <> ''").groupBy("key").agg(F.max(F.struct("max_sum", "window_start", "window_end", "signals")).alias("x"))
    got = {r["key"]: (r["x"][0], stamp(r["x"][1]), stamp(r["x"][2]), r["x"][3]) for r in told.collect()}
    want = {r["key"]: tuple(r)[1:] for r in max_window_sum(batch, ["key"], "ts", "seq", "score", 5 * MINUTE).collect()}
    assert got == want
    assert [r["seq"] for r in drained(undated(stream, "ts")).collect()] == [-3]


def test_what_automata_remember_is_bounded_by_the_window():
    chain, peak, crossing, any_order = OrderedChain(["a", "b"], 100), PeakSum(100), FirstCrossing(100, 50), UnorderedChain(["a", "b"], 100)
    for k in range(5000):
        list(chain.take([(k * 10, "a", k, 1)]))
        list(peak.take([(k * 10, "a", k, 1)]))
        list(any_order.take([(k * 10, "a", k, 1)]))
        crossing.take(k * 10)
    assert len(chain.waiting[0]) <= 11 and len(peak.before) <= 11 and len(peak.inside) <= 11 and len(crossing.times) <= 11 and len(any_order.last) == 1
    again = OrderedChain(["a", "b"], 100, chain.memory())
    assert list(again.take([(50_000, "b", 9, 1)])) == list(chain.take([(50_000, "b", 9, 1)])) == [(49_900, 50_000, [4990, 9])]


def test_gate_restarted_tells_nothing_twice(spark, tmp_path):
    ddl, told, out = "_key string, ts timestamp, n long", str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda *ns: spark.createDataFrame([("k", T0 + dt.timedelta(seconds=s), s) for s in ns], ddl).coalesce(1).write.mode("append").parquet(told)

    def run():
        stream = stateful_gate(spark.readStream.schema(ddl).parquet(told), "_key", "ts", 300_000_000)
        with keyed_state(spark):
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["n"] for r in spark.read.schema(ddl).parquet(out).collect())

    put(0, 100, 100)
    assert run() == [0]
    put(200, 301, 50)
    assert run() == [0, 301]
    assert run() == [0, 301]
    put(900, 500)
    assert run() == [0, 301, 900]


def line(minute, second, ip="192.0.2.66"):
    return f"Mar  1 10:{minute:02d}:{second:02d} bastion-2 sshd[1]: Failed password for root from {ip} port 4 ssh2\n"


def test_watch_goes_on_after_a_restart_and_a_rotation(spark, tmp_path):
    spark.dataSource.register(TailSource)
    log, folder, store = str(tmp_path / "auth.log"), str(tmp_path / "state"), str(tmp_path / "store")
    rules, correlations = load_rules()
    told = []

    def append(*rows, to=log):
        with open(to, "a") as f:
            f.writelines(rows)

    def session(*steps):
        monitor = LiveMonitor(spark, rules, correlations, [lambda a: told.extend((r["rule_id"], r["group_value"]) for r in a.select("rule_id", "group_value").collect())], folder=folder, parser=lambda rows: parse("auth.log", rows, 2024), store=store)
        lines = spark.readStream.format("tail").option("path", log).option("startingPosition", "start").load()
        query = monitor.start(lines, processingTime="0 seconds")
        try:
            for step in steps:
                step()
                query.processAllAvailable()
        finally:
            query.stop()
        return monitor

    append("noise\n", *(line(0, s) for s in range(3)))
    first = session(lambda: None, lambda: append(line(0, 10)))
    assert told == [] and first.counts["lines"] == 5 and first.counts["events"] == 4
    append(line(0, 20))  # written while nobody watches, to a file that is rotated then, twice
    os.rename(log, log + ".1")
    append(line(0, 30), to=log)
    os.rename(log + ".1", log + ".2")
    os.rename(log, log + ".1")
    append(line(0, 40), to=log)
    second = session(lambda: None)
    assert told == [("ssh-bruteforce-001", "192.0.2.66")]
    assert second.counts["lines"] == 8 and second.counts["events"] == 7 and second.counts["alerts"] == 1
    third = session(lambda: None, lambda: append(line(1, 0), line(1, 1, "192.0.2.9")))
    assert told == [("ssh-bruteforce-001", "192.0.2.66")] and third.counts["alerts"] == 1 and third.counts["lines"] == 10
    assert read_alerts(spark, store).count() == 1
    # a batch that is run again is not told again
    batch = max(third.done)
    third.on_batch(spark.createDataFrame([(line(1, 2), log, 0)], "value string, path string, ingest_seq long"), batch)
    assert third.counts["lines"] == 10 and read_alerts(spark, store).count() == 1


def test_a_batch_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("r", "t", "high", T0)], "rule_id string, rule_title string, severity string, timestamp timestamp")
    append_alerts(rows, path, batch="b1")
    append_alerts(rows, path, batch="b1")
    append_alerts(rows, path, batch="b2")
    append_alerts(rows, path)
    assert read_alerts(spark, path).count() == 3


def test_tail_plans_a_batch_alike_after_a_rotation(tmp_path):
    log = str(tmp_path / "a.log")
    with open(log, "w") as f:
        f.write("one\ntwo\nhal")
    reader = TailReader([log], True)
    start, end = reader.initialOffset(), reader.latestOffset()
    texts = lambda a, b: [x[0] for p in reader.partitions(a, b) for x in reader.read(p)]
    assert texts(start, end) == ["one", "two"]
    os.rename(log, log + ".1")
    with open(log + ".1", "a") as f:
        f.write("f\n")
    assert texts(start, end) == ["one", "two"]  # replayed
    with open(log, "w") as f:
        f.write("new\n")
    later = reader.latestOffset()
    assert texts(end, later) == ["half", "new"]
    os.remove(log + ".1")
    assert texts(end, later) == ["new"]
    with open(log, "w") as f:
        f.write("x\n")
    assert texts(later, reader.latestOffset()) == ["x"]  # truncated


def test_pushes_are_bounded_by_time(spark, capsys):
    import time

    from vigilake.sources.sinks import Push

    rows = spark.createDataFrame([(f"r{k}", "t", "high", None, 1) for k in range(5)], "rule_id string, rule_title string, severity string, group_value string, match_count long")
    slow = Push("http://x.example/t", least="low", post=lambda *a: time.sleep(0.3), most_seconds=0.5)
    sent = slow.emit(rows)
    assert 1 <= sent < 5 and f"{5 - sent} left" in capsys.readouterr().err
