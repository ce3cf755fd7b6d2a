"""The detection side: compilers on the driver, operators on small tables."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from vigilake.config import load_config
from vigilake.durations import parse_duration
from vigilake.operators import enrichment as E
from vigilake.operators.corpus import evaluate, load_cases
from vigilake.operators.correlation import ordered_chain, unordered_chain
from vigilake.operators.risk import entity_scores
from vigilake.operators.windows import dedup, max_window_sum, threshold
from vigilake.plans.condition import compile_selection, parse_condition
from vigilake.plans.rules import load_rules, rule_from_document, suppressed_ids
from vigilake.plans.sigma import import_document, merge_native_first
from vigilake.queries.lookups import PLACES
from vigilake.sources import parsers as P
from vigilake.sources.sinks import Push, append_alerts, build_pushes, header_text, http_url, read_alerts
from vigilake.sources.tail import TailReader
from vigilake.streaming.live import LiveMonitor, horizon_seconds

S = 1_000_000


def test_durations_and_config(tmp_path):
    assert [parse_duration(x) for x in ("5s", " 2m ", "1h", "3d")] == [5, 120, 3600, 259200]
    for bad in ("5", "m", "1.5h", "5x", ""):
        with pytest.raises(ValueError):
            parse_duration(bad)
    (tmp_path / "c.json").write_text(json.dumps({"alert_window": "1m", "sources": ["auth.log"]}))
    assert load_config(tmp_path / "c.json").alert_window == "1m" and load_config(default=tmp_path / "none").dedup_window == "5m"
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "missing.json")
    (tmp_path / "c.json").write_text(json.dumps({"alert_window": "soon"}))
    with pytest.raises(ValueError):
        load_config(tmp_path / "c.json")


def test_rule_documents():
    rules, correlations = load_rules()
    assert len(rules) == 8 and [c.id for c in correlations] == ["ssh-bruteforce-success-001"]
    assert suppressed_ids(correlations) == {"ssh-login-success-001"}
    doc = {"id": "x", "title": "X", "detection": {"s": {"a": 1}, "condition": "s"}}
    assert rule_from_document(doc).level == "medium"
    for change in ({"id": ""}, {"detection": {"condition": "s"}}, {"detection": {"s": {"a|near": 1}, "condition": "s"}}, {"detection": {"s": {"a": 1}, "condition": "s and ("}},
                   {"detection": {"s": {"a": 1}, "condition": "s | sum(x) > 1"}}, {"correlation": {"type": "temporal", "rules": ["a"], "timespan": "1m"}},
                   {"correlation": {"type": "other", "rules": ["a", "b"], "timespan": "1m"}}, {"correlation": {"type": "temporal", "rules": ["a", "a"], "timespan": "1m"}}):
        with pytest.raises(ValueError):
            rule_from_document({**doc, **change})
    threshold_tail = parse_condition("s | count() by source.ip >= 5").threshold
    assert (threshold_tail.by, threshold_tail.op, threshold_tail.value) == ("source.ip", ">=", 5)
    with pytest.raises(ValueError):
        parse_condition("1 of")


def test_import():
    good = import_document({"id": "a", "title": "A", "logsource": {"category": "process_creation"}, "detection": {"s": {"Image|endswith": "\\x.exe"}, "condition": "s"}})
    assert good.rule.selections == {"s": {"process.executable|endswith": "\\x.exe"}} and good.rule.logsource["category"] == "process"
    assert import_document({"title": "B", "detection": {"k": ["evil"], "condition": "k"}}).reasons == ("keywords in k",)
    native, _ = load_rules()
    assert len(merge_native_first(native, [good.rule, native[0]])) == len(native) + 1


def test_predicates(spark):
    rows = spark.createDataFrame([(1, "Alpha Beta", "x"), (2, None, "y"), (3, "a+b", None), (4, "line\rend", "z")], "k int, t string, u string")
    pick = lambda selection, condition="s": sorted(r["k"] for r in rows.where(parse_condition(condition).predicate({"s": compile_selection(selection, F.col)})).collect())
    assert pick({"t|contains": "PHA b"}) == [1] and pick({"t|contains": "%"}) == [] and pick({"t|startswith": "A+"}) == [3] and pick({"t": "alpha beta"}) == [1]
    assert pick({"t|contains": "alpha"}, "not s") == [2, 3, 4]
    assert pick({"t|re": "[a-z]+ B"}) == [1] and pick({"t|re": "beta"}) == [] and pick({"t|re": "line$"}) == []
    with pytest.warns(UserWarning):
        assert pick({"t|re": "("}) == []
    with pytest.warns(UserWarning):
        assert pick({"t|re": "a" * 1025}) == []
    assert pick([{"t": "a+b"}, {"u": ["y", "Z"]}]) == [2, 3, 4]
    assert pick({"t": "a+b"}, "1 of nothing* or s and not ghost") == [3]


def _events(n, seed):
    rng = random.Random(seed)
    return [(k, rng.randrange(3), rng.randrange(40), rng.choice("ABC"), rng.randrange(1, 9)) for k in range(n)]


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "seq long, g int, s int, rule_id string, score long")
    return df.withColumn("ts", F.timestamp_seconds("s"))


def test_windows_against_sweeps(spark):
    rows = _events(60, 1)
    df = _frame(spark, rows)
    groups = {g: sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])) for g in range(3)}
    for op, test in ((">=", lambda c: c >= 3), ("==", lambda c: c == 4), ("<", lambda c: c < 2)):
        want = {}
        for g, own in groups.items():
            for k, r in enumerate(own):
                n = sum(r[2] - x[2] <= 5 for x in own[: k + 1])
                if test(n):
                    want[g] = (n, k + 1)
                    break
        got = {r["g"]: (r["match_count"], r["rn_to"]) for r in threshold(df, ["g"], "ts", "seq", 5 * S, op, {">=": 3, "==": 4, "<": 2}[op]).collect()}
        assert got == want
    bursts = []
    for own in groups.values():
        last = None
        for r in own:
            if last is None or r[2] - last > 3:
                bursts.append([r[0], 0])
            bursts[-1][1] += 1
            last = r[2]
    assert sorted((r["seq"], r["occurrences"]) for r in dedup(df, ["g"], "ts", "seq", 3 * S).collect()) == sorted(map(tuple, bursts))
    for r in max_window_sum(df, ["g"], "ts", "seq", "score", 5 * S).collect():
        own = groups[r["g"]]
        sums = [sum(x[4] for x in own[: k + 1] if y[2] - x[2] <= 5) for k, y in enumerate(own)]
        assert r["max_sum"] == max(sums) and r["window_end"].second == own[sums.index(max(sums))][2]


def test_chains_against_search(spark):
    rows = _events(50, 7)
    df = _frame(spark, rows)
    for rules in (["A", "B"], ["B", "A", "C"]):
        want = {}
        for g in range(3):
            own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
            for r in (x for x in own if x[3] == rules[0]):
                at = r[2]
                for name in rules[1:]:
                    later = [x[2] for x in own if x[3] == name and x[2] >= at]
                    at = min(later, default=None)
                    if at is None:
                        break
                if at is not None and at - r[2] <= 6:
                    want[g] = (r[2], at)
                    break
        got = {r["g"]: (r["started"].second, r["fired"].second) for r in ordered_chain(df, ["g"], rules, 6 * S).collect()}
        assert got == want
        want = {}
        for g in range(3):
            last = {}
            for r in sorted((r for r in rows if r[1] == g and r[3] in rules), key=lambda r: (r[2], r[3], r[0])):
                last[r[3]] = r[2]
                if len(last) == len(rules) and r[2] - min(last.values()) <= 4:
                    want[g] = (last[rules[-1]], r[2])
                    break
        got = {r["g"]: (r["fired"].second, r["completed"].second) for r in unordered_chain(df, ["g"], rules, 4 * S).collect()}
        assert got == want


def test_ordered_chains_sum_no_frame_anew(spark, monkeypatch):
    """No window runs up to an unbounded following (quadratic in its rows); firings of one instant follow each other either way."""
    from vigilake.operators.blocks import Stages, ordered_chain_in_blocks

    plans, save = [], Stages.save
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().lower()
    monkeypatch.setattr(Stages, "save", lambda self, df, *a: plans.append(plan(df)) or save(self, df, *a))
    rows = _events(300, 11)
    df = _frame(spark, rows).select("*", F.lit(0).alias("all"))
    for rules in (["A", "B"], ["B", "A", "C"]):
        one, blocks = ordered_chain(df, ["all"], rules, 6 * S), ordered_chain_in_blocks(df, rules, 6 * S)
        plans.append(plan(one))
        assert one.drop("all").collect() == blocks.collect()
    assert sum("window" in p for p in plans) >= 5 and not any("unboundedfollowing" in p for p in plans)


def test_addresses(spark):
    ips = spark.createDataFrame([(x,) for x in ("130.44.3.70", "130.44.9.9", "10.1.2.3", "2a00:1::5", "fe80::1", "nonsense", "300.1.1.1", None)], "ip string")
    geo = E.geo_frame(spark, [*PLACES, ("2a00:1::/33", "V6", "Six", 1, "x"), ("fe80::/10", "LL", "Link", 2, "y"), ("bad", "", "", 0, "")])
    got = {r["ip"]: r["country_iso"] for r in E.geo_lookup(ips, "ip", geo).collect()}
    assert got == {"130.44.3.70": "ZA", "130.44.9.9": "NG", "10.1.2.3": None, "2a00:1::5": "V6", "fe80::1": None, "nonsense": None, "300.1.1.1": None, None: None}
    trust = {r["ip"]: r["trusted"] for r in E.asset_lookup(ips, "ip", E.asset_frame(spark, [("10.1.0.0/16", "a", True)])).collect()}
    assert trust["10.1.2.3"] is True and trust["nonsense"] is False and trust[None] is None


def test_dilution(spark):
    alerts = spark.createDataFrame([(90, ["1.1.1.1"], [f"u{k}" for k in range(10)], None), (60, [], [], "1.1.1.1"), (5, ["2.2.2.2"] * 2, [f"u{k}" for k in range(9)], "web")], "score long, ips array<string>, users array<string>, grp string")
    rows = entity_scores(alerts, {"source.ip": F.col("ips"), "user.name": F.col("users")}, group_value="grp").groupBy("field", "entity").agg(F.sum("share").alias("s")).collect()
    got = {(r["field"], r["entity"]): r["s"] for r in rows}
    assert got["source.ip", "1.1.1.1"] == 150 and got["user.name", "u0"] == 10 and got["source.ip", "2.2.2.2"] == 5


def test_parsers_skip_and_keep(spark):
    lines = lambda *x: spark.createDataFrame([(k, v) for k, v in enumerate(x)], "ingest_seq long, value string")
    auth = P.parse_auth_log(lines("", "noise", "Feb 29 10:00:00 h sshd[1]: Failed password for invalid user bob from 1.2.3.4 port 5 ssh2", "Mar  1 10:00:00 h CRON[1]: x"), 2023).collect()
    assert len(auth) == 1 and auth[0]["@timestamp"] is None and auth[0]["user"]["name"] == "bob" and auth[0]["source"]["port"] == 5
    web = P.parse_access_log(lines('1.1.1.1 - - [01/Mar/2024:10:00:00 +0200] "GET /a b HTTP/1.1" 404 - "-" "ua"', '1.1.1.1 - bob [bad] "-" - 7', "x")).orderBy("ingest_seq").collect()
    assert web[0]["url"]["original"] == "/a b" and web[0]["event"]["outcome"] == "failure" and web[0]["@timestamp"].hour == 8 and web[0]["http"]["request"]["referrer"] == "-"
    assert web[1]["url"] is None or web[1]["url"]["original"] is None
    end = P.parse_endpoint(lines('{"EventID": 1.0, "Image": "C:\\\\w\\\\x.exe", "UtcTime": "2024-01-01 00:00:00"}', "{bad", '{"EventID": 7}')).collect()
    assert len(end) == 1 and end[0]["process"]["name"] == "x.exe" and end[0]["@timestamp"].year == 2024
    fw = P.parse_firewall(lines("SRC=1.1.1.1 src=2.2.2.2 PROTO=udp IN= DPT=x", "kernel: DST=1.1.1.1"), 2024).collect()
    assert len(fw) == 1 and fw[0]["source"]["ip"] == "2.2.2.2" and fw[0]["network"]["direction"] is None and fw[0]["destination"]["port"] is None and fw[0]["@timestamp"] is None
    with pytest.raises(KeyError):
        P.parse("syslog", lines("x"), 2024)
    with pytest.raises(ValueError):
        P.parse("auth.log", lines("x"), 2024, enabled=("firewall",))


def test_labelled_cases(spark):
    rules, correlations = load_rules()
    cases = load_cases()
    assert len(cases) == 14
    geo = E.geo_frame(spark, PLACES)
    report = evaluate(spark, cases, rules, correlations, lambda e: E.enrich_events(e, geo=geo))
    rows = {r["rule_id"]: r for r in report.matrix.collect()}
    assert report.misses.collect() == [] and report.benign_alerts.collect() == []
    assert all(r["fp"] == 0 and r["fn"] == 0 for r in rows.values())
    assert rows["port-scan-001"]["tp"] == 2 and rows["impossible-travel-001"]["tp"] == 1 and rows["ssh-bruteforce-success-001"]["recall"] == 1.0




def test_sinks(spark, tmp_path):
    path = str(tmp_path / "alerts")
    assert read_alerts(spark, path).count() == 0
    alerts = spark.createDataFrame([("r", "Rule\r\nX: y", "critical", "g"), ("q", "Low", "low", None)], "rule_id string, rule_title string, severity string, group_value string").withColumn("match_count", F.lit(3).cast("long"))
    append_alerts(alerts, path)
    append_alerts(alerts, path)
    (tmp_path / "alerts" / "broken.json").write_text("{nope\n")
    assert read_alerts(spark, path).count() == 4 and {r["mode"] for r in read_alerts(spark, path).collect()} == {"simulation"}
    append_alerts(alerts, path, reset=True)
    assert read_alerts(spark, path).count() == 2
    sent = []
    assert Push("https://h/x", post=lambda *a: sent.append(a)).emit(alerts) == 1
    assert "\n" not in sent[0][2]["Title"] and sent[0][2]["Priority"] == "5"
    assert Push("https://h/x", post=lambda *a: 1 / 0).emit(alerts) == 0
    assert len(build_pushes([{"url": "file:///etc/passwd"}, {"url": "https://ok/", "type": "webhook"}])) == 1
    assert header_text("a\r\nb") == "ab"
    with pytest.raises(ValueError):
        http_url("gopher://x")


def test_tail(tmp_path):
    path = str(tmp_path / "a.log")
    with open(path, "w") as f:
        f.write("old\n")
    reader = TailReader([path, str(tmp_path / "none")], False)
    start = reader.initialOffset()
    with open(path, "a") as f:
        f.write("one\ntwo\npart")
    end = reader.latestOffset()
    lines = lambda a, b: [x[0] for p in reader.partitions(a, b) for x in reader.read(p)]
    assert lines(start, end) == ["one", "two"]
    with open(path, "a") as f:
        f.write("ial\n")
    later = reader.latestOffset()
    assert lines(end, later) == ["partial"]
    os.rename(path, path + ".1")
    with open(path, "w") as f:
        f.write("fresh\n")
    assert lines(later, reader.latestOffset()) == ["fresh"]


def test_live(spark):
    rules, correlations = load_rules()
    assert horizon_seconds(rules, correlations) == 3900
    told = []
    monitor = LiveMonitor(spark, rules, correlations, [lambda a: told.extend(r["rule_id"] for r in a.select("rule_id").collect())])
    line = "Mar  1 10:0{}:{:02d} bastion-2 sshd[1]: Failed password for root from 192.0.2.66 port 4 ssh2".format
    batch = lambda *x: P.parse_auth_log(spark.createDataFrame([(k, v) for k, v in enumerate(x)], "ingest_seq long, value string"), 2024)
    monitor.on_batch(batch(*(line(0, s) for s in range(4))))
    assert told == []
    monitor.on_batch(batch(line(0, 30)))
    assert told == ["ssh-bruteforce-001"]
    monitor.on_batch(batch(line(1, 0)))
    assert told == ["ssh-bruteforce-001"] and monitor.counts["alerts"] == 1
