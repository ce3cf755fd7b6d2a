"""Risk, enrichment, store, triage, intel files, command line and live forms, end to end."""

import datetime as dt
import ipaddress
import json

import pytest
from pyspark.sql import functions as F

from vigilake import cli
from vigilake.config import Config
from vigilake.functions.ip import is_ip, v6_hex
from vigilake.operators import enrichment as E
from vigilake.operators.corpus import evaluate, load_cases
from vigilake.operators.triage import append_actions, group_into_incident, read_actions, triaged
from vigilake.plans.detect import RISK_RULE, Risk, deduplicated, detect, risk_alerts, rule_alerts, travel_alerts
from vigilake.plans.rules import Rule, load_rules
from vigilake.plans.sigma import import_folder
from vigilake.sources.intel import read_assets, read_blocklist, read_geoip
from vigilake.sources.parsers import parse
from vigilake.sources.sinks import Push, append_alerts, console_table, read_alerts
from vigilake.streaming.live import drained, emission_gate

T0 = dt.datetime(2024, 3, 1, 10, 0, 0)


def lines(spark, source, rows, year=2024):
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "ingest_seq long, value string")
    return parse(source, frame, year)


def failure(minute, user, ip, second=0):
    return f"Mar  1 10:{minute:02d}:{second:02d} bastion-2 sshd[7]: Failed password for {user} from {ip} port 4000 ssh2"


def rule(name, level, **kw):
    return Rule(id=name, title=name, selections={"s": {"event.action": "ssh_login_failed"}}, condition="s", level=level, **kw)


def test_risk_is_shared_among_entities_and_a_rule_may_set_its_own(spark):
    events = lines(spark, "auth.log", [failure(k, f"user{k}", "61.4.88.9") for k in range(4)])
    fired = rule_alerts(events, [rule("a", "medium"), rule("b", "high")])
    found = {(r["risk"]["object"], r["group_value"]): r for r in risk_alerts(fired, Risk(threshold=100)).collect()}
    assert set(found) == {("source.ip", "61.4.88.9")}  # each user has 90, the address all of it
    top = found["source.ip", "61.4.88.9"]
    assert top["risk"]["score"] == 360 and top["severity"] == "critical" and top["rule_id"] == RISK_RULE
    assert len(top["risk"]["contributors"]) == 8 and top["match_count"] == 8 and len(top["events"]) == 4  # evidence once each
    quiet = risk_alerts(fired, Risk(threshold=100, scores={"a": 0, "b": 10}))
    assert quiet.count() == 0


def test_risk_window_leaves_far_alerts_apart(spark):
    events = lines(spark, "auth.log", [failure(0, "u", "61.4.88.9"), failure(40, "u", "61.4.88.9")])
    fired = rule_alerts(events, [rule("b", "high")])
    assert risk_alerts(fired, Risk(window="5m")).count() == 0
    assert risk_alerts(fired, Risk(window="1h")).count() == 2  # the address and the user
    assert risk_alerts(risk_alerts(fired, Risk(window="1h")).drop("risk"), Risk(threshold=1)).count() == 0  # no notable feeds risk


def test_detect_adds_notables_and_enrichment_and_the_store_keeps_them(spark, tmp_path):
    events = lines(spark, "auth.log", [failure(k, "root", "61.4.88.9") for k in range(6)])
    tables = {"blocklist": E.blocklist_frame(spark, ["61.4.88.0/24"]), "geo": E.geo_frame(spark, [("61.4.88.0/24", "NO", "Norway", 7, "Fjord")])}
    alerts = deduplicated(detect(E.enrich_events(events, **tables), [rule("b", "high")], [], travel=False, risk=Risk()))
    path = str(tmp_path / "store")
    append_alerts(alerts.drop("scope").withColumn("mode", F.lit("replay")), path)
    back = {(r["rule_id"], r["group_value"]): r for r in read_alerts(spark, path).collect()}
    assert back["b", None]["enrichment"]["ioc"] and back["b", None]["enrichment"]["as_org"] == "Fjord" and back["b", None]["occurrences"] == 6
    notable = back[RISK_RULE, "root"]
    assert notable["risk"]["score"] == 360 and notable["events"][0]["source"]["ip"] == "61.4.88.9" and notable["mode"] == "replay"
    assert "b" in console_table(read_alerts(spark, path))
    sent = []
    assert Push("http://x.example/t", least="low", post=lambda *a: sent.append(a)).emit(alerts) == len(sent) == 3


def test_travel_keeps_microseconds(spark):
    rows = [f"Mar  1 10:0{k}:00 h sshd[1]: Accepted password for u from {ip} port 1 ssh2" for k, ip in ((0, "61.4.88.9"), (5, "77.30.11.4"))]
    geo = E.geo_frame(spark, [("61.4.88.0/24", "NO", "Norway", 7, "a"), ("77.30.11.0/24", "PT", "Portugal", 8, "b")])
    events = E.enrich_events(lines(spark, "auth.log", rows), geo=geo).withColumn("@timestamp", F.col("`@timestamp`") + F.expr("INTERVAL 123456 MICROSECONDS"))
    (found,) = travel_alerts(events).collect()
    assert [e["@timestamp"].microsecond for e in found["events"]] == [123456, 123456] and found["events"][1]["source"]["geo"]["country_iso_code"] == "PT"


def test_triage_actions(spark, tmp_path):
    store, log = str(tmp_path / "s"), str(tmp_path / "log")
    events = lines(spark, "auth.log", [failure(k, "root", f"61.4.88.{k}") for k in range(3)])
    append_alerts(detect(events, [rule("b", "high")], [], travel=False).drop("scope"), store)
    alerts = read_alerts(spark, store)
    uids = sorted(r["uid"] for r in triaged(alerts, read_actions(spark, log)).collect())
    assert len(uids) == 3 and read_actions(spark, log).count() == 0
    append_actions(spark, log, "status", uids[:1], "closed_false_positive", "ann", T0)
    append_actions(spark, log, "assign", uids[1:2], "bo", "ann", T0)
    group_into_incident(spark, log, triaged(alerts, read_actions(spark, log), open_only=True).select("uid"), "inc-1", "ann", T0)
    held = {r["uid"]: r for r in triaged(alerts, read_actions(spark, log)).collect()}
    assert held[uids[0]]["status"] == "closed_false_positive" and held[uids[0]]["incident"] is None
    assert held[uids[1]]["assignee"] == "bo" and held[uids[2]]["incident"] == "inc-1"
    assert triaged(alerts, read_actions(spark, log), status="new").count() == 2 and triaged(alerts, read_actions(spark, log), incident="inc-1").count() == 2
    for bad in (("status", "gone"), ("dance", "x")):
        with pytest.raises(ValueError):
            append_actions(spark, log, bad[0], uids, bad[1], "ann")


def test_intel_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("# list\n61.4.88.0/24  # range\n\n77.30.11.4\nnonsense\n")
    (tmp_path / "g.csv").write_text("# places\ncidr,country_iso,country_name,asn,as_org\n61.4.88.0/24,NO,Norway,7,Fjord\n")
    (tmp_path / "a.json").write_text(json.dumps({"hosts": [{"cidr": "10.1.0.0/16", "hostname": "lab", "trusted": True}], "identities": {"Root": "admin"}}))
    rows = spark.createDataFrame([("61.4.88.1", "root"), ("77.30.11.4", "x"), ("10.1.2.3", None), (None, "ROOT")], "ip string, usr string")
    hosts, roles = read_assets(str(tmp_path / "a.json"))
    out = E.enrich_flat(
        rows, "ip", "usr", E.blocklist_frame(spark, read_blocklist(str(tmp_path / "b.txt"))), E.geo_frame(spark, read_geoip(str(tmp_path / "g.csv"))),
        E.asset_frame(spark, hosts), E.identity_frame(spark, roles),
    )
    got = {r["ip"]: (r["ioc_matched"], r["country_iso"], r["asset_name"], r["trusted"], r["role"]) for r in out.collect()}
    assert got == {
        "61.4.88.1": (True, "NO", None, False, "admin"), "77.30.11.4": (True, None, None, False, None), "10.1.2.3": (False, None, "lab", True, None), None: (False, None, None, None, "admin"),
    }


V6 = ["::", "::1", "2001:db8::ff00:42:8329", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::ffff:10.1.2.3", "1::2::3", ":::", "1:2:3", "g::1", "12345::", "1:2:3:4:5:6:7:8:9", "fe80::1%eth0", "fe80::1%", "1.2.3.4:80", ":", "ABCD::", "::1.2.3", "1:2:3:4:5:6:1.2.3.4"]


def test_v6_agrees_with_the_standard_library(spark):
    def want(x):
        try:
            return f"{int(ipaddress.IPv6Address(x)):032x}"
        except ValueError:
            return None

    got = spark.createDataFrame([(x,) for x in V6], "x string").select("x", v6_hex(F.col("x")).alias("h"), is_ip(F.col("x")).alias("ok"))
    assert {r["x"]: r["h"] for r in got.collect()} == {x: want(x) for x in V6}
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_lines_of_odd_shapes(spark):
    auth = lines(spark, "auth.log", [
        "", "noise", "Mar  1 10:00:00 h CRON[1]: session opened", "Mar  1 10:00:00 h sshd[1]: Failed password for invalid user from from 1.2.3.4 port 5 ssh2",
        "Xyz  1 10:00:00 h sshd: Accepted publickey for a from 1.2.3.4 port 5 ssh2", "Mar  1 10:00:00 h sudo:  a : TTY=x ; PWD=/ ; USER=root ; COMMAND=/bin/a USER=b ; COMMAND=c",
        "Mar  1 10:00:00 h sudo:  a b : USER=root ; COMMAND=x", " Mar  1 10:00:00 h sshd[1]: Accepted password for a from 1.2.3.4 port 5 ssh2",
    ])
    got = auth.select("ingest_seq", "event.action", "user.name", "`@timestamp`", "process.pid", "sudo.command").orderBy("ingest_seq").collect()
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(3, "ssh_login_failed", "from", 1), (4, "ssh_login_success", "a", None), (5, "sudo_command", "a", None)]
    assert got[1][3] is None and got[2][5] == "/bin/a USER=b ; COMMAND=c"
    web = lines(spark, "access.log", ['1.2.3.4 - - [01/Mar/2024:10:00:00 +0000] "GET /a b HTTP/1.1" 200 -', '1.2.3.4 - bob [bad] "-" - 7 "r" "u"', '1.2.3.4 - - "GET / HTTP/1.1" 200 5', 'x "y" z'])
    got = web.select("ingest_seq", "url.original", "user.name", "http.response.status_code", "http.response.bytes", "http.request.referrer", "`@timestamp`").orderBy("ingest_seq").collect()
    assert [tuple(r)[:6] for r in got] == [(0, "/a b", None, 200, None, None), (1, None, "bob", None, 7, "r")] and got[1][6] is None
    wall = lines(spark, "firewall", ["Mar  1 10:00:00 h kernel: [1.5] [IPTABLES DROP] IN=e OUT= SRC=1.1.1.1 SRC=2.2.2.2 DPT=x", "odd SRC=3.3.3.3 [ACCEPT]", "Mar  1 10:00:00 h kernel: [UFW BLOCK] DST=1.1.1.1"])
    got = wall.select("ingest_seq", "source.ip", "firewall.action", "destination.port", "host.name").orderBy("ingest_seq").collect()
    assert [tuple(r) for r in got] == [(0, "2.2.2.2", "blocked", None, "h"), (1, "3.3.3.3", "allowed", None, None)]


def test_emission_gate_follows_emissions(spark, tmp_path):
    rows = spark.createDataFrame([("k", T0 + dt.timedelta(seconds=s), s) for s in (0, 100, 200, 301, 900, 100)], "key string, ts timestamp, n long")
    path = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    assert sorted(r["n"] for r in drained(emission_gate(stream, "key", "ts", 300_000_000)).collect()) == [0, 301, 900]


def test_import_folder_and_report(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    doc = {"id": "x-1", "title": "X", "level": "high", "logsource": {"category": "process_creation"}, "detection": {"sel": {"CommandLine|contains": "evil"}, "condition": "sel"}}
    (tmp_path / "deep" / "x.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{")
    found = import_folder(str(tmp_path))
    assert [x.rule.id for x in found if x.rule] == ["x-1"] and any(x.reasons for x in found if not x.rule)
    rules, correlations = load_rules()
    geo = E.geo_frame(spark, [("61.4.88.0/24", "NO", "Norway", 7, "a"), ("130.44.0.0/16", "KE", "Kenya", 8, "b")])
    report = evaluate(spark, load_cases(), rules, correlations, lambda e: E.enrich_events(e, geo=geo))
    made = report.document(spark)
    assert made["passed"], (made["misses"], made["benign_alerts"])
    assert made["overall"]["precision"] == made["overall"]["recall"] == 1.0 and made["benign_cases"] == 4 and json.dumps(made)


def test_command_line(spark, tmp_path, capsys):
    log = tmp_path / "auth.log"
    log.write_text("\n".join(failure(k // 4, "root", "61.4.88.9", k % 4 * 10) for k in range(8)) + "\n")
    _, alerts = cli.replay(spark, [str(log)], Config())
    assert {"ssh-bruteforce-001"} <= {r["rule_id"] for r in alerts.select("rule_id").collect()}
    store = str(tmp_path / "store")
    assert cli.main(["replay", str(log), "--store", store]) == 0
    uid = triaged(read_alerts(spark, store), read_actions(spark, str(tmp_path / "t"))).head()["uid"]
    assert cli.main(["triage", str(tmp_path / "t"), "status", "--uid", uid, "--value", "acknowledged"]) == 0
    capsys.readouterr()
    assert cli.main(["triage", str(tmp_path / "t"), "list", "--store", store, "--status", "acknowledged"]) == 0
    assert uid in capsys.readouterr().out
    assert cli.main(["list"]) == 0
