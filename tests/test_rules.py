"""The bundled rules fire on plain attacks and stay silent on ordinary lines."""

import json
import re

import pytest

from vigilake.plans.detect import fired_alerts, rule_alerts
from vigilake.plans.rules import load_rules
from vigilake.sources.parsers import parse


def web(request, status=200):
    return f'203.0.113.9 - - [11/Mar/2024:09:30:00 +0000] "{request}" {status} 99 "-" "curl/8"'


def sudo(command, target="root"):
    return f"Mar 11 09:30:00 web01 sudo:   alice : TTY=pts/0 ; PWD=/home/alice ; USER={target} ; COMMAND={command}"


def process(command):
    return json.dumps({"EventID": 1, "UtcTime": "2024-03-11 09:30:00.000", "Computer": "WS1", "User": "CORP\\a", "ProcessId": 5, "Image": "C:\\x.exe", "CommandLine": command, "ParentImage": "C:\\p.exe", "ParentCommandLine": "p"})


ATTACKS = {
    ("access.log", "sqli-attempt-001"): [web(f"GET {u} HTTP/1.1") for u in (
        "/p?id=1' OR '1'='1", "/p?id=1' OR 1=1--", "/p?id=1%27%20or%201=1--", "/p?id=1+or+1=1", "/p?id=1 union select a,b", "/p?id=-1+UNION+ALL+SELECT+null", "/p?q=1; WAITFOR DELAY '0:0:5'",
        "/p?id=1 AND SLEEP(5)", "/p?id=benchmark(9,md5(1))", "/p?t=information_schema.tables", "/login?u=admin'--", "/p?id=1/**/or/**/1", "/p?x='='", "/p?id=1) or true--",
    )],
    ("access.log", "web-shell-001"): [web(f"GET {u} HTTP/1.1") for u in ("/uploads/shell.php?cmd=id", "/upload/shell.php", "/files/x.jsp", "/images/a.PHTML", "/tmp/c.aspx?x", "/media/y.php5")],
    ("access.log", "directory-traversal-001"): [web(f"GET {u} HTTP/1.1", 404) for u in ("/../../../../etc/passwd", "/a/..%2f..%2fetc/passwd", "/x?f=..\\..\\win.ini", "/%2e%2e/%2e%2e/etc", "/..%5c..%5cboot.ini", "/....//....//etc", "/%252e%252e%252fetc")],
    ("auth.log", "sudo-privesc-001"): [sudo(c) for c in ("/bin/bash", "/bin/sh", "/usr/bin/su -", "/usr/bin/cat /etc/shadow", "/usr/sbin/useradd eve", "/usr/sbin/usermod -aG sudo eve", "/usr/bin/passwd eve", "/usr/bin/chmod u+s /bin/x", "/bin/chmod 4755 /bin/x", "/usr/bin/vim /etc/sudoers")],
    ("sysmon", "log-tampering-001"): [process(c) for c in ("wevtutil cl Security", "wevtutil clear-log System", "powershell Clear-EventLog -LogName Security", "Remove-EventLog x", "auditpol /clear /y", "rm -rf /var/log/auth.log", "rm -f /var/log/syslog", "shred -u /root/.x", "truncate -s 0 /var/log/messages", "journalctl --vacuum-time=1s", "bash -c ': > /var/log/auth.log'", "sh -c 'echo > /var/log/wtmp'")],
}
BENIGN = {
    "access.log": [web(f"{r} HTTP/1.1") for r in (
        "GET /", "GET /index.html", "GET /images/logo.png", "GET /css/app.css", "GET /api/products?category=books&page=2", "POST /api/login", "GET /search?q=select+a+good+book", "GET /articles/2024/summer-reading",
        "POST /upload.php", "GET /products?id=42", "GET /docs/guide.html", "GET /search?q=salt+and+pepper", "GET /search?q=him+or+her", "GET /a?order=asc&or=1", "GET /files/report-1.2.pdf", "GET /union/members?select=all", "GET /v1..2/notes", "GET /o'neil", "GET /search?q=rock--paper",
    )],
    "auth.log": [sudo(c) for c in ("/usr/bin/apt update", "/usr/bin/systemctl restart nginx", "/usr/bin/tail -n 100 /var/log/nginx/error.log", "/usr/bin/git pull", "/usr/bin/rsync -a /a /b", "/usr/bin/chmod 644 /a", "/usr/local/bin/push.sh-run")] + [sudo("/bin/bash", "deploy")],
    "sysmon": [process(c) for c in ("powershell Get-Process", "git pull origin main", "cmd.exe /c dir C:\\Users", "wevtutil qe Security", "cat /var/log/syslog", "tail -f /var/log/syslog", "journalctl -u nginx", "rm -rf /tmp/x")],
}


def fired(spark, source, lines):
    frame = spark.createDataFrame(list(enumerate(lines)), "ingest_seq long, value string")
    rules, _ = load_rules()
    single = [r for r in rules if r.parsed.threshold is None and r.id != "ssh-login-success-001"]
    return {(r["rule_id"], r["seq"]) for r in rule_alerts(parse(source, frame, 2024), single).select("rule_id", "seq").collect()}


@pytest.mark.parametrize(("source", "rule"), ATTACKS)
def test_attacks_fire(spark, source, rule):
    got = fired(spark, source, ATTACKS[source, rule])
    assert [line for k, line in enumerate(ATTACKS[source, rule]) if (rule, k) not in got] == []


@pytest.mark.parametrize("source", BENIGN)
def test_ordinary_lines_stay_silent(spark, source):
    assert [(r, BENIGN[source][k]) for r, k in fired(spark, source, BENIGN[source])] == []


def test_a_log_is_scanned_twice_at_most(spark, tmp_path, monkeypatch):
    from vigilake import cli
    from vigilake.config import Config
    from vigilake.plans import detect as D
    from vigilake.plans.detect import with_evidence

    log = tmp_path / "auth.log"
    log.write_text("\n".join(f"Mar  1 10:0{k // 4}:{k % 4}0 b sshd[7]: Failed password for root from 61.4.88.9 port 4000 ssh2" for k in range(10)) + "\n")
    plans, save = [], D.Stages.save
    monkeypatch.setattr(D.Stages, "save", lambda self, df, name: (plans.append(df), save(self, df, name))[1])
    events, alerts = cli.replay(spark, [str(log)], Config())
    scans = lambda df: len(re.findall(r"\] text\b", df._jdf.queryExecution().optimizedPlan().toString()))
    whole = with_evidence(alerts, events)
    assert [scans(p) for p in plans].count(1) == sum(map(scans, plans)) == scans(whole) == 1
    rows = {r["rule_id"]: r for r in whole.collect()}
    assert len(rows["ssh-bruteforce-001"]["events"]) == 5 and rows["ssh-bruteforce-001"]["events"][0]["raw"].startswith("Mar  1")
    assert whole.count() == alerts.count()
    assert fired_alerts(events.limit(0), *load_rules()).count() == 0
