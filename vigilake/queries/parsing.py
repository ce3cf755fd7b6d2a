"""Events rendered to log lines and parsed back: SQL projects what the lines were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import parsers as P
from ..sources.scenarios import SCENARIOS
from .base import EV, Registry, flat_events

reg = Registry()
YEAR = 2024


def events_to_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events dealt over all cores, as the blocks of a log file would be: the table is one row group."""
    return flat_events(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)


def auth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_to_render(spark, sf_dir)
    stamp = F.concat(F.date_format("ts", "MMM"), F.lit(" "), F.lpad(F.date_format("ts", "d"), 2, " "), F.lit(" "), F.date_format("ts", "HH:mm:ss"))
    port = (F.pmod("seq", F.lit(60000)) + 1024).cast("string")
    message = (
        F.when(F.col("action") == "error", F.concat(F.lit("Failed password for invalid user "), "usr", F.lit(" from "), "ip", F.lit(" port "), port, F.lit(" ssh2")))
        .when(F.col("action") == "signup", F.concat(F.lit("  "), F.col("usr"), F.lit(" : TTY=pts/0 ; PWD=/home ; USER=root ; COMMAND=/bin/run "), F.col("seq").cast("string")))
        .when(F.col("action") == "view", F.lit("Connection closed by authenticating user"))
        .otherwise(F.concat(F.lit("Accepted publickey for "), "usr", F.lit(" from "), "ip", F.lit(" port "), port, F.lit(" ssh2")))
    )
    process = F.when(F.col("action") == "signup", "sudo").otherwise(F.concat(F.lit("sshd["), F.pmod("seq", F.lit(9999)).cast("string"), F.lit("]")))
    return e.select(F.concat(stamp, F.lit(" "), "host", F.lit(" "), process, F.lit(": "), message).alias("value"), F.col("seq").alias("ingest_seq"))


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_to_render(spark, sf_dir)
    stamp = F.concat(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000"))
    request = F.concat(F.lit("GET /"), "action", F.lit("?id="), F.col("seq").cast("string"), F.lit(" HTTP/1.1"))
    status = F.when(F.col("action") == "error", "500").when(F.col("action") == "view", "-").otherwise("200")
    return e.select(F.concat("ip", F.lit(" - "), F.when(F.col("user_id") % 2 == 0, F.col("usr")).otherwise("-"), F.lit(" ["), stamp, F.lit('] "'), request, F.lit('" '), status, F.lit(" "), F.col("seq").cast("string"), F.lit(' "-" "agent/'), "host", F.lit('"')).alias("value"), F.col("seq").alias("ingest_seq"))


def endpoint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_to_render(spark, sf_dir)
    process = F.col("action").isin("click", "view")
    kind = F.when(process, "1").when(F.col("action") == "error", "3").when(F.col("action") == "signup", "3.0").otherwise("22")
    on = lambda c: F.when(process, c)
    event = F.struct(
        kind.alias("EventID"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("UtcTime"), F.col("host").alias("Computer"), F.col("usr").alias("User"), F.pmod("seq", F.lit(9999)).alias("ProcessId"),
        F.concat(F.lit("C:\\bin\\"), "action", F.lit(".exe")).alias("Image"), on(F.concat("action", F.lit(" --id "), F.col("seq").cast("string"))).alias("CommandLine"),
        F.when(~process, F.col("ip")).alias("SourceIp"), F.when(~process, F.pmod("seq", F.lit(60000))).alias("SourcePort"), F.lit("tcp").alias("Protocol"),
    )
    return e.select(F.to_json(event).alias("value"), F.col("seq").alias("ingest_seq"))


def firewall_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_to_render(spark, sf_dir)
    stamp = F.concat(F.date_format("ts", "MMM"), F.lit(" "), F.lpad(F.date_format("ts", "d"), 2, " "), F.lit(" "), F.date_format("ts", "HH:mm:ss"))
    verdict = F.when(F.col("action") == "error", "BLOCK").when(F.col("action") == "click", "ALLOW").otherwise("AUDIT")
    source = F.when(F.col("action") == "view", "").otherwise(F.concat(F.lit("SRC=10.9.9.9 SRC="), "ip", F.lit(" ")))
    return e.select(F.concat(stamp, F.lit(" "), "host", F.lit(" kernel: [1.5] [UFW "), verdict, F.lit("] IN="), F.when(F.col("user_id") % 2 == 0, "eth0").otherwise(""), F.lit(" OUT= "), source, F.lit("DST=10.0.0.5 PROTO=tcp SPT="), F.pmod("seq", F.lit(60000)).cast("string"), F.lit(" DPT=443")).alias("value"), F.col("seq").alias("ingest_seq"))


def _time(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.parse_auth_log(auth_lines(spark, sf_dir), YEAR)
    return _time(e.select(F.col("ingest_seq").alias("seq"), F.col("`@timestamp`").alias("ts"), "host.name", F.col("event.action").alias("action"), F.col("event.outcome").alias("outcome"), F.col("user.name").alias("usr"), F.col("source.ip").alias("ip"), F.col("source.port").cast("long").alias("port"), F.col("process.pid").cast("long").alias("pid"), F.col("sudo.command").alias("command")).withColumnRenamed("name", "host"))


reg.add("parse_auth_log", _auth, f"""
    WITH {EV} SELECT seq, date_trunc('second', ts) AS ts, host, CASE action WHEN 'error' THEN 'ssh_login_failed' WHEN 'signup' THEN 'sudo_command' ELSE 'ssh_login_success' END AS action,
        CASE action WHEN 'error' THEN 'failure' ELSE 'success' END AS outcome, usr, CASE WHEN action <> 'signup' THEN ip END AS ip, CASE WHEN action <> 'signup' THEN seq % 60000 + 1024 END AS port,
        CASE WHEN action <> 'signup' THEN seq % 9999 END AS pid, CASE WHEN action = 'signup' THEN '/bin/run ' || seq END AS command FROM ev WHERE action <> 'view'""")


def _access(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.parse_access_log(access_lines(spark, sf_dir))
    return _time(e.select(F.col("ingest_seq").alias("seq"), F.col("`@timestamp`").alias("ts"), F.col("source.ip").alias("ip"), F.col("user.name").alias("usr"), F.col("http.request.method").alias("method"), F.col("url.original").alias("url"), F.col("http.version").alias("version"), F.col("http.response.status_code").cast("long").alias("status"), F.col("http.response.bytes").alias("bytes"), F.col("event.outcome").alias("outcome"), F.col("http.request.referrer").alias("referrer"), F.col("user_agent.original").alias("agent")))


reg.add("parse_access_log", _access, f"""
    WITH {EV} SELECT seq, date_trunc('second', ts) AS ts, ip, CASE WHEN user_id % 2 = 0 THEN usr END AS usr, 'GET' AS method, '/' || action || '?id=' || seq AS url, '1.1' AS version,
        CASE action WHEN 'error' THEN 500 WHEN 'view' THEN NULL ELSE 200 END AS status, seq AS bytes, CASE action WHEN 'error' THEN 'failure' WHEN 'view' THEN NULL ELSE 'success' END AS outcome,
        '-' AS referrer, 'agent/' || host AS agent FROM ev""")


def _endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.parse_endpoint(endpoint_lines(spark, sf_dir))
    return _time(e.select(F.col("ingest_seq").alias("seq"), F.col("`@timestamp`").alias("ts"), F.col("event.action").alias("action"), F.col("process.name").alias("process"), F.col("process.command_line").alias("command"), F.col("source.ip").alias("ip"), F.col("source.port").cast("long").alias("port"), F.col("winlog.event_id").cast("long").alias("event_id"), F.col("host.name").alias("host"), F.col("user.name").alias("usr")))


reg.add("parse_sysmon", _endpoint, f"""
    WITH {EV} SELECT seq, date_trunc('millisecond', ts) AS ts, CASE WHEN action IN ('click', 'view') THEN 'process_create' ELSE 'network_connection' END AS action, action || '.exe' AS process,
        CASE WHEN action IN ('click', 'view') THEN action || ' --id ' || seq END AS command, CASE WHEN action NOT IN ('click', 'view') THEN ip END AS ip,
        CASE WHEN action NOT IN ('click', 'view') THEN seq % 60000 END AS port, CASE WHEN action IN ('click', 'view') THEN 1 ELSE 3 END AS event_id, host, usr FROM ev WHERE action <> 'purchase'""")


def _firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.parse_firewall(firewall_lines(spark, sf_dir), YEAR)
    return _time(e.select(F.col("ingest_seq").alias("seq"), F.col("`@timestamp`").alias("ts"), F.col("host.name").alias("host"), F.col("source.ip").alias("ip"), F.col("source.port").cast("long").alias("port"), F.col("firewall.action").alias("fw"), F.col("event.outcome").alias("outcome"), F.col("network.protocol").alias("protocol"), F.col("network.direction").alias("direction"), "message"))


reg.add("parse_firewall", _firewall, f"""
    WITH {EV}, f AS (SELECT *, CASE action WHEN 'error' THEN 'blocked' WHEN 'click' THEN 'allowed' ELSE 'logged' END AS fw FROM ev WHERE action <> 'view')
    SELECT seq, date_trunc('second', ts) AS ts, host, ip, seq % 60000 AS port, fw, CASE fw WHEN 'blocked' THEN 'failure' WHEN 'allowed' THEN 'success' END AS outcome, 'TCP' AS protocol,
        CASE WHEN user_id % 2 = 0 THEN 'inbound' END AS direction, upper(fw) || ' TCP ' || ip || ' -> 10.0.0.5:443' AS message FROM f""")

_LINES = {"auth.log": auth_lines, "access.log": access_lines, "sysmon": endpoint_lines, "firewall": firewall_lines}


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.normalize_all({k: f(spark, sf_dir) for k, f in _LINES.items()}, YEAR)
    return e.groupBy(F.col("log.source").alias("source"), F.col("event.action").alias("action")).agg(F.count("*").alias("n"))


reg.add("normalize_all", _all, f"""
    WITH {EV} SELECT 'auth.log' AS source, CASE action WHEN 'error' THEN 'ssh_login_failed' WHEN 'signup' THEN 'sudo_command' ELSE 'ssh_login_success' END AS action, count(*) AS n FROM ev WHERE action <> 'view' GROUP BY ALL
    UNION ALL SELECT 'access.log', 'http_request', count(*) FROM ev
    UNION ALL SELECT 'sysmon', CASE WHEN action IN ('click', 'view') THEN 'process_create' ELSE 'network_connection' END, count(*) FROM ev WHERE action <> 'purchase' GROUP BY ALL
    UNION ALL SELECT 'firewall', 'network_connection', count(*) FROM ev WHERE action <> 'view'""")


def _detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host's lines are a file of one source, after two blank lines."""
    frames = None
    for k, (source, make) in enumerate(_LINES.items()):
        rows = make(spark, sf_dir).select(F.concat(F.lit(f"{source}/"), F.pmod("ingest_seq", F.lit(7)).cast("string")).alias("path"), F.when(F.col("ingest_seq") < 14, "   ").otherwise(F.col("value")).alias("value"), "ingest_seq")
        frames = rows if frames is None else frames.unionByName(rows)
    return P.detect_source(frames)


reg.add("detect_source", _detect, """
    SELECT s || '/' || k AS path, CASE WHEN s = 'firewall' AND t = 'view' THEN 'auth.log' ELSE s END AS source
    FROM (VALUES ('auth.log'), ('access.log'), ('sysmon'), ('firewall')) v(s), (SELECT event_id % 7 AS k, min_by(event_type, event_id) AS t FROM events WHERE event_id >= 14 GROUP BY 1) f""")


def _scenario(name: str):
    source, make = SCENARIOS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = P.parse(source, make(spark, "2024-03-01 10:00:00"), YEAR)
        return e.groupBy(F.col("event.action").alias("action"), F.col("event.outcome").alias("outcome"), F.col("source.ip").alias("ip")).agg(F.count("*").alias("n"), F.min("@timestamp").cast("timestamp_ntz").alias("first_seen"))

    return run


def _values(*rows: str) -> str:
    return "SELECT a AS action, o AS outcome, i AS ip, CAST(n AS BIGINT) AS n, CAST('2024-03-01 ' || t AS TIMESTAMP) AS first_seen FROM (VALUES " + ", ".join(rows) + ") v(a, o, i, n, t)"


_WEB = "('http_request', 'success', '10.20.4.17', 2, '10:00:00')"
_LOGIN = "('ssh_login_success', 'success', '10.20.4.17', 1, '09:59:45')"
_GUESSES = "('ssh_login_failed', 'failure', '61.4.88.140', 9, '10:00:00')"
for _name, _rows in {
    "ssh-bruteforce": [_LOGIN, _GUESSES],
    "ssh-bruteforce-success": [_LOGIN, _GUESSES, "('ssh_login_success', 'success', '61.4.88.140', 1, '10:02:15')"],
    "sudo-privesc": ["('sudo_command', 'success', NULL, 3, '10:00:00')"],
    "web-shell": [_WEB, "('http_request', 'success', '77.30.11.52', 2, '10:00:05')"],
    "dir-traversal": [_WEB, "('http_request', 'failure', '77.30.11.52', 1, '10:00:05')", "('http_request', 'success', '77.30.11.52', 1, '10:00:09')"],
    "sqli": [_WEB, "('http_request', 'success', '77.30.11.52', 1, '10:00:05')", "('http_request', 'failure', '77.30.11.52', 1, '10:00:10')"],
    "port-scan": ["('network_connection', NULL, '10.20.4.17', 1, '10:00:00')", "('network_connection', NULL, '130.44.9.31', 24, '10:00:00')"],
    "log-tampering": ["('process_create', 'success', NULL, 2, '10:00:00')"],
    "firewall-port-scan": ["('network_connection', 'success', '10.20.4.17', 1, '10:00:00')", "('network_connection', 'failure', '130.44.9.31', 24, '10:00:00')"],
}.items():
    reg.add("scenario_" + _name.replace("-", "_"), _scenario(_name), _values(*_rows))

QUERIES, ORACLE_SQL = reg.queries, reg.sql
