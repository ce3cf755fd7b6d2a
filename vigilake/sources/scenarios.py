"""Attack scenarios as log lines made by column expressions from ``spark.range``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accounts that a guesser tries in turn; the first is one that hosts have.
GUESSED = ["backup", "jenkins", "nagios", "minecraft", "ftpuser", "svc-print"]
INSIDE, GUESSER, PROWLER, SCANNER = "10.20.4.17", "61.4.88.140", "77.30.11.52", "130.44.9.31"
PROBED = 24  # ports that a scan probes, from 7000 in steps of 11


def _at(start: str, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + (seconds * 1_000_000).cast("long"))


def _syslog(ts: Column, rest: Column) -> Column:
    stamp = F.concat(F.date_format(ts, "MMM"), F.lit(" "), F.lpad(F.date_format(ts, "d"), 2, " "), F.lit(" "), F.date_format(ts, "HH:mm:ss"))
    return F.concat(stamp, F.lit(" "), rest)


def _pick(items: list, i: Column) -> Column:
    return F.get(F.array(*map(F.lit, items)), F.pmod(i, F.lit(len(items))).cast("int"))


def _lines(spark: SparkSession, rows: list[tuple[float, str]], start: str, render: Callable[[Column, Column], Column]) -> DataFrame:
    made = spark.createDataFrame([(k, float(s), x) for k, (s, x) in enumerate(rows)], "ingest_seq long, after double, text string")
    return made.select(render(_at(start, F.col("after")), F.col("text")).alias("value"), "ingest_seq")


def ssh_bruteforce(spark: SparkSession, start: str, attempts: int = 9, interval: int = 15, succeed: bool = False) -> DataFrame:
    """A key login from inside, then ``attempts`` failures from one address, and its success if asked."""
    rows = spark.range(-1, attempts + int(succeed)).withColumnRenamed("id", "i")
    i = F.col("i")
    user = _pick(GUESSED, i)
    port = F.concat(F.lit(" port "), (30211 + 3 * i).cast("string"), F.lit(" ssh2"))
    guess = F.concat(F.lit("Failed password for "), F.when(user == GUESSED[0], "").otherwise("invalid user "), user, F.lit(f" from {GUESSER}"), port)
    entry = F.concat(F.lit(f"Accepted password for {GUESSED[0]} from {GUESSER}"), port)
    calm = F.concat(F.lit(f"Accepted publickey for mira from {INSIDE}"), port)
    rest = F.concat(F.lit("bastion-2 sshd["), (i + 4100).cast("string"), F.lit("]: "), F.when(i < 0, calm).when(i < attempts, guess).otherwise(entry))
    return rows.select(_syslog(_at(start, i * interval), rest).alias("value"), (i + 1).alias("ingest_seq"))


def sudo_privesc(spark: SparkSession, start: str) -> DataFrame:
    command = "bastion-2 sudo:    {0} : TTY=pts/3 ; PWD=/srv/{0} ; USER=root ; COMMAND={1}".format
    rows = [(0, command("mira", "/usr/sbin/logrotate /etc/logrotate.conf")), (9, command("mira", "/usr/bin/df -h")), (31, command("tove", "/usr/bin/bash -i"))]
    return _lines(spark, rows, start, _syslog)


def _web(spark: SparkSession, start: str, attack: list[tuple[float, str, int, int]]) -> DataFrame:
    calm = [(0, "GET /catalogue/spring HTTP/1.1", 200, 20117), (1, "GET /static/app.js HTTP/1.1", 304, 0)]
    rows = [(s, INSIDE, r, c, n, "Mozilla/5.0 (Macintosh) Firefox/124.0") for s, r, c, n in calm]
    rows += [(s, PROWLER, r, c, n, "python-requests/2.31") for s, r, c, n in attack]
    return _lines(
        spark, [(s, f'{ip}\t"{r}" {c} {n} "-" "{ua}"') for s, ip, r, c, n, ua in rows], start,
        lambda ts, x: F.concat(F.substring_index(x, "\t", 1), F.lit(" - - ["), F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000] "), F.substring_index(x, "\t", -1)),
    )


def web_shell(spark: SparkSession, start: str) -> DataFrame:
    return _web(spark, start, [(5, "POST /gallery/send HTTP/1.1", 201, 77), (11, "GET /uploads/cover.phtml?do=whoami HTTP/1.1", 200, 33)])


def directory_traversal(spark: SparkSession, start: str) -> DataFrame:
    return _web(spark, start, [(5, "GET /static/../../../etc/hosts HTTP/1.1", 403, 199), (9, "GET /report?name=..%2f..%2fvar%2flib%2fapp.db HTTP/1.1", 200, 5120)])


def sql_injection(spark: SparkSession, start: str) -> DataFrame:
    return _web(spark, start, [(5, "GET /stock?sku=7 UNION SELECT mail,hash FROM members HTTP/1.1", 200, 2210), (10, "GET /stock?sku=7;SELECT pg_sleep(9) HTTP/1.1", 500, 98)])


def _json_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


def endpoint_port_scan(spark: SparkSession, start: str) -> DataFrame:
    """One harmless connection, then one to each probed port, four a second."""
    rows = spark.range(-1, PROBED).withColumnRenamed("id", "i")
    i = F.col("i")
    calm = i < 0
    event = F.struct(
        F.lit(3).alias("EventID"), _json_time(_at(start, F.greatest(i, F.lit(0)) * 0.25)).alias("UtcTime"), F.lit("FILES-07").alias("Computer"),
        F.lit("LOCAL\\svc-share").alias("User"), F.lit(812).alias("ProcessId"), F.lit("C:\\Program Files\\Share\\share.exe").alias("Image"), F.lit("tcp").alias("Protocol"),
        F.when(calm, INSIDE).otherwise(SCANNER).alias("SourceIp"), (F.lit(52000) + i * 2).alias("SourcePort"),
        F.lit("10.20.9.7").alias("DestinationIp"), F.when(calm, 8443).otherwise(7000 + 11 * i).alias("DestinationPort"),
    )
    return rows.select(F.to_json(event).alias("value"), (i + 1).alias("ingest_seq"))


def log_tampering(spark: SparkSession, start: str) -> DataFrame:
    system = "C:\\Windows\\System32\\"
    rows = [(0, 0.0, system + "tasklist.exe", "tasklist /v", system + "taskeng.exe"), (1, 7.0, system + "wevtutil.exe", "wevtutil cl Application", system + "cmd.exe")]
    made = spark.createDataFrame(rows, "ingest_seq long, after double, Image string, CommandLine string, ParentImage string")
    event = F.struct(
        F.lit(1).alias("EventID"), _json_time(_at(start, F.col("after"))).alias("UtcTime"), F.lit("FILES-07").alias("Computer"),
        F.lit("FILES-07\\ops").alias("User"), F.lit(2904).alias("ProcessId"), "Image", "CommandLine", "ParentImage",
    )
    return made.select(F.to_json(event).alias("value"), "ingest_seq")


def firewall_port_scan(spark: SparkSession, start: str) -> DataFrame:
    rows = spark.range(-1, PROBED).withColumnRenamed("id", "i")
    i = F.col("i")
    calm = i < 0
    ts = _at(start, F.greatest(i, F.lit(0)) * 0.25)
    rest = F.concat(
        F.lit("edge-1 kernel: ["), F.format_string("%.3f", F.unix_micros(ts) / 1e6), F.lit("] [UFW "), F.when(calm, "ALLOW").otherwise("BLOCK"), F.lit("] IN=wan0 OUT= SRC="),
        F.when(calm, INSIDE).otherwise(SCANNER), F.lit(" DST=10.20.9.7 LEN=44 TTL=61 PROTO=TCP SPT="), (F.lit(52000) + i * 2).cast("string"),
        F.lit(" DPT="), F.when(calm, 8443).otherwise(7000 + 11 * i).cast("string"), F.lit(" SYN"),
    )
    return rows.select(_syslog(ts, rest).alias("value"), (i + 1).alias("ingest_seq"))


#: name: (source, maker)
SCENARIOS: dict[str, tuple[str, Callable[[SparkSession, str], DataFrame]]] = {
    "ssh-bruteforce": ("auth.log", ssh_bruteforce),
    "ssh-bruteforce-success": ("auth.log", lambda spark, start: ssh_bruteforce(spark, start, succeed=True)),
    "sudo-privesc": ("auth.log", sudo_privesc),
    "web-shell": ("access.log", web_shell),
    "dir-traversal": ("access.log", directory_traversal),
    "sqli": ("access.log", sql_injection),
    "port-scan": ("sysmon", endpoint_port_scan),
    "log-tampering": ("sysmon", log_tampering),
    "firewall-port-scan": ("firewall", firewall_port_scan),
}
