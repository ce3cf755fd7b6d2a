"""Raw log lines to normalised events, as column expressions over (value, ...) rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import event_columns

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
#: The verdicts that firewalls log, and what they amount to.
VERDICTS = {"BLOCK": "blocked", "DROP": "blocked", "DENY": "blocked", "ALLOW": "allowed", "ACCEPT": "allowed"}
ENDPOINT_DDL = """EventID string, UtcTime string, Computer string, User string, ProcessId string, Image string, CommandLine string,
    ParentImage string, ParentCommandLine string, Protocol string, SourceIp string, SourcePort string, DestinationIp string, DestinationPort string"""


def _given(text: Column) -> Column:
    """The text, or null where it is empty."""
    return F.when(text != "", text)


def _syslog_time(head: Column, year: int) -> Column:
    """Of the first three words of a syslog line: month, day, clock."""
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.get(head, F.lit(0)))
    clock = F.split(F.get(head, F.lit(2)), ":")
    hour, minute = (F.get(clock, F.lit(k)).try_cast("int") for k in (0, 1))
    second = F.get(clock, F.lit(2)).try_cast("decimal(16,6)")
    return F.when(month > 0, F.try_make_timestamp(F.lit(year), month.cast("int"), F.get(head, F.lit(1)).try_cast("int"), hour, minute, second))


def _once(rows: DataFrame, **made: Column) -> DataFrame:
    """``rows`` with columns that are computed once a line. A filter on a plain column is pushed below
    it, and with it a copy of its expression for each use; it stops at what a generator puts out."""
    packed = F.explode(F.array(F.struct(*(c.alias(k) for k, c in made.items())))).alias("_once")
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns), packed).select(*(F.col(f"`{c}`") for c in rows.columns), *(F.col(f"_once.{k}").alias(k) for k in made))


def _basename(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^\\/]*)[\\/]*$", 1)
    return F.when(name != "", name)


def _base(lines: DataFrame, source: str) -> dict[str, Column]:
    seq = F.col("ingest_seq") if "ingest_seq" in lines.columns else F.lit(None)
    return {"raw": F.col("value"), "log.source": F.lit(source), "ingest_seq": seq}


def _emit(lines: DataFrame, leaves: dict[str, Column], keep: Column, carry: tuple[str, ...]) -> DataFrame:
    return lines.where(F.coalesce(keep, F.lit(False))).select(*event_columns(leaves), *carry)


def parse_auth_log(lines: DataFrame, year: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """sshd logins and sudo commands; other lines are dropped. The year isn't in the line; a date that
    the year lacks leaves the time null and keeps the event.

    A line is cut once at its first colon before a blank, then each side into words."""
    cut = _once(lines, _cut=F.split("value", r":\s+", 2))
    message = F.get("_cut", F.lit(1))
    rows = _once(cut, _head=F.split(F.get("_cut", F.lit(0)), r"\s+"), _message=message, _words=F.split(message, " "), _sudo=F.split(message, r"\bUSER=|\s*;\s*COMMAND=", 3))
    tag, message = F.get("_head", F.lit(4)), F.col("_message")

    def word(k: int | Column) -> Column:
        return F.get("_words", F.lit(k) if isinstance(k, int) else k)

    def login(at: Column | int) -> Column:
        """Words from ``at`` on: user "from" address "port" number."""
        return (word(at + 1) == "from") & (word(at + 3) == "port") & word(at + 4).rlike("^[0-9]") & (word(at) != "") & (word(at + 2) != "")

    ssh, sudo = tag.startswith("sshd"), tag.startswith("sudo")
    named = F.when((word(3) == "invalid") & (word(4) == "user") & (word(6) == "from"), 5).otherwise(3)
    failed = ssh & (word(0) == "Failed") & (word(1) == "password") & (word(2) == "for") & login(named)
    accepted = ssh & (word(0) == "Accepted") & (word(1) != "") & (word(2) == "for") & login(3)
    at = F.when(failed, named).otherwise(3)
    caller = F.trim(F.substring_index(F.get("_sudo", F.lit(0)), ":", 1))
    target = F.get("_sudo", F.lit(1))
    command = sudo & (F.size("_sudo") == 3) & F.get("_sudo", F.lit(0)).contains(":") & caller.rlike(r"^\S+$") & target.rlike(r"^\S+$")
    logged = failed | accepted
    action = F.when(failed, "ssh_login_failed").when(accepted, "ssh_login_success").when(command, "sudo_command")
    leaves = _base(lines, "auth.log") | {
        "@timestamp": _syslog_time(F.col("_head"), year), "message": message, "host.name": F.get("_head", F.lit(3)),
        "event.category": F.lit("authentication"), "event.action": action, "event.outcome": F.when(failed, "failure").otherwise("success"),
        "process.name": F.substring_index(tag, "[", 1), "process.pid": F.when(tag.contains("["), F.substring_index(F.substring_index(tag, "[", -1), "]", 1)).try_cast("int"),
        "user.name": F.when(logged, word(at)).when(command, caller), "source.ip": F.when(logged, word(at + 2)),
        "source.port": F.when(logged, F.regexp_extract(word(at + 4), "^[0-9]+", 0)).try_cast("int"),
        "sudo.target_user": F.when(command, target), "sudo.command": F.when(command, F.trim(F.get("_sudo", F.lit(2)))),
    }
    month, clock = F.get("_head", F.lit(0)), F.get("_head", F.lit(2))
    syslog = (F.size("_head") == 5) & month.rlike("^[A-Z][a-z][a-z]$") & F.get("_head", F.lit(1)).rlike("^[0-9]{1,2}$") & clock.rlike("^[0-9]{2}(:[0-9]{2}){2}$")
    return _emit(rows, leaves, syslog & action.isNotNull(), carry)


def parse_access_log(lines: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Combined web logs; lines of another shape are dropped.

    A line is cut once at its quotes: client, request, codes, referrer, agent."""
    part = [F.get("_cut", F.lit(k)) for k in range(6)]
    rows = _once(
        _once(lines, _cut=F.split("value", '"')),
        _client=F.split(F.trim(F.substring_index(part[0], "[", 1)), r"\s+"), _when=F.substring_index(F.substring_index(part[0], "[", -1), "]", 1),
        _request=part[1], _tokens=F.filter(F.split(part[1], r"\s+"), lambda x: x != ""), _codes=F.split(F.trim(part[2]), r"\s+"),
    )
    tokens, n = F.col("_tokens"), F.size("_tokens")
    last = F.try_element_at(tokens, F.lit(-1))
    versioned = (n >= 2) & last.startswith("HTTP/")
    url = F.array_join(F.slice(tokens, F.lit(2), F.greatest(n - F.when(versioned, 2).otherwise(1), F.lit(0))), " ")
    code, sent = F.get("_codes", F.lit(0)), F.get("_codes", F.lit(1))
    status, user = code.try_cast("int"), F.get("_client", F.lit(2))
    whole = F.size("_cut") >= 6
    leaves = _base(lines, "access.log") | {
        "@timestamp": F.try_to_timestamp("_when", F.lit("dd/MMM/yyyy:HH:mm:ss Z")), "message": F.col("_request"),
        "event.category": F.lit("web"), "event.action": F.lit("http_request"), "event.outcome": F.when(status >= 400, "failure").when(status.isNotNull(), "success"),
        "source.ip": F.get("_client", F.lit(0)), "user.name": F.when(user != "-", user),
        "http.version": F.when(versioned, F.substring_index(last, "/", -1)), "http.request.method": F.when(n >= 2, F.get(tokens, F.lit(0))),
        "http.request.referrer": F.when(whole, _given(part[3])), "http.response.status_code": status,
        "http.response.bytes": F.regexp_extract(sent, "^[0-9]+", 0).try_cast("bigint"), "url.original": F.when((n >= 2) & (url != ""), url),
        "user_agent.original": F.when(whole, _given(part[5])),
    }
    shaped = (F.size("_cut") >= 3) & (F.size("_client") == 3) & part[0].rlike(r"^\S.*\s\[[^\]]+\]\s+$") & code.rlike("^([0-9]{3}|-)$") & sent.rlike("^([0-9]|-)")
    return _emit(rows, leaves, shaped, carry)


def parse_endpoint(lines: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines of endpoint telemetry: process creations (1) and network connections (3)."""
    rows = _once(lines, _j=F.from_json("value", ENDPOINT_DDL, {"mode": "PERMISSIVE"}))

    def j(name: str) -> Column:
        return F.when(F.col(f"_j.{name}") != "", F.col(f"_j.{name}"))

    kind = F.col("_j.EventID").try_cast("double").cast("int")
    process, network = kind == 1, kind == 3
    formats = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss")
    time = F.coalesce(*(F.try_to_timestamp(j("UtcTime"), F.lit(f)) for f in formats))
    leaves = _base(lines, "sysmon") | {
        "@timestamp": time, "host.name": j("Computer"), "user.name": j("User"), "winlog.event_id": kind,
        "message": F.when(process, j("CommandLine")), "process.name": _basename(j("Image")), "process.pid": j("ProcessId").try_cast("int"),
        "process.executable": j("Image"), "process.command_line": F.when(process, j("CommandLine")),
        "process.parent.name": F.when(process, _basename(j("ParentImage"))), "process.parent.executable": F.when(process, j("ParentImage")),
        "process.parent.command_line": F.when(process, j("ParentCommandLine")),
        "event.category": F.when(process, "process").otherwise("network"), "event.action": F.when(process, "process_create").otherwise("network_connection"),
        "event.outcome": F.when(process, "success"), "source.ip": F.when(network, j("SourceIp")), "source.port": F.when(network, j("SourcePort").try_cast("int")),
        "destination.ip": F.when(network, j("DestinationIp")), "destination.port": F.when(network, j("DestinationPort").try_cast("int")),
        "network.protocol": F.when(network, j("Protocol")),
    }
    return _emit(rows, leaves, kind.isin(1, 3), carry)


def _keyed(key: str) -> Callable[[Column], Column]:
    return lambda pair: pair["k"] == key


def parse_firewall(lines: DataFrame, year: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Netfilter records with a source address; of a repeated key the last value counts."""
    words = F.split("value", r"\s+")

    def pair(w: Column) -> Column:
        return F.struct(F.upper(F.substring_index(w, "=", 1)).alias("k"), F.substring(w, F.locate("=", w) + 1, F.length(w)).alias("v"))

    verdict = F.upper(F.regexp_extract("value", r"(?i)\[(?:[A-Z]+\s+)?(" + "|".join(VERDICTS) + r")\]", 1))
    rows = _once(_once(lines, _words=words, _verdict=verdict), _kv=F.transform(F.filter("_words", lambda w: w.contains("=")), pair))
    known = ("SRC", "DST", "SPT", "DPT", "PROTO", "IN")
    rows = _once(rows, **{f"_{k}": _given(F.try_element_at(F.filter("_kv", _keyed(k)), F.lit(-1))["v"]) for k in known})
    found = {k: F.col(f"_{k}") for k in known}
    outcome = F.create_map(*(F.lit(x) for item in VERDICTS.items() for x in item))[F.col("_verdict")]
    action, protocol = F.coalesce(outcome, F.lit("logged")), F.upper(found["PROTO"])

    def shown(c: Column) -> Column:
        return F.coalesce(c, F.lit("None"))

    stamped = (F.size("_words") >= 6) & F.get("_words", F.lit(2)).rlike("^[0-9]{2}(:[0-9]{2}){2}$") & F.get("_words", F.lit(4)).endswith(":")
    leaves = _base(lines, "firewall") | {
        "@timestamp": F.when(stamped, _syslog_time(F.col("_words"), year)), "host.name": F.when(stamped, F.get("_words", F.lit(3))),
        "event.category": F.lit("network"), "event.action": F.lit("network_connection"),
        "event.outcome": F.when(outcome == "blocked", "failure").when(outcome == "allowed", "success"),
        "message": F.concat(F.upper(action), F.lit(" "), shown(protocol), F.lit(" "), found["SRC"], F.lit(" -> "), shown(found["DST"]), F.lit(":"), shown(found["DPT"])),
        "source.ip": found["SRC"], "source.port": found["SPT"].try_cast("int"), "destination.ip": found["DST"], "destination.port": found["DPT"].try_cast("int"),
        "network.protocol": protocol, "network.direction": F.when(found["IN"].isNotNull(), "inbound"), "firewall.action": action,
    }
    return _emit(rows, leaves, found["SRC"].isNotNull(), carry)


PARSERS: dict[str, Callable[..., DataFrame]] = {
    "auth.log": parse_auth_log,
    "access.log": lambda lines, year, carry=(): parse_access_log(lines, carry),
    "sysmon": lambda lines, year, carry=(): parse_endpoint(lines, carry),
    "firewall": parse_firewall,
}


def parse(source: str, lines: DataFrame, year: int, enabled: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """Events of one source. KeyError for an unknown source, ValueError for one not enabled (no list:
    all are)."""
    parser = PARSERS[source]
    if enabled and source not in enabled:
        raise ValueError(f"source {source!r} is not enabled")
    return parser(lines, year, carry)


def normalize_all(lines: dict[str, DataFrame], year: int, enabled: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """Events of several sources, one after another."""
    frames = [parse(source, df, year, enabled, carry) for source, df in lines.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, path, ingest_seq): lines of text files; malformed UTF-8 is replaced. ingest_seq keeps
    the order of a file's lines."""
    rows = spark.read.text(path)
    return rows.select("value", F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("ingest_seq"))


def detect_source(lines: DataFrame, path: str = "path", seq: str = "ingest_seq") -> DataFrame:
    """(path, source) by each file's first line that isn't blank; a file without one has no row."""
    rows = lines.withColumn("_t", F.regexp_replace("value", r"^\s+|\s+$", "")).where("_t <> ''")
    first = rows.groupBy(path).agg(F.min_by("_t", seq).alias("_t"))
    t = F.col("_t")
    guess = (
        F.when(t.startswith("{"), "sysmon").when(t.contains('"') & t.contains("HTTP/"), "access.log")
        .when(t.contains("SRC=") & (t.contains("PROTO=") | t.contains("DPT=")), "firewall").otherwise("auth.log")
    )
    return first.select(path, guess.alias("source"))
