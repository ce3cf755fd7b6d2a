"""Where alerts go: JSON lines, the console, and pushes over HTTP."""

from __future__ import annotations

import json
import sys
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rollups import SEVERITY_RANK, severity_gate
from ..plans.detect import RISK_TYPE
from ..schema import EVENT_SCHEMA
from ..stages import exists, rename

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
#: Push priorities of severities. The tags are our own.
PRIORITY = {"low": "2", "medium": "3", "high": "4", "critical": "5"}
ICON = {"low": "memo", "medium": "bell", "high": "fire", "critical": "sos"}


def store_schema() -> T.StructType:
    """The whole record of an alert, evidence included, so that pivots and risk run over a store as well."""
    ddl = (
        "rule_id string, rule_title string, severity string, timestamp timestamp, last_seen timestamp, source string, group_value string, mode string, occurrences bigint, "
        "match_count bigint, description string, enrichment struct<ioc:boolean,country:string,as_org:string,trusted:boolean,asset:string,role:string>, "
        f"risk {RISK_TYPE}, seq bigint"
    )
    return T.StructType.fromDDL(ddl).add("events", T.ArrayType(EVENT_SCHEMA))


def append_alerts(alerts: DataFrame, path: str, reset: bool = False, batch: str | None = None) -> None:
    """Adds alerts to a folder of JSON lines, or replaces what is there.

    With ``batch``, its name, they are written aside and moved in at once under that name, unless that
    is there already: a batch that is run again leaves each alert once, one cut short leaves none.
    """
    spark = alerts.sparkSession
    out = lambda mode, at: alerts.write.mode(mode).option("timestampFormat", STAMP).json(at)
    if batch is None:
        out("overwrite" if reset else "append", path)
    elif not exists(spark, f"{path}/{batch}"):
        aside = f"{path}/_staging/{batch}-{uuid.uuid4().hex}"
        out("overwrite", aside)
        rename(spark, aside, f"{path}/{batch}")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts of a store; malformed lines are passed over, a store that isn't there is empty. A missing
    mode reads simulation."""
    if not exists(spark, path):
        return spark.createDataFrame([], store_schema())
    rows = spark.read.schema(store_schema()).option("timestampFormat", STAMP).option("recursiveFileLookup", True).json(path, mode="DROPMALFORMED")
    return rows.withColumn("mode", F.coalesce("mode", F.lit("simulation")))


def console_table(alerts: DataFrame, limit: int = 50) -> str:
    """The newest alerts as text; a bounded number reaches the driver."""
    rows = alerts.orderBy(F.desc("timestamp")).limit(limit).select("severity", "rule_title", "source", "group_value", "match_count", "timestamp").collect()
    head = f"{'SEVERITY':<10}{'RULE':<48}{'SOURCE':<12}{'GROUP':<24}{'SEEN':>6}  LATEST"
    show = lambda x: "-" if x is None else str(x)
    return "\n".join([head, *(f"{show(r[0]).upper():<10}{show(r[1])[:46]:<48}{show(r[2]):<12}{show(r[3])[:22]:<24}{show(r[4]):>6}  {show(r[5])}" for r in rows)])


def http_url(url: str) -> str:
    """The address if it is http or https with a host; else ValueError."""
    parsed = urllib.parse.urlparse(url)
    if parsed.scheme not in ("http", "https") or not parsed.netloc:
        raise ValueError(f"not an http(s) address: {url!r}")
    return url


def header_text(value: str) -> str:
    """Without control characters, so that no value starts another header."""
    return "".join(c for c in value if c.isprintable()).strip()


def post_http(url: str, body: bytes, headers: dict[str, str]) -> None:
    urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=5).close()  # noqa: S310  scheme is checked


@dataclass(frozen=True)
class Push:
    """A notifier: ``style`` topic (a text with headers) or webhook (a JSON document)."""

    url: str
    style: str = "topic"
    least: str = "high"
    post: Callable[[str, bytes, dict[str, str]], None] = post_http
    most_seconds: float = 30.0

    def message(self, alert: dict) -> tuple[bytes, dict[str, str]]:
        severity = alert.get("severity") or "medium"
        text = f"{alert.get('rule_title')}: {alert.get('group_value') or '-'} ({alert.get('match_count')} events)"
        if self.style == "webhook":
            return json.dumps({"text": f"[{severity.upper()}] {text}"}).encode(), {"Content-Type": "application/json"}
        return text.encode(), {"Title": header_text(str(alert.get("rule_title"))), "Priority": PRIORITY.get(severity, "3"), "Tags": ICON.get(severity, "bell")}

    def emit(self, alerts: DataFrame) -> int:
        """Sends alerts above the gate, a partition at a time through the driver, for ``most_seconds`` at
        most, so that a flood or a dead receiver doesn't hold up detection; failures are noted and
        passed over, and so is how many were left (they are in the store). Returns how many were sent."""
        rows = severity_gate(alerts, self.least).select("rule_id", "rule_title", "severity", "group_value", "match_count")
        sent = tried = 0
        until = time.monotonic() + self.most_seconds
        for row in rows.toLocalIterator():
            if time.monotonic() > until:
                print(f"notifications stopped after {self.most_seconds:g} s: {rows.count() - tried} left", file=sys.stderr)
                break
            tried += 1
            try:
                self.post(self.url, *self.message(row.asDict()))
                sent += 1
            except Exception as e:  # noqa: BLE001  a notifier must not stop detection
                print(f"notification failed: {e}", file=sys.stderr)
        return sent


def build_pushes(specs: Iterable[dict], post: Callable = post_http) -> list[Push]:
    """Notifiers of a config; one with a bad address is noted and left out."""
    found = []
    for spec in specs:
        style = spec.get("type", "topic")
        least = spec.get("min_severity", "critical" if style == "webhook" else "high")
        try:
            found.append(Push(http_url(spec.get("url", "")), style, least if least in SEVERITY_RANK else "low", post))
        except ValueError as e:
            print(f"notifier left out: {e}", file=sys.stderr)
    return found
