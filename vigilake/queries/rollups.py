"""Counts, coverage and efficacy over alerts seen in the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import efficacy as EF
from ..operators import rollups as U
from ..plans.rules import load_rules, rules_frame
from ..plans.sigma import import_document
from .base import EV, Registry, flat_events
from .detection import DEDUP_CTE, _dedup

reg = Registry()


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an alert of its severity, source and mode; every fourth without a mode."""
    e = flat_events(spark, sf_dir)
    mode = F.coalesce(F.when(F.col("user_id") % 4 != 0, F.when(F.col("user_id") % 2 == 0, "live").otherwise("replay")), F.lit("simulation"))
    return e.select("seq", "severity", F.col("host").alias("source"), mode.alias("mode"), "ts", "usr", "ip", "ip_moving", "action", "user_id")


_AL = f"{EV}, al AS (SELECT seq, severity, host AS source, CASE WHEN user_id % 4 = 0 THEN 'simulation' WHEN user_id % 2 = 0 THEN 'live' ELSE 'replay' END AS mode, ts, usr, ip, ip_moving, action, user_id FROM ev)"
for _c in ("severity", "source", "mode"):
    reg.add(f"stats_by_{_c}", lambda s, d, c=_c: U.counts_by(alerts(s, d), c), f"WITH {_AL} SELECT {_c}, count(*) AS n FROM al GROUP BY 1")
reg.add("stats_all", lambda s, d: U.all_counts(alerts(s, d)), f"WITH {_AL} " + " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS n FROM al GROUP BY 2" for c in ("severity", "source", "mode")))
reg.add("order_severity", lambda s, d: U.counts_by(alerts(s, d), "severity").withColumn("place", U.display_order(F.col("severity"))).orderBy("place"),
        f"WITH {_AL} SELECT severity, count(*) AS n, CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS BIGINT) AS place FROM al GROUP BY 1")
reg.add("severity_gate", lambda s, d: U.severity_gate(alerts(s, d), "high").select("seq", "severity"), f"WITH {_AL} SELECT seq, severity FROM al WHERE severity IN ('high', 'critical')")
reg.add("metrics_volume", lambda s, d: U.daily_volume(alerts(s, d), "ts"), f"WITH {_AL} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM al GROUP BY 1")
reg.add("alerts_newest", lambda s, d: alerts(s, d).orderBy(F.desc("ts"), F.desc("seq")).limit(50).select("seq", "ts"), f"WITH {_AL} SELECT seq, ts FROM al ORDER BY ts DESC, seq DESC LIMIT 50")


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts(spark, sf_dir).withColumn("group_value", F.when(F.col("user_id") % 2 == 0, F.col("ip")).otherwise(F.col("usr"))).withColumn("ips", F.array("ip_moving", "ip_moving"))
    return U.top_sources(a, "group_value", "ips")


reg.add("metrics_top_sources", _top, f"""
    WITH {_AL}, x AS (SELECT ip AS source_ip FROM al WHERE user_id % 2 = 0 UNION ALL SELECT ip_moving FROM al WHERE user_id % 2 = 1 UNION ALL SELECT ip_moving FROM al WHERE user_id % 2 = 1)
    SELECT source_ip, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, source_ip LIMIT 10""")


def _verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = flat_events(spark, sf_dir).agg(F.count("*").alias("n"))
    a = _dedup(spark, sf_dir).agg(F.count("*").alias("a"))
    return n.crossJoin(a).select(*U.replay_verdict(F.col("n"), F.col("n"), F.col("a")))  # one row each


reg.add("replay_verdict", _verdict, f"WITH {DEDUP_CTE}, n AS (SELECT count(*) AS n FROM ev), a AS (SELECT count(*) AS a FROM bursts) SELECT n AS n_lines, n AS n_events, a AS n_alerts, round(a * 1000.0 / n, 4) AS per_1k FROM n, a")


# Coverage -------------------------------------------------------------------------------------

def _bundled(spark: SparkSession) -> DataFrame:
    rules, correlations = load_rules()
    extra = spark.createDataFrame([("untagged-1", "Untagged", "low", "", ["attack.discovery"], None, False)], "rule_id string, rule_title string, level string, description string, tags array<string>, risk_score int, is_correlation boolean")
    return rules_frame(spark, [*rules, *correlations]).unionByName(extra)


_TAGS = {
    "directory-traversal-001": ["T1083"], "log-tampering-001": ["T1070.001"], "port-scan-001": ["T1046"], "sqli-attempt-001": ["T1190"], "ssh-bruteforce-001": ["T1110"],
    "ssh-bruteforce-success-001": ["T1110", "T1078"], "ssh-login-success-001": ["T1078"], "sudo-privesc-001": ["T1548.003"], "web-shell-001": ["T1505.003"],
}
_COVER = "cov AS (SELECT t AS technique, 'https://attack.mitre.org/techniques/' || replace(t, '.', '/') || '/' AS url, count(*) AS n_rules, string_agg(r, ',' ORDER BY r) AS rules FROM (VALUES " + ", ".join(f"('{r}', '{t}')" for r, ts in _TAGS.items() for t in ts) + ") v(r, t) GROUP BY t)"
reg.add("coverage_techniques", lambda s, d: U.coverage(_bundled(s)), f"WITH {_COVER} SELECT * FROM cov")
reg.add("coverage_untagged", lambda s, d: U.untagged(_bundled(s)).select("rule_id", "rule_title"), "SELECT 'untagged-1' AS rule_id, 'Untagged' AS rule_title")
reg.add("navigator_layer", lambda s, d: U.navigator_layer(U.coverage(_bundled(s))), f"""
    WITH {_COVER} SELECT '{{"name":"coverage","domain":"enterprise-attack","techniques":[' || string_agg('{{"techniqueID":"' || technique || '","score":' || n_rules || ',"comment":"' || rules || '"}}', ',' ORDER BY technique)
        || '],"gradient":{{"colors":["#ffffff","#ff6666"],"minValue":0,"maxValue":3}}}}' AS layer FROM cov""")
reg.add("rule_catalog", lambda s, d: _bundled(s).where("rule_id <> 'untagged-1'").select("rule_id", "level", "is_correlation"),
        "SELECT * FROM (VALUES ('directory-traversal-001', 'medium', false), ('log-tampering-001', 'high', false), ('port-scan-001', 'medium', false), ('sqli-attempt-001', 'high', false), ('ssh-bruteforce-001', 'high', false), ('ssh-bruteforce-success-001', 'critical', true), ('ssh-login-success-001', 'low', false), ('sudo-privesc-001', 'high', false), ('web-shell-001', 'high', false)) v(rule_id, level, is_correlation)")

# Import ---------------------------------------------------------------------------------------
SAMPLES = [
    {"id": "net-port", "title": "Uncommon port", "logsource": {"category": "network_connection", "product": "windows"}, "detection": {"selection": {"DestinationPort": [4444, 1337]}, "condition": "selection"}},
    {"id": "recon", "title": "Recon tools", "logsource": {"category": "process_creation"}, "detection": {"img": {"Image|endswith": ["\\whoami.exe", "\\net.exe"]}, "cli": {"CommandLine|contains": "group"}, "condition": "img and cli"}},
    {"id": "dns", "title": "Odd source", "logsource": {"category": "dns_query"}, "detection": {"selection": {"EventID": 22}, "condition": "selection"}},
    {"id": "kw", "title": "Keywords", "detection": {"keywords": ["evil"], "condition": "keywords"}},
    {"id": "mod", "title": "All modifier", "detection": {"selection": {"CommandLine|contains|all": ["a", "b"]}, "condition": "selection"}},
    {"id": "nul", "title": "Null", "detection": {"selection": {"Image": None}, "condition": "selection"}},
    {"id": "many", "title": "Many", "detection": {"selection": {"Image": "x"}, "condition": ["selection", "not selection"]}},
    {"id": "port-scan-001", "title": "Same id as a native rule", "detection": {"selection": {"EventID": 3}, "condition": "selection"}},
]


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(doc["id"], x.rule is not None, "; ".join(x.reasons)) for doc in SAMPLES if (x := import_document(doc))]
    return spark.createDataFrame(found, "id string, imported boolean, reasons string")


reg.add("sigma_import_report", _report, """SELECT * FROM (VALUES ('net-port', true, ''), ('recon', true, ''), ('dns', true, ''), ('kw', false, 'keywords in keywords'), ('mod', false, 'modifier ''contains|all'' in selection'),
    ('nul', false, 'null value in selection'), ('many', false, 'several conditions'), ('port-scan-001', true, '')) v(id, imported, reasons)""")


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r.id, r.logsource.get("category"), key) for doc in SAMPLES if (r := import_document(doc).rule) for selection in r.selections.values() for key in selection]
    return spark.createDataFrame(rows, "id string, category string, field string")


reg.add("sigma_translate", _translated, """SELECT * FROM (VALUES ('net-port', 'network', 'destination.port'), ('recon', 'process', 'process.executable|endswith'), ('recon', 'process', 'process.command_line|contains'),
    ('dns', NULL, 'winlog.event_id'), ('port-scan-001', NULL, 'winlog.event_id')) v(id, category, field)""")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    native = _bundled(spark).select("rule_id").where("rule_id <> 'untagged-1'")
    imported = spark.createDataFrame([(doc["id"],) for doc in SAMPLES if import_document(doc).rule], "rule_id string")
    return native.union(imported.join(native, "rule_id", "left_anti"))


reg.add("sigma_merge_anti", _merged, "SELECT unnest([" + ", ".join(f"'{r}'" for r in [*_TAGS, "net-port", "recon", "dns"]) + "]) AS rule_id")

# Efficacy -------------------------------------------------------------------------------------
PATTERNS = {"abuse-1": "idiot|moron|scum", "abuse-2": "pathetic|loser", "abuse-3": "worthless|disgusting", "licence": "License", "never": "zzzzqqqq"}


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """cases, rules, expected, fired: labelled documents, of which toxic ones expect the abuse rules."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = spark.createDataFrame([(k,) for k in PATTERNS], "rule_id string")
    cases = labels.select(F.col("doc_id").alias("case_id"))
    abuse = F.explode(F.array(*(F.lit(k) for k in PATTERNS if k.startswith("abuse"))))
    expected = labels.where("toxic = 1").select(F.col("doc_id").alias("case_id"), abuse.alias("rule_id"))
    hits = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(k)) for k, p in PATTERNS.items())))
    fired = docs.join(labels.select("doc_id"), "doc_id").select(F.col("doc_id").alias("case_id"), F.explode(hits).alias("rule_id"))
    return cases, rules, expected, fired


_EFF = "cs AS (SELECT l.doc_id AS case_id, l.toxic, d.text FROM labels l JOIN documents d USING (doc_id)), ru AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{p}')" for k, p in PATTERNS.items()) + """) v(rule_id, p)),
    gr AS (SELECT case_id, rule_id, toxic = 1 AND rule_id LIKE 'abuse%' AS e, regexp_matches(text, p) AS f FROM cs, ru),
    mx AS (SELECT rule_id, count(*) FILTER (e AND f) AS tp, count(*) FILTER (NOT e AND f) AS fp, count(*) FILTER (e AND NOT f) AS fn, count(*) FILTER (NOT e AND NOT f) AS tn FROM gr GROUP BY 1),
    pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM mx)"""
reg.add("efficacy_confusion", lambda s, d: EF.confusion(*_cases(s, d)), f"WITH {_EFF} SELECT * FROM mx")
reg.add("efficacy_metrics", lambda s, d: EF.metrics(EF.confusion(*_cases(s, d))), f"WITH {_EFF} SELECT rule_id, tp, fp, fn, tn, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 4) AS f1 FROM pr")


def _micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents that aren't toxic are the benign cases; their alerts and lines are counted."""
    cases, rules, expected, fired = _cases(spark, sf_dir)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    benign = docs.join(labels.where("toxic = 0").select("doc_id"), "doc_id")
    n = benign.agg(F.count("*").alias("cases"), F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("lines")).head()
    alerts = fired.join(benign.select(F.col("doc_id").alias("case_id")), "case_id", "left_semi").select("case_id").distinct().count()
    return EF.micro(EF.confusion(cases, rules, expected, fired), n["cases"], alerts, n["lines"])


reg.add("efficacy_micro", _micro, f"""
    WITH {_EFF}, t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tp) / nullif(sum(tp) + sum(fp), 0) AS p, sum(tp) / nullif(sum(tp) + sum(fn), 0) AS r FROM mx),
    b AS (SELECT count(*) AS cases, sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1) AS lines FROM cs WHERE toxic = 0),
    a AS (SELECT count(DISTINCT case_id) AS alerts FROM gr JOIN cs USING (case_id) WHERE cs.toxic = 0 AND f)
    SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1,
           round(alerts / cases, 4) AS benign_fp_rate, round(fp * 1000 / lines, 4) AS fp_per_1k FROM t, b, a""")
reg.add("efficacy_misses", lambda s, d: EF.misses(*_cases(s, d)[2:]), f"WITH {_EFF} SELECT case_id, rule_id FROM gr WHERE e AND NOT f")


def _untested(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir)
    feeders = spark.createDataFrame([("abuse-1",)], "rule_id string")
    return EF.untested(cases[1], cases[2], EF.confusion(*cases), feeders)


reg.add("efficacy_untested", _untested, f"WITH {_EFF} SELECT rule_id FROM mx WHERE rule_id NOT LIKE 'abuse%' AND fp = 0")
reg.add("efficacy_universe", lambda s, d: EF.universe(*_cases(s, d)[1:]), f"WITH {_EFF} SELECT rule_id FROM ru")

QUERIES, ORACLE_SQL = reg.queries, reg.sql
