"""Rules, thresholds, bursts, correlations, behaviour and risk over the shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import risk as R
from ..operators.blocks import ordered_chain_in_blocks, threshold_in_blocks, unordered_chain_in_blocks
from ..operators.correlation import impossible_travel, ordered_chain, unordered_chain
from ..operators.windows import dedup, max_window_sum, threshold, threshold_evidence
from ..plans.condition import compile_selection, parse_condition
from ..plans.detect import RISK_RULE, Risk, detect, risk_alerts, rule_alerts, stored_leaderboard
from ..plans.literals import indexed_hits
from ..plans.rules import Correlation, Rule, logsource_predicate, suppressed_ids
from ..schema import ecs_json
from ..session import shared_dir
from ..sources.sinks import append_alerts, read_alerts
from .base import EV, Registry, flat_events, normalized_events, ntz

reg = Registry()
HOUR = 3_600_000_000
DAY = 24 * HOUR


# Thresholds -----------------------------------------------------------------------------------

def _threshold(op: str, value: int, keys: tuple[str, ...] = ("usr",), window: int = DAY):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = flat_events(spark, sf_dir).where("action = 'error'")
        if not keys:
            return ntz(threshold_in_blocks(e, [], "ts", "seq", window, op, value).select(F.lit("all").alias("grp"), "*"), "last_seen")
        return ntz(threshold(e, list(keys), "ts", "seq", window, op, value), "last_seen")

    return run


def _threshold_sql(op: str, value: int, key: str = "usr", hours: int = 24) -> str:
    out = key if key != "'all'" else "grp"
    return f"""
        WITH {EV}, r AS (SELECT {key} AS {out}, ts, seq, row_number() OVER (PARTITION BY {key} ORDER BY ts, seq) AS rn FROM ev WHERE action = 'error'),
        c AS (SELECT *, rn - min(rn) OVER (PARTITION BY {out} ORDER BY ts RANGE BETWEEN INTERVAL {hours} HOUR PRECEDING AND CURRENT ROW) + 1 AS cnt FROM r),
        x AS (SELECT * FROM c WHERE cnt {op.replace('==', '=')} {value} QUALIFY row_number() OVER (PARTITION BY {out} ORDER BY rn) = 1)
        SELECT {out}, ts AS last_seen, cnt AS match_count, rn - cnt + 1 AS rn_from, rn AS rn_to FROM x"""


for _name, _op, _n in (("ge", ">=", 3), ("gt", ">", 2), ("eq", "==", 3), ("lt", "<", 2), ("le", "<=", 2)):
    reg.add(f"threshold_{_name}", _threshold(_op, _n), _threshold_sql(_op, _n))
reg.add("threshold_global", _threshold(">=", 3, (), HOUR), _threshold_sql(">=", 3, "'all'", 1))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = flat_events(spark, sf_dir).where("action = 'error'").select("usr", "seq", "ts")
    return threshold_evidence(e, ["usr"], "ts", "seq", DAY, ">=", 3).select("usr", "seq", "match_count", "evidence_rank")


_EVIDENCE_CTE = f"""{EV}, r AS (SELECT usr, ts, seq, row_number() OVER (PARTITION BY usr ORDER BY ts, seq) AS rn FROM ev WHERE action = 'error'),
    c AS (SELECT *, rn - min(rn) OVER (PARTITION BY usr ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) + 1 AS cnt FROM r),
    brute AS (SELECT * FROM c WHERE cnt >= 3 QUALIFY row_number() OVER (PARTITION BY usr ORDER BY rn) = 1)"""
reg.add("threshold_evidence", _evidence, f"""
    WITH {_EVIDENCE_CTE} SELECT r.usr, r.seq, b.cnt AS match_count, r.rn - b.rn + b.cnt AS evidence_rank
    FROM brute b JOIN r ON r.usr = b.usr AND r.rn > b.rn - b.cnt AND r.rn <= b.rn""")


def _undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = flat_events(spark, sf_dir).where("action = 'error'").withColumn("ts", F.when(F.col("user_id") % 3 != 0, F.col("ts")))
    return ntz(threshold(e, ["usr"], "ts", "seq", DAY, ">=", 5), "last_seen")


reg.add("threshold_undated", _undated, f"""
    WITH {EV}, t AS (SELECT usr, user_id, seq, CASE WHEN user_id % 3 <> 0 THEN ts END AS ts FROM ev WHERE action = 'error'),
    r AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY ts, seq) AS rn FROM t WHERE ts IS NOT NULL),
    c AS (SELECT *, rn - min(rn) OVER (PARTITION BY usr ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) + 1 AS cnt FROM r),
    x AS (SELECT * FROM c WHERE cnt >= 5 QUALIFY row_number() OVER (PARTITION BY usr ORDER BY rn) = 1)
    SELECT usr, ts AS last_seen, cnt AS match_count, rn - cnt + 1 AS rn_from, rn AS rn_to FROM x
    UNION ALL SELECT usr, NULL, count(*), 1, count(*) FROM t GROUP BY usr HAVING count(ts) = 0 AND count(*) >= 5""")


# Bursts ---------------------------------------------------------------------------------------

def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = flat_events(spark, sf_dir).select("action", "usr", "ts", "seq", "severity")
    return dedup(e, ["action", "usr"], "ts", "seq", 12 * HOUR).select("action", "usr", F.col("seq").alias("first_seq"), F.col("ts").alias("first_seen"), "last_seen", "occurrences")


DEDUP_CTE = f"""{EV}, g AS (SELECT *, lag(ts) OVER (PARTITION BY action, usr ORDER BY ts, seq) AS prev FROM ev),
    s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY action, usr ORDER BY ts, seq) AS sid FROM g),
    bursts AS (SELECT action, usr, min_by(seq, ts) AS first_seq, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS occurrences FROM s GROUP BY action, usr, sid)"""
reg.add("dedup_sessions", _dedup, f"WITH {DEDUP_CTE} SELECT * FROM bursts")


# Correlations ---------------------------------------------------------------------------------

def firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brute (three errors of a user within a day), purchase, error and signup firings."""
    e = flat_events(spark, sf_dir)
    brute = threshold(e.where("action = 'error'"), ["usr", "host"], "ts", "seq", DAY, ">=", 3)
    brute = brute.select("usr", "host", F.col("last_seen").alias("ts"), F.lit("brute").alias("rule_id"), (-F.col("rn_to")).alias("seq"))
    return e.select("usr", "host", F.col("ts").cast("timestamp").alias("ts"), F.col("action").alias("rule_id"), "seq").unionByName(brute)


def _ordered(keys: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = ordered_chain(firings(spark, sf_dir), keys, ["brute", "purchase"], DAY)
        return ntz(out.select(*keys, "started", "fired", "seq_2"), "started", "fired")

    return run


def _ordered_sql(keys: str) -> str:
    return f"""
        WITH {_EVIDENCE_CTE}, b AS (SELECT brute.usr, ev.host, brute.ts FROM brute JOIN ev ON brute.seq = ev.seq),
        p AS (SELECT b.usr, b.host, b.ts AS started, e.ts AS fired, e.seq AS seq_2 FROM b JOIN ev e ON e.usr = b.usr AND e.host = b.host AND e.action = 'purchase' AND e.ts >= b.ts
              QUALIFY row_number() OVER (PARTITION BY b.usr, b.host ORDER BY e.ts, e.seq) = 1)
        SELECT {keys}, started, fired, seq_2 FROM p WHERE fired - started <= INTERVAL 24 HOUR"""


ORDERED_SQL = _ordered_sql("usr")
reg.add("corr_ordered", _ordered(["usr"]), ORDERED_SQL)
reg.add("corr_multi_key", _ordered(["usr", "host"]), _ordered_sql("usr, host"))


def _unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = unordered_chain(firings(spark, sf_dir), ["usr"], ["error", "purchase", "signup"], 6 * HOUR)
    return ntz(out, "fired", "completed")


UNORDERED_SQL = f"""
    WITH {EV}, r AS (SELECT *, max(CASE WHEN action = 'error' THEN ts END) OVER w AS t1, max(CASE WHEN action = 'purchase' THEN ts END) OVER w AS t2,
        max(CASE WHEN action = 'signup' THEN ts END) OVER w AS t3 FROM ev WHERE action IN ('error', 'purchase', 'signup')
        WINDOW w AS (PARTITION BY usr ORDER BY ts, action, seq ROWS UNBOUNDED PRECEDING)),
    x AS (SELECT * FROM r WHERE t1 IS NOT NULL AND t2 IS NOT NULL AND t3 IS NOT NULL AND ts - least(t1, t2, t3) <= INTERVAL 6 HOUR
          QUALIFY row_number() OVER (PARTITION BY usr ORDER BY ts, action, seq) = 1)
    SELECT x.usr, t3 AS fired, x.ts AS completed, a.seq AS seq_1, b.seq AS seq_2, c.seq AS seq_3
    FROM x JOIN ev a ON a.usr = x.usr AND a.action = 'error' AND a.ts = t1 JOIN ev b ON b.usr = x.usr AND b.action = 'purchase' AND b.ts = t2
    JOIN ev c ON c.usr = x.usr AND c.action = 'signup' AND c.ts = t3"""
reg.add("corr_unordered", _unordered, UNORDERED_SQL)


def _without_keys(chain, rules: list[str], span: int):
    return lambda s, d: ntz(chain(flat_events(s, d).where(F.pmod("seq", F.lit(5)) < 4), rules, span, rule="action"), *(["started", "fired"] if chain is ordered_chain_in_blocks else ["fired", "completed"]))


reg.add("corr_ordered_no_key", _without_keys(ordered_chain_in_blocks, ["signup", "error", "purchase"], HOUR), f"""
    WITH {EV}, f AS (SELECT * FROM ev WHERE seq % 5 < 4), c AS (SELECT ts AS us, seq FROM f WHERE action = 'purchase'),
    b AS (SELECT b.ts, b.seq, min((c.us, c.seq)) AS c FROM f b ASOF JOIN (SELECT us, min(seq) AS seq FROM c GROUP BY us) c ON b.ts <= c.us WHERE b.action = 'error' GROUP BY b.ts, b.seq),
    b1 AS (SELECT ts, min((seq, c)) AS x FROM b GROUP BY ts),
    a AS (SELECT a.ts, a.seq, b1.ts AS t2, b1.x AS x FROM f a ASOF JOIN b1 ON a.ts <= b1.ts WHERE a.action = 'signup')
    SELECT ts AS started, x[2][1] AS fired, seq AS seq_1, x[1] AS seq_2, x[2][2] AS seq_3 FROM a WHERE x[2][1] - ts <= INTERVAL 1 HOUR ORDER BY ts, seq LIMIT 1""")
reg.add("corr_unordered_no_key", _without_keys(unordered_chain_in_blocks, ["error", "purchase", "signup"], HOUR), f"""
    WITH {EV}, r AS (SELECT *, max(CASE WHEN action = 'error' THEN (ts, seq) END) OVER w AS l1, max(CASE WHEN action = 'purchase' THEN (ts, seq) END) OVER w AS l2,
        max(CASE WHEN action = 'signup' THEN (ts, seq) END) OVER w AS l3 FROM ev WHERE action IN ('error', 'purchase', 'signup') AND seq % 5 < 4
        WINDOW w AS (ORDER BY ts, action, seq ROWS UNBOUNDED PRECEDING)),
    x AS (SELECT * FROM r WHERE l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL AND ts - least(l1[1], l2[1], l3[1]) <= INTERVAL 1 HOUR ORDER BY ts, action, seq LIMIT 1)
    SELECT l3[1] AS fired, ts AS completed, l1[2] AS seq_1, l2[2] AS seq_2, l3[2] AS seq_3 FROM x""")


def _suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = Correlation(id="brute-then-purchase", title="", type="temporal_ordered", rules=("brute", "purchase"), timespan="24h", group_by=("user.name",), generate=("brute",))
    f = firings(spark, sf_dir)
    shown = f.where(F.col("rule_id").isin("brute", "purchase") & ~F.col("rule_id").isin(sorted(suppressed_ids([chain])))).select("usr", "rule_id", "ts")
    linked = ordered_chain(f, ["usr"], list(chain.rules), DAY).select("usr", F.lit(chain.id).alias("rule_id"), F.col("fired").alias("ts"))
    return ntz(shown.unionByName(linked), "ts")


reg.add("suppression", _suppression, f"""
    WITH {_EVIDENCE_CTE}, p AS (SELECT b.usr, b.ts AS started, e.ts AS fired FROM brute b JOIN ev e ON e.usr = b.usr AND e.action = 'purchase' AND e.ts >= b.ts
        QUALIFY row_number() OVER (PARTITION BY b.usr ORDER BY e.ts, e.seq) = 1)
    SELECT usr, 'brute' AS rule_id, ts FROM brute UNION ALL SELECT usr, 'brute-then-purchase', fired FROM p WHERE fired - started <= INTERVAL 24 HOUR""")


def _unknown_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = spark.createDataFrame([("c1", ["error", "purchase"]), ("c2", ["error", "teleport"]), ("c3", ["ghost", "view"])], "correlation_id string, rules array<string>")
    known = flat_events(spark, sf_dir).select(F.col("action").alias("rule_id")).distinct()
    return refs.select("correlation_id", F.explode("rules").alias("rule_id")).join(known, "rule_id", "left_anti").select("correlation_id", "rule_id")


reg.add("corr_unknown_refs", _unknown_refs, """
    WITH refs AS (SELECT * FROM (VALUES ('c1', 'error'), ('c1', 'purchase'), ('c2', 'error'), ('c2', 'teleport'), ('c3', 'ghost'), ('c3', 'view')) t(correlation_id, rule_id))
    SELECT * FROM refs WHERE rule_id NOT IN (SELECT DISTINCT event_type FROM events)""")


def _travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = flat_events(spark, sf_dir).where("outcome = 'success'").withColumn("country", F.get(F.array(F.lit(None), F.lit(None), F.lit("RU"), F.lit("DE"), F.lit("NG")), F.pmod("seq", F.lit(5)).cast("int")))
    return impossible_travel(e, HOUR, user="usr")


reg.add("impossible_travel", _travel, f"""
    WITH {EV}, l AS (SELECT usr, ts, seq, [NULL, NULL, 'RU', 'DE', 'NG'][seq % 5 + 1] AS country FROM ev WHERE outcome = 'success'),
    p AS (SELECT *, lag(country) OVER w AS from_country, lag(ts) OVER w AS previous_ts, lag(seq) OVER w AS seq_1 FROM l WHERE country IS NOT NULL WINDOW w AS (PARTITION BY usr ORDER BY ts, seq))
    SELECT usr, from_country, country AS to_country, previous_ts, ts, seq_1, seq AS seq_2 FROM p WHERE from_country <> country AND ts - previous_ts <= INTERVAL 1 HOUR
    QUALIFY row_number() OVER (PARTITION BY usr ORDER BY ts, seq) = 1""")


# Risk -----------------------------------------------------------------------------------------

def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_events(spark, sf_dir).withColumn("score", R.severity_score(F.col("severity")))


_SCORED = f"{EV}, sc AS (SELECT *, CASE severity WHEN 'informational' THEN 5 WHEN 'low' THEN 15 WHEN 'medium' THEN 30 WHEN 'high' THEN 60 WHEN 'critical' THEN 90 ELSE 30 END AS score FROM ev)"
_BEST = f"""{_SCORED}, cu AS (SELECT usr, ts, seq, score, sum(score) OVER w AS cum, row_number() OVER w AS rn FROM sc WINDOW w AS (PARTITION BY usr ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
    wi AS (SELECT *, cum - min(cum - score) OVER v AS s, min(rn) OVER v AS rn0, min(ts) OVER v AS t0 FROM cu WINDOW v AS (PARTITION BY usr ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)),
    best AS (SELECT usr, CAST(s AS BIGINT) AS max_sum, t0 AS window_start, ts AS window_end, rn - rn0 + 1 AS signals FROM wi QUALIFY row_number() OVER (PARTITION BY usr ORDER BY s DESC, rn) = 1)"""
BEST_SQL = f"WITH {_BEST} SELECT * FROM best"
reg.add("risk_scores", lambda s, d: scored(s, d).select("seq", "score"), f"WITH {_SCORED} SELECT seq, CAST(score AS BIGINT) AS score FROM sc")
reg.add("risk_max_window", lambda s, d: ntz(max_window_sum(scored(s, d), ["usr"], "ts", "seq", "score", DAY), "window_start", "window_end"), BEST_SQL)
reg.add("topk_risk", lambda s, d: scored(s, d).groupBy("usr").agg(F.sum("score").alias("total")).orderBy(F.desc("total"), "usr").limit(5),
        f"WITH {_SCORED} SELECT usr, CAST(sum(score) AS BIGINT) AS total FROM sc GROUP BY usr ORDER BY total DESC, usr LIMIT 5")


def _entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert per host and hour over its events; its score is shared among addresses and users."""
    e = scored(spark, sf_dir).withColumn("hour", F.date_trunc("hour", F.col("ts")))
    alerts = e.groupBy("host", "hour").agg(F.max("score").alias("score"), F.collect_set("ip").alias("ips"), F.collect_set("usr").alias("users"))
    return R.entity_scores(alerts, {"source.ip": F.col("ips"), "user.name": F.col("users")})


_ENTITIES = f"""{_SCORED}, al AS (SELECT host, date_trunc('hour', ts) AS h, max(score) AS score, list(DISTINCT ip) AS ips, list(DISTINCT usr) AS users FROM sc GROUP BY ALL),
    x AS (SELECT 'source.ip' AS field, unnest(ips) AS entity, greatest(1, score // len(ips)) AS share, h, host FROM al UNION ALL SELECT 'user.name', unnest(users), greatest(1, score // len(users)), h, host FROM al)"""
_WORST = f"""{_ENTITIES}, cu AS (SELECT field, entity, h, host, share, sum(share) OVER w AS cum, row_number() OVER w AS rn FROM x WINDOW w AS (PARTITION BY field, entity ORDER BY h, host ROWS UNBOUNDED PRECEDING)),
    wi AS (SELECT *, cum - min(cum - share) OVER v AS s, min(rn) OVER v AS rn0, min(h) OVER v AS t0 FROM cu WINDOW v AS (PARTITION BY field, entity ORDER BY h RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)),
    best AS (SELECT field, entity, CAST(s AS BIGINT) AS max_sum, t0 AS window_start, h AS window_end, rn - rn0 + 1 AS signals FROM wi QUALIFY row_number() OVER (PARTITION BY field, entity ORDER BY s DESC, rn) = 1)"""
_KEYS = ["field", "entity"]
reg.add("risk_entities", lambda s, d: _entity_rows(s, d).groupBy(*_KEYS).agg(F.sum("share").alias("total"), F.count("*").alias("n")),
        f"WITH {_ENTITIES} SELECT field, entity, CAST(sum(share) AS BIGINT) AS total, count(*) AS n FROM x GROUP BY ALL")
reg.add("risk_notables", lambda s, d: ntz(R.notables(_entity_rows(s, d), _KEYS, "hour", "host", DAY, 100), "window_start", "window_end"),
        f"WITH {_WORST} SELECT *, CASE WHEN max_sum >= 200 THEN 'critical' ELSE 'high' END AS severity FROM best WHERE max_sum >= 100")
reg.add("risk_leaderboard", lambda s, d: ntz(R.leaderboard(_entity_rows(s, d), _KEYS, "hour", "host", DAY, 100, 10), "window_start", "window_end"),
        f"WITH {_WORST} SELECT *, max_sum >= 100 AS over_threshold FROM best ORDER BY max_sum DESC, field, entity LIMIT 10")


# Predicates -----------------------------------------------------------------------------------

_PATHS = {"url.original": "url", "event.action": "action", "user.name": "usr", "event.outcome": "outcome", "host.name": "host", "source.ip": "ip", "note": "note", "number": "number", "message": "props"}


def _resolve(path: str) -> Column:
    return F.col(_PATHS[path]) if path in _PATHS else F.lit(None).cast("string")


def _pages(selection: object):
    return lambda s, d: s.read.parquet(f"{d}/pages.parquet").where(compile_selection(selection, _resolve)).select("page_id", "url")


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a field that is null for every third user, and a number."""
    return flat_events(spark, sf_dir).withColumn("note", F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("n"), F.pmod("user_id", F.lit(4))))).withColumn("number", F.pmod("user_id", F.lit(10)))


_NOTED = f"{EV}, nt AS (SELECT *, CASE WHEN user_id % 3 <> 0 THEN 'n' || (user_id % 4) END AS note, user_id % 10 AS number FROM ev)"


def _events(selections: dict, condition: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        test = parse_condition(condition).predicate({k: compile_selection(v, _resolve) for k, v in selections.items()})
        return noted(spark, sf_dir).where(test).select("seq")

    return run


reg.add("sel_contains", _pages({"url.original|contains": "UTM_source"}), "SELECT page_id, url FROM pages WHERE contains(lower(url), 'utm_source')")
reg.add("sel_startswith", _pages({"url.original|startswith": "https://M."}), "SELECT page_id, url FROM pages WHERE starts_with(lower(url), 'https://m.')")
reg.add("sel_endswith", _pages({"url.original|endswith": "#TOP"}), "SELECT page_id, url FROM pages WHERE ends_with(lower(url), '#top')")
reg.add("sel_regex", _pages({"url.original|re": "/[a-z]{2}/[0-9]+$"}), "SELECT page_id, url FROM pages WHERE regexp_matches(url, '/[a-z]{2}/[0-9]+$')")
reg.add("sel_equals", _events({"a": {"event.action": "ERROR"}}, "a"), f"WITH {_NOTED} SELECT seq FROM nt WHERE action = 'error'")
reg.add("sel_list_or", _events({"a": {"event.action": ["Error", "signup"], "number": [1, 2, 3]}}, "a"), f"WITH {_NOTED} SELECT seq FROM nt WHERE action IN ('error', 'signup') AND number IN (1, 2, 3)")
reg.add("sel_map_and", _events({"a": {"event.action": "click", "host.name": "h3", "note|startswith": "n"}}, "a"), f"WITH {_NOTED} SELECT seq FROM nt WHERE action = 'click' AND host = 'h3' AND coalesce(note LIKE 'n%', false)")
reg.add("sel_listmap_or", _events({"a": [{"event.action": "click", "host.name": "h1"}, {"event.action": "view", "number": 7}]}, "a"), f"WITH {_NOTED} SELECT seq FROM nt WHERE (action = 'click' AND host = 'h1') OR (action = 'view' AND number = 7)")
_SELS = {"sel_a": {"note": "n1"}, "sel_b": {"event.action": ["error", "click"]}, "other": {"number": 4}, "gone": {"no.such.field": "x"}}
reg.add("cond_bool", _events(_SELS, "not sel_a and (sel_b or other) and not gone"), f"WITH {_NOTED} SELECT seq FROM nt WHERE NOT coalesce(note = 'n1', false) AND (action IN ('error', 'click') OR number = 4)")
reg.add("cond_1_of", _events(_SELS, "1 of sel_* or 1 of nothing*"), f"WITH {_NOTED} SELECT seq FROM nt WHERE coalesce(note = 'n1', false) OR action IN ('error', 'click')")
reg.add("cond_all_of", _events(_SELS, "all of sel_* and not all of them"), f"WITH {_NOTED} SELECT seq FROM nt WHERE coalesce(note = 'n1', false) AND action IN ('error', 'click')")
reg.add("logsource_filter", lambda s, d: normalized_events(s, d).where(logsource_predicate({"category": "authentication", "product": "linux", "service": "ssh"})).select(F.col("ingest_seq").alias("seq")),
        f"WITH {EV} SELECT seq FROM ev WHERE action = 'error'")

_RULES = [Rule(id=f"r-{k}", title=k.title(), selections={"selection": {"event.action": k}}, condition="selection", level=v) for k, v in (("error", "critical"), ("purchase", "high"), ("signup", "medium"), ("click", "low"), ("view", "informational"))]


def _alerts(rules: list[Rule]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rule_alerts(normalized_events(spark, sf_dir), rules).select("rule_id", "severity", F.col("timestamp").cast("timestamp_ntz").alias("ts"), "match_count", "seq")

    return run


_ALERT_SQL = f"WITH {EV} SELECT 'r-' || action AS rule_id, severity, ts, CAST(1 AS BIGINT) AS match_count, seq FROM ev"
reg.add("rule_per_event", _alerts(_RULES[:1]), _ALERT_SQL + " WHERE action = 'error'")
reg.add("rules_multi", _alerts(_RULES), _ALERT_SQL)
def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts written to a store, evidence and all, and read back."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    append_alerts(rule_alerts(normalized_events(spark, sf_dir), _RULES[:2]).drop("scope"), path)
    x = read_alerts(spark, path)
    return x.select("rule_id", "severity", F.col("timestamp").cast("timestamp_ntz").alias("ts"), "mode", F.col("events")[0]["ingest_seq"].alias("seq"), F.col("events")[0]["user"]["name"].alias("usr"))


reg.add("read_alert_store", _stored, f"WITH {EV} SELECT 'r-' || action AS rule_id, severity, ts, 'simulation' AS mode, seq, usr FROM ev WHERE action IN ('error', 'purchase')")


def _stored_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaderboard of a store written with evidence and read back."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    append_alerts(rule_alerts(normalized_events(spark, sf_dir), _RULES[:2]).drop("scope"), path)
    return stored_leaderboard(read_alerts(spark, path), Risk(threshold=300))


reg.add("risk_leaderboard_stored", _stored_risk, f"""
    WITH {_SCORED}, x AS (SELECT 'source.ip' AS field, ip AS entity, ts, seq, score FROM sc WHERE action IN ('error', 'purchase') UNION ALL SELECT 'user.name', usr, ts, seq, score FROM sc WHERE action IN ('error', 'purchase')),
    cu AS (SELECT *, sum(score) OVER (PARTITION BY field, entity ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS cum FROM x),
    wi AS (SELECT *, cum - min(cum - score) OVER (PARTITION BY field, entity ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS s FROM cu)
    SELECT field, entity, CAST(max(s) AS BIGINT) AS score, count(*) AS signals, max(s) >= 300 AS over_threshold FROM wi GROUP BY field, entity ORDER BY score DESC, field, entity LIMIT 10""")
reg.add("risk_alerts", lambda s, d: risk_alerts(rule_alerts(normalized_events(s, d), _RULES[:2]), Risk(threshold=300)).select(
            F.col("risk.object").alias("field"), F.col("group_value").alias("entity"), F.col("risk.score").alias("score"), "severity", "match_count", F.size("events").cast("long").alias("n_events"), F.aggregate("risk.contributors", F.lit(0).cast("long"), lambda t, c: t + c["score"]).alias("parts")),
        f"""WITH {_SCORED}, x AS (SELECT 'source.ip' AS field, ip AS entity, ts, seq, score FROM sc WHERE action IN ('error', 'purchase') UNION ALL SELECT 'user.name', usr, ts, seq, score FROM sc WHERE action IN ('error', 'purchase')),
    cu AS (SELECT *, sum(score) OVER w AS cum, row_number() OVER w AS rn FROM x WINDOW w AS (PARTITION BY field, entity ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
    wi AS (SELECT *, cum - min(cum - score) OVER v AS s, rn - min(rn) OVER v + 1 AS n FROM cu WINDOW v AS (PARTITION BY field, entity ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)),
    best AS (SELECT * FROM wi QUALIFY row_number() OVER (PARTITION BY field, entity ORDER BY s DESC, rn) = 1)
    SELECT field, entity, CAST(s AS BIGINT) AS score, CASE WHEN s >= 600 THEN 'critical' ELSE 'high' END AS severity, n AS match_count, n AS n_events, CAST(s AS BIGINT) AS parts FROM best WHERE s >= 300""")


def _many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thousand rules over page addresses, by the index over their literals."""
    rules = [Rule(id=f"m-{k}", title="m", selections={"s": {"url.original|contains": [f"/{k}", f"id={k}&", f"P{k}."] if k % 2 else f"{k}{k % 7}"}}, condition="s") for k in range(2000)]
    return indexed_hits(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules, "page_id", _resolve).withColumnRenamed("seq", "page_id")


reg.add("rules_literal_index", _many_rules, """
    WITH lits AS (SELECT k, unnest(CASE WHEN k % 2 = 1 THEN ['/' || k, 'id=' || k || '&', 'p' || k || '.'] ELSE [k || '' || (k % 7)] END) AS lit FROM (SELECT unnest(range(2000)) AS k))
    SELECT DISTINCT page_id, 'm-' || k AS rule_id FROM pages JOIN lits ON contains(lower(url), lit)""")


def _detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, a chain that silences one of them, notables of risk, bursts and whole evidence."""
    picks = lambda name, action, level, condition="s", **kw: Rule(id=name, title=name, selections={"s": {"event.action": action}}, condition=condition, level=level, **kw)
    rules = [picks("brute", "error", "high", "s | count() by user.name >= 3", timeframe="24h"), picks("purchase", "purchase", "high"), picks("signup", "signup", "medium")]
    chain = Correlation(id="chain", title="chain", type="temporal_ordered", rules=("brute", "purchase"), timespan="24h", group_by=("user.name",), generate=("brute",), level="critical")
    out = detect(normalized_events(spark, sf_dir), rules, [chain], travel=False, risk=Risk(threshold=100), dedup_window="12h")
    return ntz(out.select(
        "rule_id", F.coalesce("group_value", F.col("events")[0]["source"]["ip"]).alias("about"), "severity", "match_count", "occurrences", F.col("timestamp").alias("ts"), "last_seen",
        F.size("events").cast("long").alias("n_events"), F.array_max(F.transform("events", lambda e: e["ingest_seq"])).alias("last_event"), F.array_min(F.transform("events", lambda e: e["message"])).alias("message"),
    ), "ts", "last_seen")


reg.add("detect_all", _detect_all, f"""
    WITH {_EVIDENCE_CTE},
    b AS (SELECT brute.usr, ev.ip, brute.ts, brute.seq, brute.cnt, brute.rn FROM brute JOIN ev ON ev.seq = brute.seq),
    p AS (SELECT b.usr, b.ip, b.ts AS started, e.ts, e.seq, b.cnt, b.rn FROM b JOIN ev e ON e.usr = b.usr AND e.action = 'purchase' AND e.ts >= b.ts QUALIFY row_number() OVER (PARTITION BY b.usr ORDER BY e.ts, e.seq) = 1),
    chain AS (SELECT * FROM p WHERE ts - started <= INTERVAL 24 HOUR),
    told AS (SELECT 'brute' AS rule_id, usr AS group_value, usr, ip, 'high' AS severity, 60 AS score, cnt AS n, ts, seq FROM b
        UNION ALL SELECT 'chain', usr, usr, ip, 'critical', 90, cnt + 1, ts, seq FROM chain
        UNION ALL SELECT 'signup', NULL, usr, ip, 'medium', 30, 1, ts, seq FROM ev WHERE action = 'signup'),
    inside AS (SELECT b.usr, r.seq FROM b JOIN r ON r.usr = b.usr AND r.rn > b.rn - b.cnt AND r.rn <= b.rn),
    evidence AS (SELECT 'brute' AS rule_id, b.seq, i.seq AS part FROM b JOIN inside i USING (usr)
        UNION ALL SELECT 'chain', c.seq, i.seq FROM chain c JOIN inside i USING (usr) UNION ALL SELECT 'chain', seq, seq FROM chain
        UNION ALL SELECT 'signup', seq, seq FROM ev WHERE action = 'signup'),
    x AS (SELECT 'source.ip' AS field, ip AS entity, * FROM told UNION ALL SELECT 'user.name', usr, * FROM told),
    cu AS (SELECT *, sum(score) OVER w AS cum, row_number() OVER w AS rn FROM x WINDOW w AS (PARTITION BY field, entity ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
    wi AS (SELECT *, cum - min(cum - score) OVER v AS s, min(ts) OVER v AS t0 FROM cu WINDOW v AS (PARTITION BY field, entity ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)),
    best AS (SELECT field, entity, s, t0, ts AS t1 FROM wi QUALIFY row_number() OVER (PARTITION BY field, entity ORDER BY s DESC, rn) = 1),
    notable AS (
        SELECT entity, CASE WHEN any_value(s) >= 200 THEN 'critical' ELSE 'high' END AS severity, count(DISTINCT (x.rule_id, x.seq)) AS n, max(x.ts) AS ts, count(DISTINCT e.part) AS n_events, max(e.part) AS last_event, min(ev.props) AS message
        FROM best JOIN x USING (field, entity) JOIN evidence e ON e.rule_id = x.rule_id AND e.seq = x.seq JOIN ev ON ev.seq = e.part
        WHERE s >= 100 AND x.ts BETWEEN t0 AND t1 GROUP BY field, entity),
    gaps AS (SELECT *, coalesce(group_value, ip) AS about, lag(ts) OVER (PARTITION BY rule_id, coalesce(group_value, ip) ORDER BY ts, seq) AS prev FROM told),
    sess AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY rule_id, about ORDER BY ts, seq) AS sid FROM gaps),
    bursts AS (SELECT rule_id, about, count(*) AS occurrences, max(ts) AS last_seen, min_by({{'severity': severity, 'n': n, 'ts': ts, 'seq': seq}}, (ts, seq)) AS a FROM sess GROUP BY rule_id, about, sid),
    shown AS (SELECT bursts.rule_id, about, a.severity AS severity, a.n AS match_count, occurrences, a.ts AS ts, last_seen, count(*) AS n_events, max(e.part) AS last_event, min(ev.props) AS message
        FROM bursts JOIN evidence e ON e.rule_id = bursts.rule_id AND e.seq = a.seq JOIN ev ON ev.seq = e.part GROUP BY ALL)
    SELECT * FROM shown UNION ALL SELECT '{RISK_RULE}', entity, severity, n, 1, ts, ts, n_events, last_event, message FROM notable""")
reg.add("alerts_union", lambda s, d: ntz(firings(s, d).where("rule_id in ('brute', 'signup')").select("usr", "rule_id", "ts"), "ts"),
        f"WITH {_EVIDENCE_CTE} SELECT usr, 'brute' AS rule_id, ts FROM brute UNION ALL SELECT usr, 'signup', ts FROM ev WHERE action = 'signup'")
reg.add("distinct_entities", lambda s, d: flat_events(s, d).select(F.explode(F.array(F.struct(F.lit("source.ip").alias("field"), F.col("ip").alias("value")), F.struct(F.lit("user.name").alias("field"), F.col("usr").alias("value")))).alias("x")).select("x.*").distinct(),
        f"WITH {EV} SELECT DISTINCT 'source.ip' AS field, ip AS value FROM ev UNION SELECT DISTINCT 'user.name', usr FROM ev")


def _ecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = normalized_events(spark, sf_dir).drop("@timestamp", "message", "process")
    return e.select(F.col("ingest_seq").alias("seq"), ecs_json(e.drop("ingest_seq")).alias("doc"))


reg.add("ecs_json", _ecs, f"""
    WITH {EV} SELECT seq, '{{"event":{{"category":"' || CASE WHEN action = 'error' THEN 'authentication' ELSE 'web' END || '","action":"' || action || '","outcome":"' || outcome
        || '"}},"source":{{"ip":"' || ip || '"}},"user":{{"name":"' || usr || '"}},"host":{{"name":"' || host || '"}},"log":{{"source":"events"}}}}' AS doc FROM ev""")

QUERIES, ORACLE_SQL = reg.queries, reg.sql
