"""From normalised events to alerts: rules, suppression, correlations, behaviour, risk, dedup."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field as default

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durations import micros
from ..operators.blocks import evidence_in_blocks, ordered_chain_in_blocks, unordered_chain_in_blocks
from ..operators.correlation import impossible_travel, ordered_chain, unordered_chain
from ..operators.enrichment import enrich_alert
from ..operators.risk import entity_scores, notables, severity_score
from ..operators.windows import dedup, max_window_sum, threshold_evidence
from ..schema import field, field_type
from ..stages import Stages
from .rules import Correlation, Rule, suppressed_ids

ALERT_COLUMNS = ("scope", "rule_id", "rule_title", "severity", "timestamp", "source", "group_value", "description", "match_count", "events", "seq")


def _alert(rule: Rule | Correlation, **columns: Column) -> list[Column]:
    fixed = {"rule_id": F.lit(rule.id), "rule_title": F.lit(rule.title), "severity": F.lit(rule.level), "description": F.lit(rule.description)}
    return [{**fixed, **columns}[c].alias(c) for c in ALERT_COLUMNS]


def _scoped(events: DataFrame) -> DataFrame:
    return events if "scope" in events.columns else events.withColumn("scope", F.lit(None).cast("string"))


def _record(events: DataFrame) -> Column:
    """The event as it stands in an alert's evidence; names that begin with _ are of the plan alone."""
    return F.struct(*(F.col(f"`{c}`") for c in events.columns if c != "scope" and not c.startswith("_")))


def rule_alerts(events: DataFrame, rules: list[Rule], alert_window: str = "5m", test: Callable[[Rule], Column] = Rule.predicate) -> DataFrame:
    """Alerts of all rules. One pass marks each event with the single-event rules that match it;
    threshold rules share one sort per (group field, operator, value, window).

    ``scope`` is a column of ``events`` that parts independent runs (cases), null for one run.
    ``test`` tells which events a rule picks, where that is known already.
    """
    events = _scoped(events)
    record = _record(events)
    single = [r for r in rules if r.parsed.threshold is None]
    parts = []
    if single:
        hits = F.array_compact(F.array(*(F.when(test(r), _rule_struct(r)) for r in single)))
        found = events.select("*", F.explode(hits).alias("_r"))
        parts.append(found.select(
            "scope", "_r.rule_id", "_r.rule_title", "_r.severity", F.col("`@timestamp`").alias("timestamp"), F.col("log.source").alias("source"),
            F.lit(None).cast("string").alias("group_value"), "_r.description", F.lit(1).cast("long").alias("match_count"), F.array(record).alias("events"), F.col("ingest_seq").alias("seq"),
        ))
    shared = defaultdict(list)
    for r in rules:
        if t := r.parsed.threshold:
            shared[t.by, t.op, t.value, r.window(alert_window)].append(r)
    for (by, op, value, seconds), group in shared.items():
        hits = F.array_compact(F.array(*(F.when(test(r), _rule_struct(r)) for r in group)))
        by_value = field(by).cast("string") if by else F.lit(None).cast("string")
        keyed = events.withColumns({"group_value": by_value, "_ts": F.col("`@timestamp`"), "_seq": F.col("ingest_seq")})
        if len(group) == 1:  # a filter, with nothing to explode
            picked = keyed.where(test(group[0])).withColumn("rule", _rule_struct(group[0]))
        else:
            picked = keyed.withColumn("rule", F.explode(hits))
        # without a group all of a rule's events are one key: these go by blocks of time
        evidence = threshold_evidence if by else evidence_in_blocks
        chosen = evidence(picked, ["scope", "rule", "group_value"], "_ts", "_seq", seconds * 1_000_000, op, value)
        # the event is put together after the windows, which pass its columns on as they are
        chosen = chosen.select("scope", "rule", "group_value", "_ts", "_seq", "match_count", "evidence_rank", F.col("log.source").alias("_source"), record.alias("event"))
        alerts = chosen.groupBy("scope", "rule", "group_value").agg(
            F.max("_ts").alias("timestamp"), F.min_by("_source", "evidence_rank").alias("source"), F.max("match_count").alias("match_count"),
            # sorted by a comparator: an event holds a map, which has no order of its own
            F.transform(F.array_sort(F.collect_list(F.struct("evidence_rank", "event")), _by_rank), lambda x: x["event"]).alias("events"), F.max("_seq").alias("seq"),
        )
        parts.append(alerts.select("scope", "rule.rule_id", "rule.rule_title", "rule.severity", "timestamp", "source", "group_value", "rule.description", "match_count", "events", "seq"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _rule_struct(r: Rule) -> Column:
    return F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.title).alias("rule_title"), F.lit(r.level).alias("severity"), F.lit(r.description).alias("description"))


def _by_rank(x: Column, y: Column) -> Column:
    return (x["evidence_rank"] - y["evidence_rank"]).cast("int")


def _by_place(x: Column, y: Column) -> Column:
    return x["_place"] - y["_place"]


def correlation_alerts(alerts: DataFrame, correlations: list[Correlation]) -> DataFrame | None:
    """Alerts of all correlations over the firings of all rules, the silent ones included."""
    parts = []
    for c in correlations:
        keys = [f"_k{i}" for i in range(len(c.group_by))]
        rows = alerts.where(F.col("rule_id").isin(list(c.rules)))
        for key, path in zip(keys, c.group_by, strict=True):
            rows = rows.withColumn(key, _first_value("events", path))
        rows = rows.withColumn("_scope", F.coalesce("scope", F.lit(""))).withColumn("_id", F.struct("seq", "rule_id"))
        chain = ordered_chain if c.type == "temporal_ordered" else unordered_chain
        found = chain(rows, ["_scope", *keys], list(c.rules), micros(c.timespan), ts="timestamp", seq="seq")
        # the evidence of all its firings comes back in one join
        wanted = found.select("_scope", *keys, "fired", F.posexplode(F.array(*(F.struct(F.lit(r).alias("rule_id"), F.col(f"seq_{k}").alias("seq")) for k, r in enumerate(c.rules, 1)))).alias("_place", "_f"))
        wanted = wanted.select("_scope", *keys, "fired", "_place", "_f.rule_id", "_f.seq")
        held = wanted.join(rows.select("_scope", *keys, "rule_id", "seq", "events", "scope", "source"), ["_scope", *keys, "rule_id", "seq"])
        whole = held.groupBy("_scope", *keys).agg(
            F.first("fired").alias("_fired"), F.first("scope").alias("_own"), F.min_by("source", "_place").alias("_source"), F.max_by("seq", "_place").alias("_seq"),
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_place", "events")), _by_place), lambda x: x["events"])).alias("_events"),
        )
        value = F.concat_ws("|", *keys) if keys else F.lit(None).cast("string")
        parts.append(whole.select(*_alert(
            c, scope=F.col("_own"), timestamp=F.col("_fired"), source=F.col("_source"), group_value=value, match_count=F.size("_events").cast("long"), events=F.col("_events"), seq=F.col("_seq"),
        )))
    out = parts[0] if parts else None
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _first_value(events: str, path: str) -> Column:
    """The first value of a field over the evidence that isn't null."""
    values = F.transform(events, lambda e: _get(e, path).cast("string"))
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def _get(event: Column, path: str) -> Column:
    if field_type(path) is None:
        return event["labels"][path]
    for part in path.split("."):
        event = event[part]
    return event


TRAVEL = Correlation(
    id="impossible-travel-001", title="Impossible Travel", type="behaviour", rules=(), timespan="1h", level="critical",
    description="One user logged in from two countries, too soon after one another to have travelled.", tags=("attack.t1078", "attack.initial_access"),
)


def travel_alerts(events: DataFrame, detector: Correlation = TRAVEL) -> DataFrame:
    """Impossible travel over enriched events."""
    events = _scoped(events)
    who = F.struct(F.coalesce("scope", F.lit("")).alias("scope"), F.col("user.name").alias("name")).alias("user")
    mine = events.where(_is_login()).select(
        who, F.when(F.col("user.name").isNotNull(), F.col("source.geo.country_iso_code")).alias("country"), F.col("`@timestamp`").alias("ts"), F.col("ingest_seq").alias("seq"), _record(events).alias("event")
    )
    found = impossible_travel(mine.drop("event"), micros(detector.timespan))
    # the two events come back by their place, so that no event is carried through the window
    wanted = found.select("user", "ts", F.posexplode(F.array("seq_1", "seq_2")).alias("_place", "seq"))
    pairs = wanted.join(mine.select("user", "seq", "event"), ["user", "seq"]).groupBy("user").agg(
        F.first("ts").alias("ts"), F.max_by("seq", "_place").alias("_seq"), F.min_by("event", "_place").alias("_e1"), F.max_by("event", "_place").alias("_e2")
    )
    scope = F.when(F.col("user.scope") != "", F.col("user.scope"))
    return pairs.select(*_alert(
        detector, scope=scope, timestamp=F.col("ts").cast("timestamp"), source=F.col("_e2.log.source"), group_value=F.col("user.name"),
        match_count=F.lit(2).cast("long"), events=F.array("_e1", "_e2"), seq=F.col("_seq"),
    ))


def _is_login() -> Column:
    return (F.col("event.category") == "authentication") & (F.col("event.outcome") == "success")


RISK_RULE = "risk-threshold-001"
RISK_TYPE = "struct<score:bigint,threshold:int,object:string,signals:bigint,contributors:array<struct<rule_id:string,severity:string,score:bigint>>>"


@dataclass(frozen=True)
class Risk:
    """How the risk of entities adds up: the window, the sum that makes one notable, the fields that
    name entities, and rules with a score of their own."""

    window: str = "24h"
    threshold: int = 100
    objects: tuple[str, ...] = ("source.ip", "user.name")
    scores: dict[str, int] = default(default_factory=dict)


def risk_scores(alerts: DataFrame, risk: Risk) -> DataFrame:
    """A row (…, field, entity, share) for each entity that an alert's evidence names. Undated alerts
    count as of now; alerts without a score, and notables, add nothing."""
    own = F.lit(None).cast("long")
    for rule, score in risk.scores.items():
        own = F.when(F.col("rule_id") == rule, F.lit(score).cast("long")).otherwise(own)
    rows = alerts.where(F.col("rule_id") != RISK_RULE).withColumns({
        "score": severity_score(F.col("severity"), own), "timestamp": F.coalesce("timestamp", F.current_timestamp()), "_scope": F.coalesce("scope", F.lit("")),
    })
    values = {path: F.transform("events", _text_at(path)) for path in risk.objects}
    return entity_scores(rows.where("score > 0"), values, "score", "group_value")


def risk_alerts(alerts: DataFrame, risk: Risk, hold: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """A notable for each entity whose best window reaches the threshold, with that window's alerts as
    contributors and the union of their evidence (of one raw line once). Both are part of the record,
    so an alert grows with its window, and with nothing else. ``hold`` keeps what is used more than once."""
    keys = ["_scope", "field", "entity"]
    scores = hold(risk_scores(alerts, risk).select("scope", *keys, "rule_id", F.col("severity").alias("level"), "timestamp", "seq", "share", "events"), "scores")
    best = notables(scores, keys, "timestamp", "seq", micros(risk.window), risk.threshold)
    inside = hold(scores.join(best, keys).where(F.col("timestamp").between(F.col("window_start"), F.col("window_end"))), "inside")
    made = inside.groupBy(*keys).agg(
        F.first("scope").alias("scope"), F.first("severity").alias("severity"), F.max("timestamp").alias("timestamp"), F.max("seq").alias("seq"), F.first("max_sum").alias("total"),
        F.sort_array(F.collect_list(F.struct("timestamp", "seq", "rule_id", F.col("level").alias("severity"), F.col("share").alias("score")))).alias("parts"),
    )
    seen = inside.select(*keys, "timestamp", "seq", F.posexplode("events").alias("place", "event"))
    line = F.coalesce("event.raw", F.concat(F.lit("#"), F.col("event.ingest_seq").cast("string")))
    order = F.struct("timestamp", "seq", "place")
    once = seen.groupBy(*keys, line.alias("line")).agg(F.min(order).alias("evidence_rank"), F.min_by("event", order).alias("event"))
    evidence = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("evidence_rank", "event")), _in_order).alias("events"))
    rows = made.join(evidence, keys)
    n, rules = F.size("parts"), F.array_join(F.array_sort(F.array_distinct(F.transform("parts", lambda p: p["rule_id"]))), ", ")
    says = F.format_string(f"%d signal(s) accumulated risk %d (threshold {risk.threshold}) on %s=%s: %s", n, "total", "field", "entity", rules)
    listed = F.transform("parts", lambda p: F.struct(p["rule_id"].alias("rule_id"), p["severity"].alias("severity"), p["score"].alias("score")))
    record = F.struct(F.col("total").alias("score"), F.lit(risk.threshold).alias("threshold"), F.col("field").alias("object"), n.cast("long").alias("signals"), listed.alias("contributors"))
    return rows.select(
        "scope", F.lit(RISK_RULE).alias("rule_id"), F.concat(F.lit("Elevated risk: "), "entity").alias("rule_title"), "severity", "timestamp", F.lit("risk").alias("source"),
        F.col("entity").alias("group_value"), says.alias("description"), n.cast("long").alias("match_count"), F.transform("events", lambda x: x["event"]).alias("events"), "seq",
        record.cast(RISK_TYPE).alias("risk"),
    )


def stored_leaderboard(alerts: DataFrame, risk: Risk, limit: int = 10) -> DataFrame:
    """The entities of most risk over stored alerts: field, entity, score (of the best window), signals
    (all that name the entity), over_threshold; ties by field and entity. Notables add nothing. One
    pass over each entity's scores."""
    rows = alerts if "scope" in alerts.columns else alerts.withColumn("scope", F.lit(None).cast("string"))
    rows = rows.withColumn("_number", F.monotonically_increasing_id())
    scores = risk_scores(rows, risk).select("field", "entity", "timestamp", F.coalesce("seq", "_number").alias("seq"), "share")
    best = max_window_sum(scores, ["field", "entity"], "timestamp", "seq", "share", micros(risk.window)).select("field", "entity", F.col("max_sum").alias("score"))
    signals = scores.groupBy("field", "entity").agg(F.count("*").alias("signals"))
    told = best.join(signals, ["field", "entity"]).withColumn("over_threshold", F.col("score") >= risk.threshold)
    return told.orderBy(F.desc("score"), "field", "entity").limit(limit)


def _text_at(path: str) -> Callable[[Column], Column]:
    def text(event: Column) -> Column:
        value = _get(event, path).cast("string")
        return F.when(value != "", value)

    return text


def _in_order(x: Column, y: Column) -> Column:
    a, b = x["evidence_rank"], y["evidence_rank"]
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


#: What an event's part in alerts is read from, besides the fields that rules, correlations and risk name.
FACTS = (
    "@timestamp", "ingest_seq", "log.source", "source.ip", "source.geo.country_iso_code", "source.as.organization", "source.asset.trusted", "source.asset.name",
    "threat.matched", "user.name", "user.role",
)


def _narrow(paths: set[str]) -> list[Column]:
    """Columns of these fields, nested as in the event."""
    tree: dict = {}
    for path in sorted(paths):
        at = tree
        for part in path.split(".") if field_type(path) is not None else ["labels"]:
            at = at.setdefault(part, {})

    def build(at: dict, path: str) -> list[Column]:
        return [(F.struct(*build(sub, f"{path}`{name}`.")) if sub else F.col(f"{path}`{name}`")).alias(name) for name, sub in at.items()]

    return build(tree, "")


def marked(events: DataFrame, rules: list[Rule], paths: set[str], logins: bool) -> DataFrame:
    """Events that some rule picks, and logins if asked for: the facts of ``paths`` alone, raw lines as
    their hash, and ``_hits``, the places of the rules that pick the event."""
    events = _scoped(events)
    hits = F.array_compact(F.array(*(F.when(r.predicate(), F.lit(k)) for k, r in enumerate(rules))))
    login = F.coalesce(_is_login(), F.lit(False)) if logins else F.lit(False)
    facts = [*_narrow(paths), F.struct(F.when(_is_login(), "authentication").alias("category"), F.when(_is_login(), "success").alias("outcome")).alias("event")]
    return events.select("scope", *facts, F.sha2("raw", 256).alias("raw"), hits.alias("_hits"), login.alias("_login")).where((F.size("_hits") > 0) | F.col("_login"))


def fired_alerts(
    events: DataFrame, rules: list[Rule], correlations: list[Correlation], alert_window: str = "5m", travel: bool = True, risk: Risk | None = None, dedup_window: str | None = None
) -> DataFrame:
    """Emitted alerts with the facts of their evidence in place of whole events, as a written table:
    rules that no correlation silences, correlations, behaviour and, if asked for, notables of risk,
    each with its enrichment; bursts merged where ``dedup_window`` is given.

    ``events`` are scanned once: what rules pick is written first, narrow, and all that follows reads
    that table and the ones made from it. ``alert_id`` numbers the alerts.
    """
    stages = Stages(events.sparkSession, "detect")
    paths = {*FACTS, *(p for c in correlations for p in c.group_by), *(r.parsed.threshold.by for r in rules if r.parsed.threshold and r.parsed.threshold.by), *(risk.objects if risk else ())}
    picked = stages.save(marked(events, rules, paths, travel), "marked")
    place = {r.id: k for k, r in enumerate(rules)}
    fired = stages.save(rule_alerts(picked, rules, alert_window, lambda r: F.array_contains("_hits", place[r.id])), "fired")
    silent = sorted(suppressed_ids(correlations))
    out = fired.where(~F.col("rule_id").isin(silent)) if silent else fired
    if (linked := correlation_alerts(fired, correlations)) is not None:
        out = out.unionByName(linked)
    out = out.unionByName(travel_alerts(picked.where("_login"))) if travel else out
    if risk:
        out = stages.save(out, "told")
    told = out.withColumn("risk", F.lit(None).cast(RISK_TYPE))
    told = enrich_alert(told.unionByName(risk_alerts(out, risk, stages.save)) if risk else told)
    told = deduplicated(told, dedup_window) if dedup_window else told
    return stages.save(told.withColumn("alert_id", F.monotonically_increasing_id()), "alerts")


def with_evidence(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts of ``fired_alerts`` with whole events, fetched by scope and number in one scan."""
    events = _scoped(events)
    places = alerts.select("alert_id", F.coalesce("scope", F.lit("")).alias("_scope"), F.posexplode(F.transform("events", lambda e: e["ingest_seq"])).alias("_place", "_seq"))
    whole = events.select(F.coalesce("scope", F.lit("")).alias("_scope"), F.col("ingest_seq").alias("_seq"), _record(events).alias("event"))
    held = places.join(whole, ["_scope", "_seq"]).groupBy("alert_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "event")), _by_place), lambda x: x["event"]).alias("events"))
    columns = [c for c in alerts.columns if c != "alert_id"]
    return alerts.drop("events").join(held, "alert_id", "left").select(*columns)


def detect(
    events: DataFrame, rules: list[Rule], correlations: list[Correlation], alert_window: str = "5m", travel: bool = True, risk: Risk | None = None, dedup_window: str | None = None
) -> DataFrame:
    """Emitted alerts with their whole evidence: two scans of ``events``, one to find what fires and one
    to fetch the evidence of what is told. ``ingest_seq`` must number the events of a scope the same
    way in both."""
    return with_evidence(fired_alerts(events, rules, correlations, alert_window, travel, risk, dedup_window), events)


def deduplicated(alerts: DataFrame, window: str = "5m") -> DataFrame:
    """Bursts of one rule and group (or, without a group, of the first event's source address)."""
    key = F.coalesce("group_value", F.col("events")[0]["source"]["ip"], F.lit(""))
    rows = alerts.withColumn("_scope", F.coalesce("scope", F.lit(""))).withColumn("_key", key)
    return dedup(rows, ["_scope", "rule_id", "_key"], "timestamp", "seq", micros(window)).drop("_scope", "_key")
