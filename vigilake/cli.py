"""Command line over the same plans: replay, scenarios, rules, coverage, efficacy, import, watch."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, load_config
from .operators import enrichment as E
from .operators.corpus import evaluate, load_cases
from .operators.rollups import coverage
from .operators.triage import ACTIONS, append_actions, read_actions, triaged
from .plans.detect import Risk, fired_alerts, stored_leaderboard, with_evidence
from .plans.rules import load_rules, rules_frame
from .plans.sigma import import_folder, merge_native_first
from .session import get_session
from .sources.intel import read_assets, read_blocklist, read_geoip
from .sources.parsers import PARSERS, detect_source, parse, read_lines
from .sources.scenarios import SCENARIOS
from .sources.sinks import append_alerts, build_pushes, console_table, read_alerts


def enricher(spark: SparkSession, config: Config):
    """The enrichment of a config; without lookup files it changes nothing."""
    tables: dict[str, DataFrame] = {}
    if config.blocklist:
        tables["blocklist"] = E.blocklist_frame(spark, read_blocklist(config.blocklist))
    if config.geoip:
        tables["geo"] = E.geo_frame(spark, read_geoip(config.geoip))
    if config.assets:
        hosts, roles = read_assets(config.assets)
        tables |= {"assets": E.asset_frame(spark, hosts), "identities": E.identity_frame(spark, roles)}
    return (lambda events: E.enrich_events(events, **tables)) if tables else (lambda events: events)


def risk_of(config: Config, rules: list) -> Risk | None:
    """The risk settings of a config, with the scores that rules declare; None where it is switched off."""
    scores = {r.id: r.risk_score for r in rules if r.risk_score is not None}
    return Risk(config.risk_window, config.risk_threshold, scores=scores) if config.risk_threshold > 0 else None


def replay(spark: SparkSession, paths: list[str], config: Config, source: str | None = None, mode: str = "replay") -> tuple[DataFrame, DataFrame]:
    """(events, alerts after dedup) of log files; each file's source is told by its first line. The alerts
    are a written table with the facts of their evidence, ``with_evidence`` fetches the events."""
    parts = []
    for k, path in enumerate(paths):
        lines = read_lines(spark, path).withColumn("ingest_seq", F.col("ingest_seq") + F.lit(k << 50))  # no number stands in two files
        head = lines.where(F.trim("value") != "").limit(1)  # by file order, without reading on
        first = detect_source(head.withColumn("path", F.lit(path))).head() if source is None else None
        parts.append(parse(source or (first["source"] if first else "auth.log"), lines, config.year, config.sources))
    events = parts[0]
    for part in parts[1:]:
        events = events.unionByName(part)
    events = enricher(spark, config)(events)
    rules, correlations = load_rules()
    return events, _fired(events, rules, correlations, config, mode)


def _fired(events: DataFrame, rules: list, correlations: list, config: Config, mode: str) -> DataFrame:
    return fired_alerts(events, rules, correlations, config.alert_window, risk=risk_of(config, rules), dedup_window=config.dedup_window).withColumn("mode", F.lit(mode))


def _deliver(alerts: DataFrame, events: DataFrame, config: Config, store: str | None) -> None:
    print(console_table(alerts))
    if store:
        append_alerts(with_evidence(alerts, events).drop("scope"), store)
    for push in build_pushes(config.notify):
        push.emit(alerts)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vigilake", description=__doc__)
    parser.add_argument("--config")
    verbs = parser.add_subparsers(dest="verb", required=True)
    run = verbs.add_parser("run", help="run a scenario")
    run.add_argument("scenario", choices=sorted(SCENARIOS))
    again = verbs.add_parser("replay", help="run log files")
    again.add_argument("paths", nargs="+")
    again.add_argument("--source", choices=sorted(PARSERS))
    for verb in (run, again):
        verb.add_argument("--store")
    verbs.add_parser("list", help="list rules")
    verbs.add_parser("coverage", help="techniques covered")
    cases = verbs.add_parser("efficacy", help="rules against labelled cases; exit code 2 on a miss or a benign alert")
    cases.add_argument("--json", help="also write the report to this file")
    triage = verbs.add_parser("triage", help="act on the alerts of a store, or list them")
    triage.add_argument("log", help="folder of the log of actions")
    triage.add_argument("act", choices=("list", *ACTIONS))
    triage.add_argument("--store", help="alerts to list")
    triage.add_argument("--uid", action="append", default=[], help="alert to act on; may be repeated")
    triage.add_argument("--value", help="status, note, incident or assignee")
    triage.add_argument("--actor", default="analyst")
    triage.add_argument("--status", help="list alerts of this status")
    triage.add_argument("--incident", help="list alerts of this incident")
    triage.add_argument("--open", action="store_true", help="list open alerts")
    risky = verbs.add_parser("risk", help="the entities of most risk over a store")
    risky.add_argument("store")
    risky.add_argument("--limit", type=int, default=10)
    sigma = verbs.add_parser("sigma", help="report on importing a folder of rules")
    sigma.add_argument("folder")
    watch = verbs.add_parser("watch", help="follow log files")
    watch.add_argument("path")
    watch.add_argument("--source", choices=sorted(PARSERS), required=True)
    watch.add_argument("--seconds", type=int, default=2)
    watch.add_argument("--folder", help="where state and checkpoint stand; a later watch of the same folder goes on from them")
    watch.add_argument("--store")
    args = parser.parse_args(argv)
    config = load_config(args.config)
    spark = get_session()
    if args.verb == "run":
        source, make = SCENARIOS[args.scenario]
        rules, correlations = load_rules()
        events = enricher(spark, config)(parse(source, make(spark, f"{config.year}-03-01 10:00:00"), config.year))
        _deliver(_fired(events, rules, correlations, config, "simulation"), events, config, args.store)
    elif args.verb == "replay":
        events, alerts = replay(spark, args.paths, config, args.source)
        _deliver(alerts, events, config, args.store)
    elif args.verb in ("list", "coverage"):
        rules, correlations = load_rules()
        frame = rules_frame(spark, [*rules, *correlations])
        (frame.select("rule_id", "level", "rule_title") if args.verb == "list" else coverage(frame).orderBy("technique")).show(200, truncate=False)
    elif args.verb == "efficacy":
        rules, correlations = load_rules()
        report = evaluate(spark, load_cases(), rules, correlations, enricher(spark, config))
        report.matrix.orderBy("rule_id").show(100, truncate=False)
        if args.json:
            Path(args.json).write_text(json.dumps(report.document(spark), indent=2) + "\n")
        return 0 if report.passed else 2
    elif args.verb == "triage":
        if args.act == "list":
            held = triaged(read_alerts(spark, args.store), read_actions(spark, args.log), args.status, args.open, args.incident)
            held.select("uid", "status", "assignee", "incident", "severity", "rule_title", "group_value", "timestamp").orderBy(F.desc("timestamp"), "uid").show(200, truncate=False)
        else:
            append_actions(spark, args.log, args.act, args.uid, args.value or "", args.actor)
    elif args.verb == "risk":
        risk = risk_of(config, load_rules()[0]) or Risk()
        stored_leaderboard(read_alerts(spark, args.store), risk, args.limit).show(args.limit, truncate=False)
    elif args.verb == "sigma":
        native, _ = load_rules()
        found = import_folder(args.folder)
        for x in found:
            notes = [*x.reasons, *([f"no such field: {', '.join(x.unmapped)}"] if x.unmapped else [])]
            print(f"{'imported' if x.rule else 'skipped '}  {x.path}  {'; '.join(notes)}")
        print(f"{len(merge_native_first(native, [x.rule for x in found if x.rule])) - len(native)} new rules")
    else:
        from .sources.tail import TailSource
        from .streaming.live import LiveMonitor

        spark.dataSource.register(TailSource)
        rules, correlations = load_rules()
        monitor = LiveMonitor(
            spark, rules, correlations, [lambda a: print(console_table(a)), *(p.emit for p in build_pushes(config.notify))], enricher(spark, config), config.alert_window, config.dedup_window,
            risk_of(config, rules), args.folder, lambda rows: parse(args.source, rows, config.year), args.store,
        )
        lines = spark.readStream.format("tail").option("path", args.path).load()
        monitor.start(lines, processingTime=f"{args.seconds} seconds").awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
