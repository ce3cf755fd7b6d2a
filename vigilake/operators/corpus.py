"""Labelled cases: log lines that must, or must not, raise given alerts. All run in one job."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.detect import TRAVEL, fired_alerts
from ..plans.rules import Correlation, Rule, read_document
from ..sources.parsers import PARSERS, parse
from ..sources.scenarios import SCENARIOS
from . import efficacy as EF

BUNDLED = Path(__file__).resolve().parent.parent / "cases"


@dataclass(frozen=True)
class Case:
    """Lines come inline, from a file beside the case, or from a scenario."""

    name: str
    label: str
    source: str
    expects: tuple[str, ...] = ()
    lines: tuple[str, ...] = ()
    scenario: str | None = None
    year: int = 2024


def load_cases(folder: Path | str = BUNDLED) -> list[Case]:
    """Every document of the folder, in order of name; ValueError says what is wrong with one."""
    found = []
    for path in sorted(Path(folder).rglob("*.case.*")):
        doc = read_document(path)
        where = f"{path.name}: "
        if not doc.get("name") or doc.get("label") not in ("attack", "benign"):
            raise ValueError(where + "a case needs a name, and attack or benign as its label")
        scenario = doc.get("scenario")
        if scenario is not None and scenario not in SCENARIOS:
            raise ValueError(where + f"unknown scenario {scenario!r}")
        source = SCENARIOS[scenario][0] if scenario else doc.get("source")
        if source not in PARSERS:
            raise ValueError(where + f"unknown source {source!r}")
        lines = tuple(doc.get("lines") or ())
        if file := doc.get("file"):
            lines += tuple((path.parent / file).read_text(encoding="utf-8", errors="replace").splitlines())
        if not scenario and not lines:
            raise ValueError(where + "no lines")
        if doc["label"] == "attack" and not doc.get("expects"):
            raise ValueError(where + "an attack expects an alert")
        found.append(Case(doc["name"], doc["label"], source, tuple(doc.get("expects") or ()), lines, scenario, int(doc.get("year", 2024))))
    names = [c.name for c in found]
    if len(set(names)) < len(names):
        raise ValueError("repeated case names")
    return found


def case_events(spark: SparkSession, cases: list[Case], start: str = "2024-03-01 10:00:00") -> DataFrame:
    """Events of all cases, with the case's name as their scope: no window spans two cases."""
    parts = []
    for source, year in sorted({(c.source, c.year) for c in cases}):
        own = [c for c in cases if (c.source, c.year) == (source, year)]
        rows = [(c.name, k, line) for c in own for k, line in enumerate(c.lines)]
        lines = spark.createDataFrame(rows, "scope string, ingest_seq long, value string")
        for c in own:
            if c.scenario:
                made = SCENARIOS[c.scenario][1](spark, start)
                lines = lines.unionByName(made.select(F.lit(c.name).alias("scope"), "ingest_seq", "value"))
        parts.append(parse(source, lines, year, carry=("scope",)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass(frozen=True)
class Report:
    matrix: DataFrame
    misses: DataFrame
    benign_alerts: DataFrame
    cases: tuple[Case, ...] = ()
    untested: DataFrame | None = None

    @property
    def passed(self) -> bool:
        return not self.misses.head(1) and not self.benign_alerts.head(1)

    def overall(self, spark: SparkSession) -> DataFrame:
        """One row over all rules, its rates by the benign cases and their lines."""
        benign = [c for c in self.cases if c.label == "benign"]
        lines = sum(len(c.lines) for c in benign)
        for c in benign:
            if c.scenario:
                lines += SCENARIOS[c.scenario][1](spark, "2024-03-01 10:00:00").count()
        return EF.micro(self.matrix, len(benign), self.benign_alerts.select("case_id").distinct().count(), lines)

    def document(self, spark: SparkSession) -> dict:
        """The report as a JSON document: a row per rule, the sums, what was missed, benign alerts and
        rules that no case tries. It is as long as the rules and cases are many."""
        rows = lambda df, *by: [r.asDict() for r in df.orderBy(*by).collect()]
        return {
            "cases": len(self.cases), "attack_cases": sum(c.label == "attack" for c in self.cases), "benign_cases": sum(c.label == "benign" for c in self.cases),
            "passed": self.passed, "overall": self.overall(spark).head().asDict(), "rules": rows(self.matrix, "rule_id"), "misses": rows(self.misses, "case_id", "rule_id"),
            "benign_alerts": rows(self.benign_alerts, "case_id", "rule_id"), "untested": [r["rule_id"] for r in self.untested.orderBy("rule_id").collect()] if self.untested is not None else [],
        }


def evaluate(spark: SparkSession, cases: list[Case], rules: list[Rule], correlations: list[Correlation], enrich=lambda e: e) -> Report:
    """Rules against cases: a confusion row per rule, expectations missed, and alerts on benign cases."""
    alerts = fired_alerts(enrich(case_events(spark, cases)), rules, correlations)
    # at most cases times rules, both of which are documents on the driver; so the plan runs once for all of the report
    fired = spark.createDataFrame(alerts.select("scope", "rule_id").distinct().collect(), "case_id string, rule_id string")
    frame = spark.createDataFrame([(c.name, c.label) for c in cases], "case_id string, label string")
    expected = spark.createDataFrame([(c.name, r) for c in cases for r in c.expects], "case_id string, rule_id string")
    known = spark.createDataFrame([(r.id,) for r in [*rules, *correlations, TRAVEL]], "rule_id string")
    benign = fired.join(frame.where("label = 'benign'"), "case_id", "left_semi")
    matrix = EF.metrics(EF.confusion(frame.select("case_id"), known, expected, fired))
    feeders = spark.createDataFrame([(r,) for c in correlations for r in c.rules], "rule_id string")
    return Report(matrix, EF.misses(expected, fired), benign, tuple(cases), EF.untested(known, expected, matrix, feeders))
