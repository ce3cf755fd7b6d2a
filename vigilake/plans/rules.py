"""Rule documents: specifications, loading with validation, and their compilation to columns."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durations import parse_duration
from ..schema import field as event_field
from .condition import Condition, compile_selection, parse_condition

BUNDLED = Path(__file__).resolve().parent.parent / "rules"
LEVELS = ("informational", "low", "medium", "high", "critical")


@dataclass(frozen=True)
class Rule:
    """One detection: selections, a condition over them, and what its alerts say."""

    id: str
    title: str
    selections: dict
    condition: str
    description: str = ""
    level: str = "medium"
    logsource: dict = field(default_factory=dict)
    timeframe: str | None = None
    tags: tuple[str, ...] = ()
    risk_score: int | None = None

    @property
    def parsed(self) -> Condition:
        return parse_condition(self.condition)

    def predicate(self, resolve=event_field) -> Column:
        """Which events the rule's selections and log source pick."""
        chosen = {k: compile_selection(v, resolve) for k, v in self.selections.items()}
        return logsource_predicate(self.logsource, resolve) & self.parsed.predicate(chosen)

    def window(self, default: str) -> int:
        return parse_duration(self.timeframe or default)


@dataclass(frozen=True)
class Correlation:
    """Firings of several rules of one group within a timespan, in order or not."""

    id: str
    title: str
    type: str
    rules: tuple[str, ...]
    timespan: str
    group_by: tuple[str, ...] = ()
    generate: bool | tuple[str, ...] = False
    description: str = ""
    level: str = "medium"
    tags: tuple[str, ...] = ()

    @property
    def suppressed(self) -> set[str]:
        """The rules it refers to that raise no alerts of their own."""
        if self.generate is True:
            return set()
        return set(self.rules) - set(self.generate or ())


def logsource_predicate(logsource: dict, resolve=event_field) -> Column:
    """Category exactly; service as a prefix of the process name; product says nothing."""
    test = F.lit(True)
    if category := logsource.get("category"):
        test = test & F.coalesce(resolve("event.category") == F.lit(category), F.lit(False))
    if service := logsource.get("service"):
        test = test & F.startswith(F.coalesce(resolve("process.name"), F.lit("")), F.lit(service))
    return test


def read_document(path: Path) -> dict:
    """A JSON document, or a YAML one where PyYAML is there."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError(f"reading {path} needs PyYAML") from e
    return yaml.safe_load(text)


def rule_from_document(doc: dict) -> Rule | Correlation:
    """Validates and builds; ValueError names what is wrong."""
    for key in ("id", "title"):
        if not doc.get(key):
            raise ValueError(f"a rule needs {key}")
    level = str(doc.get("level", "medium")).lower()
    common = {"id": str(doc["id"]), "title": str(doc["title"]), "description": str(doc.get("description", "")).strip(), "level": level, "tags": tuple(doc.get("tags") or ())}
    if spec := doc.get("correlation"):
        if spec.get("type") not in ("temporal", "temporal_ordered"):
            raise ValueError(f"{doc['id']}: correlation type {spec.get('type')!r}")
        rules = tuple(spec.get("rules") or ())
        if len(rules) < 2:
            raise ValueError(f"{doc['id']}: a correlation needs two rules")
        if len(set(rules)) < len(rules):
            raise ValueError(f"{doc['id']}: a rule is named twice")
        parse_duration(spec.get("timespan"))
        group = spec.get("group-by") or ()
        generate = spec.get("generate", False)
        return Correlation(
            **common, type=spec["type"], rules=rules, timespan=str(spec["timespan"]),
            group_by=(group,) if isinstance(group, str) else tuple(group),
            generate=generate if isinstance(generate, bool) else tuple(generate),
        )
    detection = doc.get("detection")
    if not isinstance(detection, dict) or not detection.get("condition"):
        raise ValueError(f"{doc['id']}: a detection needs a condition")
    selections = {k: v for k, v in detection.items() if k not in ("condition", "timeframe")}
    if not selections:
        raise ValueError(f"{doc['id']}: a detection needs a selection")
    if timeframe := detection.get("timeframe"):
        parse_duration(timeframe)
    score = doc.get("risk_score")
    rule = Rule(
        **common, selections=selections, condition=str(detection["condition"]), logsource=dict(doc.get("logsource") or {}),
        timeframe=timeframe, risk_score=None if score is None else int(score),
    )
    rule.parsed  # noqa: B018  raises on a bad condition
    for selection in selections.values():
        check_selection(selection)
    return rule


def check_selection(selection: object) -> None:
    from .condition import MODIFIERS

    if isinstance(selection, list):
        for x in selection:
            check_selection(x)
    elif isinstance(selection, dict):
        for spec in selection:
            if (modifier := spec.partition("|")[2]) and modifier not in MODIFIERS:
                raise ValueError(f"unsupported modifier {modifier!r}")
    else:
        raise ValueError("a selection is a map or a list of maps")


def load_rules(folder: Path | str = BUNDLED) -> tuple[list[Rule], list[Correlation]]:
    """All rule documents of a folder, by id. Repeated ids and unknown references raise."""
    found = [rule_from_document(read_document(p)) for p in sorted(Path(folder).iterdir()) if p.suffix in (".json", ".yml", ".yaml")]
    ids = [r.id for r in found]
    if repeated := {i for i in ids if ids.count(i) > 1}:
        raise ValueError(f"repeated rule ids: {sorted(repeated)}")
    rules = sorted((r for r in found if isinstance(r, Rule)), key=lambda r: r.id)
    correlations = sorted((r for r in found if isinstance(r, Correlation)), key=lambda r: r.id)
    known = {r.id for r in rules}
    for c in correlations:
        if unknown := set(c.rules) - known:
            raise ValueError(f"{c.id}: unknown rules {sorted(unknown)}")
    return rules, correlations


def suppressed_ids(correlations: list[Correlation]) -> set[str]:
    """A rule is silent if a correlation silences it."""
    return set().union(*(c.suppressed for c in correlations)) if correlations else set()


def rules_frame(spark: SparkSession, rules: list[Rule | Correlation]) -> DataFrame:
    """The rules as a dimension table."""
    rows = [(r.id, r.title, r.level, r.description, list(r.tags), getattr(r, "risk_score", None), isinstance(r, Correlation)) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, rule_title string, level string, description string, tags array<string>, risk_score int, is_correlation boolean")
