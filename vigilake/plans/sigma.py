"""Import of rules written for other products in the common rule format."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from ..schema import field_type
from .rules import Rule, read_document, rule_from_document

#: Field names of imported rules and the normalised fields they mean.
FIELD_NAMES = {
    "Image": "process.executable",
    "OriginalFileName": "process.executable",
    "CommandLine": "process.command_line",
    "ParentImage": "process.parent.executable",
    "ParentCommandLine": "process.parent.command_line",
    "User": "user.name",
    "EventID": "winlog.event_id",
    "Computer": "host.name",
    "SourceIp": "source.ip",
    "SourcePort": "source.port",
    "DestinationIp": "destination.ip",
    "DestinationPort": "destination.port",
    "Protocol": "network.protocol",
}
#: Log source categories of imported rules and the normalised categories.
CATEGORIES = {"process_creation": "process", "network_connection": "network", "process_access": "process", "image_load": "process"}


@dataclass(frozen=True)
class ImportedRule:
    """What became of one document: a rule, or the reasons why not."""

    path: str
    title: str
    rule: Rule | None
    reasons: tuple[str, ...] = ()
    #: Fields that no normalised field stands for: the rule imports, but nothing will match on them.
    unmapped: tuple[str, ...] = ()


def translate_selection(selection: object) -> object:
    if isinstance(selection, list):
        return [translate_selection(x) for x in selection]
    if isinstance(selection, dict):
        names = ((*k.partition("|"), v) for k, v in selection.items())
        return {FIELD_NAMES.get(name, name) + bar + modifier: v for name, bar, modifier, v in names}
    return selection


def reasons_against(detection: object) -> list[str]:
    if not isinstance(detection, dict):
        return ["no detection"]
    found = []
    condition = detection.get("condition")
    if isinstance(condition, list):
        found.append("several conditions")
    elif not condition:
        found.append("no condition")
    selections = {k: v for k, v in detection.items() if k not in ("condition", "timeframe")}
    if not selections:
        found.append("no selections")

    def look(name: str, selection: object) -> None:
        if isinstance(selection, list):
            for x in selection:
                look(name, x)
        elif isinstance(selection, dict):
            for key, value in selection.items():
                if (modifier := key.partition("|")[2]) and modifier not in ("contains", "startswith", "endswith", "re"):
                    found.append(f"modifier {modifier!r} in {name}")
                if value is None or (isinstance(value, list) and None in value):
                    found.append(f"null value in {name}")
        else:
            found.append(f"keywords in {name}")

    for name, selection in selections.items():
        look(name, selection)
    return list(dict.fromkeys(found))


def unmapped_fields(detection: dict) -> list[str]:
    """Names in the selections that are neither translated nor fields of the normalised event."""
    found = []

    def look(selection: object) -> None:
        for x in selection if isinstance(selection, list) else ():
            look(x)
        for key in selection if isinstance(selection, dict) else ():
            name = key.partition("|")[0]
            if name not in FIELD_NAMES and "." not in name and field_type(name) is None:
                found.append(name)

    for name, selection in detection.items():
        if name not in ("condition", "timeframe"):
            look(selection)
    return sorted(set(found))


def import_document(doc: object, path: str = "") -> ImportedRule:
    if not isinstance(doc, dict):
        return ImportedRule(path, "", None, ("not a rule document",))
    title = str(doc.get("title", ""))
    if reasons := reasons_against(doc.get("detection")):
        return ImportedRule(path, title, None, tuple(reasons))
    logsource = dict(doc.get("logsource") or {})
    if (category := logsource.pop("category", None)) in CATEGORIES:
        logsource["category"] = CATEGORIES[category]
    detection = {k: v if k in ("condition", "timeframe") else translate_selection(v) for k, v in doc["detection"].items()}
    try:
        rule = rule_from_document({**doc, "logsource": logsource, "detection": detection, "risk_score": None})
    except ValueError as e:
        return ImportedRule(path, title, None, (str(e),))
    return ImportedRule(path, title, rule, unmapped=tuple(unmapped_fields(doc["detection"])))


def import_folder(folder: Path | str) -> list[ImportedRule]:
    """Every document below the folder, in order of path."""
    found = []
    for path in sorted(p for p in Path(folder).rglob("*") if p.suffix in (".yml", ".yaml", ".json")):
        try:
            doc = read_document(path)
        except Exception as e:  # noqa: BLE001  a broken document is reported, not fatal
            found.append(ImportedRule(str(path), "", None, (f"unreadable: {e}",)))
            continue
        found.append(import_document(doc, str(path)))
    return found


def merge_native_first(native: list[Rule], imported: list[Rule]) -> list[Rule]:
    """Imported rules whose id a native rule has are dropped."""
    known = {r.id for r in native}
    return [*native, *(r for r in imported if r.id not in known)]
