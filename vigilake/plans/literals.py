"""Many rules at once: one pass over a field tells which of all rules' literals it holds.

A rule that needs one of some ``contains`` literals is tried only where one of them stands. All
literals of a field become one pattern, a trie, so its cost for a character hardly depends on how many
there are; what it finds is joined with the rules, and no expression grows with their number.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import field
from .rules import Rule

#: Longest pattern; more literals go in several, each a pass of its own over the field.
MOST_PATTERN = 200_000


@dataclass(frozen=True)
class Guard:
    """Literals, one of which a field holds wherever the rule picks an event; ``whole`` if that is all
    the rule asks for, besides its log source."""

    path: str
    literals: tuple[str, ...]
    whole: bool


def guard_of(rule: Rule) -> Guard | None:
    """A guard of a rule whose condition is one selection, or several joined by ``and``."""
    head = rule.condition.partition("|")[0].strip()
    names = re.split(r"\s+and\s+", head)
    if not all(re.fullmatch(r"[\w.-]+", n) and n in rule.selections and n not in ("not", "or") for n in names):
        return None
    best = None
    entries = [(k, v) for n in names if isinstance(rule.selections[n], dict) for k, v in rule.selections[n].items()]
    plain = all(isinstance(rule.selections[n], dict) for n in names)
    for spec, wanted in entries:
        path, _, modifier = spec.partition("|")
        values = wanted if isinstance(wanted, list) else [wanted]
        literals = tuple(sorted({(str(v).lower() if isinstance(v, bool) else str(v)).lower() for v in values}))
        if modifier == "contains" and all(literals) and (best is None or min(map(len, literals)) > min(map(len, best.literals))):
            best = Guard(path, literals, plain and len(entries) == 1)
    return best


def trie_pattern(literals: list[str]) -> str:
    """A pattern of all literals that takes the longest at a place."""
    tree: dict = {}
    for x in literals:
        at = tree
        for c in x:
            at = at.setdefault(c, {})
        at[""] = {}

    def build(at: dict) -> str:
        # a chain without branches is one piece, so that nesting follows branches and not length
        piece = ""
        while len(at) == 1 and "" not in at:
            (c, at), = at.items()
            piece += java_quoted(c)
        rest = [java_quoted(c) + build(sub) for c, sub in sorted(at.items()) if c]
        if not rest:
            return piece
        return piece + "(?:" + "|".join(rest) + ")" + ("?" if "" in at else "")

    return build(tree)


def java_quoted(c: str) -> str:
    return c if c.isalnum() and ord(c) < 128 else f"\\x{{{ord(c):x}}}"


def patterns(literals: list[str]) -> list[str]:
    """Tries of at most some MOST_PATTERN characters."""
    chunks, size = [[]], 0
    for x in sorted(literals):
        size += 8 * len(x)
        if size > MOST_PATTERN and chunks[-1]:
            chunks.append([])
            size = 8 * len(x)
        chunks[-1].append(x)
    return [trie_pattern(c) for c in chunks if c]


def _of(path: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(path).alias("path"), x.alias("literal"))


def _stands_in(path: str) -> Callable[[Column], Column]:
    return lambda x: x["path"] == F.lit(path)


def indexed_hits(events: DataFrame, rules: list[Rule], seq: str = "ingest_seq", resolve: Callable[[str], Column] = field) -> DataFrame:
    """(seq, rule_id) of every rule, threshold or not, and every event that it picks.

    Rules with a guard come from one pass per field and a join of what it finds with (literal, rule);
    those that ask for more than the guard are then tried on these few rows, the rest (no guard) in the
    same scan. ``seq`` numbers the events.
    """
    guards = {r.id: g for r in rules if (g := guard_of(r))}
    whole = [r for r in rules if r.id in guards and guards[r.id].whole]
    partly = [r for r in rules if r.id in guards and not guards[r.id].whole]
    loose = [r for r in rules if r.id not in guards]
    by_path = defaultdict(set)
    for g in guards.values():
        by_path[g.path].update(g.literals)
    found = []
    for path, literals in sorted(by_path.items()):
        text = F.lower(resolve(path).cast("string"))
        for p in patterns(sorted(literals)):
            # at each place the longest literal; shorter ones that begin there are its beginnings
            held = F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(f"(?=({p}))"), F.lit(1)), F.array().cast("array<string>")))
            found.append(F.transform(held, _of(path)))
    rest = F.array_compact(F.array(*(F.when(r.predicate(resolve), F.lit(r.id)) for r in loose))) if loose else F.array().cast("array<string>")
    category, service = F.coalesce(resolve("event.category"), F.lit("")).cast("string"), F.coalesce(resolve("process.name"), F.lit("")).cast("string")
    tests = {r.id: r.predicate(resolve) for r in partly}
    sure = F.array_compact(F.array(*(F.when(F.exists("_found", _stands_in(guards[r.id].path)), F.when(tests[r.id], F.lit(r.id))) for r in partly))) if partly else F.array().cast("array<string>")
    marked = events.withColumn("_found", F.flatten(F.array(*found)) if found else F.array().cast("array<struct<path:string,literal:string>>"))
    marked = marked.select(F.col(seq).alias("seq"), category.alias("_category"), service.alias("_service"), "_found", F.concat(rest, sure).alias("_rest"))
    marked = marked.where((F.size("_found") > 0) | (F.size("_rest") > 0))
    spark = events.sparkSession
    wanted = defaultdict(set)
    for path, literals in by_path.items():
        for x in literals:
            wanted[path, x].update(y for k in range(1, len(x) + 1) if (y := x[:k]) in literals)
    holders = defaultdict(list)
    for r in whole:
        for x in guards[r.id].literals:
            holders[guards[r.id].path, x].append((r.id, str(r.logsource.get("category") or ""), str(r.logsource.get("service") or "")))
    rows = sorted({(path, x, *h) for (path, x), shorter in wanted.items() for y in shorter for h in holders[path, y]})
    index = spark.createDataFrame(rows, "path string, literal string, rule_id string, category string, service string")
    pairs = marked.select("seq", "_category", "_service", F.explode("_found").alias("_f")).select("seq", "_category", "_service", "_f.path", "_f.literal")
    fits = ((F.col("category") == "") | (F.col("category") == F.col("_category"))) & F.startswith(F.col("_service"), F.col("service"))
    of_index = pairs.join(index, ["path", "literal"]).where(fits).select("seq", "rule_id").distinct()
    return of_index.unionByName(marked.select("seq", F.explode("_rest").alias("rule_id")))
