"""Rule conditions: parsed once on the driver and compiled to boolean columns."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import field

#: Modifiers of a field, and the longest pattern that is tried.
MODIFIERS = ("contains", "startswith", "endswith", "re")
LONGEST_PATTERN = 1024


@dataclass(frozen=True)
class Threshold:
    """``count() [by field] op value``."""

    by: str | None
    op: str
    value: int


@dataclass(frozen=True)
class Condition:
    predicate: Callable[[dict[str, Column]], Column]
    threshold: Threshold | None


def _one_value(column: Column, modifier: str | None, value: object) -> Column:
    text = column.cast("string")
    if modifier == "re":
        pattern = str(value)
        if len(pattern) > LONGEST_PATTERN or not _valid(pattern):
            warnings.warn(f"pattern matches nothing: invalid or over {LONGEST_PATTERN} characters: {pattern[:60]!r}", stacklevel=2)
            return F.lit(False)
        return text.rlike("(?dU)" + pattern)  # classes by Unicode; $ before a line feed alone
    folded, wanted = F.lower(text), F.lit((str(value).lower() if isinstance(value, bool) else str(value)).lower())
    if modifier == "contains":
        return F.contains(folded, wanted)
    if modifier == "startswith":
        return F.startswith(folded, wanted)
    if modifier == "endswith":
        return F.endswith(folded, wanted)
    return folded == wanted


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def compile_selection(selection: object, resolve: Callable[[str], Column] = field) -> Column:
    """A map is AND over its fields, a list of maps OR, a list of values OR. A missing field matches
    nothing: every leaf is two-valued, so that NOT of it is true."""
    if isinstance(selection, list):
        return reduce(Column.__or__, (compile_selection(x, resolve) for x in selection), F.lit(False))
    if not isinstance(selection, dict):
        raise ValueError(f"a selection is a map or a list of maps, not {selection!r}")

    def entry(spec: str, wanted: object) -> Column:
        name, _, modifier = spec.partition("|")
        if modifier and modifier not in MODIFIERS:
            raise ValueError(f"unsupported modifier {modifier!r}")
        values = wanted if isinstance(wanted, list) else [wanted]
        if not modifier and len(values) > 1:
            test = F.lower(resolve(name).cast("string")).isin([str(v).lower() for v in values])
        else:
            test = reduce(Column.__or__, (_one_value(resolve(name), modifier or None, v) for v in values), F.lit(False))
        return F.coalesce(test, F.lit(False))

    return reduce(Column.__and__, (entry(k, v) for k, v in selection.items()), F.lit(True))


_TOKEN = re.compile(r"\s*(\(|\)|[\w.*-]+)")
_COUNT = re.compile(r"count\(\)\s*(?:by\s+([\w.@]+))?\s*(>=|<=|==|>|<)\s*(\d+)")


def parse_condition(text: str) -> Condition:
    """Boolean expression over selections, and an optional threshold after a bar.

    ``or`` binds weakest, then ``and``, then ``not``; ``1 of`` and ``all of`` take ``them``, a prefix
    with ``*``, or one name. An unknown name, and a quantifier over no selection, are false.
    """
    head, bar, tail = text.partition("|")
    threshold = None
    if bar:
        found = _COUNT.fullmatch(tail.strip())
        if not found:
            raise ValueError(f"unsupported aggregation: {tail.strip()!r}")
        threshold = Threshold(found[1], found[2], int(found[3]))
    tokens, at = [], 0
    head = head.strip()
    while at < len(head):
        found = _TOKEN.match(head, at)
        if not found:
            raise ValueError(f"unexpected text in condition: {head[at:]!r}")
        tokens.append(found[1])
        at = found.end()
    if not tokens:
        raise ValueError("empty condition")
    place = 0

    def peek() -> str | None:
        return tokens[place] if place < len(tokens) else None

    def take() -> str:
        nonlocal place
        if place >= len(tokens):
            raise ValueError(f"condition ends early: {text!r}")
        place += 1
        return tokens[place - 1]

    def chain(word: str, part, join):
        parts = [part()]
        while peek() == word:
            take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else lambda s: reduce(join, (p(s) for p in parts))

    def either():
        return chain("or", both, Column.__or__)

    def both():
        return chain("and", negated, Column.__and__)

    def negated():
        if peek() == "not":
            take()
            inner = negated()
            return lambda s: ~inner(s)
        return primary()

    def primary():
        token = take()
        if token == "(":
            inner = either()
            if take() != ")":
                raise ValueError(f"unbalanced parentheses: {text!r}")
            return inner
        if token in ("1", "all") and peek() == "of":
            take()
            pattern = take()

            def quantified(s: dict[str, Column]) -> Column:
                if pattern == "them":
                    chosen = list(s.values())
                elif pattern.endswith("*"):
                    chosen = [c for k, c in s.items() if k.startswith(pattern[:-1])]
                else:
                    chosen = [s[pattern]] if pattern in s else []
                if not chosen:
                    return F.lit(False)
                return reduce(Column.__or__ if token == "1" else Column.__and__, chosen)

            return quantified
        if token in (")", "and", "or", "not", "of"):
            raise ValueError(f"unexpected {token!r} in condition {text!r}")
        return lambda s: s.get(token, F.lit(False))

    predicate = either()
    if peek() is not None:
        raise ValueError(f"unexpected {peek()!r} in condition {text!r}")
    return Condition(predicate, threshold)
