"""Durations such as ``5m``: an integer and one of s, m, h, d."""

import re

#: Seconds of each unit.
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86_400}


def parse_duration(text: str | int) -> int:
    """Seconds; surrounding blanks are allowed, anything else raises ValueError."""
    found = re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", str(text))
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    return int(found[1]) * SECONDS[found[2]]


def micros(text: str | int) -> int:
    return parse_duration(text) * 1_000_000
