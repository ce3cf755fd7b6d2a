"""Lookup files: blocklists, places, assets and identities. Small, so read on the driver."""

from __future__ import annotations

import csv
import ipaddress
from pathlib import Path

from ..plans.rules import read_document


def _lines(path: str | Path) -> list[str]:
    text = Path(path).read_text(encoding="utf-8", errors="replace")
    return [x for line in text.splitlines() if (x := line.partition("#")[0].strip())]


def _network(text: str) -> bool:
    try:
        ipaddress.ip_network(text, strict=False)
    except ValueError:
        return False
    return True


def read_blocklist(path: str | Path) -> list[str]:
    """An address or CIDR per line; comments and malformed lines are passed over."""
    return [x for x in _lines(path) if _network(x)]


def read_geoip(path: str | Path) -> list[tuple]:
    """cidr, country code, country, AS number, AS organization; rows with a bad CIDR or number are out."""
    found = []
    for row in csv.reader(_lines(path)):
        row = [x.strip() for x in row]
        if len(row) == 5 and _network(row[0]) and row[3].isdigit():
            found.append((row[0], row[1], row[2], int(row[3]), row[4]))
    return found


def read_assets(path: str | Path) -> tuple[list[tuple], dict[str, str]]:
    """(cidr, hostname, trusted) rows and roles by user name; hosts are trusted unless said otherwise."""
    doc = read_document(Path(path)) or {}
    hosts = [(h["cidr"], h.get("hostname"), bool(h.get("trusted", True))) for h in doc.get("hosts") or [] if _network(str(h.get("cidr", "")))]
    return hosts, {str(k): str(v) for k, v in (doc.get("identities") or {}).items()}
