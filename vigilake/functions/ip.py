"""Addresses: validity, private ranges, and longest-prefix joins as hash joins."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
V4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"

#: Special-purpose ranges that have no place in the world (private, loopback,
#: link-local, reserved, documentation, benchmarking), and the addresses in them that do.
PRIVATE = """
    0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.0.170/31 192.0.2.0/24 192.168.0.0/16
    198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4 255.255.255.255/32
    ::1/128 ::/128 ::ffff:0:0/96 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 fc00::/7 fe80::/10
""".split()
PUBLIC_WITHIN = """
    192.0.0.9/32 192.0.0.10/32 2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28
""".split()


def v4_number(ip: Column) -> Column:
    """The address as a number, or null if it isn't a dotted IPv4 address."""
    number = F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda n, x: n * 256 + x.try_cast("long"))
    return F.when(ip.rlike(V4), number)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), use)[0]


def v6_hex(ip: Column) -> Column:
    """32 hexadecimal digits of an IPv6 address, else null. A zone after % doesn't count."""

    def with_groups(text: Column) -> Column:
        last = F.substring_index(text, ":", -1)
        number = v4_number(last)
        tail = F.concat(F.hex(F.floor(number / 65536)), F.lit(":"), F.hex(F.pmod(number, F.lit(65536))))
        return F.when(last.contains("."), F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(last)), tail)).otherwise(text)

    def groups(half: Column) -> Column:
        return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def filled(halves: Column) -> Column:
        left, right = groups(halves[0]), F.when(F.size(halves) == 2, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        zeros = 8 - F.size(left) - F.size(right)
        fits = ((F.size(halves) == 1) & (zeros == 0)) | ((F.size(halves) == 2) & (zeros >= 1))
        return F.when(fits, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(zeros, F.lit(0))), right))

    def digits(eight: Column) -> Column:
        return F.when(F.forall(eight, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")), F.lower(F.array_join(F.transform(eight, lambda g: F.lpad(g, 4, "0")), "")))

    found = _let(with_groups(F.substring_index(ip, "%", 1)), lambda t: _let(_let(F.split(t, "::"), filled), digits))
    return F.when(ip.contains(":") & ~ip.rlike("%$|%.*%"), found)


def is_ip(ip: Column) -> Column:
    return F.coalesce(ip.rlike(V4) | v6_hex(ip).isNotNull(), F.lit(False))


def _ranges(names: list[str], version: int) -> list[tuple[int, int]]:
    nets = [ipaddress.ip_network(c) for c in names]
    return [(int(n.network_address), int(n.broadcast_address)) for n in nets if n.version == version]


def _within(value: Column, ranges: list[tuple]) -> Column:
    """One test over a literal array, so that the value's own expression isn't copied for each range."""
    listed = F.array(*(F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in ranges))
    return F.exists(listed, lambda r: (r["lo"] <= value) & (value <= r["hi"]))


def is_private(number: Column) -> Column:
    """Whether an IPv4 number lies in a range without a place; null stays null."""
    return _within(number, _ranges(PRIVATE, 4)) & ~_within(number, _ranges(PUBLIC_WITHIN, 4))


def is_private_v6(digits: Column) -> Column:
    """The same for an IPv6 address as 32 hexadecimal digits."""
    text = lambda rows: [(f"{lo:032x}", f"{hi:032x}") for lo, hi in rows]
    return _within(digits, text(_ranges(PRIVATE, 6))) & ~_within(digits, text(_ranges(PUBLIC_WITHIN, 6)))


def network_rows(rows: list[tuple]) -> list[tuple]:
    """(version, network as hex of 32 digits, prefix length, *rest) of rows that start with a CIDR or
    an address; rows whose first value is neither are left out."""
    found = []
    for cidr, *rest in rows:
        try:
            net = ipaddress.ip_network(str(cidr).strip(), strict=False)
        except ValueError:
            continue
        found.append((net.version, f"{int(net.network_address):032x}", net.prefixlen, *rest))
    return found


def longest_prefixes(addresses: DataFrame, ip: str, networks: DataFrame, tables: dict[str, list[str]], public_only: tuple[str, ...] = ()) -> DataFrame:
    """(ip, a struct for each of ``tables``): of each distinct address the values and prefix_len of
    the longest network of each table that holds it, null where none does (for tables in
    ``public_only`` for addresses without a place too).

    ``networks`` (table, version, network, prefix_len, ...) has the rows of all tables, which are
    dimensions. Each distinct address is masked once to each of the prefix lengths in use (162 at
    most), so all lookups are one equi join; Spark broadcasts ``networks`` while it is small and
    shuffles by key beyond that.
    """
    distinct = addresses.select(ip).where(F.col(ip).isNotNull()).distinct()
    keyed = distinct.withColumns({"_v4": v4_number(F.col(ip)), "_v6": v6_hex(F.col(ip))})
    hidden = F.coalesce(is_private(F.col("_v4")), F.lit(False)) | F.coalesce(is_private_v6(F.col("_v6")), F.lit(False))
    keyed = keyed.withColumns({"version": F.when(F.col("_v4").isNotNull(), 4).when(F.col("_v6").isNotNull(), 6), "_hidden": hidden})
    lengths = networks.select("version", "prefix_len").distinct()
    masked = keyed.where("version is not null").join(F.broadcast(lengths), "version")  # 33 lengths and 129 at most
    span = F.pow(F.lit(2.0), 32 - F.col("prefix_len")).cast("long")
    v4 = F.lpad(F.lower(F.hex(F.col("_v4") - F.pmod(F.col("_v4"), span))), 32, "0")
    digits = F.floor(F.col("prefix_len") / 4).cast("int")
    nibble = F.conv(F.substring(F.col("_v6"), digits + 1, F.lit(1)), 16, 10).cast("long")
    part = F.pow(F.lit(2.0), 4 - F.pmod("prefix_len", F.lit(4))).cast("long")
    edge = F.when(F.col("prefix_len") % 4 == 0, F.lit("")).otherwise(F.lower(F.hex(nibble - F.pmod(nibble, part))))
    v6 = F.rpad(F.concat(F.substring(F.col("_v6"), F.lit(1), digits), edge), 32, "0")
    masked = masked.withColumn("network", F.when(F.col("version") == 4, v4).otherwise(v6)).select(ip, "_hidden", "version", "network", "prefix_len")
    found = masked.join(networks, ["version", "network", "prefix_len"])

    def longest(name: str, values: list[str]) -> Column:
        held = F.col("table") == name
        held = held & ~F.col("_hidden") if name in public_only else held
        return F.max_by(F.when(held, F.struct(*values, "prefix_len")), F.when(held, F.col("prefix_len"))).alias(name)

    return found.groupBy(ip).agg(*(longest(name, values) for name, values in tables.items()))
