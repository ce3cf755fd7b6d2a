"""Threat lists, places, assets and identities joined to events by address and user."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ip import longest_prefixes, network_rows

NETWORK = {"version": pa.int32(), "network": pa.string(), "prefix_len": pa.int32()}
BLOCKED = {"feed": pa.string()}
PLACE = {"country_iso": pa.string(), "country_name": pa.string(), "asn": pa.int64(), "as_org": pa.string()}
ASSET = {"hostname": pa.string(), "trusted": pa.bool_()}


def _frame(spark: SparkSession, rows: list[tuple], columns: dict[str, pa.DataType]) -> DataFrame:
    """A table of known size, so that Spark itself can tell whether it is small enough to broadcast."""
    values = list(zip(*rows, strict=True)) or [()] * len(columns)
    return spark.createDataFrame(pa.table([pa.array(v, t) for v, t in zip(values, columns.values(), strict=True)], names=list(columns)))


def blocklist_frame(spark: SparkSession, cidrs: list[str], feed: str = "blocklist") -> DataFrame:
    return _frame(spark, network_rows([(c, feed) for c in cidrs]), NETWORK | BLOCKED)


def geo_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (cidr, country code, country name, AS number, AS organization)."""
    return _frame(spark, network_rows(rows), NETWORK | PLACE)


def asset_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (cidr, hostname, trusted)."""
    return _frame(spark, network_rows(rows), NETWORK | ASSET)


def identity_frame(spark: SparkSession, roles: dict[str, str]) -> DataFrame:
    return _frame(spark, [(k.lower(), v) for k, v in roles.items()], {"user_key": pa.string(), "role": pa.string()})


def _matches(events: DataFrame, ip: str, **frames: DataFrame | None) -> DataFrame:
    """``events`` with a struct for each lookup table that is given, all found in one pass over the distinct addresses."""
    kept = {"blocklist": list(BLOCKED), "geo": list(PLACE), "assets": list(ASSET)}
    given = {k: df.withColumn("table", F.lit(k)) for k, df in frames.items() if df is not None}
    if not given:
        return events
    networks = None
    for df in given.values():
        networks = df if networks is None else networks.unionByName(df, allowMissingColumns=True)
    return events.join(longest_prefixes(events, ip, networks, {k: kept[k] for k in given}, public_only=("geo",)), ip, "left")


def ioc_match(events: DataFrame, ip: str, blocklist: DataFrame) -> DataFrame:
    """Adds ioc_matched and ioc_feed; an absent or invalid address matches nothing."""
    joined = _matches(events, ip, blocklist=blocklist)
    return joined.select(*events.columns, F.col("blocklist").isNotNull().alias("ioc_matched"), F.col("blocklist.feed").alias("ioc_feed"))


def geo_lookup(events: DataFrame, ip: str, geo: DataFrame) -> DataFrame:
    """Adds country_iso, country_name, asn, as_org; addresses in special-purpose ranges have none."""
    return _matches(events, ip, geo=geo).select(*events.columns, *(F.col(f"geo.{c}").alias(c) for c in PLACE))


def _trusted(ip: str, match: Column) -> Column:
    present = F.col(ip).isNotNull() & (F.col(ip) != "")
    return F.when(present, F.coalesce(match, F.lit(False)))


def asset_lookup(events: DataFrame, ip: str, assets: DataFrame) -> DataFrame:
    """Adds asset_name and trusted; trusted is false where an address is there but no asset, and null
    without an address."""
    joined = _matches(events, ip, assets=assets)
    return joined.select(*events.columns, F.col("assets.hostname").alias("asset_name"), _trusted(ip, F.col("assets.trusted")).alias("trusted"))


def identity_role(events: DataFrame, user: str, identities: DataFrame) -> DataFrame:
    """Adds role, by user name without regard to case."""
    keyed = events.withColumn("user_key", F.lower(F.col(user).cast("string")))
    return keyed.join(identities, "user_key", "left").drop("user_key")


def enrich_flat(events: DataFrame, ip: str, user: str, blocklist: DataFrame | None = None, geo: DataFrame | None = None, assets: DataFrame | None = None, identities: DataFrame | None = None) -> DataFrame:
    """All four; a missing table leaves its columns null (ioc_matched false)."""
    found = _matches(events, ip, blocklist=blocklist, geo=geo, assets=assets)
    none = lambda kind: F.lit(None).cast(kind)
    kinds = dict(zip(PLACE, ("string", "string", "long", "string"), strict=True))
    out = found.select(
        *events.columns,
        (F.col("blocklist").isNotNull() if blocklist is not None else F.lit(False)).alias("ioc_matched"),
        (F.col("blocklist.feed") if blocklist is not None else none("string")).alias("ioc_feed"),
        *((F.col(f"geo.{c}") if geo is not None else none(kind)).alias(c) for c, kind in kinds.items()),
        (F.col("assets.hostname") if assets is not None else none("string")).alias("asset_name"),
        (_trusted(ip, F.col("assets.trusted")) if assets is not None else none("boolean")).alias("trusted"),
    )
    return identity_role(out, user, identities) if identities is not None else out.withColumn("role", none("string"))


def enrich_events(events: DataFrame, **tables: DataFrame | None) -> DataFrame:
    """Normalised events with threat, source.geo, source.as, source.asset and user.role filled in.
    Distinct addresses are looked up and joined back by address; roles are joined by user."""
    joined = enrich_flat(events.withColumns({"_ip": F.col("source.ip"), "_user": F.col("user.name")}), "_ip", "_user", **tables)
    geo = F.when(F.col("country_iso").isNotNull(), F.struct(F.col("country_iso").alias("country_iso_code"), F.col("country_name")))
    system = F.when(F.col("asn").isNotNull(), F.struct(F.col("asn").alias("number"), F.col("as_org").alias("organization")))
    asset = F.when(F.col("trusted").isNotNull(), F.struct(F.col("asset_name").alias("name"), F.col("trusted")))
    threat = F.when(F.col("ioc_matched"), F.struct(F.lit(True).alias("matched"), F.col("ioc_feed").alias("feed")))
    out = joined.withColumn("source", F.col("source").withField("geo", geo).withField("as", system).withField("asset", asset))
    out = out.withColumn("threat", threat).withColumn("user", F.when(F.col("user").isNotNull(), F.col("user").withField("role", F.col("role"))))
    return out.select(*events.columns)


def enrich_alert(alerts: DataFrame, events: str = "events") -> DataFrame:
    """Adds the struct enrichment from the first evidence event with a source address, else the first."""
    first = F.coalesce(F.get(F.filter(events, lambda e: e["source"]["ip"].isNotNull()), F.lit(0)), F.get(events, F.lit(0)))

    def fact(path: str) -> Column:
        column = first
        for part in path.split("."):
            column = column[part]
        return column

    return alerts.withColumn(
        "enrichment",
        F.struct(
            fact("threat.matched").alias("ioc"), fact("source.geo.country_iso_code").alias("country"), fact("source.as.organization").alias("as_org"),
            fact("source.asset.trusted").alias("trusted"), fact("source.asset.name").alias("asset"), fact("user.role").alias("role"),
        ),
    )
