"""Addresses and users of the derived events against re-authored lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ip import is_ip
from ..operators import enrichment as E
from .base import EV, Registry, flat_events

reg = Registry()
#: Small lookup tables in the shape of the files that ``sources.intel`` reads.
BLOCKED = ["151.9.40.0/24", "151.9.41.7", "61.4.88.0/25", "130.44.3.128/26"]
PLACES = [
    ("61.4.88.0/24", "RU", "Russia", 65121, "Taiga Hosting"), ("77.30.11.0/24", "DE", "Germany", 65122, "Rhein Relay"),
    ("130.44.0.0/16", "NG", "Nigeria", 65123, "Lagoon Net"), ("130.44.3.64/26", "ZA", "South Africa", 65124, "Karoo Net"), ("10.0.0.0/8", "XX", "Nowhere", 65199, "Hidden"),
]
ASSETS = [("10.0.0.0/24", "office-floor", True), ("172.22.0.0/16", "staging", True), ("172.22.4.0/26", "quarantine", False)]
ROLES = {f"U{k}": role for k, role in enumerate(("admin", "developer", "standard", "auditor"))}


def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_events(spark, sf_dir).select("ip", "usr").distinct()


def _octet(ip: str, k: int) -> str:
    return f"CAST(split_part({ip}, '.', {k}) AS INT)"


_D = f"{EV}, d AS (SELECT DISTINCT ip, usr, CAST(split_part(ip, '.', 4) AS INT) AS o4, split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.' || split_part(ip, '.', 3) AS net FROM ev)"
_IOC = "((net = '61.4.88' AND o4 < 128) OR (net = '130.44.3' AND o4 >= 128 AND o4 < 192))"
_COUNTRY = "CASE WHEN net = '61.4.88' THEN 'RU' WHEN net = '77.30.11' THEN 'DE' WHEN net = '130.44.3' AND o4 >= 64 AND o4 < 128 THEN 'ZA' WHEN net = '130.44.3' THEN 'NG' END"
_AS = "CASE WHEN net = '61.4.88' THEN 65121 WHEN net = '77.30.11' THEN 65122 WHEN net = '130.44.3' AND o4 >= 64 AND o4 < 128 THEN 65124 WHEN net = '130.44.3' THEN 65123 END"
_ASSET = "CASE WHEN net = '10.0.0' THEN 'office-floor' WHEN net = '172.22.4' AND o4 < 64 THEN 'quarantine' WHEN net = '172.22.4' THEN 'staging' END"
_TRUST = "(net = '10.0.0' OR (net = '172.22.4' AND o4 >= 64))"
_ROLE = "CASE usr WHEN 'u0' THEN 'admin' WHEN 'u1' THEN 'developer' WHEN 'u2' THEN 'standard' WHEN 'u3' THEN 'auditor' END"

reg.add("ioc_match", lambda s, d: E.ioc_match(_distinct(s, d), "ip", E.blocklist_frame(s, BLOCKED)).select("ip", "usr", "ioc_matched"), f"WITH {_D} SELECT ip, usr, {_IOC} AS ioc_matched FROM d")
reg.add("geoip_lookup", lambda s, d: E.geo_lookup(_distinct(s, d), "ip", E.geo_frame(s, PLACES)).select("ip", "usr", "country_iso", "asn"), f"WITH {_D} SELECT ip, usr, {_COUNTRY} AS country_iso, CAST({_AS} AS BIGINT) AS asn FROM d")
reg.add("asset_lookup", lambda s, d: E.asset_lookup(_distinct(s, d), "ip", E.asset_frame(s, ASSETS)), f"WITH {_D} SELECT ip, usr, {_ASSET} AS asset_name, {_TRUST} AS trusted FROM d")
reg.add("identity_role", lambda s, d: E.identity_role(_distinct(s, d), "usr", E.identity_frame(s, ROLES)), f"WITH {_D} SELECT ip, usr, {_ROLE} AS role FROM d")


def _tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {"blocklist": E.blocklist_frame(spark, BLOCKED), "geo": E.geo_frame(spark, PLACES), "assets": E.asset_frame(spark, ASSETS), "identities": E.identity_frame(spark, ROLES)}


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .base import normalized_events

    e = E.enrich_events(normalized_events(spark, sf_dir), **_tables(spark))
    return e.select(
        F.col("ingest_seq").alias("seq"), F.coalesce("threat.matched", F.lit(False)).alias("ioc"), F.col("source.geo.country_iso_code").alias("country"),
        F.col("source.as.number").alias("asn"), F.col("source.asset.name").alias("asset"), F.col("source.asset.trusted").alias("trusted"), F.col("user.role").alias("role"),
    )


reg.add("enrich_events", _enriched, f"""
    WITH {_D} SELECT ev.seq, {_IOC} AS ioc, {_COUNTRY} AS country, CAST({_AS} AS BIGINT) AS asn, {_ASSET} AS asset, {_TRUST} AS trusted, {_ROLE.replace("CASE usr", "CASE d.usr")} AS role
    FROM ev JOIN d ON ev.ip = d.ip AND ev.usr = d.usr""")


def _enriched_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert for each user's errors, its summary from the first event with an address."""
    from .base import normalized_events

    e = E.enrich_events(normalized_events(spark, sf_dir).where("event.action = 'error'"), **_tables(spark))
    # the first event with an address, else the first: folded map-side, however many a user has
    record, order = F.struct("source", "user", "threat"), F.struct(F.col("source.ip").isNull(), "ingest_seq")
    alerts = e.groupBy(F.col("user.name").alias("usr")).agg(F.array(F.min_by(record, order)).alias("events"))
    x = E.enrich_alert(alerts)
    return x.select("usr", *(F.col(f"enrichment.{c}").alias(c) for c in ("country", "as_org", "trusted", "asset", "role")), F.coalesce("enrichment.ioc", F.lit(False)).alias("ioc"))


_ORG = _AS.replace("65121", "'Taiga Hosting'").replace("65122", "'Rhein Relay'").replace("65123", "'Lagoon Net'").replace("65124", "'Karoo Net'")
reg.add("enrich_alert", _enriched_alert, f"WITH {_D} SELECT usr, {_COUNTRY} AS country, {_ORG} AS as_org, {_TRUST} AS trusted, {_ASSET} AS asset, {_ROLE} AS role, {_IOC} AS ioc FROM d WHERE usr IN (SELECT usr FROM ev WHERE action = 'error')")

reg.add("is_ip", lambda s, d: flat_events(s, d).select("usr", "ip").distinct().select(F.explode(F.array("usr", "ip", F.concat("ip", F.lit(".9")), F.concat(F.lit("300."), F.col("ip")))).alias("value")).distinct().withColumn("valid", is_ip(F.col("value"))),
        f"WITH {_D}, v AS (SELECT usr AS value, false AS valid FROM d UNION SELECT ip, true FROM d UNION SELECT ip || '.9', false FROM d UNION SELECT '300.' || ip, false FROM d) SELECT * FROM v")

_V4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
reg.add("ioc_documents", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_V4), F.lit(0)))).alias("ip")),
        r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS ip FROM documents")

QUERIES, ORACLE_SQL = reg.queries, reg.sql
