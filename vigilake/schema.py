"""The normalised event: nested structs, so that a dotted rule field is a column path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
_FIELDS: dict = {
    "@timestamp": T.TimestampType(), "message": _TEXT, "raw": _TEXT, "ingest_seq": _LONG,
    "event": {"category": _TEXT, "action": _TEXT, "outcome": _TEXT},
    "source": {
        "ip": _TEXT, "port": _INT, "geo": {"country_iso_code": _TEXT, "country_name": _TEXT},
        "as": {"number": _LONG, "organization": _TEXT}, "asset": {"name": _TEXT, "trusted": T.BooleanType()},
    },
    "user": {"name": _TEXT, "role": _TEXT},
    "host": {"name": _TEXT},
    "log": {"source": _TEXT},
    "process": {
        "name": _TEXT, "pid": _INT, "executable": _TEXT, "command_line": _TEXT,
        "parent": {"name": _TEXT, "executable": _TEXT, "command_line": _TEXT},
    },
    "destination": {"ip": _TEXT, "port": _INT},
    "network": {"protocol": _TEXT, "direction": _TEXT},
    "http": {"version": _TEXT, "request": {"method": _TEXT, "referrer": _TEXT}, "response": {"status_code": _INT, "bytes": _LONG}},
    "url": {"original": _TEXT},
    "user_agent": {"original": _TEXT},
    "sudo": {"target_user": _TEXT, "command": _TEXT},
    "firewall": {"action": _TEXT},
    "winlog": {"event_id": _INT},
    "threat": {"matched": T.BooleanType(), "feed": _TEXT},
    "labels": T.MapType(_TEXT, _TEXT),
}


def _struct(fields: dict) -> T.StructType:
    return T.StructType([T.StructField(k, _struct(v) if isinstance(v, dict) else v) for k, v in fields.items()])


EVENT_SCHEMA: T.StructType = _struct(_FIELDS)


def field_type(path: str, schema: T.StructType = EVENT_SCHEMA) -> T.DataType | None:
    """The type of a dotted field, or None where the schema has no such leaf."""
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return None if isinstance(kind, (T.StructType, T.MapType)) else kind


def field(path: str, schema: T.StructType = EVENT_SCHEMA) -> Column:
    """The column of a dotted field; a field the schema lacks is read from ``labels``, else null."""
    if field_type(path, schema) is not None:
        return F.col(".".join(f"`{p}`" for p in path.split(".")))
    if "labels" in schema.names and isinstance(schema["labels"].dataType, T.MapType):
        return F.col("labels").getItem(path)
    return F.lit(None).cast("string")


def event_columns(leaves: dict[str, Column]) -> list[Column]:
    def build(kind: T.DataType, path: str) -> Column:
        if path in leaves:
            return leaves[path].cast(kind)
        if isinstance(kind, T.StructType) and any(k.startswith(path + ".") for k in leaves):
            return F.struct(*(build(f.dataType, f"{path}.{f.name}").alias(f.name) for f in kind.fields))
        return F.lit(None).cast(kind)

    return [build(f.dataType, f.name).alias(f.name) for f in EVENT_SCHEMA.fields]


def ecs_json(df: DataFrame) -> Column:
    """The event as nested JSON with its absent fields left out."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
