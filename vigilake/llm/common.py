"""Shared helpers: tables in the cluster's shared folder, and small column idioms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stages import Stages as Stages  # noqa: PLC0414  the operators' own name for it


def text_of(column: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(spark: SparkSession, per_partition: int = 4) -> int:
    """A number of salts that follows the cluster's own number of shuffle partitions."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
