"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, text_of


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, digest_all: bool = False
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (null for rows that never
    needed a full hash, unless ``digest_all``).

    Refinement: rows alone in their byte length leave first; of the rest, rows alone in (length,
    hash of the first ``prefix_chars`` characters) leave next; only the survivors are told apart by
    SHA-256. Each step shuffles keys and counts, never texts: group sizes are aggregated map-side
    before the shuffle, and rows meet their group in a join that adaptive execution may split, so a
    group of a third of all rows lands in no single task.

    With ``digest_all`` the one scan takes every row's digest along (the caller wants it for every
    row); otherwise survivors' texts are read a second time.

    Nulls in the text count as the empty text; a null id sorts below all others. Of repeated rows
    (same id and text) exactly one is kept. An empty table gives an empty result. Other columns,
    whatever their names, play no part.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "exact_dedup")
    text = text_of(text_col)
    facts = docs.select(
        F.col(id_col).alias("id"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix"),
        (F.unhex(F.sha2(text, 256)) if digest_all else F.lit(None).cast("binary")).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    facts = stages.save(facts, "facts")

    lengths = facts.groupBy("n_bytes").count().where("count > 1").select("n_bytes")
    narrowed = facts.join(lengths, "n_bytes", "left_semi")
    prefixes = narrowed.groupBy("n_bytes", "prefix").count().where("count > 1").select("n_bytes", "prefix")
    narrowed = narrowed.join(prefixes, ["n_bytes", "prefix"], "left_semi")
    if not digest_all:
        # survivors are read again as rows of their own, by length and prefix hash, so neither null nor repeated ids matter
        full = docs.select(F.col(id_col).alias("id"), F.octet_length(text).alias("n_bytes"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix"), text.alias("text"))
        full = full.join(prefixes, ["n_bytes", "prefix"], "left_semi").select("id", "n_bytes", "prefix", F.unhex(F.sha2("text", 256)).alias("digest"))
        narrowed = stages.save(full.withColumn("row", F.monotonically_increasing_id()), "survivors")
        alone = facts.join(prefixes, ["n_bytes", "prefix"], "left_anti")
        facts = narrowed.select("id", "n_bytes", "prefix", "digest", "row").unionByName(alone.select("id", "n_bytes", "prefix", "digest", "row"))

    groups = (
        narrowed.groupBy("n_bytes", "prefix", "digest")
        .agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("size"))
        .where("size > 1")
    )
    out = facts.join(groups, ["n_bytes", "prefix", "digest"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
