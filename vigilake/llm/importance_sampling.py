"""Importance resampling towards a target: hashed n-gram log ratios, Gumbel noise, exact top share."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stages, text_of
from .text_bytes import LOWER, slices, words

#: The bytes that part words: all of ASCII but digits and small letters (texts are lowered first).
PARTS = np.zeros(256, bool)
PARTS[:128] = True
PARTS[[*range(48, 58), *range(97, 123)]] = False
#: Stretches above this many bytes are hashed one by one, the others a byte of all at a time.
SHORT = 48


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype="u4")
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()


def crc32_of_stretches(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The CRC-32 of each stretch [start, stop) of ``data``."""
    lengths = stops - starts
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    out = np.full(len(order), 0xFFFFFFFF, "u4")
    n_long = int(np.searchsorted(-left, -SHORT, "left"))
    for k in range(min(int(left.max(initial=0)), SHORT)):
        live = slice(n_long, int(np.searchsorted(-left, -k, "left")))
        out[live] = CRC[(out[live] ^ data[at[live] + k]) & 255] ^ (out[live] >> 8)
    out ^= np.uint32(0xFFFFFFFF)
    for j in range(n_long):
        out[j] = zlib.crc32(data[at[j] : at[j] + left[j]])
    back = np.empty_like(out)
    back[order] = out
    return back


def hashed_features(data: np.ndarray, ends: np.ndarray, widths: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every run of ``widths[0]`` to ``widths[1]`` words, and each text's words.

    Words are put one blank apart first, so that a run is one stretch whatever stood between.
    """
    data = LOWER[data]
    first, last = words(data, ends, PARTS)
    owner = np.searchsorted(ends, first, "right")
    lengths = last - first
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    line = np.full(int(lengths.sum()) + len(lengths), 32, "u1")
    line[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = data[~PARTS[data]]
    owners, found = [], []
    for width in range(widths[0], widths[1] + 1):
        n = max(0, len(owner) - width + 1)
        whole = owner[:n] == owner[width - 1 :]
        heads = np.flatnonzero(whole)
        tails = heads + width - 1
        owners.append(owner[heads])
        found.append(crc32_of_stretches(line, starts[heads], starts[tails] + lengths[tails]) % np.uint32(buckets))
    return np.concatenate(owners), np.concatenate(found).astype("i8"), np.bincount(owner, minlength=len(ends))


def bucket_counts(texts: DataFrame, text_col: str, widths: tuple[int, int], buckets: int) -> np.ndarray:
    """How often each bucket's features stand in all texts: every task sums its own before the
    shuffle, and at most ``buckets`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, "i8")
        for batch in batches:
            for _, data, ends in slices(batch, 0):
                sums += np.bincount(hashed_features(data, ends, widths, buckets)[1], minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("i4")), pa.array(sums[some])], ["bucket", "n"])

    parts = texts.select(text_of(text_col).alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, "i8")
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares in target and source, floored."""
    n = len(source)
    ratio = (target + 1.0) * (float(source.sum()) + n) / ((source + 1.0) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype("i8")


def weighted(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, widths: tuple[int, int]) -> DataFrame:
    """(id, n_words, n_features, weight) of each row: gains looked up in one array by bucket."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ends in slices(batch, 1):
                owner, found, n_words = hashed_features(data, ends, widths, buckets)
                order = np.argsort(owner, kind="stable")
                sums = np.concatenate(([0], np.cumsum(gains[found[order]])))
                n = np.bincount(owner, minlength=len(ends))
                stop = np.cumsum(n)
                values = (n_words.astype("i8"), n.astype("i8"), sums[stop] - sums[stop - n])
                yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, values)], ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int) -> Column:
    """Thousandths of standard Gumbel noise that follows from seed and id alone; a null id counts as
    the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def rank_offsets(scores: DataFrame, stages: Stages, percent: int) -> tuple[DataFrame, int, int | None]:
    """(score, n, above) of the histogram of integer scores, the number to draw, the cutoff score.

    ``above`` counts the rows of higher scores. The histogram is range-sorted and written with its
    partitions' numbers; their totals (a row for each partition) are suffix-summed on the driver,
    counts within a partition by a window.
    """
    histogram = scores.groupBy("score").agg(F.count("*").alias("n"))
    sorted_ = histogram.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id())
    histogram = stages.save(sorted_, "histogram")
    totals = sorted((r["part"], r["n"]) for r in histogram.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, sums = 0, {}
    for part, n in totals:
        sums[part] = before
        before += n
    draw = percent * before // 100
    if not draw:
        return histogram.select("score", "n", F.lit(0).cast("long").alias("above")), 0, None
    base = F.element_at(F.create_map(*(F.lit(x) for kv in sums.items() for x in kv)), F.col("part")).cast("long")
    earlier = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = histogram.select("score", "n", (base + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("above"))
    cutoff = offsets.where(F.col("above") < draw).agg(F.min("score")).head()[0]
    return offsets, draw, cutoff


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", widths: tuple[int, int] = (1, 1),
    buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (null where not drawn).

    Weights are sums over all features of a document of the log ratio between ``target`` and
    ``docs``; with Gumbel noise added, the highest scores are a sample without replacement that
    follows the weights. ``percent`` of the documents of ``least_words`` words or more are drawn.
    Three scans of texts (counts of both sides, weights), then only ids and numbers move: a
    histogram of the scores tells the cutoff and each score's first rank, and rows count by id
    within each score that survives.

    Null and empty texts have no features and weight 0; a null id has the noise of an empty id and
    ranks first among its score; repeated rows score alike and take ranks of their own. Other
    columns play no part. Empty tables are allowed on either side.
    """
    stages = Stages(docs.sparkSession, "resample")
    gains = bucket_gains(bucket_counts(docs, text_col, widths, buckets), bucket_counts(target, target_col, widths, buckets))
    made = weighted(docs, gains, id_col, text_col, widths).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    scored = stages.save(made, "scored")
    offsets, draw, cutoff = rank_offsets(scored.where(F.col("n_words") >= least_words), stages, percent)
    able = F.col("n_words") >= least_words
    high = able & (F.col("score") >= F.lit(cutoff)) if draw else F.lit(False)
    out = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    lower = scored.where(~high).select(*out, F.lit(None).cast("long").alias("rank"))
    if not draw:
        return lower
    kept = scored.where(high).join(offsets.where(F.col("above") < draw), "score")
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_first("id")))
    return kept.withColumn("rank", place).select(*out, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank")).unionByName(lower)
