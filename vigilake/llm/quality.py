"""A quality score learned from preference pairs (Bradley-Terry), with a cut at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, text_of
from .text_bytes import LOWER, prefix_sums, slices, stretch_hashes, words

FEATURES = (
    "upper", "symbols", "bars", "bangs", "digits", "spaces", "wide", "word_length", "log_words", "repeats", "mostly_upper", "many_symbols",
    "many_bars", "many_bangs", "many_repeats", "long_words", "short", "upper_words", "symbol_words", "line_length", "same_next_but_one",
)
UPPER, LETTER, DIGIT, SYMBOL = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = True
LETTER[[*range(65, 91), *range(97, 123)]] = True
DIGIT[48:58] = True
SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?"]] = True


def text_features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text: shares of kinds of bytes and words, and steps of these."""
    n = len(ends)
    starts = np.concatenate(([0], ends[:-1]))
    size = np.maximum(ends - starts, 1).astype("f8")

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return (sums[ends] - sums[starts]) / of

    count = lambda mask: share(mask, 1.0)
    upper = count(UPPER[data]) / np.maximum(count(LETTER[data]), 1)
    symbols, bars, bangs = share(SYMBOL[data], size), share(data == 124, size), share(data == 33, size)
    lines = count(data == 10) + 1
    first, last = words(data, ends)
    owner = np.searchsorted(ends, first, "right")
    n_words = np.bincount(owner, minlength=n).astype("f8")
    some = np.maximum(n_words, 1)
    hashes = stretch_hashes(prefix_sums(LOWER[data]), first, last)

    def same(step: int) -> np.ndarray:
        equal = (hashes[step:] == hashes[:-step]) & (owner[step:] == owner[:-step])
        return np.bincount(owner[step:][equal], minlength=n) / some

    repeats = same(1)
    lengths = (last - first).astype("f8")
    head, tail = (data[first], data[last - 1]) if len(first) else (data[:0], data[:0])
    per_word = lambda mask: np.bincount(owner[mask], minlength=n) / some
    mean = np.bincount(owner, lengths, minlength=n) / some
    return np.stack(
        [
            upper, symbols * 5, bars * 20, bangs * 20, share(DIGIT[data], size), share(data <= 32, size), share(data >= 128, size),
            mean / 10, np.log1p(n_words) / 10, repeats, upper > 0.4, symbols > 0.05, bars > 0.02, bangs > 0.02, repeats > 0.2, mean > 12,
            n_words < 3, per_word(UPPER[head] & UPPER[tail] & (lengths > 1)), per_word(SYMBOL[tail]), np.log1p(size / lines) / 10, same(2),
        ],
        axis=1,
    ).astype("f4")


def featurized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features) of each row's whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ends in slices(batch, 1):
                made = text_features(data, ends)
                values = pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype="i4") * made.shape[1], pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column(0), values], ["id", "features"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, features array<float>")


def worth_of(features: Column, weights: tuple[float, ...]) -> Column:
    return sum((F.element_at(features, k + 1).cast("double") * w for k, w in enumerate(weights)), F.lit(0.0))


@dataclass(frozen=True)
class Ranking:
    """Weights of the features, and the score at the quantile that parts good from bad."""

    weights: tuple[float, ...]
    cut: float

    def score(self, features: Column, at_cut: float = 0.3) -> Column:
        """Between 0 and 1, and ``at_cut`` at the cut; 0.5 for all where nothing could be learned."""
        if not any(self.weights):
            return F.lit(0.5)
        margin = worth_of(features, self.weights) - self.cut + float(np.log(at_cut / (1 - at_cut)))
        return 1 / (1 + F.exp(-margin))


def fit_ranking(
    labelled: DataFrame, most_rows: int = 8_000, pairs_per_row: int = 16, ridge: float = 1e-3, steps: int = 25
) -> Ranking:
    """Bradley-Terry worths from (id, features, quality): the chance that a document of label 1 is
    preferred to one of label 0 is the logistic function of the difference of their worths.

    The fit takes ``most_rows`` labelled rows at most, picked by hash of id, so its
    cost and what reaches the driver are bounded (8,000 rows of 21 floats). Each rejected document
    is paired with ``pairs_per_row`` accepted ones. Only the weights come from these rows. The cut is
    the quantile of all labelled rows' scores at the share of rejected documents among all of them,
    taken midway between the quantiles a little below and above that share, so that it stands in the
    gap; ranks are right to a millionth of the rows at any size. With labels of one kind only, all
    weights are 0.
    """
    labelled = labelled.where("quality in (0, 1)")
    # a share by hash first, so that what reaches the driver doesn't grow with the partitions
    total, rejected = labelled.agg(F.count("*"), F.count_if(F.col("quality") == 0)).head()
    share = min(1.0, 1.2 * most_rows / max(1, total))
    near = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)
    sample = labelled.where(near).orderBy(F.xxhash64("id"), "id").limit(most_rows).select("features", "quality").collect()
    y = np.array([r["quality"] for r in sample])
    if not (y == 0).any() or not (y == 1).any():
        return Ranking((0.0,) * len(FEATURES), 0.0)
    x = np.array([r["features"] for r in sample], "f8")
    bad, good = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    left = np.repeat(bad, pairs_per_row)
    right = good[(np.arange(len(left)) * 7919) % len(good)]
    d = x[right] - x[left]
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton's method on the logistic loss of the differences
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (1 - p) / len(d) - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, gradient)
    weights = tuple(w.tolist())
    worth = labelled.select(worth_of(F.col("features"), weights).alias("worth"))
    around = worth.agg(F.percentile_approx("worth", [0.97 * rejected / total, min(1.0, 1.03 * rejected / total)], 1_000_000)).head()[0]
    return Ranking(weights, float(np.mean(around)))


def held_out(id_col: str | Column) -> Column:
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.3, hold_out: bool = True
) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Learns from ``labels`` (id, quality) outside the held-out fifth of ids, or from all without ``hold_out``. Only the text is scored:
    one scan makes 21 numbers of each, which are kept; then the fit joins them with the labels, and
    the cut is taken over all labelled rows.
    Null and empty texts get the score of their features. Labels that are null, not 0 or 1, or for
    no document are ignored, of several for one id the smallest counts; repeated documents are
    scored as often as they stand. Other columns play no part. An empty table gives no rows.
    """
    stages = Stages(docs.sparkSession, "quality")
    features = stages.save(featurized(docs, id_col, text_col), "features")
    known = (labels.where(~held_out(id_col)) if hold_out else labels).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality"))
    ranking = fit_ranking(stages.save(features.join(known, "id"), "labelled"))
    stages.keep_only(features)
    score = ranking.score(F.col("features"), accept)
    return features.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= accept).cast("int")
    )
