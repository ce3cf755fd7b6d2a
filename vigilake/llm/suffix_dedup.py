"""Repeated byte strings: sampled names narrow the text, a difference-cover suffix sort settles it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages, text_of
from .text_bytes import prefix_sums, slices, stretch_hashes

GRAM = 20  # bytes of a sampled name


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a string of positive integers, by the difference cover {1, 2} mod 3.

    Positions outside multiples of 3 are sorted by their triples and named; equal names are told
    apart by recursing on the string of names. The remaining suffixes are sorted by (symbol, rank of
    the next sampled suffix), and merged: any two suffixes become comparable by ranks after one or
    two symbols, which binary searches do for all at once.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), "i8")
    t = np.concatenate((s.astype("i8"), np.zeros(3, "i8")))
    top = int(t.max()) + 1
    if top >= 1 << 20:  # keep three symbols within one integer
        t = np.unique(t, return_inverse=True)[1].astype("i8")
        top = int(t.max()) + 1
    one, two, zero = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate((one, two))  # for n = 1 mod 3 with the empty suffix, which parts the halves
    key = (t[sample] * top + t[np.minimum(sample + 1, n + 2)]) * top + t[np.minimum(sample + 2, n + 2)]
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate(([1], (np.diff(key[order]) != 0).astype("i8")))
    names = np.empty(len(sample), "i8")
    names[order] = np.cumsum(fresh)
    if names.max() < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 4, "i8")
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    base = len(sample) + 2
    key0 = t[zero] * base + rank[zero + 1]
    zero = zero[np.argsort(key0, kind="stable")]
    sorted12 = sample[order]
    sorted12 = sorted12[sorted12 < n]
    first, second = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    below1 = np.searchsorted(t[first] * base + rank[first + 1], t[zero] * base + rank[zero + 1])
    wide = lambda i: (t[i] * top + t[i + 1]) * base + rank[i + 2]
    if top * top * base < 1 << 62:
        below2 = np.searchsorted(wide(second), wide(zero))
    else:
        both = np.concatenate((second, zero))
        dense = np.lexsort((rank[both + 2], t[both + 1], t[both]))
        place = np.empty(len(both), "i8")
        steps = [x[both][dense] for x in (t, np.roll(t, -1), np.roll(rank, -2)[: len(t)])]
        moved = np.any([np.diff(x) != 0 for x in steps], axis=0)
        place[dense] = np.concatenate(([0], np.cumsum(moved)))
        below2 = np.searchsorted(place[: len(second)], place[len(second) :])
    out = np.empty(n, "i8")
    at = np.arange(len(zero)) + below1 + below2
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at] = zero
    out[~taken] = sorted12
    return out


def sampled_runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Every string of ``length`` bytes has a sampled gram: the smallest by hash within it, leftmost
    of equals, so equal strings sample at the same place. Strings next to each other that sample the
    same gram form a run. Returns each run's (gram hash, hash of its bytes and of the gram's place in
    it, text, start, number of strings)."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, k) for k in ("i8", "i8", "i8", "i8", "i8"))
    sums = prefix_sums(data)
    places = np.arange(n - GRAM + 1)
    grams = stretch_hashes(sums, places, places + GRAM)
    low = (grams >> np.uint64(32) << np.uint64(32)) | places.astype("u8")
    width = length - GRAM + 1
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[: n - length + 1], low[width - span : width - span + n - length + 1])
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(n + 1, "i8")  # +1 where a text's strings begin, -1 past the last
    holds = ends - starts >= length
    np.add.at(inside, starts[holds], 1)
    np.add.at(inside, ends[holds] - length + 1, -1)
    valid = np.cumsum(inside)[: len(low)] > 0
    picked = (low & np.uint64(0xFFFFFFFF)).astype("i8")
    change = np.ones(len(low), bool)
    change[1:] = (picked[1:] != picked[:-1]) | ~valid[:-1]
    head = np.flatnonzero(change & valid)
    past = np.ones(len(low), bool)
    past[:-1] = change[1:] | ~valid[1:]
    tail = np.flatnonzero(past & valid)
    whole = stretch_hashes(sums, head, tail + length) + (picked[head] - head).astype("u8") * np.uint64(0x9E3779B97F4A7C15)
    text = np.searchsorted(ends, head, "right")
    return grams[picked[head]].view("i8"), whole.view("i8"), text, head - starts[text], tail - head + 1


def runs_of(docs: DataFrame, length: int) -> DataFrame:
    """(g, nb, id, twin, start, n, again): the runs of all texts. Of runs with equal bytes within one batch
    all but the first are marked ``again`` here, which thins crowded groups before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, ends in slices(batch, 1):
                g, nb, text, start, n = sampled_runs(data, ends, length)
                ids, twins = (rows.column(k).take(pa.array(text, pa.int64())) for k in (0, 2))
                key = np.array(ids.fill_null(-(1 << 63)), "i8") if len(ids) else np.zeros(0, "i8")
                known = (np.array(ids.is_valid()),) if ids.null_count else ()  # null stands before all others
                order = np.lexsort((start, key, *known, nb, g))
                again = np.zeros(len(g), bool)
                same = (g[order][1:] == g[order][:-1]) & (nb[order][1:] == nb[order][:-1])
                again[order[1:]] = same
                # rows of one id and start are one string, not a repeat
                one = same & (key[order][1:] == key[order][:-1]) & (start[order][1:] == start[order][:-1])
                again[order[1:][one]] = False
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g), pa.array(nb), ids, twins, pa.array(start.astype("i8")), pa.array(n.astype("i8")), pa.array(again)],
                    ["g", "nb", "id", "twin", "start", "n", "again"],
                )

    return docs.mapInArrow(run, "g long, nb long, id long, twin long, start long, n long, again boolean")


def run_texts(asked: DataFrame, length: int) -> DataFrame:
    """(g, id, twin, start, n, bytes, crowded) of the runs asked for: rows of id, text, twin and runs (g, start, n, crowded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, twin, wanted in zip(*batch.columns, strict=True):
                data, doc, twin = text.as_py().encode(), doc.as_py(), twin.as_py()
                found = [(x["g"], doc, twin, x["start"], x["n"], data[x["start"] : x["start"] + x["n"] + length - 1], x["crowded"]) for x in wanted.as_py()]
                columns = list(zip(*found, strict=True)) if found else [()] * 7
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
                names = ["g", "id", "twin", "start", "n", "bytes", "crowded"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    return asked.mapInArrow(run, "g long, id long, twin long, start long, n long, bytes binary, crowded boolean")


def settle(rows: list[tuple[int, int | None, int, int, bytes]], length: int, twins: list[int] | None = None) -> list[tuple]:
    """(id, from, to) of the bytes covered by strings that also start earlier among these runs; with
    ``twins``, one of each run, (id, twin, from, to).

    The runs' bytes, one after another with a mark between, are suffix-sorted; strings equal in
    ``length`` bytes are then neighbours, and all but the earliest of them repeat it.
    """
    sizes = np.array([len(x[4]) + 1 for x in rows], "i8")
    heads = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(x[4] + b"\0" for x in rows), "u1")
    symbols = raw.astype("i8") + 2
    symbols[heads + sizes - 1] = 1
    counts = np.array([x[3] for x in rows], "i8")
    owner = np.repeat(np.arange(len(rows)), counts)
    at = heads[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    is_string = np.zeros(len(raw), bool)
    is_string[at] = True
    order = suffix_array(symbols)
    order = order[is_string[order]]
    views = np.lib.stride_tricks.sliding_window_view(raw, length)
    same = np.zeros(len(order), bool)
    for lo in range(1, len(order), 50_000):
        part = order[lo - 1 : lo + 50_000]
        same[lo : lo + len(part) - 1] = (views[part[1:]] == views[part[:-1]]).all(axis=1)
    group = np.cumsum(~same) - 1
    row = np.searchsorted(heads, order, "right") - 1
    ids = np.array([-(1 << 63) if x[1] is None else x[1] for x in rows], "i8")[row]
    known = np.array([x[1] is not None for x in rows])[row]  # null stands before all others
    starts = np.array([x[2] for x in rows], "i8")[row] + order - heads[row]
    ranked = np.lexsort((starts, ids, known, group))
    first = np.ones(len(ranked), bool)
    first[1:] = group[ranked][1:] != group[ranked][:-1]
    lead = ranked[np.maximum.accumulate(np.where(first, np.arange(len(ranked)), 0))]
    repeats = ranked[(ids[ranked] != ids[lead]) | (known[ranked] != known[lead]) | (starts[ranked] != starts[lead])]
    place = np.sort(order[repeats])
    if not len(place):
        return []
    row = np.searchsorted(heads, place, "right") - 1
    cut = np.concatenate(([True], (np.diff(place) > 1) | (np.diff(row) > 0)))
    a, b = place[cut], place[np.concatenate((cut[1:], [True]))]
    row = row[cut]
    named = [(x[1],) if twins is None else (x[1], t) for x, t in zip(rows, twins or rows, strict=True)]
    return [(*named[r], int(rows[r][2] + i - heads[r]), int(rows[r][2] + j - heads[r]) + length) for r, i, j in zip(row, a, b, strict=True)]


def settled(texts: DataFrame, length: int, most_bytes: int = 1_000_000) -> DataFrame:
    """(id, twin, from, to) over runs partitioned and sorted by g, some text at a time; runs of one g
    stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64()) for n in ("id", "twin", "from", "to")])

        def made(rows: list) -> pa.RecordBatch:
            found = settle([(g, doc, start, n, data) for g, doc, _, start, n, data in rows], length, [x[2] for x in rows])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else [()] * 4)], schema=schema)

        held, size, g = [], 0, None
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if row[0] != g and size > most_bytes:
                    yield made(held)
                    held, size = [], 0
                g = row[0]
                held.append(row)
                size += len(row[5])
        if held:
            yield made(held)

    return texts.select("g", "id", "twin", "start", "n", "bytes").mapInArrow(run, "id long, twin long, from long, to long")


def crowded_strings(texts: DataFrame, length: int) -> DataFrame:
    """(id, twin, from, to) for runs of very crowded grams: a row per string, grouped by hash with
    map-side minima, so that no task holds a gram's whole group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, doc, twin, start, n, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                raw = np.frombuffer(data, "u1")
                at = np.arange(n)
                h = stretch_hashes(prefix_sums(raw), at, at + length).view("i8")
                same = [pa.array([x] * n, pa.int64()) for x in (g, doc, twin)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(h), pa.array(start + at)], ["g", "id", "twin", "h", "at"])

    strings = texts.select("g", "id", "twin", "start", "n", "bytes").mapInArrow(run, "g long, id long, twin long, h long, at long")
    first = strings.groupBy("g", "h").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("count")).where("count > 1")
    repeats = strings.join(first, ["g", "h"]).where(~F.struct("id", "at").eqNullSafe(F.col("first")))
    return repeats.select("id", "twin", F.col("at").alias("from"), (F.col("at") + length).alias("to"))


def kept_texts(docs: DataFrame) -> DataFrame:
    """Rows of id, text and spans (from, to), with the spans' union cut out of the text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data, merged = text.as_py().encode(), []
                for a, b in sorted((x["from"], x["to"]) for x in spans.as_py() or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                merged = [(a, min(b, len(data))) for a, b in merged if a < len(data)]
                edges = [0, *(x for span in merged for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for column, x in zip(out, (len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def told_apart(rows: DataFrame, stages: Stages) -> DataFrame:
    """``rows`` (id, text) with twin: a hash of the text where rows of one id have several texts, else 0."""
    own = F.xxhash64("text")
    several = rows.groupBy("id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi")
    several = stages.save(several.select(F.col("id").alias("of"), F.lit(True).alias("several")), "several_texts")
    joined = rows.join(several, F.col("id").eqNullSafe(F.col("of")), "left")
    return joined.select("id", "text", F.when(F.col("several"), own).otherwise(F.lit(0).cast("long")).alias("twin"))


def repeated_spans(rows: DataFrame, length: int, stages: Stages, crowd: int = 4000) -> DataFrame:
    """(id, twin, from, to) stretches that cover every string of ``length`` bytes that also starts earlier."""
    runs = runs_of(rows, length)
    # runs already settled spread over all tasks; the others meet their gram
    runs = runs.withColumn("salt", F.when(F.col("again"), F.xxhash64("id", "start"))).repartition("g", "salt")
    equal, gram = Window.partitionBy("g", "salt", "nb"), Window.partitionBy("g", "salt")
    runs = runs.select(
        "*",
        F.min(F.struct("id", "start")).over(equal).alias("first"),
        (F.min("nb").over(gram) != F.max("nb").over(gram)).alias("varied"),
        (F.count("*").over(gram) > crowd).alias("crowded"),
    ).withColumn("again", F.col("again") | ~F.struct("id", "start").eqNullSafe(F.col("first")))
    runs = runs.where("again OR varied").select("g", "id", "twin", "start", "n", "again", "crowded")
    runs = stages.save(runs, "runs")

    wanted = runs.where("NOT again").groupBy(F.col("id").alias("of"), F.col("twin").alias("of_twin"))
    wanted = wanted.agg(F.collect_set(F.struct("g", "start", "n", "crowded")).alias("wanted"))
    asked = rows.join(wanted, F.col("id").eqNullSafe(F.col("of")) & (F.col("twin") == F.col("of_twin")))
    texts = stages.save(run_texts(asked.select("id", "text", "twin", "wanted"), length), "run_texts")
    # crowded grams are told by a column: behind a join by g, its plan (a broadcast, or the split of a skewed part)
    # would take the place of this repartition, and runs of one gram would part
    few = texts.where("NOT crowded").repartition("g").sortWithinPartitions("g")
    many = texts.where("crowded")
    whole = runs.where("again").select("id", "twin", F.col("start").alias("from"), (F.col("start") + F.col("n") + (length - 1)).alias("to"))
    return whole.union(settled(few, length)).union(crowded_strings(many, length))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, after removing each byte
    covered by a string of ``length`` bytes that also starts earlier (a smaller id, or the same
    document and an earlier start). Strings are judged on the input and never cross documents.

    A difference-cover sort of all suffixes would shuffle many times the corpus, so the text is first
    narrowed without loss: each string samples one gram of 20 bytes by its own bytes alone (about
    one gram in 40 is sampled), and only grams sampled at several runs of strings, with bytes that
    differ around them, go on; runs with equal bytes are settled by their two 64-bit hashes. The
    rest is suffix-sorted by difference cover within tasks that hold all runs of a gram, and
    neighbours are compared byte by byte. A gram of very many runs is settled by hashes of its
    strings instead, grouped map-side.

    Null text counts as empty; a null id sorts first. Rows repeating an id count as one document, whose
    strings at one start are one place: what is removed of each row, its own text tells. An empty table
    gives no rows. Other columns play no part.
    """
    stages = Stages(docs.sparkSession, "suffix_dedup")
    rows = told_apart(docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")), stages)
    spans = repeated_spans(rows, length, stages).groupBy(F.col("id").alias("of"), F.col("twin").alias("of_twin"))
    spans = spans.agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("of")) & (F.col("twin") == F.col("of_twin")), "left").select("id", "text", "spans")
    return kept_texts(joined).withColumnRenamed("id", id_col)
