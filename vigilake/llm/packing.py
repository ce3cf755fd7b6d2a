"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages, spread, text_of
from .text_bytes import slices

#: The same white space in UTF-8: one byte, or a lead byte and what follows it.
SPACE_BYTE = np.zeros(256, bool)
SPACE_BYTE[[0x20, *range(0x09, 0x0E)]] = True
WIDE_SPACES = sorted({chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)})


def unit_starts(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where units begin: white space and the word after it are one, as is white space at a text's end.

    Byte-level patterns match nothing across a word's end, so each unit is encoded as it would be
    within its text."""
    space = SPACE_BYTE[data]
    for lead in {mark[0] for mark in WIDE_SPACES}:
        leads = np.flatnonzero(data == lead)
        for mark in (m for m in WIDE_SPACES if m[0] == lead and len(leads)):
            at = leads[leads + len(mark) <= len(data)]
            for k in range(1, len(mark)):
                at = at[data[at + k] == mark[k]]
            for k in range(len(mark)):
                space[at + k] = True
    begins = np.zeros(len(data), bool)
    begins[1:] = space[1:] & ~space[:-1]
    begins[heads[heads < len(data)]] = True
    return np.flatnonzero(begins)


class UnitEncoder:
    """Ids of whole texts by a tokenizers file, each distinct unit of a batch encoded once."""

    def __init__(self, path: str, cache_units: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # of two halves the older goes when the younger is full, so common units stay
        self.cache_units = cache_units

    def starts(self, data: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Where units begin; an added token is a unit of its own, and so is what stands on either side."""
        raw, cuts = data.tobytes(), []
        for token in map(str.encode, self.added):
            at = raw.find(token)
            while at >= 0:
                cuts += [at, at + len(token)]
                at = raw.find(token, at + len(token))
        begins = unit_starts(data, heads)
        if not cuts:
            return begins
        cuts = np.unique(np.array(cuts))
        inside = np.zeros(len(data) + 1, bool)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # nothing begins within an added token
            if raw[lo:hi] in map(str.encode, self.added):
                inside[lo + 1 : hi] = True
        begins = begins[~inside[begins]]
        return np.union1d(begins, cuts[cuts < len(data)])

    def encode_texts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and, last, end) of UTF-8 texts laid out in a row."""
        heads = np.concatenate(([0], ends[:-1])).astype("i8")
        begins = self.starts(data, heads)
        if not len(begins):
            return np.zeros(0, "<u4"), np.zeros(len(ends) + 1, "i8")
        offsets = np.concatenate((begins, [len(data)])).astype("i8")
        flat = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        coded = flat.dictionary_encode()
        if len(self.cache) >= self.cache_units // 2:
            self.older, self.cache = self.cache, {}
        distinct, cache, older = coded.dictionary.to_pylist(), self.cache, self.older
        cache.update((x, older[x]) for x in distinct if x in older)
        new = [x for x in distinct if x not in cache]
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            for unit, made in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                cache[unit] = np.array(made.ids, "<u4").tobytes()
        ids = [cache[x] for x in distinct]
        sizes = np.fromiter(map(len, ids), "i8", len(ids)) // 4
        vocabulary, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        n = sizes[which]
        stops = np.cumsum(n)
        out = vocabulary[np.repeat(first[which] - (stops - n), n) + np.arange(stops[-1])]
        per_unit = np.concatenate(([0], stops))
        return out, per_unit[np.searchsorted(begins, np.concatenate((heads, [len(data)])))]


@lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    """Once per Python worker."""
    return UnitEncoder(path)


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0
) -> DataFrame:
    """id, piece, start, length, ids_crc32: each document's ids and ``end_id``, cut only where it is
    longer than ``capacity``; then all pieces but the first are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = encoder(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in batches:
            for rows, data, ends in slices(batch, 1, 12_000_000):
                ids, at = tokens.encode_texts(data, ends)
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                n = np.diff(at) + 1  # the end id
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = n - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                last = piece == pieces[row] - 1
                lo = 4 * (at[:-1][row] + start)
                hi = lo + 4 * (length - last)
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
                for k in np.flatnonzero(last).tolist():
                    crc[k] = zlib.crc32(end, crc[k])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, to rank, sequence of the first, offset): where pieces of a length go.

    Bulk-synchronous rounds over length classes: pieces of one length are interchangeable, and so
    are sequences with one gap, so a round's state is at most ``capacity`` counts of either, however
    many documents there are. A round sweeps lengths and gaps in ascending order; each gap takes the
    largest piece below it that no smaller gap has taken (its predecessor; for the piece, the gap is
    its successor), the pieces of a class in order of rank, which resolves conflicts. Then gaps
    shrink, and the next round begins. Where no gap takes a piece, as many sequences open as the
    remaining tokens fill, for the largest pieces.
    """
    left = {s: n for s, n in counts.items() if n}
    next_rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many)
    plan, sequences = [], 0

    def place(size: int, n: int, sequence: int, offset: int, into: dict) -> None:
        plan.append((size, next_rank[size], next_rank[size] + n, sequence, offset))
        next_rank[size] += n
        left[size] -= n
        if gap := capacity - offset - size:
            into.setdefault(gap, []).append((sequence, n))

    while any(left.values()):
        made: dict[int, list[tuple[int, int]]] = {}
        below: list[int] = []  # the lengths passed by the sweep, with pieces left; largest on top
        sizes = sorted((s for s, n in left.items() if n), reverse=True)
        matched = False
        for gap in sorted(gaps):
            while sizes and sizes[-1] <= gap:
                below.append(sizes.pop())
            for sequence, n in gaps[gap]:
                while n and below:
                    size = below[-1]
                    k = min(n, left[size])
                    place(size, k, sequence, capacity - gap, made)
                    matched, sequence, n = True, sequence + k, n - k
                    if not left[size]:
                        below.pop()
                if n:
                    made.setdefault(gap, []).append((sequence, n))
        if not matched:
            to_open = -(-sum(s * n for s, n in left.items()) // capacity)
            for size in sorted((s for s, n in left.items() if n), reverse=True):
                k = min(to_open, left[size])
                place(size, k, sequences, 0, made)
                sequences += k
                to_open -= k
                if not to_open:
                    break
        gaps = made
    return plan


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows of (id, piece, length, ...).

    Only the counts by length (``capacity`` of them at most) and the plan drawn from these reach the
    driver. Rows find their place by rank within their length: a rank in one of many salted parts of
    the length plus the sizes of the parts before it, so that a length of most rows is no hot group.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = packing_plan(counts, capacity)
    plan = spark.createDataFrame(rows, "length long, lo long, hi long, first long, offset long")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(spread(spark))))
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("id", "piece")
    ranked = (
        salted.withColumn("rank", F.row_number().over(within) - 1)
        .join(parts, ["length", "salt"])
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    small = len(rows) <= 100_000  # some rows a class and round, whatever the input; checked all the same
    placed = ranked.alias("r").join(
        F.broadcast(plan).alias("p") if small else plan.alias("p"),
        F.expr("r.length = p.length AND r.rank >= p.lo AND r.rank < p.hi"),
    )
    kept = [F.col(f"r.`{c}`") for c in pieces.columns]
    return placed.select(*kept, (F.col("p.first") + F.col("r.rank") - F.col("p.lo")).alias("sequence_id"), "p.offset")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenises, cuts and packs whole documents: one row per piece.

    Null and empty texts are the one end id. Repeated rows are packed as often as they stand; a null
    id stays null. An empty table gives no rows. Other columns play no part.
    """
    pieces = Stages(docs.sparkSession, "packing").save(token_pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)
