"""Byte-pair encoding of words: a priority queue of merge ranks over a linked list of symbols."""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The white space that the vocabulary's normaliser collapses (Unicode White_Space).
WHITE = r"[\x09-\x0D\x20\x85\xA0  -     　]+"
#: Code points at which Python's str.split() parts a text though they aren't White_Space.
ODD = regex.compile(r"[\x1C-\x1F]")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, free = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b], free = chr(free), free + 1
    return [table[b] for b in range(256)]


def merge_symbols(ids: list[int], ranks: list[dict[int, int]], merged: list[int]) -> list[int]:
    """The ids left when every mergeable pair is merged, lowest rank first, leftmost first.

    ``ranks[left].get(right)`` is a pair's rank and ``merged[rank]`` the id it becomes. Symbols are
    linked to their neighbours by index. The queue holds rank and place packed in one integer; an
    entry whose place no longer holds a pair of that rank is stale and skipped. ``ids`` is used up.
    """
    n = len(ids)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    now = [ranks[x].get(y, -1) for x, y in zip(ids, ids[1:], strict=False)]  # a place's rank at present
    queue = [rank << 40 | i for i, rank in enumerate(now) if rank >= 0]
    now.append(-1)
    heapq.heapify(queue)
    while queue:
        entry = heapq.heappop(queue)
        i, rank = entry & 0xFFFFFFFFFF, entry >> 40
        if now[i] != rank:
            continue
        j = after[i]
        ids[i] = new = merged[rank]
        ids[j] = now[j] = -1
        after[i] = k = after[j]
        own = -1
        if k < n:
            before[k] = i
            own = ranks[new].get(ids[k], -1)
            if own >= 0:
                heapq.heappush(queue, own << 40 | i)
        now[i] = own
        h = before[i]
        if h >= 0:
            now[h] = own = ranks[ids[h]].get(new, -1)
            if own >= 0:
                heapq.heappush(queue, own << 40 | h)
    return [x for x in ids if x >= 0]


class WordBpe:
    """A word-level BPE vocabulary with an end-of-word mark, read from a tokenizers JSON file."""

    def __init__(self, path: str, cache_words: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.suffix] for c in alphabet]
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        self.merged = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left]][vocab[right]] = rank
            self.merged.append(vocab[left + right])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.white = regex.compile(WHITE)
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words

    def encode_word(self, word: str) -> list[int]:
        data = word.encode()
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        return merge_symbols(ids, self.ranks, self.merged)

    def chunks(self, text: str) -> list[str]:
        """The stretches between white space, normalised; none of the pattern's words spans more.

        Special strings part the text first, and come with a leading blank, as no stretch has one.
        """
        found = []
        for k, part in enumerate(self.split_special.split(text) if "<|" in text else (text,)):
            if k % 2:
                found.append(" " + part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # no final form
            part = part.lower()
            found += [x for x in self.white.split(part) if x] if ODD.search(part) else part.split()
        return found

    def chunk_ids(self, chunk: str) -> bytes:
        """Little-endian 32-bit ids, kept for the chunks and words that come again."""
        cache = self.cache
        if (found := cache.get(chunk)) is not None:
            return found
        if chunk[0] == " ":
            return struct.pack("<I", self.special[chunk[1:]])
        if len(cache) >= self.cache_words:
            cache.clear()
        parts = []
        for word in self.words.findall(chunk):
            if (own := cache.get(word)) is None:
                ids = self.encode_word(word)
                own = cache[word] = struct.pack(f"<{len(ids)}I", *ids)
            parts.append(own)
        cache[chunk] = found = b"".join(parts)
        return found

    def encode_texts(self, texts: list[str]) -> tuple[list[memoryview], list[memoryview]]:
        """Of each text the ids as little-endian 32-bit integers, and its decoded text in UTF-8.

        Each distinct chunk of the batch is encoded once; Arrow puts ids and strings in order.
        """
        flat, ends = [], np.zeros(len(texts) + 1, "i8")
        for k, text in enumerate(texts):
            flat += self.chunks(text)
            ends[k + 1] = len(flat)
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        del flat
        ids = [self.chunk_ids(x) for x in coded.dictionary.to_pylist()]
        names = self.names
        decoded = ["".join([names[i] + " " for i in struct.unpack(f"<{len(x) // 4}I", x)]) for x in ids]
        out = []
        for values in (pa.array(ids, pa.large_binary()), pa.array(decoded, pa.large_string())):
            placed = values.take(coded.indices)
            _, offsets, data = placed.buffers()
            at = np.frombuffer(offsets, "i8")[: len(placed) + 1][ends] if len(placed) else ends
            data = memoryview(data) if data is not None else memoryview(b"")
            out.append([data[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
        return out[0], [x[:-1] for x in out[1]]


def in_slices(batch: pa.RecordBatch, characters: int = 6_000_000) -> Iterator[tuple[pa.Array, list[str]]]:
    """The batch's ids and texts, a bounded amount of text at a time (one text at least)."""
    ends = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype("i8"))
    start = 0
    while start < batch.num_rows:
        past = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, past + characters, "right")))
        yield batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start).to_pylist()
        start = stop


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    """Once per Python worker."""
    return WordBpe(path)


def bpe_encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int), decoded for each row. No shuffle; a task holds one Arrow batch.

    Null text counts as empty, and has no ids and an empty decoded text. Repeated rows come back as
    often as they stand. Other columns play no part. ``vocab_path`` must exist on each executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocab_path)
        for batch in batches:
            for keys, texts in in_slices(batch):
                made, decoded = bpe.encode_texts(texts)
                ids = pa.array([np.frombuffer(x, "<i4") for x in made], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, ids, pa.array([str(x, "utf-8") for x in decoded], pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def bpe_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``bpe_encode``, with digests of ids and decoded text in place of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocab_path)
        for batch in batches:
            for keys, texts in in_slices(batch):
                made, decoded = bpe.encode_texts(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        pa.array([len(x) // 4 for x in made], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in made], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                    ],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
