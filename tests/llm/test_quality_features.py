"""The quality features against a plain count, and the ranking on labels that it hasn't seen."""

import math
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigilake.llm.quality import FEATURES, quality_scores, text_features
from vigilake.llm.text_bytes import slices
from vigilake.stages import BATCH_BYTES, BATCH_SETTING, Stages

DATA = Path("/root/testdata/sf0.01")
TEXTS = ["", " ", "Plain words stand here.", "BUY!! NOW!! NOW!! | | |", "a a a b a b", "Ünï çödé 日本語 \U0001f600 \n\nline", "x" * 300, "1 2 3 $$$ %%% ok### ok###", "One\nTwo\tThree\x0bFour\x0c five", "WORD W WW wW Ww", "it's e.g. (fine), \"quoted\" - yes?"]


def counted(text):
    b = text.encode()
    size, letters = max(len(b), 1), sum(chr(c).isalpha() for c in b if c < 128)
    symbol = lambda c: 33 <= c < 127 and not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?"
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", b) if w]
    n, some = len(words), max(len(words), 1)
    low = [w.lower() for w in words]
    share = lambda test: sum(map(test, b)) / size
    same = lambda k: sum(low[i] == low[i - k] for i in range(k, n)) / some
    upper, symbols, bars, bangs = sum(65 <= c <= 90 for c in b) / max(letters, 1), share(symbol), share(lambda c: c == 124), share(lambda c: c == 33)
    mean = sum(map(len, words)) / some
    return [
        upper, symbols * 5, bars * 20, bangs * 20, share(lambda c: 48 <= c <= 57), share(lambda c: c <= 32), share(lambda c: c >= 128), mean / 10, math.log1p(n) / 10, same(1), upper > 0.4,
        symbols > 0.05, bars > 0.02, bangs > 0.02, same(1) > 0.2, mean > 12, n < 3, sum(len(w) > 1 and 65 <= w[0] <= 90 and 65 <= w[-1] <= 90 for w in words) / some,
        sum(symbol(w[-1]) for w in words) / some, math.log1p(size / (b.count(b"\n") + 1)) / 10, same(2),
    ]


def test_features_are_plain_counts():
    parts = [t.encode() for t in TEXTS]
    data, ends = np.frombuffer(b"".join(parts), "u1"), np.cumsum([len(p) for p in parts])
    got = text_features(data, ends)
    assert got.shape == (len(TEXTS), len(FEATURES))
    for row, text in zip(got, TEXTS, strict=True):
        assert np.allclose(row, counted(text), atol=1e-6), text


@pytest.mark.skipif(not DATA.exists(), reason="needs the sample tables")
def test_ranking_on_labels_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    print(f"held out: {len(rows)} rows, AUC {auc:.3f}, accuracy {right:.3f}")
    assert len(bad) > 5 and auc >= 0.9 and right >= 0.9


def test_texts_go_to_python_in_bounded_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    before = spark.conf.get(BATCH_SETTING)
    docs = spark.range(10_000, numPartitions=1).select(F.lit("four words a line " * 200).alias("text"))
    got = Stages(spark, "batches").save(docs.mapInArrow(sizes, "n long, size long"), "sizes").collect()
    assert sum(r["n"] for r in got) == 10_000 and max(r["size"] for r in got) < 1.1 * BATCH_BYTES
    assert spark.conf.get(BATCH_SETTING) == before
    data, ends = np.full(2_500_000, 97, "u1"), np.arange(5_000, 2_500_001, 5_000)
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(ends))), pa.array(["a" * 5_000] * len(ends))], ["id", "text"])
    parts = list(slices(rows, 1))
    assert max(len(d) for _, d, _ in parts) <= 1_000_000 and np.array_equal(np.concatenate([d for _, d, _ in parts]), data)
