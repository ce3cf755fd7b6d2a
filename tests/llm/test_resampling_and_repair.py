"""Importance resampling and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vigilake.llm import conversation_repair as repair
from vigilake.llm.conversation_repair import BLANK, CUT, DUPLICATE, WELL, damaged, repair_conversations, repairable, solve
from vigilake.llm.importance_sampling import crc32_of_stretches, resample

# ---- resampling


def grams(text, widths):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [" ".join(words[k : k + w]) for w in range(widths[0], widths[1] + 1) for k in range(len(words) - w + 1)], len(words)


def brute_resample(docs, target, widths=(1, 1), buckets=10_000, least=20, percent=10, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, grams(x, widths)[0]))
    for x in target:
        t.update(map(bucket, grams(x, widths)[0]))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for k, (i, x) in enumerate(docs):
        g, n = grams(x, widths)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in map(bucket, g))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([k, i, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n, None])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[4], -1 if r[1] is None else r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[6] = rank
    return sorted((str(r[1]), r[2], r[3], r[4], str(r[6])) for r in rows)


def rows_of(df):
    return sorted((str(r["doc_id"]), r["n_features"], r["weight"], r["score"], str(r["rank"])) for r in df.collect())


def test_crc_of_stretches():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype("u1")
    starts = rng.integers(0, 4000, 300)
    stops = starts + rng.integers(0, 200, 300)
    assert crc32_of_stretches(data, starts, stops).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, stops, strict=True)]
    assert crc32_of_stretches(data, starts[:0], stops[:0]).tolist() == []


@pytest.mark.parametrize("widths", [(1, 1), (1, 2), (2, 3)])
def test_resampling(spark, widths):
    rng = random.Random(2)
    vocabulary = [*"the of cat DOG Ürün 12 x9 ñandú 日本 été".split(), "w" * 90, "a-b", "c`d", "e{f}g", "h\x7fi"]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for k in range(400)]
    docs += [(500, None), (501, ""), (502, " ,;\n"), (503, "one two"), (504, "long cat " * 30_000), (7, docs[7][1]), (7, docs[7][1]), (None, docs[9][1])]
    target = [" ".join(rng.choice(vocabulary[:5]) for _ in range(30)) for _ in range(20)] + [None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS score", "'x' AS id", "2 AS rank")
    got = resample(frame, spark.createDataFrame([(x,) for x in target], "text string"), widths=widths, buckets=50)
    assert rows_of(got) == brute_resample(docs, target, widths, 50)


def test_resampling_of_nothing(spark, none):
    assert resample(none, none).count() == 0
    few = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert rows_of(resample(few, none)) == brute_resample([(1, "a b c"), (2, None)], [])


def test_resampling_with_many_ties(spark):
    text = "same words stand here " * 6
    docs = [(1, text)] * 300 + [(k, text) for k in range(2, 100)]
    got = resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("same",)], "text string"), percent=60)
    assert rows_of(got) == brute_resample(docs, ["same"], percent=60)


# ---- repair


def spelled(initials):
    return re.fullmatch(r"(s?(ua)+)?", initials) is not None


def brute_repair(marks, most=14):
    """Least (cost, audit) by trying all edits, cheapest first."""
    best = None
    stack = [(0, 0, "", "")]
    while stack:
        k, cost, letters, initials = stack.pop()
        if cost > most or (best and cost > best[0]) or letters.endswith("III"):
            continue
        if k == len(marks) and spelled(initials) and (best is None or (cost, letters) < best):
            best = (cost, letters)
        for new in "ua":
            stack.append((k, cost + 5, letters + "I", initials + new))
        if k < len(marks):
            initial, fault = marks[k]
            stack.append((k + 1, cost + 2, letters + "D", initials))
            if fault in (WELL, CUT):
                more = 5 if fault == CUT else 0
                stack.append((k + 1, cost + more, letters + "K", initials + initial))
                stack += [(k + 1, cost + 1 + more, letters + "R", initials + new) for new in "ua"]
    return best


def test_edits_against_all_edits():
    rng = random.Random(8)
    for n in range(6):
        for _ in range(60 if n else 1):
            marks = tuple((rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.choice([WELL, WELL, WELL, BLANK, DUPLICATE, CUT])) for _ in range(n))
            cost, letters, _ = solve(marks)
            assert (cost, "".join(letters)) == brute_repair(marks), marks


def reference_repair(rows):
    """{conv: facts} of (conv, turn, role, text), by a plain forward search for every conversation."""
    out, spaces = {}, " \t\n\v\f\r"
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        kept = []
        for _, turn, role, text in own:
            d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = (" " if role is None else role), (" " if text is None else text)
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            kept += [(turn, "user" if d == 4 else role, text)] * {0: 0, 3: 2}.get(d, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, marks = set(), []
        for _, role, text in kept:
            body = text.rstrip(spaces)
            marks.append((role[:1], BLANK if not body else DUPLICATE if (role, text) in seen else WELL if body[-1] in ".!?" else CUT))
            seen.add((role, text))
        turns = {r[0] for r in kept} - {None}
        cost, letters, roles = solve(tuple(marks))
        lines = [x for k, (w, g) in enumerate(zip(letters, roles, strict=True)) for x in repair.repaired_lines(w, g, *(kept[k][1:] if k < len(kept) else ("", "")))]
        made = re.sub("[^sua]", "", "".join(x[:1] for x in lines)) if all(x[:1] in "sua" for x in lines) else None
        assert made is None or spelled(made)
        faults = [m[1] for m in marks]
        pairs = [a[0] + b[0] for a, b in itertools.pairwise(marks)]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), sum(p not in ("su", "ua", "au") for p in pairs), cost, "".join(letters), hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(6)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), rng.choice(["Yes.", "No!", "Well", " \n", None, f"Say {turn}?", "Same."])))
    rows += [(900, t, ["user", "assistant"][t % 2], f"Hot {t % 7}{'.' if t % 5 else ''}") for t in range(700)]  # a third of all rows and more
    return rows + [(901, None, "user", "Hi."), (901, None, "assistant", "Ho. " + "x" * 100_000), (902, 3, None, None)]


@pytest.mark.parametrize("partitions", [None, 1, 7, 30])
def test_repair(spark, partitions):
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'c' AS conv", "1 AS part", "2 AS at", "3 AS gone").repartition(5)
    found = repair_conversations(damaged(frame), partitions=partitions).collect()
    expected = reference_repair(rows)
    del expected[901]  # its rows share a turn: their order is any
    got = {r[0]: tuple(r)[1:] for r in found}
    assert len(found) == len(got) == len(expected) + 1 and 901 in got
    assert {k: got[k] for k in expected} == expected


def test_repair_of_undamaged_rows_and_none(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho."), (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 5, "assistant", "Ho")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in repair_conversations(repairable(frame)).collect()}
    assert got[1]["audit"] == "KK" and got[1]["cost"] == 0 and got[1]["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Ho.").hexdigest()
    assert (got[2]["gaps"], got[2]["duplicate"], got[2]["truncated"], got[2]["audit"]) == (4, 1, 1, "DDD")
    assert repair_conversations(damaged(frame.limit(0))).count() == 0
