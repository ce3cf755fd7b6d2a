"""Personal data in texts: fixed patterns, and further spans chosen by boosted trees.

Generators propose spans beyond the fixed patterns, freely and overlapping; gradient-boosted trees
score each by its format and its surroundings; a threshold for each kind, calibrated on rows that
the trees didn't see, says which are redacted.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: n for n, k in enumerate(KINDS)}
#: The patterns of the base spans, anchored where their first fixed character stands.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
DOTTED = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])++")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def small_parts(dotted: str) -> bool:
    """Whether every part is at most 255, however many zeros lead it."""
    return all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in dotted.split("."))


def runs_before(text: str, anchors: Iterator[re.Match], allowed: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each anchor's match with the run of ``allowed`` characters before it, the
    leftmost ones that don't overlap; linear, as no character is stripped twice."""
    done = 0
    for m in anchors:
        head = text[done : m.start()]
        start = done + len(head.rstrip(allowed))
        if start < m.start():
            yield start, m.end()
            done = m.end()


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """The spans of the fixed patterns; ``runs`` are those of digits."""
    out = [("email", s, e) for s, e in runs_before(text, DOMAIN.finditer(text), LOCAL)] if "@" in text else []
    for kind, pattern in (("ip", DOTTED), ("card", GROUPED)):
        done = 0
        for s, _ in runs:
            if s >= done and (m := pattern.match(text, s)):
                done = m.end()
                if small_parts(m[0]) if kind == "ip" else 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                    out.append((kind, s, done))
    if runs and "+" in text:
        out += [("phone", m.start(), m.end()) for m in PLUS.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


# ---- generators beyond the fixed patterns

AT = re.compile(r"\s?[(\[{<]\s?(?i:at)\s?[)\]}>]\s?| (?:at|AT) |@")
DOT = r"(?:\s?[(\[{<]\s?(?i:dot)\s?[)\]}>]\s?| (?i:dot) |\.)"
HOST = re.compile(rf"[^\W_](?:[\w-]{{0,62}})(?:{DOT}[^\W_][\w-]{{0,62}}){{1,10}}")
WIDE_LOCAL = re.compile(r"[\w.%+-]{1,64}\Z")
BETWEEN = re.compile(r"[  ().\-/_]{1,3}\Z")
DEFANGED = re.compile(r"[0-9]{1,3}(?:\s?[(\[{]\s?(?:\.|(?i:dot))\s?[)\]}]\s?[0-9]{1,3}){3}(?![0-9])")
COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
HEX_GROUPS = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
HEX = "0123456789abcdefABCDEF"


def wide_emails(text: str) -> Iterator[Span]:
    for m in AT.finditer(text):
        host = HOST.match(text, m.end())
        local = WIDE_LOCAL.search(text[max(0, m.start() - 64) : m.start()]) if host else None
        if local:
            yield "email", m.start() - len(local[0]), host.end()


def wide_addresses(text: str, runs: list[tuple[int, int]]) -> Iterator[Span]:
    for s, e in runs:
        if e - s <= 3 and text[e : e + 1] in " ([{" and (m := DEFANGED.match(text, s)):
            yield "ip", s, m.end()
    done = 0
    for m in COLONS.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and m.start() - start < 5 and text[start - 1] in HEX:
            start -= 1
        if found := HEX_GROUPS.match(text, start):
            done = found.end()
            yield "ip", start, done


def clusters(text: str, runs: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Runs of digits with nothing but separators between them, 40 at a time at most: a window of
    15 or 19 digits reaches no further than 19 runs, and chunks overlap by as many."""
    now: list[tuple[int, int]] = []
    for s, e in runs:
        if now and not (s - now[-1][1] <= 3 and BETWEEN.match(text[now[-1][1] : s])):
            yield now
            now = []
        elif len(now) == 40:
            yield now
            now = now[-20:]
        now.append((s, e))
    if now:
        yield now


def wide_numbers(text: str, runs: list[tuple[int, int]]) -> Iterator[Span]:
    for groups in clusters(text, runs):
        if sum(e - s for s, e in groups) < 7:
            continue
        for i, (s, _) in enumerate(groups):
            n = 0
            for j in range(i, len(groups)):
                e = groups[j][1]
                n += e - groups[j][0]
                if n > 19:
                    break
                if 13 <= n:
                    yield "card", s, e
                if 7 <= n <= 15 and j - i < 6:
                    start = s
                    if start and text[start - 1] == "(" and ")" in text[start:e]:
                        start -= 1
                    if start and text[start - 1] == "+":
                        start -= 1
                    yield "phone", start, e


def proposals(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    return sorted({*wide_emails(text), *wide_addresses(text, runs), *wide_numbers(text, runs)})


# ---- features of format and context

#: Words (in four languages) near each kind, and words that speak against it.
NEAR = {
    "email": "mail email e-mail courriel correo contact kontakt contacto write reach schreiben escribir écrire",
    "ip": "ip ipv4 ipv6 host server address adresse dirección serveur servidor client from peer login gateway",
    "card": "card visa mastercard amex credit debit carte karte kreditkarte tarjeta bancaire payment paid pan",
    "phone": "phone tel telephone call fax mobile cell whatsapp telefon handy anruf téléphone appel móvil teléfono llamar sms",
}
AGAINST = set("order invoice isbn issn version build ref reference ticket serial imei tracking commit uuid id sku model mac page pages vol chapter year date time bestellung rechnung commande facture pedido factura zip postcode plz score ratio price total".split())
NEAR = {k: set(v.split()) for k, v in NEAR.items()}
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
FEATURES = (
    "email", "ip", "card", "phone", "length", "digits", "luhn", "groups", "longest", "shortest", "separators", "plus", "brackets", "near", "against",
    "joined_before", "joined_after", "distinct", "letters", "last_label", "spelled_out", "issuer", "colons", "date_like", "local_marks", "zero_first", "number_beside",
)
CONTEXT = 40


def issuer(d: str) -> bool:
    """Whether length and first digits are those that card issuers use."""
    return (
        (d[0] == "4" and len(d) in (13, 16, 19)) or (d[:2] in ("34", "37") and len(d) == 15) or (len(d) == 16 and (51 <= int(d[:2]) <= 55 or 2221 <= int(d[:4]) <= 2720))
        or (len(d) in (14, 16) and d[:2] in ("36", "38", "60", "64", "65"))
    )


def span_features(text: str, kind: str, start: int, end: int) -> list[float]:
    value, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 12]
    d, groups = digits_of(value), DIGITS.findall(value)
    ahead = [w.lower() for w in WORD.findall(before)][-5:]
    labels = re.split(DOT, value) if kind == "email" else []
    sizes = [len(g) for g in groups] or [0]
    date = bool(re.fullmatch(r"(?:(?:19|20)\d\d[-/. ]\d{1,2}[-/. ]\d{1,2}|\d{1,2}[-/. ]\d{1,2}[-/. ](?:19|20)\d\d|(?:19|20)\d\d ?- ?(?:19|20)\d\d)(?: \d{1,2})*", value))
    return [
        kind == "email", kind == "ip", kind == "card", kind == "phone", len(value) / 40, len(d) / 20, bool(d) and luhn(d), len(groups) / 8,
        max(sizes) / 16, min(sizes) / 8, len({c for c in value if not c.isalnum()}) / 4, value.startswith(("+", "00")), "(" in value or "[" in value,
        any(w in NEAR[kind] for w in ahead), any(w in AGAINST for w in ahead[-3:]), bool(before) and (before[-1].isalnum() or before[-1] in "-_/.#$€@+"),
        bool(after) and (after[0].isalnum() or (after[0] in "-_/.:%€$@" and after[1:2].isalnum())), len(set(d)) / 10, sum(c.isalpha() for c in value) / len(value),
        len(labels[-1]) / 8 if labels else 0.0, len(re.findall(r"(?i)[(\[{<\s](?:at|dot)[)\]}>\s]", value)) / 2, len(d) >= 13 and issuer(d),
        value.count(":") / 8, date, sum(c in "._%+-0123456789" for c in re.split(AT, value)[0]) / 4 if kind == "email" else 0.0, value.lstrip("(").startswith("0"),
        bool(re.search(r"[0-9][ .()/-]{0,2}\Z", before)) + bool(re.match(r"[ .()/-]{0,2}[0-9]", after)),
    ]


# ---- the model


@dataclass(frozen=True)
class SpanModel:
    """Trees as flat arrays (feature, threshold, left, right, value) with their weights, and for
    each kind the calibration curve and the threshold: some kilobytes, whatever the corpus."""

    trees: tuple[tuple[np.ndarray, ...], ...]
    weights: tuple[float, ...]
    curves: dict[str, tuple[np.ndarray, np.ndarray]]
    thresholds: dict[str, float]

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), "i4")
            while (feature[at] >= 0).any():
                inner = feature[at] >= 0
                low = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += weight * value[at]
        return total

    def probabilities(self, kinds: list[str], x: np.ndarray) -> np.ndarray:
        """Calibrated by kind."""
        margin = self.margins(x)
        return np.array([np.interp(m, *self.curves[k]) for k, m in zip(kinds, margin, strict=True)])

    def chosen(self, text: str, taken: list[Span], runs: list[tuple[int, int]]) -> list[tuple[Span, float]]:
        """Proposals at their kind's threshold or above that overlap no span of ``taken``; of those
        that overlap each other the likeliest, then longest, then first."""
        busy = sorted((s, e) for _, s, e in taken)
        reach = np.maximum.accumulate([e for _, e in busy]).tolist() if busy else []

        def free(start: int, end: int) -> bool:
            n = bisect_left(busy, (end,))
            return not n or reach[n - 1] <= start

        found = [p for p in proposals(text, runs) if free(p[1], p[2])]
        if not found:
            return []
        x = np.array([span_features(text, *p) for p in found], "f8")
        score = self.probabilities([p[0] for p in found], x)
        ranked = sorted((-q, p[1] - p[2], p[1], p) for p, q in zip(found, score, strict=True) if q >= self.thresholds[p[0]])
        starts, ends, out = [], [], []
        for q, _, _, p in ranked:
            k = bisect_left(starts, p[2])
            if not k or ends[k - 1] <= p[1]:
                starts.insert(k, p[1])
                ends.insert(k, p[2])
                out.append((p, -q))
        return out


def labelled_sentences(n: int = 4000, seed: int = 11) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): ``n`` sentences made by rule, each with one value that is
    personal data (1) or looks like it (0). Triaged findings of the same columns can take their place."""
    rng = random.Random(seed)
    pick, num = rng.choice, lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    names, hosts, tlds = "anna jose li maria tom lea paul nora".split(), "example mailhost correo poste firma kontor".split(), "com org net de fr es info".split()
    filler = "the of and is to le la de un en der die und ist el los que por near later was".split()

    def card_digits(k: int, valid: bool) -> str:
        body = pick(["4", "51", "55", "37", "36", "6011"] if k != 13 else ["4"])
        body += num(k - 1 - len(body))
        return next(body + c for c in "0123456789" if luhn(body + c)) if valid else next(body + c for c in rng.sample("0123456789", 10) if not luhn(body + c))

    def email(good: bool) -> str:
        host = f"{pick(hosts)}{pick(['', num(1)])}"
        if good:
            local = pick([f"{pick(names)}.{pick(names)}", f"{pick(names)}{num(2)}", f"{num(2)}", f"{pick(names)}_{pick(names)}", f"josé{num(1)}"])
            at, dot = pick([("(at)", "."), ("[at]", "."), (" at ", " dot "), (" [at] ", "[dot]"), (" (at) ", "(dot)"), ("{at}", "."), ("@", ".")])
            return f"{local}{at}{host}{dot}{pick(tlds)}"
        return pick([f"{pick(['look', 'shop', 'sold', 'meet', 'found', 'is'])} at {host}.{pick(tlds)}", f"{pick(filler)} at {pick(['noon', 'home', 'v1'])}.{pick(['The', 'Then', '2', 'x'])}", f"{pick(filler)} at {pick(filler)}.{pick(filler)}"])

    def ip(good: bool) -> str:
        h = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
        if good:
            return pick([":".join(h(4) for _ in range(8)), f"2001:db8:{h(4)}::{h(2)}", f"fe80::{h(4)}:{h(4)}:{h(4)}:{h(3)}", "[.]".join(str(rng.randrange(1, 255)) for _ in range(4)), "(dot)".join(str(rng.randrange(1, 255)) for _ in range(4))])
        return pick([f"{num(1)}1:{num(1)}2:0{num(1)}", ":".join(h(2) for _ in range(6)), f"{num(1)}:{num(1)}:{num(1)}", f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", f"abc::{h(1)}f::", "::"])

    def card(good: bool) -> str:
        k = pick([16, 16, 16, 15, 14, 13])
        if good:
            d, sep = card_digits(k, True), pick([".", "/", " ", "-", "_", " ", ""])
            return sep.join(d[i : i + 4] for i in range(0, k, 4))
        return pick([card_digits(k, False), "978" + num(10), "17" + num(11), " ".join(num(4) for _ in range(4)), num(pick([13, 14, 15, 17, 18])), f"{num(6)}-{num(8)}"])

    def phone(good: bool) -> str:
        if good:
            return pick([f"({num(3)}) {num(3)}-{num(4)}", f"{pick('23456789')}{num(2)}-{num(3)}-{num(4)}", f"{pick('23456789')}{num(2)}.{num(3)}.{num(4)}", f"0{num(3)} {num(7)}", f"0{num(2)}/{num(8)}", f"00{num(2)} {num(2)} {num(4)} {num(4)}", f"+{num(2)} {num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"+1 ({num(3)}) {num(3)}-{num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"])
        return pick([f"20{num(2)}-0{pick('123456789')}-1{num(1)}", f"1{num(1)}/1{pick('012')}/20{num(2)}", f"19{num(2)}-20{num(2)}", f"{num(5)}-{num(4)}", num(8), num(7), f"{num(1)}.{num(3)}.{num(3)}", f"{num(2)}-{num(4)}-{num(2)}", f"978-3-{num(2)}-{num(6)}-{num(1)}", f"{num(3)} {num(2)} {num(3)} {num(1)}", num(10), num(12), f"20{num(2)}-0{num(1)}-1{num(1)} {num(2)}.{num(2)}"])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        kind, good = pick(KINDS), rng.random() < 0.5
        value = makers[kind](good)
        near = pick(sorted(NEAR[kind])) if rng.random() < (0.45 if good else 0.1) else pick(sorted(AGAINST)) if rng.random() < (0.02 if good else 0.35) else pick(filler)
        before = " ".join([*(pick(filler) for _ in range(rng.randrange(5))), pick([near, near.capitalize()])]) + pick([" ", ": ", " ", " # " if not good else " "])
        after = pick([" ", ". ", ", ", "\n", ") "]) + " ".join(pick(filler) for _ in range(rng.randrange(4)))
        if good and rng.random() < 0.12:
            after = f" {num(pick([3, 16]))} " + after  # a number beside hides the end of the value from the fixed patterns
        out.append((before + value + after, kind, len(before), len(before) + len(value), int(good)))
    return out


def labelled_candidates(rows: list[tuple[str, str, int, int, int]]) -> list[tuple[str, list[float], float]]:
    """(kind, features, label) of every proposal in labelled texts: those that are the labelled span
    have its label; others that touch it are false, as are all in texts without personal data."""
    out = []
    for text, kind, start, end, label in rows:
        runs = [m.span() for m in DIGITS.finditer(text)]
        for k, s, e in proposals(text, runs):
            exact = k == kind and (s, e) == (start, end)
            if exact or label == 0 or (s < end and start < e):
                out.append((k, [float(v) for v in span_features(text, k, s, e)], float(exact and label)))
    return out


def _flat(tree: object) -> tuple[np.ndarray, ...]:
    feature, threshold, left, right, value = [], [], [], [], []

    def add(node: object) -> int:
        k = len(feature)
        inner = node.numDescendants() > 0
        for column, v in zip((feature, threshold, left, right, value), (node.split().featureIndex() if inner else -1, node.split().threshold() if inner else 0.0, 0, 0, node.prediction()), strict=True):
            column.append(v)
        if inner:
            left[k], right[k] = add(node.leftChild()), add(node.rightChild())
        return k

    add(tree._call_java("rootNode"))
    return np.array(feature, "i4"), np.array(threshold), np.array(left, "i4"), np.array(right, "i4"), np.array(value)


def fit_span_model(
    spark: SparkSession, labelled: list[tuple[str, str, int, int, int]] | None = None, rounds: int = 20, depth: int = 4, precision: float = 0.98
) -> SpanModel:
    """Trees from labelled texts (a bounded set, ``labelled_sentences`` by default); a third of them
    is kept for calibration: an isotonic curve of probability by kind, and the least threshold at
    which and above which this third is right ``precision`` of the time, 1.01 (none) where it never is."""
    rows = labelled_sentences() if labelled is None else labelled
    parts = [labelled_candidates([r for k, r in enumerate(rows) if (k % 3 == 0) == held]) for held in (False, True)]
    frames = [spark.createDataFrame(p, "kind string, x array<double>, label double").coalesce(1).withColumn("features", array_to_vector("x")) for p in parts]
    fitted = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=64, stepSize=0.3, seed=5, minInstancesPerNode=5).fit(frames[0].cache())
    frames[0].unpersist()
    trees = SpanModel(tuple(map(_flat, fitted.trees)), tuple(fitted.treeWeights), {}, {})
    kinds, y = np.array([p[0] for p in parts[1]]), np.array([p[2] for p in parts[1]])
    margin = trees.margins(np.array([p[1] for p in parts[1]]))
    curves, thresholds = {}, {}
    for kind in KINDS:
        own = [(float(a), float(m)) for a, m in zip(y[kinds == kind], margin[kinds == kind], strict=True)]
        curve = IsotonicRegression().fit(spark.createDataFrame(own, "label double, features double").coalesce(1)) if own else None
        curves[kind] = (curve.boundaries.toArray(), curve.predictions.toArray()) if own else (np.zeros(1), np.zeros(1))
        probability = np.interp(margin[kinds == kind], *curves[kind])
        levels = [t for t in np.unique(probability) if t >= 0.5 and y[kinds == kind][probability >= t].mean() >= precision]
        thresholds[kind] = float(min(levels, default=1.01))
    return SpanModel(trees.trees, trees.weights, curves, thresholds)


def found_in(text: str, model: SpanModel) -> tuple[list[Span], list[tuple[Span, float]]]:
    """The base spans of a text, and those that the model adds with their probabilities."""
    runs = [m.span() for m in DIGITS.finditer(text)]
    base = base_spans(text, runs)
    return base, model.chosen(text, base, runs)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], ORDER[x[0]], x[2])))


def find_personal_data(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, and spans: array of (kind, start, stop, base, probability), by start.

    Offsets count code points, stop exclusive; ``base`` marks the fixed patterns' spans (probability
    1). One scan, no shuffle: texts are read whole, in linear time, and the model goes with the task.
    Null and empty texts have no spans; repeated rows repeat theirs; a null id stays; other columns
    play no part; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())]))
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, added = found_in(text, model)
                spans = [(*s, True, 1.0) for s in base] + [(*s, False, float(q)) for s, q in added]
                spans.sort(key=lambda x: (x[1], ORDER[x[0]], x[2]))
                rows.append([dict(zip(("kind", "start", "stop", "base", "probability"), s, strict=True)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    shape = "array<struct<kind string, start long, stop long, base boolean, probability double>>"
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans {shape}").withColumnRenamed("id", id_col)


def personal_data_digests(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base spans counted by kind, their digest, and all spans written
    ``kind:start:end``; ``n_added`` counts those of the model. Cases as in ``find_personal_data``."""
    found = find_personal_data(docs, model, id_col, text_col)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select(id_col, *map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


def redacted(text: str, model: SpanModel) -> str:
    base, added = found_in(text, model)
    out, done = [], 0
    for kind, start, end in sorted([*base, *(s for s, _ in added)], key=lambda x: (x[1], -x[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact_personal_data(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, every span in their text replaced by its kind in brackets (of spans
    that overlap the first names the whole stretch). Null text comes back null, no row is dropped,
    other columns stay as they are, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            made = [None if t is None else redacted(t, model) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(made, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
