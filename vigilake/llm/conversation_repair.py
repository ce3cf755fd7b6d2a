"""Structure repair of conversations: the cheapest edits on a graph of columns and states.

A conversation's rows are columns, the states of the wanted shape ``(s?(ua)+)?`` its nodes. Costs
forward from the start and backward from the end tell which arcs lie on a cheapest path; a walk over
these takes the least letter at each step. Both costs are products of small min-plus matrices, so a
conversation that spans partitions is solved in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages

#: States: nothing yet, after a system row, after a user row, after an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (EMPTY, ASSISTANT)
#: What a user or assistant row leads to where one may stand, and which of the two may.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("user", "user", "assistant", "user")
#: Costs of the edits, of a truncated row that stays, and the spaces of a blank text.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACES = " \t\n\v\f\r"
FAR = 1 << 60
WELL, BLANK, DUPLICATE, CUT = range(4)  # a row's first fault

Vector = tuple[int, int, int, int]
#: A row to the solver: its role's initial and its first fault.
Mark = tuple[str, int]


def kept_state(state: int, initial: str) -> int | None:
    """The state after a row of this initial, None where the shape has no place for it."""
    if not initial:
        return state
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    if initial in "ua" and ROLES[state][0] == initial:
        return NEXT[state]
    return None


@lru_cache(maxsize=4096)
def row_arcs(mark: Mark) -> tuple[tuple[int, str, int, int], ...]:
    """(state, letter, cost, state after) of every edit that takes this row."""
    initial, fault = mark
    arcs = [(q, "D", DELETE, q) for q in STATES]
    if fault in (WELL, CUT):
        more = TRUNCATED if fault == CUT else 0
        arcs += [(q, "K", KEEP + more, to) for q in STATES if (to := kept_state(q, initial)) is not None]
        arcs += [(q, "R", REROLE + more, NEXT[q]) for q in STATES]
    return tuple(arcs)


def _inserted_forward(costs: Sequence[int]) -> Vector:
    best = list(costs)
    for _ in range(2):  # more than two inserted rows in a place gain nothing
        for q in STATES:
            best[NEXT[q]] = min(best[NEXT[q]], best[q] + INSERT)
    return tuple(best)


def _inserted_backward(costs: Sequence[int]) -> Vector:
    best = list(costs)
    for _ in range(2):
        for q in STATES:
            best[q] = min(best[q], best[NEXT[q]] + INSERT)
    return tuple(best)


def forward_costs(marks: Sequence[Mark], entry: Vector) -> list[Vector]:
    """For each column, and the place after the last, the least cost of each state with inserts
    there; ``entry`` holds the costs before the first column's inserts."""
    out = [_inserted_forward(entry)]
    for mark in marks:
        after = [FAR] * 4
        for q, _, cost, to in row_arcs(mark):
            after[to] = min(after[to], out[-1][q] + cost)
        out.append(_inserted_forward(after))
    return out


def backward_costs(marks: Sequence[Mark], leaving: Vector) -> list[Vector]:
    """For each column, and the place after the last, the least cost from each state to the end;
    ``leaving`` holds those after the last column's inserts."""
    out = [_inserted_backward(leaving)]
    for mark in reversed(marks):
        here = [FAR] * 4
        for q, _, cost, to in row_arcs(mark):
            here[q] = min(here[q], out[-1][to] + cost)
        out.append(_inserted_backward(here))
    return out[::-1]


def least_walk(
    marks: Sequence[Mark], forward: list[Vector], backward: list[Vector], total: int, frontier: set[int], last: bool
) -> tuple[list[str], list[list[str | None]], set[int]]:
    """The letters at each column, the roles they give, and the frontier behind the last column.

    Walks from all states of ``frontier`` at once along arcs that lie on a cheapest path, and keeps
    those with the least letter at each step. Inserts behind the last column belong to the block
    where the conversation ends (``last``).
    """
    letters, roles = [], []
    for k in range(len(marks) + last):
        word, given = "", []
        ended = k == len(marks)
        while True:
            if ended and any(q in ENDS and forward[k][q] == total for q in frontier):
                break  # the shorter of two words is the lesser
            tight = [] if ended else [(letter, q, to) for q, letter, cost, to in row_arcs(marks[k]) if q in frontier and forward[k][q] + cost + backward[k + 1][to] == total]
            tight += [("I", q, NEXT[q]) for q in frontier if forward[k][q] + INSERT + backward[k][NEXT[q]] == total]
            least = min(letter for letter, _, _ in tight)
            word += least
            given.append(None if least in "DK" else next(ROLES[q] for letter, q, _ in tight if letter == least))
            frontier = {to for letter, _, to in tight if letter == least}
            if least != "I":
                break
        letters.append(word)
        roles.append(given)
    return letters, roles, frontier


START: Vector = (0, FAR, FAR, FAR)
FINISH: Vector = tuple(0 if q in ENDS else FAR for q in STATES)


@lru_cache(maxsize=50_000)
def solve(marks: tuple[Mark, ...]) -> tuple[int, list[str], list[list[str | None]]]:
    """Cost, letters and roles of a whole conversation's cheapest edits."""
    forward, backward = forward_costs(marks, START), backward_costs(marks, FINISH)
    total = backward[0][EMPTY]
    return total, *least_walk(marks, forward, backward, total, {EMPTY}, True)[:2]


def repaired_lines(word: str, given: list[str | None], role: str, text: str) -> Iterator[str]:
    """The lines that a column's letters leave of its row."""
    for letter, new in zip(word, given, strict=True):
        if letter == "I":
            yield f"{new}:"
        elif letter != "D":
            yield f"{new or role}:{text}"


def fault_of(text: str) -> int:
    """BLANK, CUT or WELL; whether a row repeats an earlier one is its neighbours' affair."""
    body = text.rstrip(SPACES)
    return BLANK if not body else WELL if body[-1] in ".!?" else CUT


def is_illegal(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone) after damage drawn by CRC-32 of ``conv:turn`` modulo 20.

    0 drops a row (it stays here, marked gone), 1 empties its text, 2 takes out its full stops,
    exclamation and question marks, 3 repeats it, 4 makes it a user's. Null roles and texts, and
    nulls in the drawn key, count as one space.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(spaced(text_col), "[.!?]", "")).otherwise(spaced(text_col))
    role = F.when(draw == 4, "user").otherwise(spaced(role_col))
    return turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), (draw == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(draw == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def repairable(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone) of rows as they are; null roles and texts count as one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"), F.lit(False).alias("gone"))


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Whole:
    """One conversation's rows in order, as far as they have come."""

    def __init__(self, conv: object):
        self.conv, self.rows, self.seen = conv, [], set()

    def add(self, turn: int | None, role: str, text: str) -> None:
        fault = fault_of(text)
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        if fault != BLANK and key in self.seen:
            fault = DUPLICATE
        self.seen.add(key)
        self.rows.append((turn, role, text, fault))

    def result(self) -> tuple:
        turns = {r[0] for r in self.rows if r[0] is not None}
        marks = tuple((r[1][:1], r[3]) for r in self.rows)
        cost, letters, roles = solve(marks)
        digest, first = hashlib.sha256(), True
        for k, (word, given) in enumerate(zip(letters, roles, strict=True)):
            role, text = self.rows[k][1:3] if k < len(self.rows) else ("", "")
            for line in repaired_lines(word, given, role, text):
                digest.update(("" if first else "\n").encode() + line.encode())
                first = False
        faults = [m[1] for m in marks]
        illegal = sum(is_illegal(a[0], b[0]) for a, b in zip(marks, marks[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        return (gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, cost, "".join(letters), digest.hexdigest())


def _first_pass(ordered: DataFrame) -> DataFrame:
    """Results of conversations that lie inside a partition; the rows of its first and last ones,
    which may go on next door, come out as they are, with partition and place.

    Rows of the first go out as they are read; of the others one conversation at a time is held, at
    most a partition's share of one.
    """
    kind = ordered.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, part int, at long, turn long, role string, text string, gone boolean, {', '.join(f'{x} long' for x in FACTS)}, audit string, sha string"
    arrow = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, first, now, nothing = TaskContext.get().partitionId(), 0, True, None, (None,) * (len(FACTS) + 2)
        raw, out = [], []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in out], arrow_of(conv_type))
            out.clear()
            return made

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for conv, turn, role, text, gone in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "gone")), strict=True):
                if now is None or now.conv != conv:
                    if now is not None and not first:
                        out.append((now.conv, *(None,) * 6, *now.result()))
                    first = now is None
                    now, raw = _Whole(conv), []
                row = (conv, part, at, turn, role, text, gone, *nothing)
                at += 1
                if first:
                    out.append(row)
                else:
                    raw.append(row)
                    if not gone:
                        now.add(turn, role, text)
                if len(out) >= 2000:
                    yield flush()
        for row in raw:  # the last may go on in the next partition
            out.append(row)
            if len(out) >= 2000:
                yield flush()
        if out:
            yield flush()

    NAMES = [c.split()[0] for c in schema.split(", ")]

    def arrow_of(conv_type: pa.DataType) -> pa.Schema:
        nonlocal arrow
        if arrow is None:
            kinds = {"part": pa.int32(), "role": pa.string(), "text": pa.string(), "audit": pa.string(), "sha": pa.string(), "gone": pa.bool_(), "conv": conv_type}
            arrow = pa.schema([(n, kinds.get(n, pa.int64())) for n in NAMES])
        return arrow

    return ordered.select("conv", "turn", "role", "text", "gone").mapInArrow(run, schema)


def _identity(q: int) -> Vector:
    return tuple(0 if k == q else FAR for k in STATES)


def _marks(block: pa.Table) -> list[Mark]:
    return list(zip((r[:1] for r in block["role"].to_pylist()), block["fault"].to_pylist(), strict=True))


def _ordered(block: pa.Table) -> pa.Table:
    return block.sort_by("at")


def _summaries(rows: DataFrame) -> dict[object, list[dict]]:
    """For each open conversation its blocks in order: counts, turns, and the min-plus matrix from
    states before the block's inserts to states before the next one's. A block lies in one
    partition, of which at most two conversations are open, so twice the partitions bound what
    reaches the driver."""
    kind = rows.schema["conv"].dataType.simpleString()
    fields = "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string, costs array<long>"

    def run(block: pa.Table) -> pa.Table:
        block = _ordered(block)
        marks, turns = _marks(block), [t for t in block["turn"].to_pylist() if t is not None]
        costs = []
        for q in STATES:
            at = forward_costs(marks[:-1], _identity(q))[-1]
            after = [FAR] * 4
            for p, _, cost, to in row_arcs(marks[-1]):
                after[to] = min(after[to], at[p] + cost)
            costs += after
        faults = [m[1] for m in marks]
        row = {
            "conv": block["conv"][0].as_py(), "part": block["part"][0].as_py(), "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
            "illegal": sum(is_illegal(a[0], b[0]) for a, b in zip(marks, marks[1:], strict=False)), "head": marks[0][0], "tail": marks[-1][0], "costs": costs,
        }
        long, text = pa.int64(), pa.string()
        kinds = {"conv": block.schema.field("conv").type, "part": pa.int32(), "head": text, "tail": text, "costs": pa.list_(long)}
        return pa.Table.from_pylist([row], pa.schema([(k, kinds.get(k, long)) for k in row]))

    out: dict[object, list[dict]] = {}
    facts = rows.select("conv", "part", "at", "turn", "role", "fault").groupBy("conv", "part").applyInArrow(run, f"conv {kind}, part int, {fields}")
    for r in sorted((r.asDict() for r in facts.collect()), key=lambda r: r["part"]):
        out.setdefault(r["conv"], []).append(r)
    return out


def _times(vector: Vector, costs: list[int]) -> Vector:
    return tuple(min(min(vector[q] + costs[4 * q + to] for q in STATES), FAR) for to in STATES)


def _vectors(blocks: list[dict]) -> tuple[int, list[Vector], list[Vector]]:
    """The least cost, and costs before each block and behind it, of a conversation's blocks."""
    entries = [START]
    for b in blocks:
        entries.append(_times(entries[-1], b["costs"]))
    leaving = [_inserted_backward(FINISH)]
    for b in reversed(blocks[1:]):
        following = leaving[-1]
        here = tuple(min(min(b["costs"][4 * q + to] + following[to] for to in STATES), FAR) for q in STATES)
        leaving.append(_inserted_backward(here))
    return min(entries[-1][q] + leaving[0][q] for q in STATES), entries[:-1], leaving[::-1]


def _block_walks(rows: DataFrame, plans: dict, frontiers: dict | None) -> DataFrame:
    """With ``frontiers``: letters and lines of each block's rows. Without: where each block's walk
    ends, for each state in which it may begin. ``plans`` has each block's costs on either side."""
    kind = rows.schema["conv"].dataType.simpleString()

    def run(block: pa.Table) -> pa.Table:
        block = _ordered(block)
        conv, part, marks = block["conv"][0].as_py(), block["part"][0].as_py(), _marks(block)
        total, entry, leaving, last = plans[conv, part]
        forward, backward = forward_costs(marks, entry), backward_costs(marks, leaving if not last else FINISH)
        out = []
        if frontiers is None:
            for q in STATES:
                if forward[0][q] + backward[0][q] == total and entry[q] < FAR:
                    ends = least_walk(marks, forward, backward, total, {q}, last)[2]
                    out += [{"conv": conv, "part": part, "at": q, "letters": str(min(ends)), "lines": None}]
        else:
            letters, roles, _ = least_walk(marks, forward, backward, total, set(frontiers[conv, part]), last)
            held = list(zip(block["at"].to_pylist(), block["role"].to_pylist(), block["text"].to_pylist(), strict=True))
            held += [(held[-1][0] + 1, "", "")] * last
            for (at, role, text), word, given in zip(held, letters, roles, strict=True):
                lines = list(repaired_lines(word, given, role, text))
                out.append({"conv": conv, "part": part, "at": at, "letters": word, "lines": "\n".join(lines) if lines else None})
        kinds = {"conv": block.schema.field("conv").type, "part": pa.int32(), "at": pa.int64()}
        return pa.Table.from_pylist(out, pa.schema([(k, kinds.get(k, pa.string())) for k in ("conv", "part", "at", "letters", "lines")]))

    return rows.groupBy("conv", "part").applyInArrow(run, f"conv {kind}, part int, at long, letters string, lines string")


def _streamed_hash(lines: DataFrame) -> DataFrame:
    """(conv, sha) of each conversation's lines, joined by line ends: sorted streams of whatever
    length in constant memory (a SHA-256 has to pass one conversation in order)."""
    kind = lines.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, first, made = None, None, True, []
        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for conv, line in zip(batch.column("conv").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        made.append((now, digest.hexdigest()))
                    now, digest, first = conv, hashlib.sha256(), True
                if line is not None:
                    digest.update(("" if first else "\n").encode() + line.encode())
                    first = False
        if digest is not None:
            made.append((now, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], conv_type), pa.array([m[1] for m in made], pa.string())], ["conv", "sha"])

    return lines.select("conv", "part", "at", "lines").repartition("conv").sortWithinPartitions("conv", "part", "at").select("conv", "lines").mapInArrow(run, f"conv {kind}, sha string")


def _open_results(rows: DataFrame, stages: Stages) -> DataFrame:
    """Results of the conversations that may span partitions: blocks summarised as matrices, their
    products taken on the driver (at most twice the partitions), then each block walked alone."""
    spark = rows.sparkSession
    kind = rows.schema["conv"].dataType.simpleString()
    key = F.sha2(F.to_json(F.struct("conv", "role", "text")), 256)
    body = F.rtrim("text", F.lit(SPACES))
    bare = F.when(body == "", BLANK).when(F.substring(body, -1, 1).isin(".", "!", "?"), WELL).otherwise(CUT)
    live = rows.where(~F.col("gone")).withColumn("key", key)
    first = live.groupBy("key").agg(F.min(F.struct("part", "at")).alias("first"))
    again = (bare != BLANK) & (F.struct("part", "at") != F.col("first"))
    told = stages.save(live.join(first, "key").select("conv", "part", "at", "turn", "role", "text", F.when(again, DUPLICATE).otherwise(bare).alias("fault")), "told")
    made, plans, order = {}, {}, {}
    for conv, blocks in _summaries(told).items():
        total, entries, leaving = _vectors(blocks)
        for k, b in enumerate(blocks):
            plans[conv, b["part"]] = (total, entries[k], leaving[k], k == len(blocks) - 1)
        known = [b for b in blocks if b["turns"]]
        turns = sum(b["turns"] for b in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
        gaps = known[-1]["high"] - known[0]["low"] + 1 - turns if known else 0
        illegal = sum(b["illegal"] for b in blocks) + sum(is_illegal(a["tail"], b["head"]) for a, b in zip(blocks, blocks[1:], strict=False))
        made[conv] = (gaps, *(sum(b[x] for b in blocks) for x in ("blank", "duplicate", "truncated")), illegal, total)
        order[conv] = [b["part"] for b in blocks]
    exits = {(r["conv"], r["part"], r["at"]): int(r["letters"]) for r in _block_walks(told, plans, None).collect()}
    frontiers = {}
    for conv, parts in order.items():
        state = EMPTY
        for part in parts:
            frontiers[conv, part] = (state,)
            state = exits[conv, part, state]
    walked = stages.save(_block_walks(told, plans, frontiers), "walked")
    in_block = walked.groupBy("conv", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "letters"))), lambda x: x["letters"]), "").alias("word"))
    audits = in_block.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "word"))), lambda x: x["word"]), "").alias("audit"))
    facts = spark.createDataFrame([(conv, *values) for conv, values in made.items()], f"conv {kind}, {', '.join(f'{x} long' for x in FACTS)}")
    same = lambda a, b: a["conv"].eqNullSafe(b["conv"])
    hashes = _streamed_hash(walked)
    joined = facts.join(audits, same(facts, audits)).drop(audits["conv"])
    found = joined.join(hashes, same(joined, hashes)).drop(hashes["conv"])
    bare_ones = rows.select("conv").distinct()
    return _with_absent(bare_ones, found, same)


def _with_absent(all_ones: DataFrame, found: DataFrame, same) -> DataFrame:
    """``found``, and zeros for the conversations of which no row is left."""
    absent = all_ones.join(found, same(all_ones, found), "left_anti")
    zeros = [F.lit(0).cast("long").alias(x) for x in FACTS]
    return found.unionByName(absent.select("conv", *zeros, F.lit("").alias("audit"), F.lit(hashlib.sha256(b"").hexdigest()).alias("sha")))


def repair_conversations(rows: DataFrame, conv_name: str = "conv_id", partitions: int | None = None) -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit (the
    letters of the cheapest edits) and repaired_sha256 (of the repaired lines).

    ``rows`` come from ``damaged`` or ``repairable``. They are range-sorted by conversation and turn
    (nulls first; rows of one turn by a hash of role and text), so that a conversation with a great
    share of all rows lies over many partitions; those inside one are solved as they stream by.

    A null id is one conversation; rows repeated exactly are duplicates; blank and empty texts are
    blank rows; an empty role has no initial and may stand anywhere. Conversations without a row
    left have zeros and the empty text's hash. Other columns play no part; an empty table gives no rows.
    """
    stages = Stages(rows.sparkSession, "repair")
    keyed = rows.withColumns({"h": F.xxhash64("role", "text"), "n": F.monotonically_increasing_id()})
    keys = [F.asc_nulls_first(c) for c in ("conv", "turn", "h", "n")]
    spread = keyed.repartitionByRange(partitions, *keys) if partitions else keyed.repartitionByRange(*keys)
    passed = stages.save(_first_pass(spread.sortWithinPartitions(*keys)), "passed")
    whole = passed.where("part IS NULL").select("conv", *FACTS, "audit", "sha")
    opened = _open_results(passed.where("part IS NOT NULL").select("conv", "part", "at", "turn", "role", "text", "gone"), stages)
    return whole.unionByName(opened).select(F.col("conv").alias(conv_name), *FACTS, "audit", F.col("sha").alias("repaired_sha256"))
