"""Keyed streams in order of time: rows wait in state until the watermark has passed them, then go
through an automaton one after another, whatever the order in which they arrived.

An automaton is a class with ``take(rows)`` for the rows of one instant and ``memory()``; what it
remembers is what its pattern still needs, so state is bounded by the rows of a window and of the
lateness allowed, not by the stream.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A row to an automaton: microseconds, what it is (a rule, say), its number, its score.
Row = tuple[int, str, int, float]


class FirstCrossing:
    """The first time that ``value`` rows lie within the window."""

    def __init__(self, window_us: int, value: int, memory: dict | None = None):
        m = memory or {}
        self.window_us, self.value, self.times, self.fired = window_us, value, deque(m.get("times", ())), m.get("fired", False)

    def memory(self) -> dict:
        return {"times": list(self.times), "fired": self.fired}

    def take(self, us: int) -> bool:
        if self.fired:
            return False
        self.times.append(us)
        while self.times[0] < us - self.window_us:
            self.times.popleft()
        self.fired = len(self.times) >= self.value
        if self.fired:
            self.times.clear()
        return self.fired


class OrderedChain:
    """The first firing of the first rule from which each next one fires at or after the one before,
    all within the timespan: started, fired, and the numbers of the firings. Fires once.

    All starts that wait for the same rule move on together; those too old for the timespan go.
    """

    columns = "started long, fired long, seqs array<long>"

    def __init__(self, rules: list[str], timespan_us: int, memory: dict | None = None):
        m = memory or {}
        self.rules, self.timespan_us = rules, timespan_us
        self.waiting, self.done = [[tuple(x) for x in w] for w in m.get("waiting", [[] for _ in rules[1:]])], m.get("done", False)

    def memory(self) -> dict:
        return {"waiting": self.waiting, "done": self.done}

    def take(self, rows: list[Row]) -> Iterator[tuple]:
        if self.done:
            return
        us = rows[0][0]
        least = {}
        for _, rule, seq, _ in rows:
            least[rule] = min(seq, least.get(rule, seq))
        for k, rule in enumerate(self.rules):
            if k == 0:
                moved = [(us, [r[2]]) for r in sorted(rows) if r[1] == rule]
            elif rule in least:
                moved, self.waiting[k - 1] = [(s, [*seqs, least[rule]]) for s, seqs in self.waiting[k - 1]], []
            else:
                moved = []
            if k == len(self.rules) - 1:
                whole = [m for m in moved if us - m[0] <= self.timespan_us]
                if whole:
                    self.done, self.waiting = True, []
                    yield (whole[0][0], us, whole[0][1]) if len(whole) == 1 else (min(whole)[0], us, min(whole)[1])
            else:
                self.waiting[k] = sorted(x for x in [*self.waiting[k], *moved] if us - x[0] <= self.timespan_us)


class UnorderedChain:
    """The first moment at which every rule has fired within the timespan. Remembers each rule's latest."""

    columns = "fired long, completed long, seqs array<long>"

    def __init__(self, rules: list[str], timespan_us: int, memory: dict | None = None):
        m = memory or {}
        self.rules, self.timespan_us, self.last, self.done = rules, timespan_us, {k: tuple(v) for k, v in m.get("last", {}).items()}, m.get("done", False)

    def memory(self) -> dict:
        return {"last": self.last, "done": self.done}

    def take(self, rows: list[Row]) -> Iterator[tuple]:
        for us, rule, seq, _ in sorted(rows, key=lambda r: r[1:3]):
            if self.done or rule not in self.rules:
                continue
            self.last[rule] = (us, seq)
            if len(self.last) == len(self.rules) and us - min(self.last.values())[0] <= self.timespan_us:
                self.done = True
                yield self.last[self.rules[-1]][0], us, [self.last[r][1] for r in self.rules]
                self.last = {}


class PeakSum:
    """Each new largest sum of scores over a window: the sum, the window, its rows. A monotone deque
    holds the running sums from which the window may be counted; the last that is told is the peak."""

    columns = "max_sum long, window_start long, window_end long, signals long"

    def __init__(self, window_us: int, memory: dict | None = None):
        m = memory or {}
        self.window_us, self.total, self.n, self.best = window_us, m.get("total", 0), m.get("n", 0), m.get("best")
        self.before = deque(tuple(x) for x in m.get("before", ()))  # (us, running sum before a row), sums rising
        self.inside = deque(tuple(x) for x in m.get("inside", ()))  # (us, place) of the window's rows

    def memory(self) -> dict:
        return {"total": self.total, "n": self.n, "best": self.best, "before": list(self.before), "inside": list(self.inside)}

    def take(self, rows: list[Row]) -> Iterator[tuple]:
        for us, _, _, score in sorted(rows, key=lambda r: r[2]):
            while self.before and self.before[-1][1] >= self.total:
                self.before.pop()
            self.before.append((us, self.total))
            self.total, self.n = self.total + int(score), self.n + 1
            self.inside.append((us, self.n))
            while self.inside[0][0] < us - self.window_us:
                self.inside.popleft()
            while self.before[0][0] < us - self.window_us:
                self.before.popleft()
            reached = self.total - self.before[0][1]
            if self.best is None or reached > self.best:
                self.best = reached
                yield reached, self.inside[0][0], us, self.n - self.inside[0][1] + 1


@dataclass
class Fed:
    """A chain one of whose rules is the first crossing of a threshold by rows of another kind."""

    chain: OrderedChain
    crossing: FirstCrossing
    counts: str
    name: str
    rows: list = field(default_factory=list)

    def memory(self) -> dict:
        return {"chain": self.chain.memory(), "crossing": self.crossing.memory()}

    def take(self, rows: list[Row]) -> Iterator[tuple]:
        crossed = [(us, self.name, seq, score) for us, kind, seq, score in sorted(rows, key=lambda r: r[2]) if kind == self.counts and self.crossing.take(us)]
        yield from self.chain.take([*rows, *crossed])


def in_order(
    events: DataFrame, key: str, ts: str, seq: str, make: Callable[[dict | None], object], columns: str, kind: Column | None = None, score: Column | None = None, late: str = "1 hour"
) -> DataFrame:
    """(key, *columns) of what each key's automaton tells over its rows in order of (time, number).

    Rows wait until the watermark (``late`` behind the newest row of all keys) has passed them, so the
    result is that of the sorted stream for any order of arrival within ``late``; rows later still are
    dropped and counted by Spark (``numRowsDroppedByWatermark``). Rows without time or key take no
    part; ``undated`` gives them. ``make`` builds the automaton from what it remembered, or None.
    """

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, memory = (json.loads(x) for x in state.get) if state.exists else ([], None)
        rows = [tuple(r) for r in held]
        if not state.hasTimedOut:
            for f in frames:
                rows += zip(f["us"].tolist(), f["kind"].tolist(), f["seq"].tolist(), f["score"].tolist(), strict=True)
        rows.sort(key=lambda r: (r[0], r[2]))
        mark = state.getCurrentWatermarkMs() * 1000
        automaton, out, at = make(memory), [], 0
        while at < len(rows) and rows[at][0] < mark:
            stop = at
            while stop < len(rows) and rows[stop][0] == rows[at][0]:
                stop += 1
            out += automaton.take(rows[at:stop])
            at = stop
        rows = rows[at:]
        state.update((json.dumps(rows), json.dumps(automaton.memory())))
        if rows:  # wakes when the watermark is past the first of them
            state.setTimeoutTimestamp(max(rows[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([(group[0], *x) for x in out], columns=[key, *names])

    names = [c.split()[0] for c in columns.split(", ")]
    rows = events.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).withWatermark(ts, late).select(
        F.col(key).alias("k"), F.col(ts), F.unix_micros(ts).alias("us"), (F.lit("") if kind is None else kind).cast("string").alias("kind"), F.col(seq).cast("long").alias("seq"),
        (F.lit(0) if score is None else score).cast("double").alias("score"),
    )
    type_ = events.schema[key].dataType.simpleString()
    return rows.groupBy("k").applyInPandasWithState(step, f"{key} {type_}, {columns}", "held string, memory string", "append", GroupStateTimeout.EventTimeTimeout)


def undated(events: DataFrame, ts: str) -> DataFrame:
    """The rows without a time, a stream of their own: no window is theirs, and no watermark drops them."""
    return events.where(F.col(ts).isNull())


def stream_ordered_chain(events: DataFrame, key: str, rules: list[str], timespan_us: int, kind: Column, ts: str = "ts", seq: str = "seq", late: str = "1 hour") -> DataFrame:
    """key, started, fired, seqs (microseconds and numbers): the chain that ``ordered_chain`` finds."""
    return in_order(events, key, ts, seq, lambda m: OrderedChain(rules, timespan_us, m), OrderedChain.columns, kind, late=late)


def stream_fed_chain(
    events: DataFrame, key: str, rules: list[str], timespan_us: int, kind: Column, counts: str, name: str, window_us: int, value: int, ts: str = "ts", seq: str = "seq", late: str = "1 hour"
) -> DataFrame:
    """A chain with rule ``name``: the first time that ``value`` rows of kind ``counts`` fall in the window."""

    def make(m: dict | None) -> Fed:
        m = m or {}
        return Fed(OrderedChain(rules, timespan_us, m.get("chain")), FirstCrossing(window_us, value, m.get("crossing")), counts, name)

    return in_order(events, key, ts, seq, make, OrderedChain.columns, kind, late=late)


def stream_unordered_chain(events: DataFrame, key: str, rules: list[str], timespan_us: int, kind: Column, ts: str = "ts", seq: str = "seq", late: str = "1 hour") -> DataFrame:
    """key, fired, completed, seqs: what ``unordered_chain`` finds."""
    return in_order(events, key, ts, seq, lambda m: UnorderedChain(rules, timespan_us, m), UnorderedChain.columns, kind, late=late)


def stream_peaks(events: DataFrame, key: str, window_us: int, score: Column, ts: str = "ts", seq: str = "seq", late: str = "1 hour") -> DataFrame:
    """key, max_sum, window_start, window_end, signals at each new peak; the last is ``max_window_sum``'s."""
    return in_order(events, key, ts, seq, lambda m: PeakSum(window_us, m), PeakSum.columns, score=score, late=late)
