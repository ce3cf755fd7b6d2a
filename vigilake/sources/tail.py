"""A stream of the lines appended to log files, through rotation and truncation."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 65_536


def last_line_end(path: str, size: int) -> int:
    """Where the last whole line ends: a partial line waits for its rest."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            start = max(0, at - BLOCK)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return 0


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int
    name: str = ""
    order: int = 0


def siblings(path: str) -> dict[int, tuple[int, str]]:
    """{inode: (time of the last write, path)} of a log and of what it became by rotation: files beside
    it whose name goes on from its own, compressed ones left out."""
    folder, name = os.path.split(os.path.abspath(path))
    found = {}
    for entry in os.scandir(folder) if os.path.isdir(folder) else ():
        if (entry.name == name or entry.name.startswith((f"{name}.", f"{name}-"))) and not entry.name.endswith((".gz", ".xz", ".bz2", ".zst")) and entry.is_file():
            stat = entry.stat()
            found[stat.st_ino] = (stat.st_mtime_ns, entry.path)
    return found


def find_inode(path: str, inode: int) -> str | None:
    """Where the file stands now: a stretch that was noted before a rotation is read after it."""
    held = siblings(path).get(inode)
    return held[1] if held else None


def rotated_since(path: str, inode: int) -> list[int]:
    """The inodes from that one on, oldest first; none if it is gone."""
    held = siblings(path)
    if inode not in held:
        return []
    return [inode, *(i for i, (at, _) in sorted(held.items(), key=lambda x: x[1]) if at >= held[inode][0] and i != inode)]


class TailReader(DataSourceStreamReader):
    """Offsets are {path: [inode, byte]}. Each file's new stretch is read by its own task.

    Files are found by inode, so a batch is the same when it is planned again after a rotation. Where
    the inode has changed, the rest of the old file comes first, then files rotated since, then the new
    one; a rotated file that was deleted or compressed meanwhile is lost.
    """

    def __init__(self, paths: list[str], from_start: bool):
        self.paths, self.from_start = paths, from_start

    def _places(self, at_end: bool) -> dict:
        found = {}
        for path in self.paths:
            try:
                stat = os.stat(path)
            except OSError:
                continue
            found[path] = [stat.st_ino, last_line_end(path, stat.st_size) if at_end else 0]
        return found

    def initialOffset(self) -> dict:  # noqa: N802
        return self._places(not self.from_start)

    def latestOffset(self) -> dict:  # noqa: N802
        return self._places(True)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        found = []
        for path, (inode, stop) in end.items():
            before, byte = start.get(path, [inode, 0])
            if before == inode:
                stretches = [(inode, 0 if byte > stop else byte, stop)]  # shorter than before: truncated
            else:
                chain = rotated_since(path, before)
                stretches = [(i, byte if i == before else 0, None) for i in chain if i != inode] + [(inode, 0, stop)]
            for order, (i, first, last) in enumerate(stretches):
                at = find_inode(path, i)
                last = last_line_end(at, os.stat(at).st_size) if at and last is None else last
                if at and last > first:
                    found.append(Stretch(at, first, last, path, order))
        return found

    def read(self, partition: Stretch) -> Iterator[tuple[str, str, int]]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline(partition.end - at)
                if not line:
                    return
                yield line.rstrip(b"\r\n").decode("utf-8", "replace"), partition.name or partition.path, (partition.order << 48) + at
                at += len(line)


class TailSource(DataSource):
    """``format("tail")``: options path (several parted by commas) and startingPosition (end, start)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string, path string, ingest_seq bigint"

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        paths = [p.strip() for p in self.options["path"].split(",")]
        return TailReader(paths, self.options.get("startingposition", self.options.get("startingPosition", "end")) == "start")
