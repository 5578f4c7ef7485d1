"""A stream source that follows growing line files, which the file source doesn't.

Offsets are bytes by file, always behind a line's end. The driver only looks at sizes and for the last
line's end; the bytes are read by tasks, each a range of a file, which gives the lines that begin in it.
A file that got shorter is read from its start again. The folder must be one that all executors see.
Register with ``spark.dataSource.register(TailSource)`` and read with
``format("tail").option("path", folder)``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that a task reads, and in which the end of the last line is looked for.
RANGE_BYTES, STEP_BYTES = 32 << 20, 64 << 10


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in [start, end); ``first``: where the file's new part begins."""

    file: str
    start: int
    end: int
    first: int


def last_line_end(file: str, start: int, size: int) -> int:
    """The place behind the last line feed of a file's bytes from ``start``; ``start`` if there is none."""
    at = size
    with open(file, "rb") as f:
        while at > start:
            low = max(start, at - STEP_BYTES)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return start


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, from_end: bool, suffix: str, range_bytes: int):
        self.folder, self.from_end, self.suffix, self.range_bytes = folder, from_end, suffix, range_bytes
        self.known: dict[str, int] = {}

    def _sizes(self) -> dict[str, int]:
        with os.scandir(self.folder) as found:
            return {f.path: f.stat().st_size for f in sorted(found, key=lambda f: f.path) if f.name.endswith(self.suffix)}

    def initialOffset(self) -> dict:
        """Files that are there at the start are read from their start, or their end if so asked."""
        return {"files": json.dumps({f: last_line_end(f, 0, n) if self.from_end else 0 for f, n in self._sizes().items()})}

    def latestOffset(self) -> dict:
        for f, n in self._sizes().items():
            before = self.known.get(f, 0)
            self.known[f] = last_line_end(f, before if before <= n else 0, n)
        return {"files": json.dumps(self.known)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, out = json.loads(start["files"]), []
        for f, stop in json.loads(end["files"]).items():
            first = before.get(f, 0)
            first = first if first <= stop else 0  # the file was cut
            out += [Range(f, s, min(s + self.range_bytes, stop), first) for s in range(first, stop, self.range_bytes)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        with open(part.file, "rb") as lines:
            offset = part.start
            if part.start > part.first:  # a line that begins before the range is another task's
                lines.seek(part.start - 1)
                offset = part.start - 1 + len(lines.readline())
            lines.seek(offset)
            while offset < part.end:
                line = lines.readline()
                if not line:
                    break
                yield part.file, offset, line.decode(errors="replace").rstrip("\r\n")
                offset += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, offset bigint, line string"

    def streamReader(self, schema) -> TailReader:
        o = self.options
        return TailReader(o["path"], o.get("fromend", "false") == "true", o.get("suffix", ".jsonl"), int(o.get("rangebytes", RANGE_BYTES)))
