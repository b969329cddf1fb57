"""Session files read on from where the last reading ended.

A streaming source of lines over files that grow. Its offset names every file with what was
read of it: (size, modification time, byte, check of its beginning) and a generation. A file
that has grown gives its new whole lines; one that is shorter than what was read, or begins
otherwise, is read anew, and a higher generation reads all files anew. A last line without its
end waits for it. Long stretches are cut for several tasks, so a large file is no single one.

Register with ``spark.dataSource.register(SessionLines)``, then
``spark.readStream.format("session-lines").load(folder)``; the checkpoint of the query keeps
the cursors. Files are opened by path, so the folder is one that the driver and all executors
mount.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, generation int, pos long, value string"
HEAD_BYTES = 256
PART_BYTES = 32 << 20


@dataclass
class Stretch(InputPartition):
    """The lines of a file that begin at ``start`` or later and before ``end``; ``first`` is where the reading begins."""

    path: str
    generation: int
    first: int
    start: int
    end: int
    stop: int


def local_path(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def files_under(path: str, pattern: str) -> Iterator[str]:
    """Files whose name fits the pattern; hidden ones and those of a writer at work are none."""
    root = local_path(path)
    if os.path.isfile(root):
        yield root
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if not f.startswith((".", "_")))
        yield from (os.path.join(folder, n) for n in sorted(names) if not n.startswith((".", "_")) and fnmatch(n, pattern))


def whole_lines(path: str, size: int) -> int:
    """Where the last whole line within ``size`` ends."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            begin = max(0, at - 65_536)
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return 0


def head_check(path: str, upto: int) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read(min(HEAD_BYTES, upto)))


def cursor_of(path: str, before: list | None = None) -> list | None:
    """[size, mtime, byte, head] of a file now; the cursor before if it has not changed, None if the file is gone."""
    try:
        stat = os.stat(path)
        if before and [stat.st_size, stat.st_mtime_ns] == before[:2]:
            return before
        byte = whole_lines(path, stat.st_size)
        return [stat.st_size, stat.st_mtime_ns, byte, head_check(path, byte)]
    except FileNotFoundError:
        return None


def new_stretches(start: dict, end: dict, part_bytes: int = PART_BYTES) -> list[Stretch]:
    """What two offsets differ by, cut into stretches of bounded size.

    A file goes on from its byte if it still begins as it did when that was reached, else from its start.
    """
    out = []
    for path, (_, _, byte, _) in sorted(end["files"].items()):
        before = start["files"].get(path) if start["generation"] == end["generation"] else None
        grown = before and before[2] <= byte and (before == end["files"][path] or head_check(path, before[2]) == before[3])
        first = before[2] if grown else 0
        for at in range(first, byte, part_bytes):
            out.append(Stretch(path, end["generation"], first, at, min(at + part_bytes, byte), byte))
    return out


def read_stretch(part: Stretch) -> Iterator[tuple[str, int, int, str]]:
    """(path, generation, pos, value): a stretch that does not begin a line leaves it to the one before."""
    with open(part.path, "rb") as f:
        at = part.start
        if at > part.first:
            f.seek(at - 1)
            at += len(f.readline()) - 1
        else:
            f.seek(at)
        while at < part.end:
            line = f.readline(part.stop - at)
            if not line:
                break
            text = line.rstrip(b"\r\n").decode("utf-8", "replace")
            if text.strip():
                yield part.path, part.generation, at, text
            at += len(line)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str, generation: int, part_bytes: int) -> None:
        self.path, self.pattern, self.generation, self.part_bytes = path, pattern, generation, part_bytes
        self.known: dict[str, list] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"generation": self.generation, "files": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        cursors = {path: cursor_of(path, self.known.get(path)) for path in files_under(self.path, self.pattern)}
        self.known = {path: c for path, c in cursors.items() if c}
        return {"generation": self.generation, "files": self.known}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return new_stretches(start, end, self.part_bytes)

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return read_stretch(partition)

    def commit(self, end: dict) -> None:
        pass


class _Batch(DataSourceReader):
    def __init__(self, path: str, pattern: str, generation: int, part_bytes: int) -> None:
        self.stream = _Stream(path, pattern, generation, part_bytes)

    def partitions(self) -> list[Stretch]:
        return new_stretches(self.stream.initialOffset(), self.stream.latestOffset(), self.stream.part_bytes) or [Stretch("", 0, 0, 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return read_stretch(partition) if partition.path else iter(())


class SessionLines(DataSource):
    """Lines of growing files. Options: ``pattern`` of the names, ``generation``, ``partBytes``."""

    @classmethod
    def name(cls) -> str:
        return "session-lines"

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[str, str, int, int]:
        return self.options["path"], self.options.get("pattern", "*"), int(self.options.get("generation", 1)), int(self.options.get("partBytes", PART_BYTES))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._given())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(*self._given())


Collector = Callable[[DataFrame], DataFrame]
_COLLECTORS: dict[str, Collector] = {}


def register_collector(name: str, collector: Collector) -> None:
    """Adds a reader of lines (path, generation, pos, value) to rows of any kind; a name is given once."""
    if _COLLECTORS.setdefault(name, collector) is not collector:
        raise ValueError(f"there is a collector {name} already")


def collect(spark: SparkSession, name: str, folder: str, out: str, checkpoint: str, **options: str) -> None:
    """Reads on what came to ``folder`` since the last call with this checkpoint, and appends the collector's rows to ``out``.

    A call that is cut off is taken up by the next one: rows are written once.
    """
    spark.dataSource.register(SessionLines)
    lines = spark.readStream.format("session-lines").options(**options).load(folder)
    rows = _COLLECTORS[name](lines)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def json_collector(fields: str) -> Collector:
    """A collector of JSON lines with the given fields; ``ok`` is false where a line is none."""
    return lambda lines: lines.select("path", "generation", "pos", F.from_json("value", fields).alias("row"), F.coalesce(F.try_parse_json("value").isNotNull(), F.lit(False)).alias("ok")).select("path", "generation", "pos", "row.*", "ok")
