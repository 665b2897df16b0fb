"""Sources that are read by ranges: files that are appended to, answers given a page at a time, tables of a database.

`register(spark)` makes the formats `growing_lines` and `paged_bodies` known. What is read are byte ranges and pages,
each a partition's own work; the driver lists files and makes ranges, and holds no rows.
"""

from __future__ import annotations

import io
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

STEP, BLOCK = 32 << 20, 1 << 16


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(paths: str) -> list[tuple[str, int]]:
    """(path, size) of every file that comma-separated paths name, folders read through, by path."""
    from pyarrow import fs

    found = []
    for given in paths.split(","):
        system, inner = _file_system(given.strip())
        scheme = given.split("://")[0] + "://" if "://" in given else ""
        info = system.get_file_info(inner)
        files = system.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]
        found += [(scheme + ("/" if scheme and not f.path.startswith("/") and scheme == "file://" else "") + f.path, f.size) for f in files if f.type == fs.FileType.File]
    return sorted(found)


def _open(path: str) -> io.BufferedReader:
    system, inner = _file_system(path)
    return system.open_input_file(inner)


def whole_lines(path: str, size: int, known: int) -> int:
    """Where the last whole line of a file ends, read backwards by blocks, no further than `known`, an end of one."""
    with _open(path) as f:
        end = size
        while end > known:
            begin = max(known, end - BLOCK)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return known


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in [start, end); first: the range begins where a line does."""

    path: str
    start: int
    end: int
    first: bool


def ranges(path: str, start: int, end: int, step: int) -> list[Range]:
    return [Range(path, s, min(s + step, end), s == start) for s in range(start, end, step)]


def lines_of(part: Range) -> Iterator[tuple[str, int, str]]:
    """(path, start, line): every line that begins in the range; the last one is read to its end. Bytes that are no
    UTF-8 are replaced."""
    with _open(part.path) as raw:
        raw.seek(part.start if part.first else part.start - 1)
        f = io.BufferedReader(raw, BLOCK)
        at = part.start if part.first else part.start - 1 + len(f.readline())
        while at < part.end:
            line = f.readline()
            if not line:
                return
            yield part.path, at, line.rstrip(b"\n").decode("utf-8", "replace")
            at += len(line)


class _Lines(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.step = options["path"], int(options.get("step", STEP))

    def partitions(self) -> list[Range]:
        return [r for path, size in _listed(self.paths) for r in ranges(path, 0, size, self.step)]

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        yield from lines_of(partition)


class _AppendedLines(DataSourceStreamReader):
    """An offset is the end of the last whole line of each file. A restart goes on from the offset in the checkpoint, so a
    byte is handed on once; a file that is shorter than its offset was replaced and is read from its start."""

    def __init__(self, options: dict[str, str]):
        self.paths, self.step = options["path"], int(options.get("step", STEP))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for path, size in _listed(self.paths):
            known = self.known.get(path, 0)
            found[path] = whole_lines(path, size, known if known <= size else 0)
        self.known = found
        return found

    def partitions(self, start: dict, end: dict) -> list[Range]:
        made = []
        for path, stop in end.items():
            begin = start.get(path, 0)
            made += ranges(path, begin if begin <= stop else 0, stop, self.step)
        return made

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        yield from lines_of(partition)

    def commit(self, end: dict) -> None:
        return None


class GrowingLines(DataSource):
    """Lines of files (path: files or folders, comma-separated) in ranges of `step` bytes. As a
    stream: whole lines that were appended since the last batch. As a batch: all lines, an unfinished last one too."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "path string, start bigint, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Lines(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _AppendedLines(self.options)


@dataclass
class Span(InputPartition):
    """Times from start to end, both included."""

    start: int
    end: int


class _Pages(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options

    def partitions(self) -> list[Span]:
        start, end, n = int(self.o["start"]), int(self.o["end"]), int(self.o.get("spans", 8))
        width = max(1, -(-(end - start + 1) // n))
        return [Span(s, min(s + width - 1, end)) for s in range(start, end + 1, width)]

    def _body(self, query: dict) -> str:
        """One page, asked for again after a failure of the server or the way to it, each time after twice the wait."""
        sent = {k.split(".", 1)[1]: v for k, v in self.o.items() if k.startswith("header.")}
        asked = urllib.request.Request(f"{self.o['url']}?{urllib.parse.urlencode(query)}", headers=sent)
        tries, wait = int(self.o.get("tries", 5)), float(self.o.get("wait", 0.5))
        for left in range(tries - 1, -1, -1):
            try:
                with urllib.request.urlopen(asked, timeout=30) as answer:
                    return answer.read().decode("utf-8")
            except urllib.error.HTTPError as e:
                if (e.code < 500 and e.code != 429) or not left:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if not left:
                    raise
            time.sleep(wait)
            wait *= 2
        raise RuntimeError("no try was left")

    def read(self, partition: Span) -> Iterator[tuple[int, str, str]]:
        own = {k.split(".", 1)[1]: v for k, v in self.o.items() if k.startswith("param.")}
        page: object = 1
        while page is not None:
            body = self._body(own | {"timestamp_start": partition.start, "timestamp_end": partition.end, "limit": self.o.get("limit", "200"), "page": page})
            yield partition.start, str(page), body
            read = json.loads(body)
            read = read if isinstance(read, dict) else {}
            page = (read.get("pagination") or read).get("next_page")


class PagedBodies(DataSource):
    """Bodies of a paged answer: times from `start` to `end` cut into `spans`, each a partition that follows
    `next_page` from page 1. Options: url, limit, tries, wait, `param.*` and `header.*` for what is sent along."""

    @classmethod
    def name(cls) -> str:
        return "paged_bodies"

    def schema(self) -> str:
        return "span bigint, page string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLines)
    spark.dataSource.register(PagedBodies)


def database_rows(spark: SparkSession, url: str, table: str, key: str, parts: int = 8, **options: str) -> DataFrame:
    """Rows of a database's table or parenthesised query, read in `parts` ranges of a whole-number key whose
    ends the database is asked for. An empty table gives no rows; rows without a key are read with the first range."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    named = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    low, high = reader.option("query", f"SELECT min({named}) AS low, max({named}) AS high FROM {table}").load().first()
    whole = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if low is None or low == high:
        return whole.load()
    return whole.option("partitionColumn", key).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", str(parts)).load()
