"""Raw lines of log files, at rest or as they come."""

from __future__ import annotations

import glob
import hashlib
import json
import os
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from emberlog.sources.packs import Pack

SCHEMA = "content string, file_path string"


def clean(lines: DataFrame) -> DataFrame:
    """Without white space at the end, and without empty lines."""
    return lines.withColumn("content", F.regexp_replace("content", r"\s+$", "")).where("content != ''")


def read(spark: SparkSession, paths: list[str], pack: str, source: str, *, stream: bool = False, files_per_batch: int = 1000) -> DataFrame:
    """content, file_path, pack, source of text files (globs, compressed ones too). A stream takes each new file whole."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if stream else spark.read
    found = reduce(DataFrame.unionByName, [reader.text(p) for p in paths]) if stream else reader.text(paths)
    return clean(found.select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("file_path"))).select("content", "file_path", F.lit(pack).alias("pack"), F.lit(source).alias("source"))


def read_packs(spark: SparkSession, packs: dict[str, Pack], root: str, *, stream: bool = False) -> DataFrame:
    """The lines of all sources, of copies of their files under root."""
    of = lambda p, s: read(spark, [f"{root.rstrip('/')}{path}" for path in s.paths], p.name, s.name, stream=stream)
    return reduce(DataFrame.unionByName, [of(p, s) for p in packs.values() for s in p.sources])


class GrowingFiles(DataSource):
    """Lines that are appended to files: spark.readStream.format("growing_files").option("path", glob).load().

    The offset is each file's inode and the bytes up to its last whole line, so a line without an end waits,
    a file that was replaced or cut starts anew, and new files are found in each batch. New bytes are dealt into
    stretches of STRETCH, so a long backlog is many tasks. The column offset is where a line begins. spark.read gives
    what the files hold now. Driver and executors have to see the files by the same path.

    The option max_bytes bounds a batch: what it lets in is shared out among the files, small rests first, in whole
    lines (one at least of a file). What was let in is remembered; over a restart in the file that the option progress
    names, without which the first batch after a restart takes all that is there.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return f"{SCHEMA}, offset long"

    def reader(self, schema) -> _GrownReader:
        return _GrownReader(self.options["path"])

    def streamReader(self, schema) -> _GrowingReader:  # noqa: N802
        return _GrowingReader(self.options["path"], int(self.options.get("max_bytes", 0)), self.options.get("progress"))


#: Bytes of a file that one task reads.
STRETCH = 32 << 20


class _Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: bool):
        self.path, self.start, self.end, self.first = path, start, end, first


def _whole_lines(pattern: str, known: dict[str, tuple] | None = None) -> dict[str, list[int]]:
    """Inode and bytes up to the last line end of the files that fit; files that go meanwhile are left out.

    known remembers what was found, so that only files that changed since are opened.
    """
    found, known = {}, {} if known is None else known
    for path in sorted(glob.glob(pattern)):
        try:
            if os.path.isfile(path):
                s = os.stat(path)
                if known.get(path, (None,))[0] != (s.st_ino, s.st_size, s.st_mtime_ns):
                    known[path] = (s.st_ino, s.st_size, s.st_mtime_ns), _last_line_end(path)
                found[path] = [s.st_ino, known[path][1]]
        except FileNotFoundError:
            continue
    return found


def _stretches(path: str, start: int, end: int) -> list[_Stretch]:
    return [_Stretch(path, at, min(at + STRETCH, end), at == start) for at in range(start, end, STRETCH)]


def _lines_of(s: _Stretch) -> Iterator[tuple[str, str, int]]:
    """The lines that begin in a stretch; only the first stretch begins at a line for certain."""
    with open(s.path, "rb") as f:
        f.seek(s.start if s.first else s.start - 1)
        if not s.first:
            f.readline()
        while (at := f.tell()) < s.end and (line := f.readline()):
            text = line.decode("utf-8", "replace").rstrip()
            if text:
                yield text, s.path, at


class _GrownReader(DataSourceReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def partitions(self) -> list[_Stretch]:
        return [s for path, (_, size) in _whole_lines(self.pattern).items() for s in _stretches(path, 0, size)]

    def read(self, partition: _Stretch) -> Iterator[tuple[str, str, int]]:
        return _lines_of(partition)


class _GrowingReader(DataSourceStreamReader):
    def __init__(self, pattern: str, max_bytes: int = 0, progress: str | None = None):
        self.pattern, self.max_bytes, self.progress, self.known = pattern, max_bytes, progress, {}
        #: What batches have been given so far; None while that isn't known.
        self.given: dict[str, list[int]] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        self.given = {}
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.given is None and self.progress:
            self.given = {}
            if os.path.exists(self.progress):
                with open(self.progress) as f:
                    self.given = json.load(f)
        there = _whole_lines(self.pattern, self.known)
        self.given = there if self.given is None or not self.max_bytes else self._let_in(there)
        return {"files": json.dumps(self.given)}

    def _let_in(self, there: dict[str, list[int]]) -> dict[str, list[int]]:
        rests, out, left = [], {}, self.max_bytes
        for path, (inode, size) in there.items():
            at = _start(self.given.get(path), inode, size)
            out[path] = [inode, at]
            if size > at:
                rests.append((size - at, path))
        for i, (rest, path) in enumerate(sorted(rests)):
            share, (inode, at) = left // (len(rests) - i), out[path]
            if rest <= share:
                out[path], left = [inode, at + rest], left - rest
            elif left > 0:
                end = _line_end_near(path, at, at + max(1, share), at + rest)
                out[path], left = [inode, end], left - (end - at)
        return out

    def partitions(self, start: dict, end: dict) -> list[_Stretch]:
        before, after, out = json.loads(start["files"]), json.loads(end["files"]), []
        if self.given is None:
            self.given = after
        if self.progress:
            os.makedirs(os.path.dirname(self.progress) or ".", exist_ok=True)
            with open(f"{self.progress}.new", "w") as f:
                json.dump(after, f)
            os.replace(f"{self.progress}.new", self.progress)
        for path, (inode, size) in after.items():
            out += _stretches(path, _start(before.get(path), inode, size), size)
        return out

    def read(self, partition: _Stretch) -> Iterator[tuple[str, str, int]]:
        return _lines_of(partition)


def _start(seen: list[int] | None, inode: int, size: int) -> int:
    """Up to where a file has been read: not at all if it was replaced or cut."""
    return seen[1] if seen and seen[0] == inode and seen[1] <= size else 0


def _line_end_near(path: str, start: int, at: int, end: int, step: int = 1 << 16) -> int:
    """The last line end from start up to at; if there is none, the first one behind it, up to end."""
    with open(path, "rb") as f:
        low = at
        while low > start:
            begin = max(start, low - step)
            f.seek(begin)
            if (k := f.read(low - begin).rfind(b"\n")) >= 0:
                return begin + k + 1
            low = begin
        while at < end:
            f.seek(at)
            if (k := f.read(min(step, end - at)).find(b"\n")) >= 0:
                return at + k + 1
            at += step
    return end


def _last_line_end(path: str, step: int = 1 << 16) -> int:
    """Bytes up to the last line end."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at:
            start = max(0, at - step)
            f.seek(start)
            k = f.read(at - start).rfind(b"\n")
            if k >= 0:
                return start + k + 1
            at = start
    return 0


def grow(spark: SparkSession, pattern: str, pack: str, source: str, *, stream: bool = True, max_bytes: int = 0, progress: str | None = None) -> DataFrame:
    """The lines of files with where they begin: a stream of what is appended to them, or what they hold now."""
    spark.dataSource.register(GrowingFiles)
    reader = (spark.readStream if stream else spark.read).format("growing_files").option("path", pattern)
    if max_bytes:
        reader = reader.option("max_bytes", max_bytes)
    lines = (reader.option("progress", progress) if progress else reader).load()
    return lines.select("content", "file_path", "offset", F.lit(pack).alias("pack"), F.lit(source).alias("source"))


def grow_packs(spark: SparkSession, packs: dict[str, Pack], root: str = "", *, stream: bool = True, max_bytes: int = 0, progress: str | None = None) -> DataFrame:
    """The lines of the files of all sources of packs, under root. progress: a folder; max_bytes is shared out among the paths."""
    found = [(p.name, s.name, f"{root.rstrip('/')}{path}") for p in packs.values() for s in p.sources for path in s.paths if path.startswith("/")]
    of = lambda pack, source, path: f"{progress}/{hashlib.md5(f'{pack}/{source}/{path}'.encode()).hexdigest()}.json" if progress else None
    return reduce(DataFrame.unionByName, [grow(spark, path, pack, source, stream=stream, max_bytes=-(-max_bytes // len(found)), progress=of(pack, source, path)) for pack, source, path in found])
