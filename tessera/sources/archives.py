"""Python data sources: lines of files in zip archives, and a stream of what is new in feeds.

Paths are any that pyarrow's file systems open, so tasks read them without the driver's disk.
"""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from tessera.sources.feeds import Markup

#: Bytes of a task: small archives are read together, and so are small members of large ones; large members in ranges of so many.
RANGE = 64 << 20
#: Bytes of lines in a batch.
BATCH = 4 << 20
DAMAGED = (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, RuntimeError, OSError, ValueError, pa.ArrowException)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder whose names end so, by path."""
    store, base = opened(path)
    found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix))


class Part(InputPartition):
    """Whole archives, or members of one, from the first to before the last by their places; of a single one, lines that begin in a range of its bytes."""

    def __init__(self, archives: list[str], first: int = 0, last: int | None = None, start: int = 0, end: int | None = None):
        self.archives, self.first, self.last, self.start, self.end = archives, first, last, start, end


class ArchiveLines(DataSource):
    """format("archive_lines"): (archive, member, at, text), the lines of members of the zip archives in a folder.

    Options: path; member, the ending of the names of members that are read (default: .txt); range, the bytes of a task. `at` is
    where a line begins in its member. Archives and members that cannot be read give nothing, or what comes before the damage, whatever the range; lines
    are UTF-8 with damage replaced, without their line ends; empty lines come, too.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return "archive string, member string, at long, text string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix, self.range = options["path"], options.get("member", ".txt"), int(options.get("range", RANGE))

    def partitions(self) -> list[Part]:
        out, together, size = [], [], 0
        for archive, n in listed(self.path, ".zip"):
            if n > self.range:
                out += self._ranges(archive)
                continue
            if together and size + n > self.range:
                out.append(Part(together))
                together, size = [], 0
            together.append(archive)
            size += n
        return out + ([Part(together)] if together or not out else [])  # one at least, which may be empty

    def _ranges(self, archive: str) -> list[Part]:
        try:
            with opened(self.path)[0].open_input_file(archive) as file, zipfile.ZipFile(file) as zipped:
                sizes = [m.file_size for m in self._members(zipped)]
        except DAMAGED:
            return []
        out, first, together = [], 0, 0
        for k, n in enumerate(sizes):
            if together + n > self.range and first < k:
                out.append(Part([archive], first, k))
                first, together = k, 0
            if n > self.range:
                out += [Part([archive], k, k + 1, at, min(n, at + self.range)) for at in range(0, n, self.range)]
                first = k + 1
            else:
                together += n
        return out + ([Part([archive], first, len(sizes))] if first < len(sizes) else [])

    def _members(self, zipped: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
        return [m for m in zipped.infolist() if m.filename.endswith(self.suffix)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for archive in partition.archives:
            for row in self._lines(archive, partition):
                rows.append(row)
                size += len(row[3])
                if size >= BATCH:
                    yield _batch(rows)
                    rows, size = [], 0
        yield _batch(rows)

    def _lines(self, archive: str, part: Part) -> Iterator[tuple]:
        try:
            with opened(self.path)[0].open_input_file(archive) as file, zipfile.ZipFile(file) as zipped:
                for info in self._members(zipped)[part.first : part.last]:
                    yield from self._member(archive, zipped, info, part)
        except DAMAGED:
            return

    def _member(self, archive: str, zipped: zipfile.ZipFile, info: zipfile.ZipInfo, part: Part) -> Iterator[tuple]:
        try:
            with zipped.open(info) as member:
                at = _skip(member, part.start)
                while part.end is None or at < part.end:
                    line = member.readline()
                    if not line:
                        break
                    yield archive, info.filename, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                    at += len(line)
        except DAMAGED:
            return


def _skip(member: io.BufferedIOBase, start: int) -> int:
    """Reads up to the first line that begins at start or after it, and says where that is."""
    at = 0
    while at < start - 1:
        got = len(member.read(min(1 << 20, start - 1 - at)))
        if not got:
            return at
        at += got
    return at + len(member.readline()) if start else 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["archive", "member", "at", "text"])


class FeedStream(DataSource):
    """format("feed_files"): (feed, guid, item), the items that are new in the feeds of a folder, as a stream.

    A feed is a file that is replaced when it changes. What was seen of one are the guids it listed last; an item comes
    once as long as its feed goes on to list it. Options: path, and most, the items of a micro-batch at most, feeds being taken whole.
    That reads in the driver, and a run over what is there, which is one micro-batch, leaves what is over `most` to the next.

    Given changed=true, all items come of every feed that was replaced, a task a feed and in one micro-batch, however many;
    which were seen is then left to the stream, as by dropDuplicates on feed and guid.
    """

    @classmethod
    def name(cls) -> str:
        return "feed_files"

    def schema(self) -> str:
        return "feed string, guid string, item string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        if self.options.get("changed", "false").lower() != "true":
            return super().streamReader(schema)  # which makes Spark ask for the simple one
        return ChangedFeeds(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FeedReader(self.options)


def items_of(data: bytes) -> list[tuple[str, str]]:
    """(guid, item) of a feed, in its order; the first of those that share a guid."""
    channel, out = Markup(data).channel(), {}
    inner, end = channel.element(b"item")
    while inner is not None:
        item = Markup(inner)
        guid = (item.element(b"guid")[0] or item.attribute(b"enclosure", b"url") or item.element(b"link")[0] or b"").decode("utf-8", "replace").strip()
        if guid:
            out.setdefault(guid, inner.decode("utf-8", "replace"))
        inner, end = channel.element(b"item", end)
    return list(out.items())


class FeedReader(SimpleDataSourceStreamReader):
    """Offsets are {"feed": guids seen}; they are what a stream that starts again goes by."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("most", 100_000))

    def initialOffset(self) -> dict:
        return {"seen": "{}"}

    def _feeds(self) -> Iterator[tuple[str, list[tuple[str, str]]]]:
        store, _ = opened(self.path)
        for file, _ in listed(self.path, ".xml"):
            with store.open_input_file(file) as f:
                yield file, items_of(f.read())

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        seen, rows = json.loads(start["seen"]), []
        for feed, items in self._feeds():
            known = set(seen.get(feed, ()))
            new = [(feed, guid, item) for guid, item in items if guid not in known]
            if rows and len(rows) + len(new) > self.most:
                break
            rows += new
            seen[feed] = [g for g, _ in items]
        return iter(rows), {"seen": json.dumps(seen, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        before, after = json.loads(start["seen"]), json.loads(end["seen"])
        for feed, items in self._feeds():
            known, wanted = set(before.get(feed, ())), set(after.get(feed, ()))
            yield from ((feed, guid, item) for guid, item in items if guid in wanted and guid not in known)


class Feed(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ChangedFeeds(DataSourceStreamReader):
    """Offsets are {"feed": size and time}, so what passes the driver are a few numbers a feed."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"feeds": "{}"}

    def latestOffset(self) -> dict:
        store, base = opened(self.path)
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        return {"feeds": json.dumps({f.path: [f.size, f.mtime_ns] for f in found if f.type == fs.FileType.File and f.path.endswith(".xml")}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Feed]:
        before, after = json.loads(start["feeds"]), json.loads(end["feeds"])
        return [Feed(path) for path, stamp in after.items() if before.get(path) != stamp]

    def read(self, partition: Feed) -> Iterator[tuple]:
        with opened(self.path)[0].open_input_file(partition.path) as f:
            data = f.read()
        return ((partition.path, guid, item) for guid, item in items_of(data))


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(ArchiveLines)
    spark.dataSource.register(FeedStream)
