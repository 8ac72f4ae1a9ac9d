"""Data sources: concatenated JSON objects read by byte ranges, and JSON lines written whole or not at all.

``spark.read.format("concatenated_json").option("rangeBytes", n).load(path)`` gives (file, begin, value): the text of each object of
files that hold objects one after the other with nothing or white space between, and the byte at which it begins.  A file is cut into ranges; an
object belongs to the range that its first byte is in.  A range that begins inside an object, or inside a string of it, has to find the next
object: every ``}`` followed by ``{`` is tried, and the first from which whole objects can be read on to the range's end (or through one object
with members, if that ends later) is taken; from inside a string that fails, as a string holds no bare quote.  Anything else than objects fails.

``df.write.format("json_log").mode("append").save(path)`` appends (value STRING) rows as lines.  Tasks write into a staging folder; the
job's commit moves the files to their place, an abort removes them, so that readers see all lines of a write or none.  Names of a write's files
come from its own id, so a task that runs twice leaves one file.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

RANGE_BYTES = 32 << 20
_PIECE = 1 << 16
_SPACE = b" \t\r\n"
_NEXT = re.compile(rb"\}[ \t\r\n]*(\{)")


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int

    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class _Window:
    """The bytes of a file from ``base`` on, as far as they were needed; as Latin-1 text, where a character is a byte."""

    def __init__(self, file, base: int):
        self.file, self.base, self.data, self.ended = file, base, b"", False
        file.seek(base)

    def more(self) -> bool:
        piece = b"" if self.ended else self.file.read(max(_PIECE, len(self.data) // 2))
        self.ended = self.ended or not piece
        self.data += piece
        return bool(piece)

    def drop(self, at: int) -> int:
        """Forgets what lies before ``at``; gives its new place."""
        self.data, self.base = self.data[at:], self.base + at
        return 0

    def skip_space(self, at: int) -> int:
        while True:
            while at < len(self.data) and self.data[at] in _SPACE:
                at += 1
            if at < len(self.data) or not self.more():
                return at

    def object_at(self, at: int) -> int:
        """The end of the object that begins at ``at``; ValueError if there is none."""
        if self.data[at : at + 1] != b"{":
            raise ValueError(f"no object at byte {self.base + at}")
        decoder, known = json.JSONDecoder(strict=False), None
        while True:
            if known != len(self.data):
                known = len(self.data)
                try:
                    return at + decoder.raw_decode(self.data[at:].decode("latin-1"))[1]
                except json.JSONDecodeError as e:
                    # what is cut off fails near the end of the data, or as a string that never ends
                    if e.pos < known - at - 16 and "Unterminated" not in e.msg:
                        raise
            if not self.more():
                raise ValueError(f"the object at byte {self.base + at} is cut off")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, path = _file_system(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and not re.search(r"(^|/)[_.][^/]*$", f.path)]
        return [Range(f.path, at, min(at + self.size, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        system, _ = _file_system(self.path)
        with system.open_input_file(partition.path) as file:
            window, at = _Window(file, 0), 0
            if partition.begin:
                begun = self._resume(file, partition)
                if begun is None:
                    return
                window = _Window(file, begun)
            at = window.skip_space(at)
            while window.base + at < partition.end and at < len(window.data):
                end = window.object_at(at)
                yield partition.path, window.base + at, window.data[at:end].decode()
                at = window.skip_space(window.drop(end) if end > _PIECE else end)

    def _resume(self, file, partition: Range) -> int | None:
        """The first byte, from the range's begin on, at which an object begins."""
        back = partition.begin  # the brace that closes the object before may stand before the range
        while back:
            back -= 1
            file.seek(back)
            if file.read(1) not in (b" ", b"\t", b"\r", b"\n"):
                break
        window, at = _Window(file, back), 0
        while True:
            found = _NEXT.search(window.data, at)
            if found is None:
                last = window.data.rfind(b"}")
                at = max(at, last if last >= 0 else len(window.data))
                if window.base + len(window.data) > partition.end and not re.fullmatch(rb"\}[ \t\r\n]*", window.data[at:]) or not window.more():
                    return None  # no object begins here
                continue
            begin = found.start(1)
            if window.base + begin >= partition.end:
                return None
            if window.base + begin >= partition.begin and self._goes_on(window, begin, partition.end):
                return window.base + begin
            at = found.start() + 1

    def _goes_on(self, window: _Window, at: int, end: int) -> bool:
        """Whether whole objects follow one another from ``at`` to the range's end at least, and through one that has members."""
        members = False
        try:
            while True:
                to = window.object_at(at)
                members = members or b'"' in window.data[at:to]
                at = window.skip_space(to)
                if at >= len(window.data) or members and window.base + at >= end:
                    return True
        except ValueError:
            return False


class ConcatenatedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "concatenated_json"

    def schema(self) -> str:
        return "file string, begin bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


@dataclass
class _Written(WriterCommitMessage):
    name: str
    lines: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.id = options["path"], overwrite, uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/_staging-{self.id}"

    def write(self, iterator: Iterator) -> _Written:
        from pyspark import TaskContext

        system, root = _file_system(self.path)
        context = TaskContext.get()
        system.create_dir(self._staging(root), recursive=True)
        name, lines = f"part-{context.partitionId():05d}-{self.id}.jsonl", 0
        # each attempt has a file of its own; the commit takes that of the attempt that counts
        attempt = f"{name}.{context.taskAttemptId()}"
        with system.open_output_stream(f"{self._staging(root)}/{attempt}") as out:
            for row in iterator:
                text = row[0]
                if text is None or "\n" in text:
                    raise ValueError("a line is text without line ends")
                out.write(text.encode() + b"\n")
                lines += 1
        return _Written(attempt, lines)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, root = _file_system(self.path)
        old = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File] if self.overwrite else []
        for m in messages:
            if m is not None and m.lines:
                system.move(f"{self._staging(root)}/{m.name}", f"{root}/{m.name.rpartition('.')[0]}")
        for path in old:
            system.delete_file(path)
        self._clear(system, root)

    def abort(self, messages: list) -> None:
        self._clear(*_file_system(self.path))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(self._staging(root)).type == fs.FileType.Directory:
            system.delete_dir(self._staging(root))


class JsonLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_log"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session."""
    for source in (ConcatenatedJson, JsonLog):
        spark.dataSource.register(source)
