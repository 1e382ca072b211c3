"""A data source for logs that grow: the lines of a folder's files, in a batch or as a stream that goes on at a byte.

`spark.read.format("growing_logs").load(folder)` and `spark.readStream.format("growing_logs").load(folder)` give line, at and
file. `at` is the byte at which the line begins, so (file, at) tells lines apart and orders those of a file; Runs numbers
them. The stream's progress is the byte that each file was read to, cut after the last newline that is there; a line without its
newline waits. The driver looks at names, sizes and the tail of files that grew, tasks read ranges of bytes. A file that gets
shorter is an error, as lines would be lost; one that is gone is done with. The folder is a path or an address that pyarrow's file systems know; files whose names begin
with a dot or an underscore are left out. Options: `glob` (names, "*" if not given) and `rangeBytes` (of a task, 64 MB).
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "growing_logs"
_TAIL = 1 << 16


class Piece(InputPartition):
    """Lines of a file that begin in first..end; `end` cuts the file there."""

    def __init__(self, file: str, first: int, last: int, end: int):
        self.file, self.first, self.last, self.end = file, first, last, end


class _Folder:
    def __init__(self, options: dict[str, str]):
        self.folder, self.glob = options["path"].rstrip("/"), options.get("glob", "*")
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", 64 << 20)))

    def open(self):
        from pyarrow import fs

        if "://" not in self.folder and not self.folder.startswith("file:"):
            return fs.LocalFileSystem(), self.folder
        return fs.FileSystem.from_uri(self.folder)

    def sizes(self) -> dict[str, int]:
        """Names and sizes of the files, by name."""
        from pyarrow import fs

        system, base = self.open()
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        names = {f.base_name: f.size for f in found if f.is_file and not f.base_name.startswith((".", "_")) and fnmatch.fnmatch(f.base_name, self.glob)}
        return dict(sorted(names.items()))

    def whole(self, name: str, known: int, size: int) -> int:
        """The byte after the last newline of a file, at least `known`."""
        system, base = self.open()
        with system.open_input_file(f"{base}/{name}") as file:
            end = size
            while end > known:
                begin = max(known, end - _TAIL)
                file.seek(begin)
                at = file.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return known

    def pieces(self, first: dict[str, int], end: dict[str, int]) -> list[Piece]:
        step = self.range_bytes
        return [Piece(name, lo, min(lo + step, e), e) for name, e in end.items() for lo in range(first.get(name, 0), e, step)]

    def lines(self, piece: Piece) -> Iterator[tuple[str, int, str]]:
        """A line belongs to the piece in which it begins; what the piece before began is passed over."""
        system, base = self.open()
        with system.open_input_file(f"{base}/{piece.file}") as file:
            at = piece.first
            if at:  # from the byte before, so that a line that begins here is seen to
                file.seek(at - 1)
                at += len(self._line(file, at - 1, piece.end)) - 1
            file.seek(at)
            while at < piece.last:
                line = self._line(file, at, piece.end)
                yield line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace"), at, piece.file
                at += len(line)
                file.seek(at)

    @staticmethod
    def _line(file, at: int, end: int) -> bytes:
        """From `at` to the newline, with it, or to the end."""
        parts = []
        while at < end:
            data = file.read(min(_TAIL, end - at))
            cut = data.find(b"\n")
            if cut >= 0:
                return b"".join([*parts, data[: cut + 1]])
            parts.append(data)
            at += len(data)
        return b"".join(parts)


class _Batch(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self) -> list[Piece]:
        return self.folder.pieces({}, self.folder.sizes())

    def read(self, partition: Piece) -> Iterator[tuple]:
        return self.folder.lines(partition) if partition is not None else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: _Folder):
        self.folder, self.known = folder, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        sizes = self.folder.sizes()
        self.known = {name: self.folder.whole(name, self.known.get(name, 0), size) for name, size in sizes.items()}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        short = [name for name, first in start.items() if end.get(name, first) < first]
        if short:
            raise ValueError(f"files that were read have become shorter: {short}")
        return self.folder.pieces(start, end)

    def read(self, partition: Piece) -> Iterator[tuple]:
        return self.folder.lines(partition)


class GrowingLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "line string, at bigint, file string"

    def reader(self, schema) -> _Batch:
        return _Batch(_Folder(self.options))

    def streamReader(self, schema) -> _Stream:  # noqa: N802
        return _Stream(_Folder(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLogs)
