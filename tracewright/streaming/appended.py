"""Lines of files that grow, as a stream: an unfinished line waits for the batch in which its end has come.

The offset of a batch says for each file up to which byte its whole lines are read. What has no line end yet isn't part
of it. Ranges of bytes are read by tasks, in pieces of at most `piece_bytes`, each from its first whole line on.

Files are reached through Arrow's file systems (local, HDFS, S3, GCS by the path's scheme). A file that has become
shorter than what was read of it is read anew from its start; one that is gone is left out. Lines end in a line feed; a
carriage return before it goes too. Bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

TAIL = 1 << 20


class Piece(InputPartition):
    def __init__(self, path: str, first: int, start: int, end: int):
        self.path, self.first, self.start, self.end = path, first, start, end


def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def last_line_end(system, path: str, size: int, least: int) -> int:
    """The place after the last line feed from `least` on; `least` if there is none."""
    with system.open_input_file(path) as file:
        end = size
        while end > least:
            start = max(least, end - TAIL)
            at = file.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return least


class Lines(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str, piece_bytes: int):
        self.path, self.suffix, self.piece_bytes = path, suffix, piece_bytes
        self.told: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, root = opened(self.path)
        found = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.type == fs.FileType.File and info.path.endswith(self.suffix) and not info.base_name.startswith(("_", ".")):
                before = self.told.get(info.path, 0)
                found[info.path] = last_line_end(system, info.path, info.size, before if info.size >= before else 0)
        self.told = found
        return {"files": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before, out = json.loads(start["files"]), []
        for path, upto in sorted(json.loads(end["files"]).items()):
            first = before.get(path, 0)
            first = first if upto >= first else 0
            out += [Piece(path, first, at, min(at + self.piece_bytes, upto)) for at in range(first, upto, self.piece_bytes)]
        return out or [Piece("", 0, 0, 0)]

    def read(self, piece: Piece) -> Iterator[tuple]:
        if not piece.path:
            return
        system, _ = opened(self.path)
        with io.BufferedReader(system.open_input_file(piece.path), TAIL) as file:
            at = piece.start
            if at > piece.first:  # the line that runs into this piece belongs to the one before
                file.seek(at - 1)
                at += len(file.readline()) - 1
            else:
                file.seek(at)
            while at < piece.end:
                line = file.readline()
                if not line.endswith(b"\n"):
                    return
                yield piece.path, at, line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
                at += len(line)


class AppendedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "path string, start long, value string"

    def streamReader(self, schema) -> Lines:
        return Lines(self.options["path"], self.options.get("suffix", ""), int(self.options.get("piece_bytes", 64 << 20)))


def lines(spark: SparkSession, path: str, *, suffix: str = "", piece_bytes: int = 64 << 20) -> DataFrame:
    """path, start (the line's place in bytes), value of each whole line below a folder, as they come."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").option("path", path).option("suffix", suffix).option("piece_bytes", piece_bytes).load()
