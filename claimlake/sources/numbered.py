"""Lines of text files with their numbers, read in byte ranges.

A line belongs to the range in which it begins.  A first pass counts the lines of each range, the driver adds up these counts (one number
for each range), and the second pass numbers each range's lines from there; so a file of any size is read by many tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_READ = 1 << 20  # bytes read at a time
_ROWS = 4096


@dataclass
class Range(InputPartition):
    """Bytes from ``start`` up to ``stop`` of a file, and the number of lines before them."""

    file: str
    start: int
    stop: int
    before: int = 0


class NumberedLines(DataSource):
    """``file, line, value`` of each line (``value`` without its end), or ``file, start, lines`` of each range with the option ``count``."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "file string, start bigint, lines bigint" if "count" in self.options else "file string, line bigint, value string"

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)


def _files(path: str) -> list[tuple[str, int]]:
    """Files and their sizes: of a file, or of all in a folder but hidden ones."""
    system, inner = fs.FileSystem.from_uri(path)
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner))
    head = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
    return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.count = "count" in options
        self.before = {(f, start): n for f, start, n in json.loads(options.get("before", "[]"))}
        self.paths, self.each = json.loads(options["paths"]), int(options["rangebytes"])

    def partitions(self) -> list[Range]:
        return [Range(f, a, min(size, a + self.each), self.before.get((f, a), 0)) for path in self.paths for f, size in _files(path) for a in range(0, size, self.each)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if self.count:
            yield pa.RecordBatch.from_arrays([pa.array([part.file]), pa.array([part.start]), pa.array([sum(1 for _ in _lines(part))])], names=["file", "start", "lines"])
            return
        held: list[str] = []
        number = part.before
        for line in _lines(part):
            held.append(line.decode("utf-8", "replace"))
            if len(held) == _ROWS:
                yield _batch(part.file, number, held)
                number, held = number + len(held), []
        if held:
            yield _batch(part.file, number, held)


def _batch(file: str, before: int, values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(values)), pa.array(range(before + 1, before + len(values) + 1), pa.int64()), pa.array(values, pa.string())], names=["file", "line", "value"])


def _lines(part: Range) -> Iterator[bytes]:
    """The lines that begin in a range, without line ends (LF or CRLF)."""
    system, inner = fs.FileSystem.from_uri(part.file)
    with system.open_input_file(inner) as source:
        at = max(0, part.start - 1)  # a line begins here if the byte before ends one
        source.seek(at)
        rest, begin, skip = b"", part.start, part.start > 0
        while begin < part.stop:
            data = source.read(_READ)
            pieces = (rest + data).split(b"\n")
            rest = pieces.pop()
            if skip and pieces:
                begin, skip = at + len(pieces.pop(0)) + 1, False
            for line in pieces:
                if begin >= part.stop:
                    return
                yield line.removesuffix(b"\r")
                begin += len(line) + 1
            if not data:
                if rest and not skip and begin < part.stop:
                    yield rest.removesuffix(b"\r")
                return


def read_numbered(spark: SparkSession, paths: list[str], range_bytes: int = 64 << 20) -> DataFrame:
    """``file, line, value`` of all lines of these files or folders; lines count from 1."""
    spark.dataSource.register(NumberedLines)
    named = json.dumps([p if "://" in p else f"file://{p}" for p in paths])
    source = lambda: spark.read.format("numbered_lines").option("paths", named).option("rangebytes", range_bytes)
    before, known = [], {}
    for r in source().option("count", "1").load().orderBy("file", "start").collect():  # a row for each range
        before.append((r.file, r.start, known.get(r.file, 0)))
        known[r.file] = known.get(r.file, 0) + r.lines
    return source().option("before", json.dumps(before)).load()


def parsed(lines: DataFrame, schema: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """``file, line, value, record, error`` of the lines that are not blank, as JSON objects of ``schema``.

    ``mapping`` names the field of the source for columns of ``schema`` that are called otherwise there.  ``error`` tells file and line of what is no JSON object.
    """
    rows = lines.filter(F.trim("value") != "")
    at = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"))
    whole = F.try_parse_json("value")
    bad = F.when(whole.isNull() | ~F.schema_of_variant(whole).startswith("OBJECT"), F.concat(F.lit("not a JSON object: "), at))
    wanted = lines.sparkSession.createDataFrame([], schema).schema
    names = {f.name: (mapping or {}).get(f.name, f.name) for f in wanted}
    given = ", ".join(f"`{names[f.name]}` {f.dataType.simpleString()}" for f in wanted)
    record = F.from_json("value", given)
    return rows.select("file", "line", "value", F.struct(*(record[names[f.name]].alias(f.name) for f in wanted)).alias("record"), bad.alias("error"))
