"""CSV files that each have a header of their own, read by column name in ranges of bytes: Spark format ``headed_csv``.

Options: path (a file, folder or pattern below which files called ``name``, default *.csv, are read), columns (names to read, comma-separated),
required (names without which a file gives no rows), delimiter, range_bytes. Rows have the columns, as strings, and ``file``.

Planning reads the first line of each file; each range then takes the lines that begin in it, so a large file is read by many tasks. A column that
a file lacks, a short row's missing cells and empty unquoted cells are null. Cells may be quoted, but a line end inside quotes ends the line.
Files are those that pyarrow opens; a header is at most HEADER_BYTES long.
"""

from __future__ import annotations

import csv
import fnmatch
import io
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 32_000_000
HEADER_BYTES = 1 << 16
BLOCK = 4_000_000
BATCH_ROWS = 10_000


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    header: tuple[str, ...]


def header_of(first: bytes, delimiter: str) -> tuple[tuple[str, ...], int]:
    """Names in the first line, and where the second begins."""
    end = first.find(b"\n")
    line = first if end < 0 else first[:end]
    cells = next(csv.reader([line.decode("utf-8-sig", "replace").rstrip("\r")], delimiter=delimiter), [])
    return tuple(c.strip() for c in cells), len(first) if end < 0 else end + 1


def lines_in(read, size: int, start: int, end: int, begin: int) -> Iterator[bytes]:
    """Lines that begin in [start, end); begin is where the file's first row does. read(at, n) gives bytes."""
    at = max(start, begin)
    if at >= end:
        return
    held = b""
    if at > begin:  # the line that runs into the range belongs to the one before
        at -= 1
        while True:
            block = read(at, BLOCK)
            cut = block.find(b"\n")
            if cut >= 0 or not block:
                held, place = block[cut + 1 :], at + cut + 1
                at += len(block)
                break
            at += len(block)
        if not held and at >= size:
            return
    else:
        place = at
    while place < end:
        cut = held.find(b"\n")
        if cut < 0:
            block = read(at, BLOCK) if at < size else b""
            if not block:
                if held:
                    yield held
                return
            held, at = held + block, at + len(block)
            continue
        lines = held.split(b"\n")
        held = lines.pop()
        for line in lines:
            if place >= end:
                return
            yield line
            place += len(line) + 1


class HeadedCsvReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.name = options["path"].rstrip("/"), options.get("name", "*.csv")
        self.columns = [c.strip() for c in options["columns"].split(",")]
        self.required = {c.strip() for c in options.get("required", "").split(",") if c.strip()}
        self.delimiter, self.range_bytes = options.get("delimiter", ","), int(options.get("range_bytes", RANGE_BYTES))

    def _files(self):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else []
        return files, [f for f in found if f.type == fs.FileType.File and (f is info or fnmatch.fnmatch(f.base_name, self.name)) and not f.base_name.startswith(("_", "."))]

    def partitions(self):
        files, found = self._files()

        def plan(info):
            with files.open_input_file(info.path) as file:
                header, _ = header_of(file.read(HEADER_BYTES), self.delimiter)
            if not self.required <= set(header):
                return []
            return [Range(info.path, a, min(a + self.range_bytes, info.size), header) for a in range(0, info.size, self.range_bytes)]

        with ThreadPoolExecutor(16) as pool:
            planned = [r for ranges in pool.map(plan, sorted(found, key=lambda f: f.path)) for r in ranges]
        return planned or [Range("", 0, 0, ())]

    def read(self, partition: Range):
        import pyarrow as pa
        from pyarrow import fs

        if not partition.file:
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        places = [partition.header.index(c) if c in partition.header else None for c in self.columns]
        schema = pa.schema([(c, pa.string()) for c in [*self.columns, "file"]])

        def batch(rows):
            columns = [pa.nulls(len(rows), pa.string()) if p is None else pa.array([r[p] if p < len(r) and r[p] != "" else None for r in rows], pa.string()) for p in places]
            return pa.RecordBatch.from_arrays([*columns, pa.array([partition.file] * len(rows), pa.string())], schema=schema)

        with files.open_input_file(partition.file) as file:
            size = file.size()

            def read(at, n):
                file.seek(at)
                return file.read(n)

            _, begin = header_of(read(0, HEADER_BYTES), self.delimiter)
            text = (line.decode("utf-8", "replace").rstrip("\r") for line in lines_in(read, size, partition.start, partition.end, begin))
            rows = []
            for line in text:
                if not line.strip():
                    continue
                rows.append(next(csv.reader(io.StringIO(line), delimiter=self.delimiter), []))
                if len(rows) >= BATCH_ROWS:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


class HeadedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "headed_csv"

    def schema(self) -> str:
        return ", ".join(f"`{c.strip()}` string" for c in [*self.options["columns"].split(","), "file"])

    def reader(self, schema) -> HeadedCsvReader:
        return HeadedCsvReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HeadedCsv)
