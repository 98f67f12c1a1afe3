"""A Python data source of text lines: files in order, each opened only when its lines are asked for.

``spark.read.format("tessera_lines").load(folder)`` gives (path, line, value) of the ``.txt``, ``.jsonl`` and ``.csv``
files under a folder, ``.gz`` ones too, each file a partition. With option ``limit`` the files are read one after
another and none beyond the last line that is wanted; a filter on ``path`` leaves all other files closed.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SUFFIXES = (".txt", ".jsonl", ".csv", ".txt.gz", ".jsonl.gz", ".csv.gz")
#: Lines of a batch.
BATCH = 4096


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class LinesReader(DataSourceReader):
    def __init__(self, root: str, limit: int | None):
        self.root, self.limit = root, limit
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  the interface's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",) and self.limit is None:
                self.only = {f.value} if self.only is None else self.only & {f.value}
            else:
                yield f

    def store(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (pafs.LocalFileSystem(), self.root)

    def partitions(self) -> list[Files]:
        fs, at = self.store()
        if fs.get_file_info(at).type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True)) if fs.get_file_info(at).type == pafs.FileType.Directory else [fs.get_file_info(at)]
        paths = sorted(f.path for f in found if f.is_file and f.path.endswith(SUFFIXES))
        if self.only is not None:
            paths = [p for p in paths if p in self.only]
        return [Files(paths)] if self.limit is not None else [Files([p]) for p in paths] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = self.store()
        left = self.limit
        for path in partition.paths:
            if left is not None and left <= 0:
                return
            with fs.open_input_stream(path, compression=None) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
                number, batch = 0, []
                for line in io.TextIOWrapper(stream, "utf-8", errors="ignore"):
                    batch.append(line.rstrip("\r\n"))
                    if left is not None:
                        left -= 1
                    if len(batch) == BATCH or left == 0:
                        yield self.told(path, number, batch)
                        number, batch = number + len(batch), []
                        if left == 0:
                            return
                if batch:
                    yield self.told(path, number, batch)

    @staticmethod
    def told(path: str, number: int, lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array(range(number, number + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["path", "line", "value"])


class LinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_lines"

    def schema(self) -> str:
        return "path string, line long, value string"

    def reader(self, schema) -> LinesReader:
        limit = self.options.get("limit")
        return LinesReader(self.options["path"], None if limit is None else max(0, int(limit)))


def read_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(path, line from 0, value) of the text files under ``path``; the first ``limit`` lines by path and place, if given."""
    spark.dataSource.register(LinesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(LinesSource.name())
    return (reader if limit is None else reader.option("limit", str(limit))).load(path)
