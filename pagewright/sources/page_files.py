"""Files of pages as a data source of Spark: ``spark.read.format("page_files")`` and ``readStream``.

    register(spark)
    spark.read.format("page_files").option("parser", "my.module:make").load("s3://in/handbooks")

``parser`` names a callable that makes a ``parsers.PageParser``; the module has to be where the
workers can import it.  A partition is a range of files, whose rows stream out page by page;
a file that can't be parsed is one row with ``error``, after the pages that it gave.  As a stream a file is
taken once, in the order of its time and name; the offset is the last file taken.
Paths are local ones or what Arrow can open (s3, gs, hdfs).
"""

from __future__ import annotations

import fnmatch
import importlib
from collections.abc import Iterator

import xxhash
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Files of one partition.
FILES = 16
SCHEMA = "doc_id bigint, path string, page_no int, text string, error string"


class Files(InputPartition):
    """A range of files."""

    def __init__(self, paths: tuple[str, ...]):
        self.paths = paths


def _store(path: str):
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return store, root, (lambda p: f"file:{p}" if isinstance(store, fs.LocalFileSystem) else f"{path.split('://')[0]}://{p}")


def _listed(path: str, glob: str) -> list[tuple[int, str]]:
    """``(time, path)`` of the files below a folder, or of one file, in order; hidden ones are left out."""
    from pyarrow import fs

    store, root, _ = _store(path)
    one = store.get_file_info(root)
    infos = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    files = [x for x in infos if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, glob) and not x.base_name.startswith(("_", "."))]
    return sorted((x.mtime_ns or 0, x.path) for x in files)


def document_id(path: str) -> int:
    """What ``xxhash64`` of the path is in Spark."""
    value = xxhash.xxh64_intdigest(path.encode(), seed=42)
    return value - (1 << 64) if value >= 1 << 63 else value


class _Reader:
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("pathGlobFilter", "*")
        self.parser, self.files = options["parser"], int(options.get("filesPerPartition", FILES))

    def _ranges(self, paths: list[str]) -> list[Files]:
        return [Files(tuple(paths[i : i + self.files])) for i in range(0, len(paths), self.files)]

    def read(self, partition: Files) -> Iterator[tuple]:
        module, _, name = self.parser.partition(":")
        parser = getattr(importlib.import_module(module), name)()
        store, _, named = _store(self.path)
        for path in partition.paths:
            full, page = named(path), 0
            doc_id = document_id(full)
            try:
                with store.open_input_stream(path) as file:
                    content = file.read()
                for page, text in enumerate(parser.pages(content), 1):
                    yield doc_id, full, page, text, None
            except Exception as problem:  # noqa: BLE001  a file that can't be parsed is data
                yield doc_id, full, page + 1, None, str(problem)[:500]


class PageReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self._ranges([path for _, path in _listed(self.path, self.glob)]) or [Files(())]


class PageStreamReader(_Reader, DataSourceStreamReader):
    """Offsets are ``{"time", "path"}`` of the last file of a batch; a file that comes with an older time is not seen."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(_listed(self.path, self.glob), default=(-1, ""))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((x["time"], x["path"]) for x in (start, end))
        return self._ranges([path for time, path in _listed(self.path, self.glob) if low < (time, path) <= high])

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(PageFiles)
