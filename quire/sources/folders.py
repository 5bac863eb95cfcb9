"""Folders of document files as a data source: ``spark.read.format("documents")``.

``path`` holds a folder for each model, and files below it: ``path/Model/…/name.md``.
A folder is a partition, or several if it holds many files. Filters on model and
doc are pushed: folders of other models aren't listed, files of other names not read.
Files are reached through Arrow's file systems, so a path with a scheme works where
Arrow knows it. Writing makes a file for each row, by tasks, whatever their number.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "store string, model string, doc string, path string, text string"
#: Files of a partition at most.
FILES = 1000
#: Bytes of texts that a task hands on at once.
BATCH_BYTES = 4_000_000


def _place(path: str) -> tuple[fs.FileSystem, str, str]:
    """A path's file system, its path there, and what comes before it."""
    if "://" in path or path.startswith("file:"):
        found, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        return found, inner.rstrip("/"), path[: path.index(inner)] if inner in path else ""
    return fs.LocalFileSystem(), path.rstrip("/"), ""


@dataclass
class Files(InputPartition):
    model: str
    paths: list[str]

    def __post_init__(self) -> None:
        super().__init__(None)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.store, self.pattern = options["path"], options.get("store", "local"), options.get("pattern", "*.md")
        self.models: set[str] | None = None
        self.docs: set[str] | None = None
        self.starts: list[str] = []
        self.nothing = False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("model",):
                self.models = values if self.models is None else self.models & values
            elif values is not None and f.attribute == ("doc",):
                self.docs = values if self.docs is None else self.docs & values
            elif values is not None and f.attribute == ("store",):
                self.nothing |= self.store not in values
            elif isinstance(f, StringStartsWith) and f.attribute == ("doc",):
                self.starts.append(f.value)
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        doc = name.rpartition(".")[0]
        return fnmatch.fnmatch(name, self.pattern) and not name.startswith(".") and (self.docs is None or doc in self.docs) and all(doc.startswith(s) for s in self.starts)

    def partitions(self) -> list[InputPartition]:
        if self.nothing:
            return [Files("", [])]
        files, root, _ = _place(self.path)
        top = [x for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.Directory and not x.base_name.startswith(".")]
        out: list[InputPartition] = []
        for folder in sorted(top, key=lambda x: x.base_name):
            if self.models is None or folder.base_name in self.models:
                hidden = lambda p, at=len(folder.path): "/." in p[at:]
                paths = sorted(x.path for x in files.get_file_info(fs.FileSelector(folder.path, recursive=True)) if x.type == fs.FileType.File and not hidden(x.path) and self._wanted(x.base_name))
                out += [Files(folder.base_name, paths[i : i + FILES]) for i in range(0, len(paths), FILES)]
        return out or [Files("", [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _, before = _place(self.path)
        held, size = [], 0
        for path in partition.paths:
            with files.open_input_file(path) as f:
                text = f.read().decode("utf-8", "replace")
            name = path.rpartition("/")[2]
            held.append((self.store, partition.model, name.rpartition(".")[0], before + path, text))
            size += len(text)
            if size >= BATCH_BYTES:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["store", "model", "doc", "path", "text"])


class FolderWriter(DataSourceArrowWriter):
    """A file for each row (model, doc, text), at ``path/model/doc.md``; a name may have slashes. A file is written beside its place and moved there, so a task that runs again does no harm."""

    def __init__(self, options: dict, columns: list[str]):
        self.path, self.at = options["path"], [columns.index(c) for c in ("model", "doc", "text")]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root, _ = _place(self.path)
        made: set[str] = set()
        from pyspark import TaskContext

        mark = TaskContext.get().taskAttemptId()
        for batch in iterator:
            for model, doc, text in zip(*(batch.column(i).to_pylist() for i in self.at)):
                target = f"{root}/{model}/{doc}.md"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                aside = f"{folder}/.{target.rpartition('/')[2]}.{mark}"
                with files.open_output_stream(aside) as f:
                    f.write((text or "").encode() + (b"" if (text or "").endswith("\n") else b"\n"))
                files.move(aside, target)
        return WriterCommitMessage()


class DocumentFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        return FolderWriter(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    """Make the format ``documents`` known, and its filters pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentFolders)
