"""`document_files`: a data source that writes one file for each row, whole or not at all.

    spark.dataSource.register(DocumentFiles)
    df.select("name", "content").write.format("document_files").mode("append").save(path)

Tasks write to a staging folder below the target, each attempt under names of
its own. When all tasks are done the driver moves the files of those attempts
that count to their places; when any failed, or two rows have one name,
nothing is moved and the staging folder goes. append replaces files of the same
names, overwrite clears the folder first. The target is a folder that driver
and executors share (each task looks for a mark that the driver left there,
and fails if it can't see it), or a URI that Arrow knows.

With the option job, what was written is listed in <path>/_written-<job> as
JSON lines of name and size.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MARK = "_shared"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    path = path.removeprefix("file://").removeprefix("file:").rstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def checked(name: str | None) -> str:
    """A file's name, which may have folders but can't leave the target."""
    parts = (name or "").split("/")
    if not all(parts) or ".." in parts or parts[0].startswith("_"):
        raise ValueError(f"not a name for a file: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    tag: str
    files: int


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str, listed: bool, overwrite: bool):
        self.path, self.job, self.listed, self.overwrite = path, job, listed, overwrite
        store, top = opened(path)
        store.create_dir(f"{top}/_staging-{job}/files", recursive=True)
        with store.open_output_stream(f"{top}/_staging-{job}/{MARK}"):
            pass

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top = opened(self.path)
        task, stage = TaskContext.get(), f"{top}/_staging-{self.job}"
        if store.get_file_info(f"{stage}/{MARK}").type == fs.FileType.NotFound:
            raise ValueError(f"{self.path} is not a folder that driver and executors share")
        tag, listed, files = f"{task.partitionId()}-{task.taskAttemptId()}", [], 0
        for b in iterator:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                target, data = f"{stage}/files/{checked(name)}@{tag}", content.as_buffer() if content.is_valid else b""
                if store.get_file_info(target).type != fs.FileType.NotFound:
                    raise ValueError(f"two rows are called {name}")
                store.create_dir(target.rpartition("/")[0], recursive=True)
                with store.open_output_stream(target) as out:
                    out.write(data)
                listed.append(json.dumps({"name": name, "size": len(data)}))
                files += 1
        if self.listed and listed:
            with store.open_output_stream(f"{stage}/{tag}.json") as out:
                out.write("\n".join(listed).encode())
        return Written(tag, files)

    def _staged(self, store: fs.FileSystem, folder: str, tags: set[str]) -> Iterator[tuple[str, list[str]]]:
        """(folder, names) of staged files whose attempts count, a folder at a time."""
        found = store.get_file_info(fs.FileSelector(folder))
        for x in found:
            if x.type == fs.FileType.Directory:
                yield from self._staged(store, x.path, tags)
        yield folder, [x.base_name for x in found if x.type == fs.FileType.File and x.base_name.rpartition("@")[2] in tags]

    def commit(self, messages: list[Written | None]) -> None:
        store, top = opened(self.path)
        stage, tags = f"{top}/_staging-{self.job}", {m.tag for m in messages if m}
        for folder, names in self._staged(store, f"{stage}/files", tags):
            own = [x.rpartition("@")[0] for x in names]
            if len(own) > len(set(own)):
                raise ValueError(f"rows share names in {folder.removeprefix(stage)}: {sorted({x for x in own if own.count(x) > 1})[:5]}")
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(top)):
                if x.path.rpartition("/")[2] != f"_staging-{self.job}":
                    (store.delete_dir if x.type == fs.FileType.Directory else store.delete_file)(x.path)
        for folder, names in self._staged(store, f"{stage}/files", tags):
            target = f"{top}{folder.removeprefix(f'{stage}/files')}"
            store.create_dir(target, recursive=True)
            for x in names:
                store.move(f"{folder}/{x}", f"{target}/{x.rpartition('@')[0]}")
        if self.listed:
            store.create_dir(f"{top}/_written-{self.job}", recursive=True)
            for m in messages:
                if m and m.files:
                    store.move(f"{stage}/{m.tag}.json", f"{top}/_written-{self.job}/{m.tag}.json")
        store.delete_dir(stage)

    def abort(self, messages: list[Written | None]) -> None:
        store, top = opened(self.path)
        if store.get_file_info(f"{top}/_staging-{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{top}/_staging-{self.job}")


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], self.options.get("job") or uuid.uuid4().hex, "job" in self.options, overwrite)
