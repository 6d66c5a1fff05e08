"""A data source for folder trees, `tree`: partitions are folders, and ignored folders are pruned before they are listed.

    spark.dataSource.register(TreeSource)
    spark.read.format("tree").option("path", root).load()

The driver lists folders from the root until there are enough to share out; what is below
them is walked by the tasks.  Executors must see the tree under the same path.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import values as V

SHAPE = "relative_path string, size_bytes long, outcome string, sha string, content string"
#: Folders to share out; the driver lists no more than so many.
FOLDERS = 256
#: Rows of an Arrow batch, and bytes of content after which one ends.
ROWS, BYTES = 1_000, 16 << 20


@dataclass
class Folder(InputPartition):
    """Some folders, and whether all that is below each is meant or its own files only."""

    folders: list[tuple[str, bool]]


def extension(name: str) -> str:
    at = name.rfind(".")
    return name[at:].lower() if at > 0 else ""


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.directories = set(json.loads(options.get("directories", "null")) or V.IGNORED_DIRECTORIES)
        self.filenames = set(json.loads(options.get("filenames", "null")) or V.IGNORED_FILENAMES)
        self.extensions = set(json.loads(options.get("extensions", "null")) or V.IGNORED_EXTENSIONS)
        self.max_bytes = int(options.get("maxbytes", V.MAX_FILE_BYTES))
        self.max_lines = int(options.get("maxlines", V.MAX_LINES))
        self.folders = int(options.get("folders", FOLDERS))
        self.log = options.get("log")

    def list(self, folder: str):
        """(folders to go into, files) of a folder, by name; links are neither.  What can't be listed has nothing."""
        if self.log:  # for tests: what was listed, a line each
            with open(self.log, "a") as f:
                f.write(folder + "\n")
        below, files = [], []
        try:
            with os.scandir(folder) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        if e.name not in self.directories:
                            below.append(e.path)
                    elif e.is_file(follow_symlinks=False):
                        files.append(e.path)
        except (FileNotFoundError, NotADirectoryError, PermissionError):
            pass
        return sorted(below), sorted(files)

    def partitions(self):
        whole, listed = [self.root], []
        while whole and len(whole) + len(listed) < self.folders and len(listed) < self.folders:
            folder = whole.pop(0)  # breadth first
            listed.append(folder)
            whole += self.list(folder)[0]
        shares = [Folder([]) for _ in range(min(self.folders, len(whole) + len(listed)))]
        for i, x in enumerate([*((f, True) for f in whole), *((f, False) for f in listed)]):
            shares[i % len(shares)].folders.append(x)
        return shares

    def look(self, path: str):
        """A file's row: its outcome, and its text where that is to be decided further."""
        import hashlib

        name, relative = os.path.basename(path), os.path.relpath(path, self.root).replace(os.sep, "/")
        if name in self.filenames or extension(name) in self.extensions:
            return relative, None, "reject-static", None, None
        try:
            size = os.path.getsize(path)
            if size > self.max_bytes:
                return relative, size, "oversized", None, None
            with open(path, "rb") as f:
                head = f.read(4096)
                if b"\0" in head:
                    return relative, size, "binary", None, None
                data = head + f.read()
        except OSError:
            return relative, None, "reject-static", None, None
        text = data.decode("utf-8", "replace")
        if text.count("\n") + 1 > self.max_lines:
            return relative, size, "oversized", None, None
        return relative, size, None, hashlib.sha256(text.encode()).hexdigest(), text

    def read(self, partition):
        import pyarrow as pa

        names = [x.split()[0] for x in SHAPE.split(", ")]
        kinds = pa.schema([(n, pa.int64() if n == "size_bytes" else pa.string()) for n in names])
        rows, size = [], 0
        stack = list(reversed(partition.folders))
        while stack:
            folder, deep = stack.pop()
            below, files = self.list(folder)
            stack += [(f, True) for f in reversed(below)] if deep else []
            for path in files:
                rows.append(self.look(path))
                size += len(rows[-1][4] or "")
                if len(rows) >= ROWS or size >= BYTES:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], kinds)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], kinds)


class TreeSource(DataSource):
    """relative_path, size_bytes, outcome, sha, content of each file.

    outcome: reject-static (name, extension, or unreadable; not opened), oversized, binary,
    or null where admission decides further; only then there is a sha and a content.
    Options: path; directories, filenames, extensions (JSON lists of what is ignored);
    maxBytes, maxLines; folders, to share out.  Links are not followed.
    """

    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return SHAPE

    def reader(self, schema):
        return TreeReader(self.options)


def scan(spark: SparkSession, root: str, **options) -> DataFrame:
    """The files below root, as TreeSource gives them; lists are passed as such."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").option("path", root)
    for k, x in options.items():
        reader = reader.option(k, json.dumps(list(x)) if isinstance(x, (list, tuple, set)) else x)
    return reader.load()


def copy(spark: SparkSession, root: str, to: str, **options) -> DataFrame:
    """Copies the files below root, ignored folders and file names left out, to another folder: relative_path, copied.

    Each file is written beside its place and then moved there, so a task that runs again
    does no harm; extensions are no reason to leave a file out.  A file that can't be read is
    not copied.  Both folders must be shared.
    """
    files = scan(spark, root, extensions=["no extension"], maxBytes=0, **options).where("outcome <> 'reject-static'").select("relative_path")

    def run(batches):
        import shutil

        import pyarrow as pa

        for batch in batches:
            done = []
            for path in batch.column(0).to_pylist():
                target = os.path.join(to, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{os.getpid()}.part"
                try:
                    shutil.copyfile(os.path.join(root, path), part, follow_symlinks=False)
                    os.replace(part, target)
                    done.append(True)
                except OSError:
                    done.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.bool_())], ["relative_path", "copied"])

    return files.mapInArrow(run, "relative_path string, copied boolean")
