"""Directory listing as a Spark data source.

Spark's file sources skip names that begin with _ or . and cut times to milliseconds; this source lists every regular entry
below a root, with times in nanoseconds. Folders are dealt over the tasks, level by level until there are enough. The root must be visible to the
executors, as for any file scan.
"""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def walk(root: str, recurse: bool = True):
    """(relative path, stat) of every entry below root that is no folder; folders that are links aren't followed."""
    for folder, _, names in os.walk(root):
        for name in names:
            full = os.path.join(folder, name)
            try:
                yield os.path.relpath(full, root), os.stat(full)
            except FileNotFoundError:  # gone since it was listed, or a link to nothing
                continue
        if not recurse:
            return


#: Folders that the driver lists before it deals the tree over tasks, at least where there are so many.
DEAL = 64


def _dealt(root: str) -> tuple[list[str], list[str]]:
    """Folders to list by themselves, and folders to walk: the tree is opened level by level until there are DEAL to walk."""
    flat, deep = [root], [e.path for e in os.scandir(root) if e.is_dir(follow_symlinks=False)]
    while deep and len(deep) < DEAL:
        below = [e.path for f in deep for e in os.scandir(f) if e.is_dir(follow_symlinks=False)]
        flat += deep
        deep = below
    return sorted(flat), sorted(deep)


class _Folder(InputPartition):
    def __init__(self, start: str, recurse: bool):
        self.start, self.recurse = start, recurse


class _Reader(DataSourceReader):
    def __init__(self, root: str, content: bool):
        self.root, self.content = root, content

    def partitions(self):
        flat, deep = _dealt(self.root)
        return [*(_Folder(f, False) for f in flat), *(_Folder(f, True) for f in deep)]

    def read(self, partition):
        for name, st in walk(partition.start, partition.recurse):
            full = os.path.join(partition.start, name)
            if not stat.S_ISREG(st.st_mode):
                continue
            row = (os.path.relpath(full, self.root), st.st_mtime_ns, st.st_size)
            if self.content:
                with open(full, "rb") as f:
                    row += (f.read(),)
            yield row


class TreeSource(DataSource):
    """spark.read.format("tree").option("content", "true").load(root)"""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def _content(self) -> bool:
        return str(self.options.get("content", "false")).lower() == "true"

    def schema(self) -> str:
        return "rel_path string, mtime_ns long, size_bytes long" + ", content binary" * self._content()

    def reader(self, schema) -> DataSourceReader:
        root = self.options.get("path")
        if not root or not os.path.isdir(root):
            raise FileNotFoundError(f"no folder {root!r}")
        return _Reader(root, self._content())


def manifest(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """rel_path, mtime_ns, size_bytes and, where asked for, content of every file below root."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("content", str(content).lower()).load(os.path.abspath(root))


def contents(files: DataFrame, root: str) -> DataFrame:
    """files (rel_path and more) with content: only the files named are read, where they are named. content is null for one
    that can't be read."""
    root = os.path.abspath(root)

    def run(frames):
        import pyarrow as pa

        for f in frames:
            # one file at a time, so that no batch holds more than one
            for k, rel in enumerate(f.column("rel_path").to_pylist()):
                try:
                    with open(os.path.join(root, rel), "rb") as g:
                        got = g.read()
                except OSError:
                    got = None
                yield pa.RecordBatch.from_arrays([*f.slice(k, 1).columns, pa.array([got], pa.binary())], [*f.schema.names, "content"])

    return files.mapInArrow(run, files.withColumn("content", F.lit(None).cast("binary")).schema)


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """rel_path and content of files that are named one by one; _error where one can't be read."""

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for p in f.rel_path:
                try:
                    with open(p, "rb") as g:
                        out.append((p, g.read(), None))
                except OSError as e:
                    out.append((p, None, str(e)))
            yield pd.DataFrame(out, columns=["rel_path", "content", "_error"])

    return spark.createDataFrame([(os.path.abspath(p),) for p in paths], "rel_path string").mapInPandas(run, "rel_path string, content binary, _error string")
