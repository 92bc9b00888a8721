"""A Spark data source that walks directory trees: one partition a subtree, one row an entry."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, path string, parent string, file_name string, is_dir boolean, is_hidden boolean, file_size bigint, mtime timestamp, atime timestamp, ctime timestamp, inode bigint, device bigint, readable boolean"


class Subtree(InputPartition):
    """A directory to walk; shallow ones give their own entries only."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class WalkReader(DataSourceReader):
    """Options: path; recursive (true); partitions (64): how far the tree is split on the driver."""

    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"])
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.wanted = int(options.get("partitions", "64"))

    def partitions(self) -> list[InputPartition]:
        if not self.recursive:
            return [Subtree(self.root, False)]
        shallow, deep = [], [self.root]
        while deep and len(deep) < self.wanted:
            level, split = [], False
            for d in deep:
                try:
                    subs = [e.path for e in os.scandir(d) if e.is_dir(follow_symlinks=False) and not os.path.ismount(e.path)]
                except OSError:
                    subs = []
                if subs:
                    shallow.append(d)
                    level += subs
                    split = True
                else:
                    level.append(d)
            deep = level
            if not split:
                break
        return [*(Subtree(p, False) for p in shallow), *(Subtree(p, True) for p in deep)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        todo = [partition.path]
        while todo:
            d = todo.pop()
            try:
                entries = sorted(os.scandir(d), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                try:
                    s = e.stat(follow_symlinks=False)
                except OSError:
                    continue
                if stat.S_ISLNK(s.st_mode):
                    continue
                is_dir = stat.S_ISDIR(s.st_mode)
                when = lambda t: datetime.fromtimestamp(t, timezone.utc)
                yield (f"file://{e.path}", e.path, d, e.name, is_dir, e.name.startswith("."), None if is_dir else s.st_size, when(s.st_mtime), when(s.st_atime), when(s.st_ctime), s.st_ino, s.st_dev, os.access(e.path, os.R_OK))
                if is_dir and partition.deep and not os.path.ismount(e.path):
                    todo.append(e.path)


class WalkSource(DataSource):
    """spark.read.format("filewalk").option("path", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "filewalk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WalkReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WalkSource)


def with_content(spark: SparkSession, path: str, glob: str = "*"):
    """(url, path, mtime, size, content) of files by the built-in binary source."""
    from pyspark.sql import functions as F

    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return df.select(F.regexp_replace("path", "^file:/*", "file:///").alias("url"), "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def free_space(path: str) -> tuple[int, float]:
    """Bytes and percent free, on the driver."""
    import shutil

    u = shutil.disk_usage(path)
    return u.free, 100.0 * u.free / u.total
