"""Snapshots: what changes of a catalogue is written beside what is read, then a marker makes the new state visible.

Files and interpretations are laid out by graph. A snapshot's marker holds its manifest: for each table, and each graph of
the two large ones, the snapshot whose files hold it. So a batch that touches two graphs rewrites two graphs.
"""

from __future__ import annotations

import functools
import json
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartei import catalog
from kartei.catalog import Catalog

TABLES = ("files", "ies", "roots", "folders", "artists", "tags")
BY_GRAPH = ("files", "ies")
#: Tables that events of files never change.
STEADY = ("roots", "tags")
#: The marker of a complete snapshot, with the number of the batch that it holds last.
MARK = re.compile(r"done-(\d+)(?:-batch-(\d+))?")


def _fs(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    jvm, fs = _fs(spark, folder)
    root = jvm.org.apache.hadoop.fs.Path(folder)
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def _marks(spark: SparkSession, folder: str) -> dict[int, tuple[str, int]]:
    """Snapshot -> (name of its marker, batch or -1)."""
    return {int(m[1]): (n, int(m[2] or -1)) for n in _names(spark, folder) if (m := MARK.fullmatch(n))}


def current(spark: SparkSession, folder: str) -> int:
    """The number of the newest complete snapshot, 0 if there is none."""
    return max(_marks(spark, folder), default=0)


def last_batch(spark: SparkSession, folder: str) -> int:
    """The number of the last batch that a complete snapshot holds, -1 if there is none."""
    return max((b for _, b in _marks(spark, folder).values()), default=-1)


def manifest(spark: SparkSession, folder: str, n: int) -> dict[str, int | dict[str, int]]:
    """Table, or table and folder of a graph -> the snapshot whose files hold it."""
    jvm, fs = _fs(spark, folder)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{folder}/{_marks(spark, folder)[n][0]}"))
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read(spark: SparkSession, folder: str) -> Catalog | None:
    """The newest complete snapshot."""
    n = current(spark, folder)
    if not n:
        return None
    held = manifest(spark, folder, n)

    def table(name: str) -> DataFrame:
        schema = getattr(catalog, name.upper())
        if name not in BY_GRAPH:
            return spark.read.schema(schema).parquet(f"{folder}/snap-{held[name]}/{name}.parquet")
        parts = []
        for k in sorted(set(held[name].values())):
            base = f"{folder}/snap-{k}/{name}.parquet"
            mine = [f"{base}/{d}" for d, at in sorted(held[name].items()) if at == k]
            parts.append(spark.read.schema(schema).option("basePath", base).parquet(*mine))
        if not parts:
            return spark.createDataFrame([], schema)
        df = functools.reduce(DataFrame.unionByName, parts)
        return df.select(*sorted(df.columns, key=lambda c: c != "graph"))

    return Catalog(*[table(name) for name in ("files", "ies", "roots", "folders", "artists", "tags")])


def write(c: Catalog, folder: str, batch: int | None = None, changed: set[str] | None = None) -> int:
    """Write a catalogue as snapshot n + 1; it is read only once its marker exists, so a failed write changes nothing.

    changed: the graphs that differ from snapshot n, the newest; the others, and the tables that events never change, stay
    where they are. None writes all. The marker also names the batch whose events the snapshot holds, so a batch and its
    mark become visible at once.
    """
    spark = c.files.sparkSession
    before = current(spark, folder)
    old = manifest(spark, folder, before) if before and changed is not None else None
    n = before + 1
    now: dict[str, int | dict[str, int]] = {}
    for name in TABLES:
        path = f"{folder}/snap-{n}/{name}.parquet"
        df = getattr(c, name)
        if name in BY_GRAPH:
            if old is not None:
                df = df.where(F.col("graph").isin(*changed))
            df.write.mode("overwrite").partitionBy("graph").parquet(path)
            kept = {d: k for d, k in old[name].items() if unquote(d.removeprefix("graph=")) not in changed} if old is not None else {}
            now[name] = kept | {d: n for d in _names(spark, path) if d.startswith("graph=")}
        elif old is not None and name in STEADY:
            now[name] = old[name]
        else:
            df.write.mode("overwrite").parquet(path)
            now[name] = n
    jvm, fs = _fs(spark, folder)
    name = f"done-{n}" + ("" if batch is None else f"-batch-{batch}")
    # written under another name first: a marker is complete as soon as it exists
    draft = jvm.org.apache.hadoop.fs.Path(f"{folder}/draft-{n}")
    out = fs.create(draft, True)
    out.write(json.dumps(now).encode())
    out.close()
    fs.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
    return n


def drop_old(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Remove all but the newest snapshots, and of the older ones what no newer one refers to."""
    jvm, fs = _fs(spark, folder)
    marks = _marks(spark, folder)
    gone = sorted(marks)[:-keep] if keep else sorted(marks)
    used: set[int] = set()
    for n in set(marks) - set(gone):
        for held in manifest(spark, folder, n).values():
            used |= set(held.values()) if isinstance(held, dict) else {held}
    for n in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{marks[n][0]}"), True)
    for name in _names(spark, folder):
        if (m := re.fullmatch(r"snap-(\d+)", name)) and int(m[1]) not in used and int(m[1]) <= max(marks, default=0):
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
