"""Streaming twins: coalescing as keyed state, micro-batches applied to snapshots, windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kartei.catalog import EVENTS
from kartei.operators.coalesce import APPEND, BARRIER, DROP, EFFECT, MOVED, REPLACE, coalesce_events, kind_of, with_barriers

#: Events of a file of the queue, and files that a micro-batch takes at most.
TASKS_PER_COMMIT, FILES_PER_BATCH = 800, 2
STATE = "kind int, seq long, op string, dest_url string, is_dir boolean, attributes_only boolean, shown boolean"
OUT = "seq long, op string, file_url string, dest_url string, is_dir boolean, attributes_only boolean, status string"


def coalesce_stream(events: DataFrame) -> DataFrame:
    """The queue of every path as keyed state: rows as they leave the queue; the last one stays in it.

    status: "left" for an event that has left its queue for good; "queued" for the last event of its path after the
    micro-batch, which a later batch makes "left" or takes back ("replaced"). What has left, and what is queued and not
    taken back, is what coalesce_events leaves of all events. Moves leave at once and make the queue of their destination
    forget. Deletions of directories purge other keys: that needs the events of a micro-batch together (apply_batches).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["seq", "second"])
        out = []

        def tell(e: tuple, status: str) -> None:
            out.append((e[1], e[2], key[0], e[3], e[4], e[5], status))

        for r in rows.itertuples():
            effect = EFFECT.get((last[0], r.kind), APPEND) if last else APPEND
            if effect == DROP:
                continue
            if last and effect != REPLACE:
                tell(last, "left")
            elif last and last[6]:
                tell(last, "replaced")
            dest, is_dir, attributes = (None if pd.isna(x) else x for x in (r.dest_url, r.is_dir, r.attributes_only))
            if r.kind == MOVED:
                out.append((r.seq, "CREATED", dest, None, is_dir, attributes, "left") if effect == REPLACE else (r.seq, r.op, key[0], dest, is_dir, attributes, "left"))
            last = None if r.kind in (MOVED, BARRIER) else (int(r.kind), int(r.seq), r.op, dest, is_dir, attributes, False)
        if last:
            if not last[6]:
                tell(last, "queued")
            state.update((*last[:6], True))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["seq", "op", "file_url", "dest_url", "is_dir", "attributes_only", "status"])

    e = events.where("op is not null and file_url is not null and seq is not null").withColumn("kind", kind_of(F.col("op"), F.col("attributes_only"))).where("kind is not null")
    return with_barriers(e).groupBy("key").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def enqueue(events: DataFrame, folder: str, tasks: int = TASKS_PER_COMMIT) -> None:
    """Add events to a queue on disk, in files of at most so many."""
    events.write.mode("append").option("maxRecordsPerFile", tasks).parquet(folder)


def queued(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The queue as a stream; a micro-batch takes at most so many files, the rest waits on disk."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def apply_batches(events: DataFrame, apply, checkpoint: str):
    """Run ``apply(coalesced, batch_id)`` for every micro-batch, one at a time; the checkpoint makes batches repeatable."""

    def each(batch: DataFrame, batch_id: int) -> None:
        apply(coalesce_events(batch), batch_id)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "3 days") -> DataFrame:
    """(window, op, n) over event time; events later than the watermark are dropped in append mode."""
    t = events.where("ts is not null and op is not null").withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return t.groupBy(w, "op").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "op", "n")


def changed_graphs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(graph, urn, change): the notifications between two snapshots, keyed by graph and urn."""
    b = before.select("graph", "urn", F.xxhash64(*[c for c in before.columns if c not in ("graph", "urn")]).alias("old")).dropDuplicates(["graph", "urn"])
    a = after.select("graph", "urn", F.xxhash64(*[c for c in after.columns if c not in ("graph", "urn")]).alias("new")).dropDuplicates(["graph", "urn"])
    change = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update")
    return b.join(a, ["graph", "urn"], "full_outer").select("graph", "urn", change.alias("change")).where("change is not null")
