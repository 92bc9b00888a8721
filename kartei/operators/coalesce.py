"""Coalescing of queued change events.

A queue looks at the last queued event of a path only, so the queue of a path is a finite automaton: what a new event
does depends on the kind of the last one. Events of a path are cut into chunks of neighbouring sequence numbers; each
chunk is summarised for every state it may start in (end state, first effect on the event before it), summaries are
chained by windows over chunks that carry nothing else, in running order and without looking ahead, and then every chunk
is resolved by itself. So a path with a third of all events is spread over many tasks, one task sees a few numbers for
each CHUNK of its events, and the result is the same as for one pass in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartei.operators.prefix import climb
from kartei.session import materialize

# kinds of events, and of the last queued event (0: none)
CREATED, UPDATED, ATTRIBUTES, DELETED, MOVED, BARRIER = 1, 2, 3, 4, 5, 6
APPEND, REPLACE, DROP = 0, 1, 2
#: (queued, new) -> what happens; all other pairs are both kept.
EFFECT = {
    (CREATED, CREATED): REPLACE,
    (CREATED, UPDATED): REPLACE,
    (CREATED, DELETED): REPLACE,
    (CREATED, MOVED): REPLACE,
    (UPDATED, UPDATED): DROP,
    (UPDATED, ATTRIBUTES): DROP,
    (UPDATED, DELETED): REPLACE,
    (ATTRIBUTES, UPDATED): REPLACE,
    (ATTRIBUTES, ATTRIBUTES): DROP,
    (ATTRIBUTES, DELETED): REPLACE,
    (DELETED, DELETED): DROP,
}
STATES = (0, CREATED, UPDATED, ATTRIBUTES, DELETED)
CHUNK = 512


def _next(state: int, kind: int) -> int:
    """The last queued event after a new one; a move forgets it."""
    if EFFECT.get((state, kind)) == DROP:
        return state
    return 0 if kind in (MOVED, BARRIER) else kind


_NEXT = [_next(s, k) for s in STATES for k in range(7)]
_EFFECT = [EFFECT.get((s, k), APPEND) for s in STATES for k in range(7)]


def _at(table: list[int], state: Column, kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in table]), (state * 7 + kind + 1).cast("int"))


def kind_of(op: Column, attributes_only: Column) -> Column:
    return (
        F.when(op == "CREATED", CREATED)
        .when((op == "UPDATED") & F.coalesce(attributes_only, F.lit(False)), ATTRIBUTES)
        .when(op == "UPDATED", UPDATED)
        .when(op == "DELETED", DELETED)
        .when(op == "MOVED", MOVED)
    )


def purge_below_deleted(events: DataFrame) -> DataFrame:
    """Events without those queued before the deletion of a directory above them."""
    gone = events.where((F.col("op") == "DELETED") & F.col("is_dir")).groupBy(F.col("file_url").alias("_a")).agg(F.max("seq").alias("_last"))
    last = climb(events.select("seq", "file_url"), "file_url", gone, "_a", False).join(gone, "_a").where("_last > seq").select("seq").distinct()
    return events.join(last, "seq", "left_anti")


def with_barriers(e: DataFrame) -> DataFrame:
    """Events with the key whose queue they go to; a move also makes the queue of its destination forget (second = 1)."""
    own = F.struct(F.col("file_url").alias("key"), F.lit(0).alias("second"), F.col("kind").alias("kind"), F.col("dest_url").alias("dest"))
    stop = F.struct(F.col("dest_url").alias("key"), F.lit(1).alias("second"), F.lit(BARRIER).alias("kind"), F.lit(None).cast("string").alias("dest"))
    both = F.when((F.col("kind") == MOVED) & F.col("dest_url").isNotNull(), F.array(own, stop)).otherwise(F.array(own))
    each = e.select("seq", "op", "is_dir", "attributes_only", F.explode(both).alias("e"))
    return each.select("e.key", "seq", "e.second", "e.kind", "op", F.col("e.dest").alias("dest_url"), "is_dir", "attributes_only")


def coalesce_events(events: DataFrame, chunk: int = CHUNK, purge: bool = True) -> DataFrame:
    """The events left in the queue: (seq, op, file_url, dest_url, is_dir, attributes_only).

    Events with NULL op, url or seq are dropped; repeated rows count once. A created file that is moved becomes a creation
    of its destination. A move makes the queue forget both paths. Deletions of directories drop what was queued below
    them, unless purge is false.
    """
    cols = ["seq", "op", "file_url", "dest_url", "is_dir", "attributes_only"]
    e = events.where("op is not null and file_url is not null and seq is not null").select(*cols).distinct()
    e = (purge_below_deleted(e) if purge else e).withColumn("kind", kind_of(F.col("op"), F.col("attributes_only"))).where("kind is not null")
    keyed = with_barriers(e).select("key", F.struct("seq", "second", "kind", "op", "dest_url", "is_dir", "attributes_only").alias("x"))
    chunks = materialize(keyed.groupBy("key", F.floor(F.col("x.seq") / chunk).alias("part")).agg(F.array_sort(F.collect_list("x")).alias("xs")))
    kinds = F.transform("xs", lambda x: x.kind)

    def summary(start: int) -> Column:
        zero = F.struct(F.lit(start).alias("state"), F.lit(-1).alias("first"))

        def step(acc: Column, kind: Column) -> Column:
            effect = _at(_EFFECT, acc.state, kind)
            return F.struct(_at(_NEXT, acc.state, kind).alias("state"), F.when((acc.first < 0) & (effect != DROP), effect).otherwise(acc.first).alias("first"))

        return F.aggregate(kinds, zero, step)

    sums = chunks.select("key", "part", F.array(*[summary(s) for s in STATES]).alias("by_start"))
    # the state before each chunk. Every kind but an attribute update leads to one state from any start, so a chunk's map
    # is constant unless it holds attribute updates alone; that map applied twice is that map. A run of chunks begins after
    # a constant one; within it the start is the state before the run, or the run's first map of it.
    w = Window.partitionBy("key").orderBy("part")
    ends = F.transform("by_start", lambda s: s.state)
    fixed = F.size(F.array_distinct(ends)) == 1
    run = F.sum(F.lag(fixed.cast("int"), 1, 1).over(w)).over(w)
    sums = sums.withColumn("ends", ends).withColumn("run", run).withColumn("before", F.coalesce(F.lag(F.when(fixed, F.element_at(ends, 1))).over(w), F.lit(0)))
    r = Window.partitionBy("key", "run").orderBy("part")
    before, mapped = F.first("before").over(r), F.first("ends").over(r)
    begun = sums.withColumn("start", F.when(F.row_number().over(r) == 1, before).otherwise(F.element_at(mapped, (before + 1).cast("int"))))
    begun = begun.withColumn("own", F.nullif(F.element_at("by_start", (F.col("start") + 1).cast("int")).first, F.lit(-1)))
    # what the chunks behind do first, carried along from the last chunk
    back = Window.partitionBy("key").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    solved = chunks.join(begun.select("key", "part", "start", F.last("own", ignorenulls=True).over(back).alias("after")), ["key", "part"])
    states = F.aggregate(
        "xs",
        F.struct(F.col("start").alias("state"), F.array().cast("array<int>").alias("effects")),
        lambda acc, x: F.struct(_at(_NEXT, acc.state, x.kind).alias("state"), F.concat(acc.effects, F.array(_at(_EFFECT, acc.state, x.kind))).alias("effects")),
    ).effects
    paired = F.filter(F.arrays_zip(F.col("xs").alias("x"), states.alias("effect")), lambda p: p.effect != DROP)
    kept = solved.select("key", "after", paired.alias("ps"))
    alive = F.filter("ps", lambda p, i: F.coalesce(F.try_element_at("ps", i + 2).effect, F.when(i + 1 == F.size("ps"), F.col("after")), F.lit(APPEND)) != REPLACE)
    out = kept.select("key", F.explode(alive).alias("p")).where(F.col("p.x.kind") != BARRIER)
    as_new = (F.col("p.x.kind") == MOVED) & (F.col("p.effect") == REPLACE)
    return out.select(
        F.col("p.x.seq").alias("seq"),
        F.when(as_new, "CREATED").otherwise(F.col("p.x.op")).alias("op"),
        F.when(as_new, F.col("p.x.dest_url")).otherwise(F.col("key")).alias("file_url"),
        F.when(~as_new, F.col("p.x.dest_url")).alias("dest_url"),
        F.col("p.x.is_dir").alias("is_dir"),
        F.col("p.x.attributes_only").alias("attributes_only"),
    )

