"""From raw monitor events to queue events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartei.functions.text import extension_changed


def translate(events: DataFrame) -> DataFrame:
    """Raw events to notifier events: (seq, part, op, file_url, dest_url, is_dir, attributes_only).

    events carry what the eligibility operators say: indexable, dest_indexable, parent_indexable and source_monitored.
    A new file that makes its folder ineligible deletes the folder; a move out of sight is a deletion, one into sight an
    update of the destination; a moved file first deletes what it replaces, and is updated if its ending changed.
    """
    parent = F.regexp_replace("file_url", r"/[^/]*$", "")

    def event(op: str, url: Column, dest: Column | None = None, is_dir: Column | None = None, attributes: Column | None = None) -> Column:
        return F.struct(F.lit(op).alias("op"), url.alias("file_url"), (F.lit(None).cast("string") if dest is None else dest).alias("dest_url"), (F.col("is_dir") if is_dir is None else is_dir).alias("is_dir"), (F.lit(False) if attributes is None else attributes).alias("attributes_only"))

    f, d = F.col("file_url"), F.col("dest_url")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    none = F.array().cast("array<struct<op:string,file_url:string,dest_url:string,is_dir:boolean,attributes_only:boolean>>")
    created = (
        F.when(~yes("is_dir") & ~yes("parent_indexable"), F.array(event("DELETED", parent, is_dir=F.lit(True))))
        .when(yes("indexable"), F.array(event("CREATED", f)))
        .otherwise(none)
    )
    plain = F.when(yes("indexable"), F.array(F.struct(F.col("op"), f.alias("file_url"), F.lit(None).cast("string").alias("dest_url"), F.col("is_dir"), yes("attributes_only").alias("attributes_only")))).otherwise(none)
    replaced = F.when(~yes("is_dir"), F.array(event("DELETED", d))).otherwise(none)
    renamed = F.when(extension_changed(f, d), F.array(event("UPDATED", d))).otherwise(none)
    moved = (
        F.when(~yes("source_monitored"), none)
        .when(~yes("indexable") & yes("dest_indexable"), F.array(event("UPDATED", d)))
        .when(~yes("indexable"), none)
        .when(~yes("dest_indexable"), F.array(event("DELETED", f)))
        .otherwise(F.concat(replaced, F.array(event("MOVED", f, d)), renamed))
    )
    out = F.when(F.col("op") == "CREATED", created).when(F.col("op") == "MOVED", moved).when(F.col("op").isin("UPDATED", "DELETED"), plain).otherwise(none)
    return events.select("seq", F.posexplode(out).alias("part", "e")).select("seq", "part", "e.*")


def pair_moves(events: DataFrame, most_apart: int = 1) -> DataFrame:
    """MOVED_FROM and MOVED_TO of neighbouring sequence numbers as one MOVED; a lone one is a DELETED or a CREATED.

    Neighbours meet in an equi join on the sequence number, so no ordering of the whole stream is needed.
    """
    src = events.where("op = 'MOVED_FROM'").select(F.col("seq").alias("from_seq"), F.col("file_url").alias("src"))
    dst = events.where("op = 'MOVED_TO'").select("seq", "file_url", "is_dir", F.explode(F.sequence(F.col("seq") - most_apart, F.col("seq") - 1)).alias("from_seq"))
    met = dst.join(src, "from_seq").groupBy("seq", "file_url", "is_dir").agg(F.max_by(F.struct("from_seq", "src"), "from_seq").alias("m"))
    moves = met.select("seq", F.lit("MOVED").alias("op"), F.col("m.src").alias("file_url"), F.col("file_url").alias("dest_url"), "is_dir")
    used = met.select(F.explode(F.array("seq", "m.from_seq")).alias("seq"))
    rest = events.join(used, "seq", "left_anti").select("seq", F.when(F.col("op") == "MOVED_FROM", "DELETED").when(F.col("op") == "MOVED_TO", "CREATED").otherwise(F.col("op")).alias("op"), "file_url", F.lit(None).cast("string").alias("dest_url"), "is_dir")
    return moves.unionByName(rest)
