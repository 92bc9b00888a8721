"""Queries of the text operators over the test tables. Each covers its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartei.llm import canonical, encoding, language, leakage, lookalike, mixing, toxicity, truncation


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows whose titles look the same and differ."""
    return lookalike.lookalike_pairs(_read(spark, sf_dir, "ies"), "urn", "title").select("urn_a", "urn_b")


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title in its consistent form."""
    return lookalike.with_form(_read(spark, sf_dir, "ies").select("urn", "title"), "title", "title_form").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genre entries meant by freely typed genres."""
    mapped = canonical.map_rows(_read(spark, sf_dir, "ies"), "urn", "genre", _read(spark, sf_dir, "genres"), "genre_id", "pref_label", "alt_labels")
    return mapped.select("urn", F.col("entry").cast("int").alias("genre_id"))


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that name no entry, with the rows that hold them."""
    ies = _read(spark, sf_dir, "ies").select("urn", "genre").distinct()
    mapped = canonical.map_values(ies, "genre", _read(spark, sf_dir, "genres"), "genre_id", "pref_label", "alt_labels").where("entry = -1")
    held = ies.where("genre is not null").groupBy("genre").agg(F.count(F.lit(1)).alias("rows"))
    return held.join(mapped.select(F.col("value").alias("genre")), "genre")


FIELDS = {"title": "title", "ie_comment": "comment", "plain_text": "plain_text"}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with text that was decoded with a wrong encoding."""
    return encoding.find_garbled(_read(spark, sf_dir, "ies"), "urn", FIELDS).select("urn", "field_name").distinct()


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fields with the chain of encodings and the restored text."""
    return encoding.find_garbled(_read(spark, sf_dir, "ies"), "urn", FIELDS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of texts whose label is missing or wrong or that mix languages."""
    return language.find_label_errors(_read(spark, sf_dir, "ies"), "urn", "plain_text", "ie_language").select("urn", "lang").distinct()


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every segment of every text."""
    return language.segments(_read(spark, sf_dir, "ies"), "urn", "plain_text", "ie_language")


def _cut(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return truncation.find_cut(_read(spark, sf_dir, "ies"), "urn", "plain_text", "stored_as", _read(spark, sf_dir, "files"), "url", "data_source")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text was cut."""
    return _cut(spark, sf_dir)[0].where("cut").select("urn").distinct()


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut texts per source, with the limit found."""
    return _cut(spark, sf_dir)[2]


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(_read(spark, sf_dir, "documents"), "doc_id", "text", _read(spark, sf_dir, "eval_items"), "item_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items that leaked into them."""
    return _leaks(spark, sf_dir).where("leaked").select("doc_id", "item_id").distinct()


def p6_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an edited copy of a test item, by alignment, that is not a leak word for word."""
    return _leaks(spark, sf_dir).where("edited").select("doc_id", "item_id", "score").distinct()


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each test item the documents it leaked into, whole or in part, and the best alignment."""
    found = _leaks(spark, sf_dir).groupBy("item_id").agg(F.count_if("leaked").alias("documents"), F.count_if(~F.col("leaked")).alias("partly"), F.max("score").alias("best_score"))
    items = _read(spark, sf_dir, "eval_items").select("item_id", "eval_set").distinct()
    return items.join(found, "item_id", "left").select("item_id", "eval_set", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("partly", F.lit(0)).alias("partly"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_read(spark, sf_dir, "documents"), "doc_id", "text", "source", _read(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen records with their number of uses."""
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares per source."""
    return _mix(spark, sf_dir)[1]


def _toxic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), "doc_id", "text", "source", _read(spark, sf_dir, "moderation_samples"), "text", "is_abusive")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an abusive, hateful or explicit sentence."""
    return _toxic(spark, sf_dir)[0].where("flagged").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    return _toxic(spark, sf_dir)[0].select("doc_id", "source", "score", "best", "passages", "flagged")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of such documents per source."""
    return _toxic(spark, sf_dir)[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_found, p1_forms, p2_found, p2_unmatched, p3_found, p3_restored, p4_found, p4_segments, p5_found, p5_rates, p6_found, p6_edited, p6_items, p7_mix, p7_shares, p8_found, p8_scores, p8_rates)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """SQL twins: the exact part of problem 6 is expressible; the others are tested in tests/llm."""
    words = r"[x for x in regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+') if x <> '']"
    return {
        "p6_found": f"""
with i as (select distinct item_id, {words.format('text')} as w from eval_items),
ig as (select item_id, len(w) as n, k, array_to_string(w[k:k+7], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 6)) as k from i)),
d as (select doc_id, {words.format('text')} as w from documents),
dg as (select distinct doc_id, array_to_string(w[k:k+7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as k from d)),
hit as (select distinct doc_id, item_id, n, k from dg join ig using (g)),
cov as (select doc_id, item_id, n, count(distinct k + j) as c from (select *, unnest(range(0, 8)) as j from hit) group by all)
select doc_id, item_id from cov where 2 * c >= n"""
    }
