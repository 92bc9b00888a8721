"""Problem 7: records mixed by source to target shares of the total size.

Sizes are tokens of a public tokenizer. Tokens are counted once and summed per source; the total is the largest one for
which every source reaches its share within its repeats (or a given one); rate = target tokens / tokens of the source,
capped. Each record is used floor(rate) times, and once more if a hash of its id and the seed, read as a number in
[0, 1), is below the fraction.

Defined results: NULL texts have no tokens, are never used and count for nothing; sources without a target, or without
tokens, are not used, and the latter are reported with share 0; a share of 0 uses nothing; the same ids and seed give the
same mix in any partitioning.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartei.session import materialize

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
MOST_BROADCAST_SOURCES = 100_000


def split_pattern(folder: str = TOKENIZERS) -> str:
    """The pattern by which the folder's byte-level tokenizers split texts, on the driver."""
    spec = importlib.util.spec_from_file_location("_public_tokenizers", Path(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


@functools.cache
def encoding(path: str = f"{TOKENIZERS}/{VOCABULARY}", pattern: str | None = None):
    """The tokenizer of a rank file."""
    import tiktoken

    lines = Path(path).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
    return tiktoken.Encoding(Path(path).name, pat_str=pattern or split_pattern(str(Path(path).parent)), mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, into: str = "n_tokens", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """df with the number of tokens of a text column; 0 for NULL.

    The folder need only exist on the driver, which serves the file to the executors.
    """
    df.sparkSession.sparkContext.addFile(str(Path(folder, name)))
    pattern = split_pattern(folder)

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        enc = encoding(SparkFiles.get(name), pattern)
        return s.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return df.withColumn(into, count(F.col(text)))


def rates(sizes: DataFrame, targets: DataFrame, source: str, share: str, repeats: str, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, source_tokens, total, rate) of every source with a target."""
    joined = targets.select(F.col(source), F.col(share).alias("target_share"), F.col(repeats).alias("max_repeats")).where(F.col(source).isNotNull()).distinct().join(sizes, source, "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    most = F.when((F.col("target_share") > 0) & (F.col("source_tokens") > 0), F.col("source_tokens") * F.col("max_repeats") / F.col("target_share"))
    total = joined.agg(F.coalesce(F.lit(total_tokens).cast("double"), F.min(most), F.lit(0.0)).alias("total"))
    rate = F.when(F.col("source_tokens") > 0, F.least(F.col("total") * F.col("target_share") / F.col("source_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return joined.withColumn("total", total.scalar()).withColumn("rate", F.coalesce(rate, F.lit(0.0)))


def mix(docs: DataFrame, doc_id: str, text: str, source: str, targets: DataFrame, share: str = "target_share", repeats: str = "max_repeats", total_tokens: int | None = None, seed: int = 17, folder: str = TOKENIZERS, name: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The used records (doc, source, n_tokens, uses) and the shares per source.

    Rates have one row a source; up to MOST_BROADCAST_SOURCES of them are broadcast, so a source with a third of all
    records is not shuffled; more are joined by shuffle, where adaptive execution splits what is skewed. Records carry
    their id, source and size, never their text.
    """
    sized = count_tokens(docs.select(doc_id, source, text).where(F.col(text).isNotNull()), text, "n_tokens", folder, name).select(doc_id, source, "n_tokens")
    sized = materialize(sized.where("n_tokens > 0"))
    sizes = sized.groupBy(source).agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("records"))
    rate = materialize(rates(sizes, targets, source, share, repeats, total_tokens))
    draw = F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.lit(seed)), 11) / F.lit(float(1 << 53))
    wanted = rate.select(source, "rate").where("rate > 0")
    if wanted.count() <= MOST_BROADCAST_SOURCES:  # one row a source; counted, so the hint has a bound
        wanted = F.broadcast(wanted)
    used = sized.join(wanted, source).withColumn("uses", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("int"))
    used = used.where("uses > 0").select(doc_id, source, "n_tokens", "uses")
    actual = used.groupBy(source).agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
    whole = actual.agg(F.sum("used_tokens").alias("all_tokens"))
    shares = rate.join(actual, source, "left").withColumn("all_tokens", whole.scalar())
    shares = shares.select(source, "target_share", "max_repeats", "source_tokens", "rate", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce(F.col("used_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))
    return used, shares
