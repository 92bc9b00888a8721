"""Problem 5: texts that were cut off.

Per source, the lengths of all texts (in characters and in UTF-8 bytes) form a histogram. A log-normal length
distribution is fitted by maximum likelihood with the texts at a candidate limit right-censored (EM over the histogram).
Where more texts end at a length than the fit lets expect, the length is a limit, and the excess share is the censoring
posterior of its texts: their prior of being cut. Away from limits the prior is the rate of cuts in transfer, estimated
for each source. How cut and complete texts end is learned from the same
texts: expectation and maximisation over the counts of kinds of endings, by prior, starts from the texts at limits. A text
is cut if the log odds of its prior and its ending are positive, so the same ending may be cut at a limit and complete
elsewhere. A text that ends in an end mark is not cut, whatever its length.

Defined results: NULL and empty texts give no row; a text with several sources counts for each and is cut if any of them
says so; texts whose file has no known source are taken as one source; repeated rows count once;
without any limit the endings keep to their pseudo-counts and what the texts add to them.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartei.llm.encoding import undo_plain
from kartei.session import materialize

CLOSED, ELLIPSIS, PAGE, PATH, NUMBERS, ITEM, NAME, BLANK, SHORT, OPEN = "closed", "ellipsis", "page", "path", "numbers", "item", "name", "blank", "short", "open"
#: Kinds of endings with their pseudo-counts (times STRENGTH), in texts cut at any place and in complete ones. A place taken at random lies
#: within a sentence, mostly in plain text; a complete text ends in some mark of completeness.
KINDS = {CLOSED: (0.05, 8.0), ELLIPSIS: (1.0, 0.2), PAGE: (0.1, 0.5), PATH: (0.1, 0.5), NUMBERS: (0.1, 0.5), ITEM: (0.3, 0.5), NAME: (0.1, 0.5), BLANK: (2.0, 0.1), SHORT: (0.5, 0.2), OPEN: (10.0, 0.1)}
RATE, ROUNDS, SOURCE_WEIGHT, STRENGTH = 0.02, 100, 20.0, 5.0
MARKS, CLOSERS = ".!?。！？", "\"'”’»“)]\ufffd"
PAGE_MARK = re.compile(r"(?:[^\n]{0,40}\s)?\d+\s?/\s?\d+|[-–—]\s?\d+\s?[-–—]|(?:page|seite|p\.|s\.)\s?\d+", re.IGNORECASE)
NUMBER_LINE = re.compile(r"[\d\s.,;:|+\-–%/()€$]+")
LIST_ITEM = re.compile(r"\s*(?:[-*•–]|\d+[.)])\s+\S")
SIGNATURE = re.compile(r"[^\W\d_]+(?:[ -][^\W\d_]+){0,2}")
EXTENSION = re.compile(r"\w{1,5}")
BYTE_SLACK = 3  # a cut in bytes drops the rest of a character


def is_path(word: str) -> bool:
    """A word with a slash and, behind it, an extension at its end."""
    body, dot, end = word.rpartition(".")
    return bool(dot) and "/" in body and EXTENSION.fullmatch(end) is not None


def ending(text: str) -> str:
    """How a text ends, by its last two lines."""
    trimmed = text.rstrip()
    at = trimmed.rfind("\n")
    tail = undo_plain(trimmed[trimmed.rfind("\n", 0, max(at, 0)) + 1 :])
    before, _, last = tail.rpartition("\n")
    before, last = before.strip(), last.strip()
    body = last.rstrip(CLOSERS)
    if last.endswith(("…", "...")):
        return ELLIPSIS
    if not last or body[-1:] and body[-1] in MARKS:
        return CLOSED
    if PAGE_MARK.fullmatch(last):
        return PAGE
    if is_path(last.rsplit(None, 1)[-1]):
        return PATH
    if NUMBER_LINE.fullmatch(last):
        return NUMBERS
    if LIST_ITEM.match(last) and (LIST_ITEM.match(before) or before.endswith(":")):
        return ITEM
    if before and before.rstrip(CLOSERS)[-1:] not in MARKS and SIGNATURE.fullmatch(last) and last[:1].isupper() and len(before.split()) <= 5 and len(trimmed) == len(text):
        return NAME
    if len(trimmed) < len(text):
        return BLANK
    return SHORT if at >= 0 and len(last.split()) <= 2 else OPEN


def learn_endings(at_limits: list[tuple[float, str, int]], free: np.ndarray, sources: np.ndarray) -> dict[str, float]:
    """The log likelihood ratio of each kind of ending.

    at_limits: (prior, ending, texts); free: for sources, the texts away from any limit by ending, in the order of KINDS; sources: how
    many sources have those counts. Such texts have no prior but the rate of their source, which is estimated with the
    endings: what is common to all sources is how complete texts end, what differs between them is how many are cut.
    """
    pseudo = STRENGTH * np.array(list(KINDS.values())).T
    at = {k: i for i, k in enumerate(KINDS)}
    kind = np.array([at[e] for _, e, _ in at_limits], np.int64)
    fixed = np.array([p for p, *_ in at_limits], float)
    n = np.array([n for *_, n in at_limits], float)
    size = free.sum(axis=1)
    rate = np.full(len(free), RATE)
    mass = pseudo.copy()
    for _ in range(ROUNDS):
        p = mass / mass.sum(axis=1, keepdims=True)
        a, b = fixed * p[0, kind], (1 - fixed) * p[1, kind]
        r = a / (a + b)
        a, b = rate[:, None] * p[0], (1 - rate)[:, None] * p[1]
        cut = free * (a / (a + b))
        mass = pseudo + np.stack((np.bincount(kind, n * r, len(KINDS)) + sources @ cut, np.bincount(kind, n * (1 - r), len(KINDS)) + sources @ (free - cut)))
        rate = (RATE * SOURCE_WEIGHT + cut.sum(axis=1)) / (SOURCE_WEIGHT + size)
    p = mass / mass.sum(axis=1, keepdims=True)
    return dict(zip(KINDS, np.log(p[0] / p[1]).tolist(), strict=True))


def source_rate(endings: dict[str, int], ratio: dict[str, float]) -> float:
    """The rate of cuts of a source from its endings away from limits."""
    n, odds = np.array(list(endings.values()), float), np.exp([ratio[e] for e in endings])
    rate = RATE
    for _ in range(ROUNDS):
        r = rate * odds / (rate * odds + 1 - rate)
        rate = (RATE * SOURCE_WEIGHT + (n * r).sum()) / (SOURCE_WEIGHT + n.sum())
    return float(rate)


def fit_lognormal(x: np.ndarray, n: np.ndarray, limit: float | None, censored: float, rounds: int = 60) -> tuple[float, float]:
    """Mean and deviation of log length; ``censored`` further texts are only known to be longer than ``limit``."""
    y, n = np.log(x), n.astype(float)
    mu = float(np.average(y, weights=n)) if n.sum() else math.log(limit or 1)
    sd = max(0.05, float(np.sqrt(np.average((y - mu) ** 2, weights=n)))) if n.sum() else 0.5
    if not censored:
        return mu, sd
    c = math.log(limit)
    for _ in range(rounds):
        a = (c - mu) / sd
        tail = max(1e-12, 0.5 * math.erfc(a / math.sqrt(2)))
        hazard = math.exp(-a * a / 2) / math.sqrt(2 * math.pi) / tail
        m1 = mu + sd * hazard
        m2 = mu * mu + sd * sd + sd * (c + mu) * hazard
        total = n.sum() + censored
        new = (float((n * y).sum()) + censored * m1) / total
        var = (float((n * y * y).sum()) + censored * m2) / total - new * new
        mu, sd = new, math.sqrt(max(var, 0.0025))
    return mu, sd


def limits_of(length: np.ndarray, count: np.ndarray, slack: int, least: int = 4) -> list[tuple[int, int, float, float]]:
    """(limit, texts at it, expected there, censoring posterior) of a source's histogram of lengths."""
    order = np.argsort(length)
    x, n = length[order].astype(float), count[order].astype(float)
    total = n.sum()
    if total < 2 * least:
        return []
    # texts within slack below each length
    upto = np.cumsum(n)
    low = np.searchsorted(x, x - slack)
    at = upto - np.where(low > 0, upto[low - 1], 0)
    out = []
    mu, sd = fit_lognormal(x, n, None, 0)
    expected = total * (slack + 1) * np.exp(-((np.log(x) - mu) ** 2) / (2 * sd * sd)) / (x * sd * math.sqrt(2 * math.pi))
    # few lengths have so many more texts than the fit expects: a Poisson bound on the log tail
    surprise = at * np.log(np.maximum(at, 1e-9) / np.maximum(expected, 1e-9)) - (at - expected)
    for k in np.argsort(-surprise):
        if at[k] < least or surprise[k] < 12 or at[k] < 3 * expected[k] or any(abs(x[k] - lim) <= 2 * slack + 1 for lim, *_ in out):
            continue
        inside = (x <= x[k]) & (x >= x[k] - slack)
        mu, sd = fit_lognormal(x[~inside], n[~inside], x[k], float(at[k]))
        e = total * (slack + 1) * math.exp(-((math.log(x[k]) - mu) ** 2) / (2 * sd * sd)) / (x[k] * sd * math.sqrt(2 * math.pi))
        post = max(0.0, 1 - e / at[k])
        if post > 0.5:
            out.append((int(x[k]), int(at[k]), float(e), float(min(post, 0.999))))
    return out


def describe(df: DataFrame, key: str, text: str, urls: str, files: DataFrame, url: str, source: str) -> DataFrame:
    """(key, source, n_chars, n_bytes, ending) of every text and source of its files; texts themselves aren't shuffled."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "urls": b["urls"], "n_chars": b["t"].map(len), "n_bytes": b["t"].map(lambda t: len(t.encode("utf-8", "replace"))), "ending": b["t"].map(ending)})

    seen = df.where(F.length(text) > 0).select(key, F.col(text).alias("t"), F.col(urls).alias("urls"))
    seen = seen.mapInPandas(run, f"{key} {kind}, urls array<string>, n_chars int, n_bytes int, ending string").distinct()
    where = files.where(F.col(source).isNotNull() & F.col(url).isNotNull()).select(F.col(url).alias("one"), F.col(source).alias("source")).distinct()
    each = seen.withColumn("one", F.explode_outer("urls")).drop("urls").join(where, "one", "left").drop("one")
    return each.distinct()


def ending_ratios(seen: DataFrame) -> dict[str, float]:
    """learn_endings from (source, p, ending, n) of all sources; those with equal counts of endings are one row on the driver."""
    held = seen.where("p is not null").groupBy("p", "ending").agg(F.sum("n").alias("n")).orderBy("p", "ending").collect()
    away = seen.where("p is null").groupBy("source").agg(*[F.sum(F.when(F.col("ending") == k, F.col("n")).otherwise(0)).alias(k) for k in KINDS])
    alike = away.groupBy(*KINDS).agg(F.count(F.lit(1)).alias("sources")).toArrow().sort_by([(k, "ascending") for k in KINDS])
    free = np.array([alike[k].to_numpy() for k in KINDS], float).T
    return learn_endings([(r.p, r.ending, r.n) for r in held], free, alike["sources"].to_numpy().astype(float))


def judge(described: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, source, ending, at_limit, log_odds, cut) of every text and source, and the limits found.

    How texts end is learned from all sources; limits and rates are those of each source.
    """
    per = described.select("source", "ending", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length")))).alias("m"))
    hist = per.where("source is not null").groupBy("source", "m.unit", "m.length").agg(F.count(F.lit(1)).alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        source, unit = pdf["source"].iloc[0], pdf["unit"].iloc[0]
        found = limits_of(pdf["length"].to_numpy(), pdf["n"].to_numpy(), BYTE_SLACK if unit == "bytes" else 0)
        return pd.DataFrame([(source, unit, *f) for f in found], columns=["source", "unit", "limit", "texts_at", "expected", "posterior"])

    limits = materialize(hist.groupBy("source", "unit").applyInPandas(fit, "source string, unit string, limit int, texts_at int, expected double, posterior double"))
    # a limit in one unit shows as weaker ones in the other: the unit with the larger excess holds
    excess = limits.groupBy("source", "unit").agg(F.max(F.col("texts_at") - F.col("expected")).alias("e")).groupBy("source").agg(F.max_by("unit", "e").alias("unit"))
    limits = limits.join(excess, ["source", "unit"], "left_semi")
    by_source = limits.groupBy("source").agg(F.collect_list(F.struct("unit", "limit", "posterior")).alias("limits"))
    at = F.filter("limits", lambda x: F.when(x.unit == "chars", F.col("n_chars") == x.limit).otherwise(F.col("n_bytes").between(x.limit - BYTE_SLACK, x.limit)))
    placed = materialize(described.join(by_source, "source", "left").withColumn("post", F.array_max(F.transform(at, lambda x: x.posterior))).select(key, "source", "ending", "post"))
    seen = placed.groupBy("source", F.round("post", 2).alias("p"), "ending").agg(F.count(F.lit(1)).alias("n"))
    ratio = ending_ratios(seen)

    def rate_of(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": pdf["source"].iloc[:1], "rate": [source_rate(dict(zip(pdf["ending"], pdf["n"], strict=True)), ratio)]})

    rates = seen.where("p is null").groupBy("source").applyInPandas(rate_of, "s string, rate double")
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in ratio.items() for x in kv]), F.col("ending"))
    prior = F.coalesce("post", "rate", F.lit(RATE))
    judged = placed.join(rates, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("log_odds", F.ln(prior / (1 - prior)) + weight)
    return judged.select(key, "source", "ending", F.col("post").isNotNull().alias("at_limit"), "log_odds", ((F.col("log_odds") > 0) & (F.col("ending") != CLOSED)).alias("cut")), limits


def find_cut(df: DataFrame, key: str, text: str, urls: str, files: DataFrame, url: str, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The judged texts, the limits found, and the share of cut texts per source."""
    judged, limits = judge(materialize(describe(df, key, text, urls, files, url, source)), key)
    rates = judged.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut_texts"), F.count_if(F.col("cut") & F.col("at_limit")).alias("cut_at_limit")).withColumn("share", F.col("cut_texts") / F.col("texts"))
    top = limits.groupBy("source").agg(F.max_by(F.struct("limit", "unit"), "texts_at").alias("top"))
    return judged, limits, rates.join(top, "source", "left").select("source", "texts", "cut_texts", "cut_at_limit", "share", F.col("top.limit").alias("main_limit"), F.col("top.unit").alias("unit"))
