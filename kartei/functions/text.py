"""Text functions as column expressions."""

from __future__ import annotations

import functools
import unicodedata as ud

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"^\s+|\s+$"


@functools.cache
def accents() -> tuple[str, str]:
    """Lower-case letters with accents and their base letters, for translate; made from the interpreter's Unicode data."""
    pairs = {}
    for c in range(0xC0, 0x2000):
        ch = chr(c).lower()
        base = ud.normalize("NFD", ch)
        if len(ch) == 1 and len(base) > 1 and not ud.combining(base[0]) and all(ud.combining(x) for x in base[1:]):
            pairs[ch] = base[0]
    return "".join(pairs), "".join(pairs.values())


def fold(x: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.regexp_replace(F.lower(x), r"\p{Mn}", ""), *accents())


def is_blank(x: Column) -> Column:
    """NULL, empty, or blanks only."""
    return F.coalesce(F.regexp_replace(x, r"(?U)\s", "") == "", F.lit(True))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def coalesce_strip(*cols: Column) -> Column:
    """The first value that isn't blank, without blanks at its ends."""
    return F.coalesce(*[F.when(~is_blank(c), strip(c)) for c in cols])


def merge(delimiter: str, *cols: Column) -> Column:
    """The values that aren't NULL, joined; NULL if there are none. Empty strings are kept."""
    return F.when(functools.reduce(lambda a, b: a | b, [c.isNotNull() for c in cols]), F.concat_ws(delimiter, *cols))


def normalize_words(x: Column, max_words: int) -> Column:
    """Letters only, runs of anything else as one blank, at most so many words."""
    words = F.filter(F.split(x, r"[^\p{L}]+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, max_words), " ")


def ellipsize(x: Column, n: int, at_end: bool = True) -> Column:
    """Texts of n or more characters are cut to n with an ellipsis; shorter ones are kept."""
    cut = F.concat(F.left(x, F.lit(n - 1)), F.lit("…")) if at_end else F.concat(F.lit("…"), F.right(x, F.lit(n - 1)))
    return F.when(F.length(x) < n, x).otherwise(cut)


def keywords(x: Column) -> Column:
    """Keywords split at commas and semicolons, quotes and one blank at the ends removed, without repeats, in order."""
    inner = F.regexp_replace(F.regexp_replace(x, r'^[^"]*"', ""), r'"\s*$', "")
    text = F.when(F.contains(x, F.lit('"')), inner).otherwise(x)
    return F.array_distinct(F.transform(F.filter(F.split(text, "[,;]"), lambda k: k != ""), lambda k: F.regexp_replace(k, "^ | $", "")))


def title_from_name(name: Column) -> Column:
    """A title from a file name: without its ending, underscores as blanks."""
    return F.translate(F.when(F.startswith(name, F.lit(".")), F.substring(name, 2, 1 << 30)).otherwise(F.regexp_replace(name, r"\.[^.]*$", "")), "_", " ")


def same_name_without_extension(a: Column, b: Column) -> Column:
    """Names equal without their endings, in any letter case."""
    bare = lambda x: F.lower(F.regexp_replace(x, r"\.[^.]*$", ""))
    return bare(a) == bare(b)


def extension(x: Column) -> Column:
    """The ending after the last dot of the last step, with the dot; NULL if there is none."""
    return F.nullif(F.regexp_extract(x, r"\.[^./]*$", 0), F.lit(""))


def extension_changed(a: Column, b: Column) -> Column:
    return ~F.equal_null(extension(a), extension(b))


def tokens(x: Column, longest: int = 200) -> Column:
    """Folded words of letters and digits, in order; longer ones are not indexed."""
    return F.filter(F.split(fold(x), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 0) & (F.length(w) <= longest))
