"""Text functions as column expressions; Arrow functions only where Unicode normalisation is needed."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collapse(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s+", " ")


def norm_link(c: Column) -> Column:
    """Linking form: trimmed, blanks squeezed, without case; null becomes empty."""
    return F.coalesce(F.lower(collapse(c)), F.lit(""))


def norm_conflict(c: Column) -> Column:
    return F.lower(collapse(c))


def safe(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


@F.pandas_udf(T.StringType())
def norm_ascii(s: pd.Series) -> pd.Series:
    """NFKD without accents, lower case, anything but letters, digits and blanks as a blank, squeezed."""
    return s.map(lambda t: None if t is None else " ".join(re.sub(r"[^0-9a-z ]+", " ", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()).split()))


@F.pandas_udf(T.StringType())
def norm_unicode(s: pd.Series) -> pd.Series:
    """NFKC, lower case, separators as blanks, other signs dropped (Devanagari kept), squeezed; null becomes empty."""

    def one(t: str | None) -> str:
        if t is None or t != t:
            return ""
        t = re.sub(r"[_\-/\\]+", " ", unicodedata.normalize("NFKC", str(t)).lower())
        return " ".join(re.sub(r"[^\w\sऀ-ॿ]", "", t).split())

    return s.map(one)


def norm_key(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), " -", "__")


def to_number(c: Column) -> Column:
    """Number of a text once commas are dropped; null for anything that is not a plain number."""
    t = F.replace(F.trim(c), F.lit(","), F.lit(""))
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def clean_number(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")


def script_type(c: Column) -> Column:
    d, latin = c.rlike("[ऀ-ॿ]"), c.rlike("[A-Za-z]")
    return F.when(c.isNull() | (F.trim(c) == ""), "empty").when(d & latin, "mixed").when(d, "devanagari").when(latin, "latin").otherwise("other")


def exact(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (a == b), F.lit(False)).cast("double")


def prefix3(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (b != "") & (F.left(a, F.lit(3)) == F.left(b, F.lit(3))), F.lit(False)).cast("double")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def grams(c: Column, n: int = 3) -> Column:
    """Distinct runs of n letters; a shorter text is its own only run, an empty one has none."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.length(c) < n, F.array(c)).otherwise(F.array_distinct(runs))


def jaccard(x: Column, y: Column, floor: int = 1) -> Column:
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(floor))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != "")


def token_overlap(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(tokens(a)), F.array_distinct(tokens(b)))


def first_present(m: Column, *keys: str) -> Column:
    """Value of the first key that is present, even if null there; null when none is."""
    out = F.when(F.map_contains_key(m, keys[0]), F.try_element_at(m, F.lit(keys[0])))
    for k in keys[1:]:
        out = out.when(F.map_contains_key(m, k), F.try_element_at(m, F.lit(k)))
    return out


def falsy_to_null(c: Column) -> Column:
    """Empty, zero and false texts become null."""
    return F.when(~F.coalesce(c.isin("", "0", "0.0", "false", "False"), F.lit(True)), c)


def parse_time(c: Column) -> Column:
    """ISO date or date-time; null when it is none."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(t))


def stem_clean(c: Column) -> Column:
    """File stem without the usual image and mask suffixes, removed one after the other."""
    out = F.lower(F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.[^.]*$", ""))
    for suffix in ("_mask", "-mask", "_label", "-label", "_image", "-image", "_img"):
        out = F.regexp_replace(out, suffix, "")
    return out
