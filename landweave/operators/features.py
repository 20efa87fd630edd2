"""Feature vectors of record pairs (104 columns) and single records (54 columns), and schema-driven comparators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.functions import fuzzy, numeric, text
from landweave.session import lookup_join
from landweave.types import TEXT_FIELDS

# Names of the features, in their order.
PAIR_SUFFIXES = ("both_empty", "one_empty", "exact", "len_a", "len_b", "len_ratio", "ratio", "wratio", "token_sort", "token_set", "partial", "char3_jaccard", "token_overlap", "same_script", "cross_script")
AREA_SUFFIXES = ("exact", "both_empty", "one_empty", "relative_diff", "close_1pct", "close_5pct", "close_10pct")
CROSS = ("district_khasra_exact", "district_pargana_exact", "district_village_exact", "strong_cadastral_identity", "exact_field_count", "available_field_count", "exact_field_ratio")
PAIR_FEATURES = tuple(f"{f}__{s}" for f in TEXT_FIELDS for s in PAIR_SUFFIXES) + tuple(f"area__{s}" for s in AREA_SUFFIXES) + tuple(f"cross__{s}" for s in CROSS)
RECORD_FIELDS = ("village", "district", "khasra", "pargana", "tehsil", "block", "village_code", "district_code", "tehsil_code", "parcel_type", "development")
COUNTED_FIELDS = ("district", "village", "khasra", "pargana")
RECORD_FEATURES = (
    tuple(f"{f}__{s}" for f in RECORD_FIELDS for s in ("present", "length"))
    + ("identity__field_count", "identity__missing_count")
    + tuple(f"{f}__{s}" for f in COUNTED_FIELDS for s in ("value_length", "digit_count", "token_count"))
    + ("khasra__numeric", "khasra__has_slash", "khasra__has_dash", "khasra__has_alpha", "cross__district_present", "cross__village_present", "cross__pargana_present", "cross__strong_identity", "cross__admin_identity_count", "source__row_group")
    + tuple(f"{f}__{s}" for f in COUNTED_FIELDS for s in ("frequency", "rarity"))
)
_FUZZY = {"ratio": fuzzy.ratio_udf, "wratio": fuzzy.wratio_udf, "token_sort": fuzzy.token_sort_udf, "token_set": fuzzy.token_set_udf, "partial": fuzzy.partial_udf}


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def normalise_sides(pairs: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """Replace the text columns of both sides by their normal form, in one Arrow pass each."""
    return pairs.withColumns({f"{f}_{s}": text.norm_unicode(F.col(f"{f}_{s}")) for f in fields for s in ("a", "b")})


def pair_features(pairs: DataFrame, keys: list[str], fuzzy_columns: bool = True) -> DataFrame:
    """The 104 features (74 without the fuzzy ones) of pairs with columns ``<field>_a`` and ``<field>_b``.

    If either side of a text is empty, all similarities of that field are 0. Each family is a select of its own, so that no
    generated method grows beyond what the compiler accepts.
    """
    df = normalise_sides(pairs)
    out = {}
    for f in TEXT_FIELDS:
        a, b = F.col(f"{f}_a"), F.col(f"{f}_b")
        both = (a != "") & (b != "")
        la, lb = F.least(F.length(a), F.lit(100)), F.least(F.length(b), F.lit(100))
        sa, sb = text.script_type(a), text.script_type(b)
        out |= {
            f"{f}__both_empty": _flag((a == "") & (b == "")), f"{f}__one_empty": _flag((a == "") != (b == "")), f"{f}__exact": text.exact(a, b),
            f"{f}__len_a": la.cast("double"), f"{f}__len_b": lb.cast("double"),
            f"{f}__len_ratio": F.when(both, F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))).otherwise(0.0),
            f"{f}__char3_jaccard": F.when(both, text.jaccard(text.grams(a), text.grams(b))).otherwise(0.0),
            f"{f}__token_overlap": F.when(both, text.token_overlap(a, b)).otherwise(0.0),
            f"{f}__same_script": F.when(both, _flag(sa == sb)).otherwise(0.0), f"{f}__cross_script": F.when(both, _flag(sa != sb)).otherwise(0.0),
        }
        if fuzzy_columns:
            out |= {f"{f}__{n}": F.when(both, u(a, b)).otherwise(0.0) for n, u in _FUZZY.items()}
    df = df.withColumns(out)
    xa, xb = F.regexp_replace(F.coalesce(F.col("area_a").cast("string"), F.lit("")), r"[^0-9.\-]", ""), F.regexp_replace(F.coalesce(F.col("area_b").cast("string"), F.lit("")), r"[^0-9.\-]", "")
    na, nb = xa.try_cast("double"), xb.try_cast("double")
    relative = F.abs(na - nb) / F.greatest(F.abs(na), F.abs(nb), F.lit(1e-9))
    df = df.withColumns({
        "area__exact": text.exact(xa, xb), "area__both_empty": _flag((xa == "") & (xb == "")), "area__one_empty": _flag((xa == "") != (xb == "")),
        "area__relative_diff": F.coalesce(F.least(relative, F.lit(10.0)), F.lit(1.0)),
        **{f"area__close_{p}pct": _flag(relative <= p / 100) for p in (1, 5, 10)},
    })
    hit = {f: F.col(f"{f}__exact") for f in ("district", "khasra", "pargana", "village")}
    exacts = [F.col(f"{f}__exact") for f in TEXT_FIELDS] + [F.col("area__exact")]
    filled = [1 - F.col(f"{f}__both_empty") for f in (*TEXT_FIELDS, "area")]
    count, available = sum(exacts[1:], exacts[0]), sum(filled[1:], filled[0])
    df = df.withColumns({
        "cross__district_khasra_exact": hit["district"] * hit["khasra"], "cross__district_pargana_exact": hit["district"] * hit["pargana"], "cross__district_village_exact": hit["district"] * hit["village"],
        "cross__strong_cadastral_identity": _flag((hit["district"] > 0) & ((hit["khasra"] > 0) | (hit["pargana"] > 0) | (hit["village"] > 0))),
        "cross__exact_field_count": count, "cross__available_field_count": available, "cross__exact_field_ratio": count / F.greatest(available, F.lit(1.0)),
    })
    skip = set() if fuzzy_columns else {f"{f}__{n}" for f in TEXT_FIELDS for n in _FUZZY}
    return df.select(*keys, *[n for n in PAIR_FEATURES if n not in skip])


def field_frequencies(records: DataFrame, field: str) -> DataFrame:
    """(value, frequency) of the normalised, non-empty values of a field over all records."""
    return records.select(F.col(field).alias("value")).filter("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("frequency"))


def record_features(records: DataFrame, keys: list[str], row_group: str | None = None) -> DataFrame:
    """The 54 features of single records (columns of RECORD_FIELDS); frequencies are counted over all given records."""
    raw = records.withColumn("__khasra", text.safe(F.col("khasra")))
    df = raw.withColumns({f: text.norm_unicode(F.col(f)) for f in RECORD_FIELDS})
    for f in COUNTED_FIELDS:
        freq = field_frequencies(df, f).select(F.col("value").alias(f), F.col("frequency").alias(f"{f}__frequency"))
        df = lookup_join(df, freq, [f]).withColumn(f"{f}__frequency", F.coalesce(F.col(f"{f}__frequency"), F.lit(0)).cast("double"))
    present = {f: (F.col(f) != "").cast("double") for f in RECORD_FIELDS}
    total = sum(list(present.values())[1:], present[RECORD_FIELDS[0]])
    out = {}
    for f in RECORD_FIELDS:
        out |= {f"{f}__present": present[f], f"{f}__length": F.least(F.length(f), F.lit(100)).cast("double")}
    out |= {"identity__field_count": total, "identity__missing_count": F.lit(float(len(RECORD_FIELDS))) - total}
    for f in COUNTED_FIELDS:
        out |= {f"{f}__value_length": F.length(f).cast("double"), f"{f}__digit_count": F.regexp_count(F.col(f), F.lit(r"\p{Nd}")).cast("double"), f"{f}__token_count": F.size(text.tokens(F.col(f))).cast("double"), f"{f}__rarity": 1 / (1 + F.col(f"{f}__frequency"))}
    three = present["district"] + present["village"] + present["pargana"]
    out |= {
        "khasra__numeric": _flag(F.col("khasra").rlike(r"^\p{Nd}+(\.\p{Nd}*)?$|^\.\p{Nd}+$")), "khasra__has_slash": _flag(F.col("__khasra").contains("/")), "khasra__has_dash": _flag(F.col("__khasra").contains("-")), "khasra__has_alpha": _flag(F.col("khasra").rlike(r"\p{L}")),
        "cross__district_present": present["district"], "cross__village_present": present["village"], "cross__pargana_present": present["pargana"],
        "cross__strong_identity": present["district"] * present["village"] * present["khasra"], "cross__admin_identity_count": three,
        "source__row_group": F.coalesce(F.col(row_group).try_cast("double"), F.lit(0.0)) if row_group else F.lit(0.0),
    }
    return df.withColumns(out).select(*keys, *RECORD_FEATURES)


def evidence_names(features: tuple[str, ...] = PAIR_FEATURES, matched: float = 0.9, conflicting: float = 0.2) -> tuple[Column, Column]:
    """Names of the features at or above, and at or below, the cutoffs; every feature counts as a similarity here."""
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).alias("v")) for n in features])
    return F.transform(F.filter(pairs, lambda p: p["v"] >= matched), lambda p: p["n"]), F.transform(F.filter(pairs, lambda p: p["v"] <= conflicting), lambda p: p["n"])


# Comparators by name; numeric ones are used when either side parses as a number.
STRING_COMPARATORS: dict[str, Callable[[Column, Column], Column]] = {
    **dict.fromkeys(("exact", "equal", "match"), text.exact),
    **dict.fromkeys(("jaro", "jaro_winkler", "jw"), lambda a, b: fuzzy.jaro_winkler_udf(a, b)),
    **dict.fromkeys(("levenshtein", "lev", "edit", "ratio", "sim", "similarity"), text.levenshtein_ratio),
    **dict.fromkeys(("token_sort", "tokensort"), lambda a, b: fuzzy.token_sort_udf(a, b)),
    "prefix": text.prefix3,
}
NUMERIC_COMPARATORS: dict[str, Callable[[Column, Column], Column]] = {
    **dict.fromkeys(("ratio", "area_ratio"), numeric.ratio),
    **dict.fromkeys(("diff", "abs_diff", "absdiff"), numeric.absolute_difference),
    **dict.fromkeys(("rel_diff", "relative_diff", "pct_diff"), numeric.relative_difference),
    "log_ratio": numeric.log_ratio,
}
PRESENCE_COMPARATORS = ("both_present", "any_missing", "missing")


def parse_feature_name(name: str) -> tuple[str, str]:
    """(field, comparator) of a flat name; the longest comparator that ends the name counts."""
    for c in sorted({*STRING_COMPARATORS, *NUMERIC_COMPARATORS, *PRESENCE_COMPARATORS}, key=len, reverse=True):
        if name.endswith("_" + c):
            return name[: -len(c) - 1], c
    raise ValueError(f"unknown comparator in {name!r}")


def schema_features(pairs: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Features compiled from flat names such as ``village_jaro_winkler``; an unknown comparator fails before anything runs."""
    out = {}
    for name in names:
        field, c = parse_feature_name(name)
        a, b = F.col(f"{field}_a").cast("string"), F.col(f"{field}_b").cast("string")
        ta, tb = text.norm_link(a), text.norm_link(b)
        if c in PRESENCE_COMPARATORS:
            both = (ta != "") & (tb != "")
            out[name] = _flag(both if c == "both_present" else ~both)
            continue
        x, y = text.to_number(a), text.to_number(b)
        number = F.coalesce(NUMERIC_COMPARATORS[c](x, y), F.lit(0.0)) if c in NUMERIC_COMPARATORS else None
        string = STRING_COMPARATORS[c](ta, tb) if c in STRING_COMPARATORS else F.lit(0.0)
        out[name] = string if number is None else F.when(x.isNotNull() | y.isNotNull(), number).otherwise(string)
    return pairs.select(*keys, *[v.alias(k) for k, v in out.items()])
