"""Quantities in different units: unit texts are segmented over tries once per distinct pattern, then joined back."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.session import cut, lookup_join, maybe_broadcast

# Spellings of scales, square marks, SI prefixes, roots and exponents, each with its log prior.
SCALES = {"k": (1e3, -1.5), "'000": (1e3, -0.5), "000": (1e3, -1.0), "thousand": (1e3, -0.5), "hundred": (1e2, -0.5), "lakh": (1e5, -0.5), "lac": (1e5, -0.8), "lakhs": (1e5, -0.5), "million": (1e6, -0.5), "crore": (1e7, -0.5), "हजार": (1e3, -0.5), "लाख": (1e5, -0.5)}
SQUARE = {"sq": -0.2, "square": -0.2, "s": -1.5, "sqr": -0.3, "वर्ग": -0.2}
SI = {"k": (1e3, -0.4), "kilo": (1e3, -0.3), "h": (1e2, -1.5), "hecto": (1e2, -0.5), "d": (1e-1, -2.0), "c": (1e-2, -0.8), "centi": (1e-2, -0.4), "m": (1e-3, -1.2), "milli": (1e-3, -0.5)}
LINEAR = {
    "sq_m": ("m", "mt", "mts", "mtr", "mtrs", "metre", "metres", "meter", "meters", "मीटर", "मी"),
    "sq_ft": ("ft", "feet", "foot", "फुट", "फीट", "फ़ुट"),
    "sq_yd": ("yd", "yds", "yard", "yards", "gaj", "गज", "guz"),
}
AREA = {
    "hectare": ("ha", "hect", "hectare", "hectares", "हेक्टेयर", "हे"),
    "acre": ("ac", "acr", "acre", "acres", "acre(s)", "एकड़", "एकड"),
    "are": ("a", "are", "ares", "आर"),
    "cent": ("cent", "cents", "सेंट"),
    "guntha": ("guntha", "gunthas", "gunta", "guntas", "गुंठा"),
    "bigha": ("bigha", "bighas", "bgh", "बीघा"),
    "biswa": ("biswa", "biswas", "बिस्वा"),
    "biswansi": ("biswansi", "biswansis", "बिस्वांसी"),
    "sq_yd": ("gaj", "गज"),  # a length by itself, an area by custom
}
#: Letters that stand for a unit only beside others of its family ("2A-10G", "1B 5Bw 3Bs").
COMPOUND = {"a": "acre", "g": "guntha", "b": "bigha", "bw": "biswa", "bs": "biswansi"}
EXPONENT = {"2": -0.1, "^2": -0.1, "**2": -0.2}
FAMILIES = (("acre", "guntha", "cent"), ("bigha", "biswa", "biswansi"), ("sq_km", "hectare", "are", "sq_m"))
LABELS = ("area", "approx", "about", "total", "extent", "रकबा", "क्षेत्रफल", "~", "ca")
_SEPARATORS = " .-_/:;,"
#: A number of an extent text; not a multiplier such as '000 and not an exponent glued to letters.
NUMBER = r"(?<![\p{L}'’^.,\d])\d+(?:[.,]\d+)*"


def _trie() -> dict:
    root: dict = {}

    def put(word: str, item: tuple) -> None:
        node = root
        for ch in unicodedata.normalize("NFKC", word):
            node = node.setdefault(ch, {})
        node.setdefault("", []).append(item)

    for w, (x, s) in SCALES.items():
        put(w, ("scale", x, s))
    for w, s in SQUARE.items():
        put(w, ("square", None, s))
    for w, (x, s) in SI.items():
        put(w, ("si", x, s))
    for code, words in LINEAR.items():
        for w in words:
            put(w, ("linear", code, -1.0 if len(w) == 1 else -0.2))
    for code, words in AREA.items():
        for w in words:
            put(w, ("area", code, -2.0 if len(w) == 1 else -0.2))
    for w, code in COMPOUND.items():
        put(w, ("letter", code, -1.0))
    for w, s in EXPONENT.items():
        put(w, ("exponent", None, s))
    return root


_TRIE = _trie()


def segment(text: str, compound: bool = False, dimension: int = 2) -> dict[tuple[str, float], float]:
    """Every reading (unit code, multiplier) of a unit text with its best log score.

    Dynamic programming over positions; the state says what has been read: 0 nothing but scales, 1 a square mark,
    2 an SI prefix, 3 a root of length, 4 a whole unit. ``dimension`` is the field's prior: a reading of any
    other dimension is refused, and single letters count as units only in a ``compound``.
    """
    n = len(text)
    best: list[dict[tuple, float]] = [{} for _ in range(n + 1)]
    best[0][(0, "", 1.0, 0)] = 0.0  # state, code, multiplier, dimension

    def relax(i: int, key: tuple, score: float) -> None:
        if score > best[i].get(key, -1e9):
            best[i][key] = score

    for i in range(n):
        for (state, code, mult, dim), score in list(best[i].items()):
            if text[i] in _SEPARATORS or text[i] in "()":
                if state != 2:  # an SI prefix is written together with its root
                    relax(i + 1, (state, code, mult, dim), score)
            node, j = _TRIE, i
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                for kind, value, prior in node.get("", ()):
                    s = score + prior - 0.5
                    glued = j < n and text[j] not in _SEPARATORS
                    if kind == "scale" and state == 0:
                        relax(j, (0, code, mult * value, dim), s - (2.0 if glued and len(text[i:j]) == 1 else 0.0))
                    elif kind == "square" and state == 0:
                        relax(j, (1, code, mult, 2), s)
                    elif kind == "si" and state in (0, 1) and glued:
                        relax(j, (2, code, mult * value**2, dim), s)
                    elif kind == "linear" and (state in (0, 1) or state == 2):
                        relax(j, (4 if dim == 2 else 3, value, mult, dim or 1), s)
                    elif kind == "area" and state == 0:
                        relax(j, (4, value, mult, 2), s)
                    elif kind == "letter" and state == 0 and compound:
                        relax(j, (4, value, mult, 2), s)
                    elif kind == "exponent" and state == 3:
                        relax(j, (4, code, mult, 2), s)
    out: dict[tuple[str, float], float] = {}
    for (state, code, mult, dim), score in best[n].items():
        if state in (3, 4) and dim == dimension:
            out[(code, mult)] = max(score, out.get((code, mult), -1e9))
    return out


@lru_cache(maxsize=100_000)
def unit_of(text: str, dimension: int = 2) -> tuple[str, float] | None:
    """The best reading of a unit text, or None when there is none or two readings tie."""
    found = sorted(segment(_plain(text), False, dimension).items(), key=lambda kv: -kv[1])
    if not found or (len(found) > 1 and found[0][1] - found[1][1] < 1e-9):
        return None
    return found[0][0]


def _plain(text: str) -> str:
    out = unicodedata.normalize("NFKC", text).casefold().replace("’", "'").strip()
    for label in LABELS:
        out = re.sub(rf"(?:^|(?<=\s)){re.escape(label)}(?=$|[\s:.#])\s*[:.]?\s*", "", out)
    return out.strip()


def read_pattern(pattern: str, unit: str | None, default: str | None) -> list[tuple[int, str, float]] | None:
    """Terms (index of the number, unit code, multiplier) of an extent whose numbers are written as ``#``.

    A unit in the pattern holds over ``unit``; with neither, ``default`` applies. None: no known unit.
    """
    text = _plain(pattern)
    count = text.count("#")
    if count == 0:
        return None
    if m := re.fullmatch(r"#(?:\s*[-/:]\s*#)+\s*\(?\s*([^#()]+)\)?", text):
        units = [unit_of(u) for u in re.split(r"[-/:]", m[1])]
        if len(units) == count and all(units):
            return [(i, u[0], u[1]) for i, u in enumerate(units)]
        return None
    first, *rest = text.split("#")
    if count == 1:
        stated = " ".join(x for x in (first.strip(" -:="), rest[0].strip(" -:=")) if x)
        if stated:
            found = unit_of(stated)
        elif unit is not None and unit.strip():
            found = unit_of(unit)
        elif default is not None and default.strip():
            found = unit_of(default.replace("_", " "))
        else:
            found = None
        return [(0, found[0], found[1])] if found else None
    if first.strip(_SEPARATORS):
        return None
    options = [segment(x.strip(_SEPARATORS + " "), True) for x in rest]
    best: tuple[float, list] | None = None
    for family in FAMILIES:
        # best score of the parts read so far by the unit read last: units of one family follow in falling order
        states: dict[int, tuple[float, list]] = {-1: (0.0, [])}
        for i, option in enumerate(options):
            step: dict[int, tuple[float, list]] = {}
            for (code, mult), score in option.items():
                if code not in family:
                    continue
                at = family.index(code)
                for last, (total, terms) in states.items():
                    if last < at and (at not in step or total + score > step[at][0]):
                        step[at] = (total + score, [*terms, (i, code, mult)])
            states = step
            if not states:
                break
        for score, terms in states.values():
            if best is None or score > best[0]:
                best = (score, terms)
    return best[1] if best else None


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        terms = [read_pattern(p, u, d) for p, u, d in zip(pdf["__u_pattern"], pdf["__u_unit"], pdf["__u_default"], strict=True)]
        yield pdf.assign(__u_terms=[None if t is None else [{"ix": i, "unit": c, "mult": m} for i, c, m in t] for t in terms])


def _digits(c: Column) -> Column:
    return F.translate(c, "०१२३४५६७८९", "0123456789")


def _number(text: Column, mark: Column) -> Column:
    dotted = F.when(mark == ",", F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(","), F.lit("")))
    return dotted.try_cast("double")


def normalise_areas(df: DataFrame, sources: DataFrame, area_units: DataFrame, *, area: str = "area", unit: str = "area_unit", raw: str = "area_raw", source: str = "source_system", district: str = "district") -> DataFrame:
    """Add ``area_sqm`` (double, null where no positive extent in a known unit stands) to every row.

    Numbers of ``raw`` follow the source's ``decimal_mark``; a text without any number falls back to ``area``.
    Null, blank, unknown or tied units, zero, negative, NaN and infinite extents give null. ``area_units`` rows
    with a null ``district`` hold everywhere; others for their district in any case; biswa and biswansi follow
    from bigha (1/20, 1/400) where only that is listed. An existing column ``area_sqm`` is replaced.
    """
    per_source = sources.select(F.col("source_system").alias("__u_src"), F.col("default_area_unit").alias("__u_default"), F.col("decimal_mark").alias("__u_mark")).dropDuplicates(["__u_src"])
    text = _digits(F.coalesce(F.col(raw), F.lit("")))
    keyed = df.withColumns({"__u_src": F.col(source), "__u_text": text, "__u_unit": F.coalesce(F.trim(F.col(unit)), F.lit("")), "__u_district": F.lower(F.trim(F.col(district)))}).drop("area_sqm")
    keyed = keyed.join(maybe_broadcast(per_source), "__u_src", "left").withColumn("__u_default", F.coalesce("__u_default", F.lit("")))
    keyed = keyed.withColumn("__u_texts", F.regexp_extract_all("__u_text", F.lit(NUMBER), 0))
    has_raw = F.size("__u_texts") > 0
    keyed = keyed.withColumns({
        "__u_numbers": F.when(has_raw, F.transform("__u_texts", lambda x: _number(x, F.col("__u_mark")))).otherwise(F.array(F.col(area).cast("double"))),
        "__u_pattern": F.when(has_raw, F.when(F.col("__u_text").rlike(r"^\s*[-−]\s*\d"), F.lit("negative")).otherwise(F.trim(F.regexp_replace("__u_text", NUMBER, "#")))).otherwise(F.lit("#")),
    }).drop("__u_text", "__u_texts", "__u_mark", "__u_src")
    key = ["__u_pattern", "__u_unit", "__u_default"]
    patterns = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("__u_n"))
    terms = patterns.mapInPandas(_read_batches, "__u_pattern string, __u_unit string, __u_default string, __u_n long, __u_terms array<struct<ix int, unit string, mult double>>").filter("__u_terms is not null")
    terms = cut(terms)  # read once: its size is asked for before the join
    keyed = lookup_join(keyed, terms, key, counts="__u_n")

    known = area_units.select(F.lower(F.trim("district")).alias("__u_district"), F.col("unit_code").alias("code"), F.col("sqm_per_unit").alias("x")).filter("code is not null and x > 0")
    per_district = known.filter("__u_district is not null").groupBy("__u_district", "code").agg(F.max("x").alias("x")).groupBy("__u_district").agg(F.map_from_entries(F.collect_list(F.struct("code", "x"))).alias("__u_local"))
    codes = sorted({*LINEAR, *AREA})
    everywhere = known.filter(F.col("__u_district").isNull() & F.col("code").isin(codes)).groupBy("code").agg(F.max("x").alias("x")).collect()  # at most as many rows as codes
    general = F.create_map(*[F.lit(v) for r in everywhere for v in (r["code"], r["x"])]) if everywhere else F.create_map().cast("map<string,double>")
    keyed = lookup_join(keyed, per_district, ["__u_district"])

    def factor(code: Column) -> Column:
        local = F.col("__u_local")
        derived = F.when(code == "biswa", F.try_element_at(local, F.lit("bigha")) / 20).when(code == "biswansi", F.try_element_at(local, F.lit("bigha")) / 400)
        return F.coalesce(F.try_element_at(local, code), F.try_element_at(general, code), derived)

    total = F.aggregate("__u_terms", F.lit(0.0), lambda acc, t: acc + F.get("__u_numbers", t["ix"]) * t["mult"] * factor(t["unit"]))
    return keyed.withColumn("area_sqm", F.when((total > 0) & (total < 1e300), total)).drop(*key, "__u_numbers", "__u_terms", "__u_local", "__u_district")
