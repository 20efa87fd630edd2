"""Mixed timestamp formats and zones: every distinct text is parsed once, kept, and joined back."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.session import lookup_join, maybe_broadcast, stored

# Month and weekday names.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8, "september": 9, "sept": 9, "october": 10, "november": 11, "december": 12,
    "जनवरी": 1, "फरवरी": 2, "मार्च": 3, "अप्रैल": 4, "मई": 5, "जून": 6, "जुलाई": 7, "अगस्त": 8, "सितंबर": 9, "अक्टूबर": 10, "नवंबर": 11, "दिसंबर": 12,
}
_WEEKDAY = re.compile(r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+", re.I)
_REGION = re.compile(r"\s*\[([A-Za-z0-9_+\-/]+)\]$")
_OFFSET = re.compile(r"(?<=[\d:mM ])\s*(?:UTC|GMT)?\s*([+-])(\d{1,2})(?::?(\d{2}))?(?::?(\d{2}))?$", re.I)
_ABBREVIATION = re.compile(r"(?<=\d)\s*([A-Za-z]{1,5})$")
_TIME = re.compile(r"(?:^|[T\s,]+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,:](\d+))?)?\s*([ap])?\.?(?(5)m\.?)$", re.I)
_COMPACT_TIME = re.compile(r"(?<=\d)[T\s](\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?$")
_YEAR_FIRST = re.compile(r"^(\d{4})([-/. ])(\d{1,2})\2(\d{1,2})$")
_COMPACT = re.compile(r"^(\d{4})(\d{2})(\d{2})$")
_TRIPLE = re.compile(r"^(\d{1,2})([-/. ])(\d{1,2})\2(\d{4}|\d{2})$")
_DAY_NAME = re.compile(r"^(\d{1,2})(?:st|nd|rd|th)?[\s\-/.]*([^\W\d_]+[^\d\s,\-/.]*)\.?[\s\-/.,]+(\d{4}|\d{2})$")
_NAME_DAY = re.compile(r"^([^\W\d_]+[^\d\s,\-/.]*)\.?[\s\-]+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4}|\d{2})$")
_COUNT = re.compile(r"^([+-]?)(\d{9,20})(?:\.(\d+))?$")
_EPOCH = datetime(1970, 1, 1)


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - any unusable name is an unknown zone
        return None


def _micros(t: datetime) -> int:
    return (t - _EPOCH) // timedelta(microseconds=1)


def _date(text: str, order: str) -> tuple[int, int, int] | None:
    if m := _YEAR_FIRST.match(text):
        return int(m[1]), int(m[3]), int(m[4])
    if m := _COMPACT.match(text):
        return int(m[1]), int(m[2]), int(m[3])
    if m := _TRIPLE.match(text):
        a, b, c = int(m[1]), int(m[3]), int(m[4])
        if order == "YMD" and len(m[4]) == 2:
            return 2000 + a, b, c
        year = c if len(m[4]) == 4 else 2000 + c
        return (year, a, b) if order == "MDY" else (year, b, a)
    if (m := _DAY_NAME.match(text)) and (month := MONTHS.get(m[2].lower())):
        return int(m[3]) + 2000 * (len(m[3]) == 2), month, int(m[1])
    if (m := _NAME_DAY.match(text)) and (month := MONTHS.get(m[1].lower())):
        return int(m[3]) + 2000 * (len(m[3]) == 2), month, int(m[2])
    return None


def parse_instant(raw: str | None, zone: str | None, order: str | None) -> tuple[str, int | None]:
    """(status, microseconds since 1970 UTC or None) of one text.

    status: ``ok``; ``ambiguous`` (zone-less local time that occurred twice); ``nonexistent`` (one that never
    occurred); ``unreadable`` (no calendar date, or a local time of a source whose zone is unknown); ``blank``.
    """
    if raw is None:
        return "blank", None
    text = " ".join(unicodedata.normalize("NFKC", raw).split())
    if not text:
        return "blank", None
    if not text.isascii():
        text = "".join(str(unicodedata.decimal(ch)) if ch.isdecimal() else ch for ch in text)
    if m := _COUNT.match(text):
        digits = m[2]
        compact = len(digits) == 14 and digits[:2] in ("19", "20")
        if not compact:
            power = 6 if len(digits) <= 11 else 3 if len(digits) <= 14 else 0 if len(digits) <= 17 else -3
            whole, fraction = int(digits), (m[3] or "")[:6] if power == 6 else ""
            value = whole * 10**power if power >= 0 else whole // 10**-power
            value += int(fraction.ljust(6, "0")) if fraction else 0
            value = -value if m[1] == "-" else value
            return ("ok", value) if abs(value) < 253_402_300_800_000_000 else ("unreadable", None)
        text = f"{digits[:8]} {digits[8:]}"
    region = None
    if m := _REGION.search(text):
        region, text = m[1], text[: m.start()]
    text = _WEEKDAY.sub("", text)
    offset, abbreviation = None, None
    if text[-1:] in "Zz" and text[-2:-1].isdigit():
        offset, text = 0, text[:-1]
    elif (m := _OFFSET.search(text)) and ":" in text[: m.start()]:
        offset = (int(m[2]) * 3600 + int(m[3] or 0) * 60 + int(m[4] or 0)) * (-1 if m[1] == "-" else 1)
        text = text[: m.start()].rstrip()
    elif (m := _ABBREVIATION.search(text)) and m[1].lower() not in ("am", "pm", "a", "p") and m[1].lower() not in MONTHS:
        abbreviation, text = m[1].upper(), text[: m.start()].rstrip()
        if abbreviation in ("UTC", "Z"):
            offset = 0
    hour = minute = second = micro = 0
    if m := _TIME.search(text):
        hour, minute, second = int(m[1]), int(m[2]), int(m[3] or 0)
        micro = int((m[4] or "")[:6].ljust(6, "0"))
        if m[5]:
            if not 1 <= hour <= 12:
                return "unreadable", None
            hour = hour % 12 + 12 * (m[5].lower() == "p")
        text = text[: m.start()]
    elif (m := _COMPACT_TIME.search(text)) and _COMPACT.match(text[: m.start()]):
        hour, minute, second = int(m[1]), int(m[2]), int(m[3] or 0)
        micro = int((m[4] or "")[:6].ljust(6, "0"))
        text = text[: m.start()]
    date = _date(text.strip(" ,T"), order or "DMY")
    if date is None or not 1 <= date[0] <= 9998:
        return "unreadable", None
    try:
        local = datetime(*date)
    except ValueError:
        return "unreadable", None
    if hour > 24 or minute > 59 or second > 60 or (hour == 24 and (minute or second or micro)):
        return "unreadable", None
    local += timedelta(hours=hour, minutes=minute, seconds=second, microseconds=micro)
    if offset is not None:
        return "ok", _micros(local) - offset * 1_000_000
    tz = _zone(region or zone or "")
    if tz is None:
        return "unreadable", None
    early, late = local.replace(tzinfo=tz), local.replace(tzinfo=tz, fold=1)
    a, b = early.utcoffset(), late.utcoffset()
    if a != b:
        names = [x.tzname() for x in (early, late)]
        if abbreviation and names.count(abbreviation) == 1:
            a = (a, b)[names.index(abbreviation)]
        else:
            return ("ambiguous" if a > b else "nonexistent"), None
    return "ok", _micros(local) - a // timedelta(microseconds=1)


def instant_text(status: str, micros: int | None) -> str:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ`` of an instant, else the reason."""
    return status if micros is None else (_EPOCH + timedelta(microseconds=micros)).isoformat(timespec="microseconds") + "Z"


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [parse_instant(t, z, o) for t, z, o in zip(pdf["__ts_text"], pdf["__ts_zone"], pdf["__ts_order"], strict=True)]
        yield pdf.assign(ts_status=[s for s, _ in found], instant_micros=pd.array([m for _, m in found], dtype="Int64"), instant_utc=[instant_text(s, m) for s, m in found])


_KEY = ["__ts_text", "__ts_zone", "__ts_order"]
_DICTIONARY = "__ts_text string, __ts_zone string, __ts_order string, __ts_n long, ts_status string, instant_micros long, instant_utc string"


def update_dictionary(rows: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """Bring the dictionary at ``path`` up to date with the texts in ``rows`` (columns of ``_KEY``).

    Texts are deduplicated with map-side combining; those already in the dictionary are not parsed again and
    the new ones are appended, so a rerun after a lost job only parses what is missing.
    """
    spark = rows.sparkSession
    distinct = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("__ts_n"))
    known = None
    if path is not None:
        fs = spark._jvm.org.apache.hadoop.fs.Path(path)
        if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
            known = spark.read.schema(_DICTIONARY).parquet(path)
            distinct = distinct.join(known.select(*_KEY), _KEY, "left_anti")
    parsed = distinct.mapInPandas(_parse_batches, _DICTIONARY)
    table, path = stored(parsed, "timestamp-dictionary", "append", path)
    return table.dropDuplicates(_KEY) if known is not None else table, path


def normalise_timestamps(df: DataFrame, text: str, source: str, sources: DataFrame, dictionary: str | None = None) -> DataFrame:
    """Add ``ts_status``, ``instant_micros`` and ``instant_utc`` to every row of ``df``.

    ``sources``: one row per ``source_system`` with ``time_zone`` and ``date_order``. Texts that are null or blank
    get status ``blank`` and a null instant; a source that is not listed has no zone, so its zone-less texts are
    ``unreadable`` while texts with an offset still resolve. Duplicate rows stay; an empty frame gives an empty frame.
    Columns of ``df`` that bear one of the three output names are replaced.
    """
    zones = sources.select(F.col("source_system").alias("__ts_src"), F.coalesce("time_zone", F.lit("")).alias("__ts_zone"), F.coalesce("date_order", F.lit("DMY")).alias("__ts_order")).dropDuplicates(["__ts_src"])
    keyed = df.withColumn("__ts_src", F.col(source)).withColumn("__ts_text", F.coalesce(F.trim(F.col(text)), F.lit(""))).drop("ts_status", "instant_micros", "instant_utc")
    keyed = keyed.join(maybe_broadcast(zones), "__ts_src", "left").drop("__ts_src")
    keyed = keyed.withColumns({"__ts_zone": F.coalesce("__ts_zone", F.lit("")), "__ts_order": F.coalesce("__ts_order", F.lit("DMY"))})
    table, _ = update_dictionary(keyed.select(*_KEY), dictionary)
    return lookup_join(keyed, table.select(*_KEY, "__ts_n", "ts_status", "instant_micros", "instant_utc"), _KEY, counts="__ts_n").drop(*_KEY)
