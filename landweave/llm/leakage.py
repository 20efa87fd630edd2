"""Evaluation texts in training text: windows of typed templates are hash-joined, then their slots are compared."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.operators.units import AREA, LINEAR
from landweave.session import counted, cut, lookup_join

WINDOW = 12
#: A window with fewer literal words than this is matched word for word only: its template would say nothing.
LEAST_LITERAL = 4
#: Bits of the filter sent to the workers: FILTER_BITS a window of the evaluation texts, at most 2 ** FILTER_MOST (16 MB).
#: A fuller filter lets more windows through to the join and loses none.
FILTER_BITS, FILTER_MOST = 16, 27
#: Items that one row of the join holds for one window; a window of more items is split over several.
ITEMS_A_ROW = 1000
# Words of measures beside the area and length units of the core.
MEASURES = "rod rods chain chains link links mile miles pole poles perch perches km cm mm kg gram grams litre litres quintal quintals rupee rupees rs inch inches".split()
UNITS = frozenset(w.casefold() for words in (*LINEAR.values(), *AREA.values(), MEASURES) for w in words if len(w) > 1 and w.isalpha())
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NUMBER, _UNIT, _NAME = "<number>", "<unit>", "<name>"


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, without case; whatever stands between is ignored."""
    return _WORD.findall((text or "").casefold())


def kind(word: str) -> str | None:
    """Placeholder of a word by the word alone, the same in any case and context: numbers by their digits, units of measure."""
    return _NUMBER if any(ch.isdigit() for ch in word) else _UNIT if word in UNITS else None


def names_in(text: str | None) -> tuple[list[str], list[bool]]:
    """(words, is a name): capitalised words inside a sentence."""
    words, named, end = [], [], None
    for m in _WORD.finditer(text or ""):
        w = m[0]
        inside = end is not None and not re.search(r"[.!?।:;\n\"“”(]", text[end : m.start()])  # type: ignore[index]
        words.append(w.casefold())
        named.append(inside and len(w) > 2 and w[0].isupper() and w[1:].islower())
        end = m.end()
    return words, named


class _Codes(dict):
    """Words (or placeholders) to 64-bit codes, each hashed once; emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), dtype=np.uint64, count=len(words))


class _Kinds(dict):
    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        typed = self[word] = kind(word) or word
        return typed


def window_hashes(codes: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Polynomial hash of every run of ``size`` codes, modulo 2^64."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * _BASE + codes[i : i + n]
    return out


def typed_windows(words: list[str], kinds: dict[str, str], codes: _Codes) -> tuple[np.ndarray, list[str]]:
    """(hash of every window, typed words): numbers and units as placeholders, or the words themselves where few literal words are left."""
    typed = [kinds[w] for w in words]
    out = window_hashes(codes.of(typed))
    if len(out):
        slots = np.fromiter((a != b for a, b in zip(words, typed, strict=True)), dtype=np.int64, count=len(words))
        held = np.convolve(slots, np.ones(WINDOW, dtype=np.int64), "valid")
        if (few := held > WINDOW - LEAST_LITERAL).any():
            out = np.where(few, window_hashes(codes.of(words)), out)
    return out, typed


def named_windows(text: str | None, kinds: dict[str, str], codes: _Codes) -> tuple[np.ndarray, np.ndarray, list[str], list[str], list[str]]:
    """(hash, usable, words, typed, typed at a window's start): names and words after a number as placeholders too.

    What stands before a window must not change it, so its first word is typed without regard to a number before it.
    """
    words, named = names_in(text)
    first = [_NAME if n else kinds[w] for w, n in zip(words, named, strict=True)]
    typed = [_UNIT if i and first[i - 1] == _NUMBER and t != _NUMBER else t for i, t in enumerate(first)]
    a, b = codes.of(typed), codes.of(first)
    out = window_hashes(a)
    n = len(out)
    if n:
        with np.errstate(over="ignore"):
            top = np.uint64(1)
            for _ in range(WINDOW - 1):
                top = top * _BASE
            out = out + (b[:n] - a[:n]) * top
    slots = np.fromiter((t[0] == "<" for t in typed), dtype=np.int64, count=len(typed))
    usable = np.convolve(slots, np.ones(WINDOW, dtype=np.int64), "valid") <= WINDOW - LEAST_LITERAL if n else np.zeros(0, dtype=bool)
    return out, usable, words, typed, first


_WINDOWS = "key string, pos int, hash long, words array<string>, template string"


def template_windows(df: DataFrame, key: str, text: str, wanted: np.ndarray | None = None, names: bool = False) -> DataFrame:
    """(key, pos, hash, words, template): template windows of every text; with ``wanted`` (a bit filter of hashes), only those it may hold.

    Windows of words alone (typed_windows) have an empty ``template``; with ``names`` those of named_windows come too.
    """
    sent = None if wanted is None else df.sparkSession.sparkContext.broadcast(wanted)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = None if sent is None else sent.value
        kinds, codes = _Kinds(), _Codes()
        held: list[tuple] = []

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(held, columns=["key", "pos", "hash", "words", "template"])
            held.clear()
            return out

        for pdf in batches:
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                words = words_of(t)
                found, _ = typed_windows(words, kinds, codes)
                for p in _passing(found, bits):
                    held.append((k, p, found.view(np.int64)[p], words[p : p + WINDOW], ""))
                if names:
                    found, usable, words, typed, first = named_windows(t, kinds, codes)
                    for p in _passing(found, bits):
                        if usable[p]:
                            held.append((k, p, found.view(np.int64)[p], words[p : p + WINDOW], " ".join([first[p], *typed[p + 1 : p + WINDOW]])))
                if len(held) > 20_000:
                    yield frame()
            if held:
                yield frame()

    return df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null").mapInPandas(windows, _WINDOWS)


def _passing(hashes: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    """Positions whose hash the filter may hold."""
    if bits is None:
        return np.arange(len(hashes))
    at = hashes & np.uint64(len(bits) * 64 - 1)
    return np.nonzero((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))[0]


def hash_filter(windows: DataFrame, most: int = FILTER_MOST) -> np.ndarray:
    """Bit i is set when some hash ends in the bits of i; built on the workers, of bounded size whatever the number of hashes."""
    size = min(2**most, 1 << max(12, (FILTER_BITS * counted(windows)).bit_length()))
    at = F.col("hash").bitwiseAND(F.lit(size - 1))
    words = windows.select(F.shiftright(at, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast((hash & {size - 1}L) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(size // 64, dtype=np.uint64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def matched_windows(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, names: bool = False, filter_most: int = FILTER_MOST) -> DataFrame:
    """(doc_key, item_key, doc_pos, item_pos, doc_words, item_words, same): windows of one template in both texts.

    ``same`` is true where the slots hold the same words too, so the window stands word for word in the document.
    Whole texts are read; null keys or texts, and items of fewer than twelve words, match nothing. The number of rows is
    the same whatever the size of the filter; windows that many items share are split over rows of ITEMS_A_ROW.
    """
    theirs = cut(template_windows(items, item_key, item_text, names=names))
    ours = cut(template_windows(docs, doc_key, doc_text, hash_filter(theirs, filter_most), names))
    counts = cut(theirs.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / ITEMS_A_ROW).cast("int").alias("parts")))
    split = lookup_join(theirs, counts, ["hash"], "inner").withColumn("part", F.pmod(F.xxhash64("key", "pos", "template"), F.col("parts")).cast("int"))
    grouped = cut(split.groupBy("hash", "part").agg(F.collect_list(F.struct(F.col("key").alias("item_key"), F.col("pos").alias("item_pos"), F.col("words").alias("item_words"), F.col("template").alias("item_template"))).alias("items")))
    ours = lookup_join(ours, counts, ["hash"], "inner").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    joined = lookup_join(ours, grouped, ["hash", "part"], "inner")
    out = joined.select(F.col("key").alias("doc_key"), F.col("pos").alias("doc_pos"), F.col("words").alias("doc_words"), "template", F.explode("items").alias("i"))
    out = out.select("doc_key", "doc_pos", "doc_words", "template", "i.item_key", "i.item_pos", "i.item_words", "i.item_template").withColumn("same", F.expr("doc_words = item_words"))
    typed = F.col("same") | (F.col("template") == F.col("item_template"))
    return out.filter(typed).drop("template", "item_template")


def leaked_items(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, filter_most: int = FILTER_MOST) -> DataFrame:
    """(doc_key, item_key): documents that contain at least twelve consecutive words of the item, each pair once."""
    return matched_windows(docs, doc_key, doc_text, items, item_key, item_text, filter_most=filter_most).filter("same").select("doc_key", "item_key").distinct()


def reparameterised_items(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, filter_most: int = FILTER_MOST) -> DataFrame:
    """(doc_key, item_key, n_windows, n_same, consistent): items found by template, word for word or with other slot values.

    A slot is a number, a unit of measure, a word after a number, or a capitalised word inside a sentence, so names in
    scripts without capitals stay literal. ``consistent``: every value of a slot in the item stands for one value in the
    document throughout, as in a question asked again with other numbers, names or units.
    """
    rows = matched_windows(docs, doc_key, doc_text, items, item_key, item_text, True, filter_most)
    rows = cut(rows.dropDuplicates(["doc_key", "item_key", "doc_pos", "item_pos"]))
    sums = rows.groupBy("doc_key", "item_key").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if("same").alias("n_same"))
    pairs = rows.select("doc_key", "item_key", F.explode(F.arrays_zip("item_words", "doc_words")).alias("w")).select("doc_key", "item_key", F.col("w.item_words").alias("a"), F.col("w.doc_words").alias("b")).distinct()
    clash = pairs.groupBy("doc_key", "item_key", "a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_key", "item_key").distinct().withColumn("clash", F.lit(True))
    return sums.join(clash, ["doc_key", "item_key"], "left").select("doc_key", "item_key", "n_windows", "n_same", F.col("clash").isNull().alias("consistent"))
