"""Filling fixed-capacity containers: first-fit decreasing with a tournament tree, in randomised groups."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.session import cut, seen

#: Items of one randomised group: enough for little waste, few enough for one task.
GROUP_ITEMS = 50_000


#: Splits text before the merges of a rank file (the pattern of byte-level BPE).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def load_tokenizer(path: str):  # noqa: ANN201
    """A public tokenizer from a ``.tiktoken`` (ranks), ``.json`` (tokenizers) or ``.model`` (sentencepiece) file, cached per worker."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _bounded(texts: list[str], characters: int = 200_000) -> Iterator[list[str]]:
    """The texts in runs of bounded size, as encodings take many times the memory of their texts."""
    run: list[str] = []
    size = 0
    for t in texts:
        if run and size + len(t) > characters:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def count_tokens(df: DataFrame, text: str, tokenizer: str, out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of each text (0 for null or empty); whole texts, special tokens read as plain text."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_tokenizer(tokenizer)
        for texts in batches:
            values = texts.fillna("").tolist()
            sizes: list[int] = []
            for part in _bounded(values):
                if tokenizer.endswith(".tiktoken"):
                    sizes += [len(model.encode_ordinary(x)) for x in part]
                elif tokenizer.endswith(".model"):
                    sizes += [len(x) for x in model.encode(part, num_threads=1)]
                else:
                    sizes += [len(x) for x in model.encode_batch_fast(part, add_special_tokens=False)]
            yield pd.Series(sizes, dtype="int64")

    return df.withColumn(out, counted(F.col(text)))


class FirstFit:
    """First bin with enough room in logarithmic time: a tournament tree over the room left in each bin."""

    def __init__(self, capacity: int, bins: int):
        self.size = 1 << max(1, int(bins - 1).bit_length())
        self.capacity = capacity
        self.tree = [capacity] * (2 * self.size)
        self.used = 0

    def place(self, item: int) -> int:
        tree, node = self.tree, 1
        while node < self.size:
            node <<= 1
            if tree[node] < item:
                node += 1
        at = node - self.size
        tree[node] -= item
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            most = a if a >= b else b
            if tree[node] == most:
                break
            tree[node] = most
            node >>= 1
        self.used = max(self.used, at + 1)
        return at


def first_fit_decreasing(sizes: np.ndarray, capacity: int, ties: np.ndarray | None = None) -> np.ndarray:
    """Bin number of every item (each at most ``capacity``), largest items first, ties by ``ties``."""
    order = np.lexsort((ties if ties is not None else np.arange(len(sizes)), -sizes))
    fit, out = FirstFit(capacity, max(1, len(sizes))), np.zeros(len(sizes), dtype=np.int64)
    for i in order:
        out[i] = fit.place(int(sizes[i]))
    return out


_PLACED = "item_key string, n long, copy long, full long, pack_group int, rest_container long, first_full long"


def pack(df: DataFrame, key: str, size: str, capacity: int, group_items: int = GROUP_ITEMS, seed: int = 0) -> DataFrame:
    """(item_key, piece_no, token_start, token_end, pack_group, container): a container for every item or piece.

    An item is cut only when it alone exceeds ``capacity``: into full pieces, each a container of its own, and a rest.
    Rests and all other items are packed first-fit decreasing within groups of about ``group_items`` items drawn by a
    seeded hash, so the same rows give the same groups on every run. Containers are numbered from 0 within their
    pack_group, full pieces after the shared ones; (pack_group, container) names one container. Null keys or sizes are
    left out, sizes of zero or less go into containers as empty pieces; rows that repeat a key are packed each, and copies
    of one item are spread over the groups, however many there are. Empty in, empty out.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = df.select(F.col(key).cast("string").alias("item_key"), F.col(size).cast("long").alias("n")).filter("item_key is not null and n is not null").withColumn("n", F.greatest("n", F.lit(0)))
    items = cut(items.groupBy("item_key", "n").agg(F.count(F.lit(1)).alias("copies")), items=F.sum("copies"))  # sizes may be costly to compute: once, not for each use below
    groups = max(1, -(-(seen(items)["items"] or 0) // group_items))
    items = items.select("item_key", "n", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    items = items.withColumn("full", (F.col("n") / capacity).cast("long")).withColumn("pack_group", F.pmod(F.xxhash64("item_key", "n", "copy", F.lit(seed)), F.lit(groups)).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item_key", "n", "copy"], kind="stable", ignore_index=True)
        full = pdf["full"].to_numpy()
        rest = pdf["n"].to_numpy() - full * capacity
        shared = (rest > 0) | (full == 0)
        container = np.full(len(pdf), -1, dtype=np.int64)
        container[shared] = first_fit_decreasing(rest[shared], capacity)
        return pdf.assign(rest_container=container, first_full=container.max(initial=-1) + 1 + np.cumsum(full) - full)

    placed = items.groupBy("pack_group").applyInPandas(fill, _PLACED)
    whole = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0), F.col("full") - 1), lambda i: F.struct(i.alias("piece_no"), (F.col("first_full") + i).alias("container"))))
    rest = F.when(F.col("rest_container") >= 0, F.array(F.struct(F.col("full").alias("piece_no"), F.col("rest_container").alias("container"))))
    nothing = F.array().cast("array<struct<piece_no:bigint,container:bigint>>")
    pieces = placed.select("item_key", "n", "pack_group", F.explode(F.concat(F.coalesce(whole, nothing), F.coalesce(rest, nothing))).alias("p"))
    return pieces.select("item_key", F.col("p.piece_no").cast("int").alias("piece_no"), (F.col("p.piece_no") * capacity).alias("token_start"), F.least("n", (F.col("p.piece_no") + 1) * capacity).alias("token_end"), "pack_group", F.col("p.container").alias("container"))
