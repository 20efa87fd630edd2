"""Session helpers: shared checkpoint folder, written tables with counted rows, size-checked broadcast, skew-safe lookup joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A lookup of at most this many rows may be broadcast; the size is counted before each use.
BROADCAST_ROWS = 20_000
#: A key counts as hot when it holds more than one part in HOT_SHARE of the rows, so at most HOT_SHARE keys are hot.
HOT_SHARE = 512
#: Parts into which the rows of one hot key are split.
HOT_PARTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only on a ``local`` master where it is unset (tests), a temporary one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if conf is None and current.isDefined():
        return current.get().rsplit("/", 1)[0]
    if conf is None and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = conf or tempfile.mkdtemp(prefix="landweave-")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def _folder(spark: SparkSession) -> str:
    """This application's folder below the shared one; removed when the driver ends."""
    path = f"{shared_dir(spark)}/landweave/{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(_remove, spark, path)
    return path


_FOLDERS: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def cut(df: DataFrame, **observed: Column) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and the loss of executors is survived.

    A written table rather than checkpoint(): a checkpointed frame keeps the partitioning and constraints inferred for
    its plan, and planning then slows exponentially over the rounds of an iterative algorithm. Its rows are counted in
    the same pass (see ``counted``), and so are the aggregates ``observed`` (see ``seen``).
    """
    return stored(df, "cut", **observed)[0]


def stored(df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None, **observed: Column) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet below the shared folder (or to ``path``) and read it back."""
    spark = df.sparkSession
    whole = path is None or mode == "overwrite"
    path = path or f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    pass_ = Observation()
    df.observe(pass_, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in observed.items()]).write.mode(mode).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if whole:
        out._landweave = {"path": path} | pass_.get
    return out, path


def counted(df: DataFrame) -> int:
    """Rows of a frame: known for one just written by ``cut``, counted otherwise."""
    return seen(df).get("rows") if "rows" in seen(df) else df.count()


def seen(df: DataFrame) -> dict:
    """What was observed while ``df`` was written by ``cut``."""
    return getattr(df, "_landweave", {})


def release(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more, so that rounds of an iteration do not pile up."""
    for df in frames:
        if "path" in seen(df):
            _remove(df.sparkSession, seen(df)["path"])


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a small file is one split, however costly its rows are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` holds at most ``rows`` rows (known for a frame just written, else counted no further than the bound)."""
    known = seen(df).get("rows")
    return known <= rows if known is not None else df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when the counted size is within the bound; otherwise the plain frame (shuffle join)."""
    return F.broadcast(df) if is_small(df, rows) else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join, whatever its estimated size.

    The planner estimates a side by the bytes of the files below it: compressed, and blind to what explode makes of
    them. Left to that it may gather any multiple of its threshold in the driver.
    """
    return df.hint("merge")


def lookup_join(big: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left", rows: int = BROADCAST_ROWS, counts: str | None = None, size: int | None = None) -> DataFrame:
    """Join ``big`` to a ``lookup`` that is unique on ``keys``, safely under hot keys.

    A lookup within ``rows`` rows (``size`` gives its number of rows where the caller knows it) is broadcast. Beyond
    that both sides are shuffled; keys that hold more than 1/HOT_SHARE of the rows (``counts`` names the lookup's column
    with the number of rows per key; without it they are counted here) are split into HOT_PARTS parts. Null keys match nothing.
    """
    if size <= rows if size is not None else is_small(lookup, rows):
        return big.join(F.broadcast(lookup.drop(counts) if counts else lookup), keys, how)
    n = "_n_rows" if counts is None else counts
    if counts is None:
        per = big.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
        lookup = lookup.join(shuffled(per), keys, "left")
    total = lookup.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT_SHARE > F.lit(total)
    hot_keys = lookup.filter(hot).select(*keys, F.lit(True).alias("_hot"))  # at most HOT_SHARE rows
    salted = big.join(F.broadcast(hot_keys), keys, "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(*big.columns), F.lit(HOT_PARTS)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    spread = lookup.withColumn("_part", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0))))).drop(n)
    return salted.join(shuffled(spread), [*keys, "_part"], how).drop("_part")
