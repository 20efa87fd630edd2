"""Schemas that drift between the files of a feed: per-file schemas, a type-promotion lattice, and the log of changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landweave.session import counted, cut, lookup_join, shuffled

# The types a field can have, lowest in the lattice first.
TYPES = ("boolean", "number", "text", "list", "object")
#: Least share of the records filled on both sides whose content must go on under the new key.
SAME_CONTENT = 0.6
#: Least agreement beyond what chance gives two fields with these value frequencies.
BEYOND_CHANCE = 0.5


def promote(a: str | None, b: str | None) -> str | None:
    """Least type that holds both: nothing is below every type, equal types stay, all others meet in text."""
    return b if a is None else a if b is None or a == b else "text"


def normal_key(key: Column) -> Column:
    """Keys as ingestion compares them: trimmed, lower case, blanks and hyphens as underscores."""
    return F.translate(F.lower(F.trim(key)), " -", "__")


def cells(raw: DataFrame) -> DataFrame:
    """One row per key of every JSON object in ``raw_attributes``: its normal name, type, text and comparable content.

    Rows that hold no JSON object have no keys. A type of null means a JSON null. Where a row gives one normal key
    twice both cells are kept.
    """
    spark = raw.sparkSession
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parsed = raw.select("raw_id", "feed_id", "file_no", "feed_record", "line_no", F.try_parse_json("raw_attributes").alias("doc")).filter("doc is not null and schema_of_variant(doc) like 'OBJECT%'")
    parsed.createOrReplaceTempView("__drift_parsed")
    exploded = spark.sql("select p.raw_id, p.feed_id, p.file_no, p.feed_record, p.line_no, x.key, x.value from __drift_parsed p, lateral variant_explode(p.doc) x")
    kind = F.schema_of_variant("value")
    typed = (
        F.when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "object").when(kind == "STRING", "text").when(kind == "BOOLEAN", "boolean").when(kind != "VOID", "number")
    )
    plain = F.when(typed.isin("list", "object"), F.coalesce(*[F.try_variant_get("value", p, "string") for p in ("$[0]", "$.value", "$.label", "$.name")], F.to_json("value"))).otherwise(F.expr("cast(value as string)"))
    out = exploded.select("raw_id", "feed_id", "file_no", "feed_record", "line_no", normal_key(F.col("key")).alias("field_name"), typed.alias("type"), plain.alias("text"))
    low = F.lower(F.trim("text"))
    content = F.when(low.isin("y", "yes", "true"), "true").when(low.isin("n", "no", "false"), "false").otherwise(F.coalesce(low.try_cast("double").cast("string"), low))
    return out.withColumn("content", content)


def file_schemas(all_cells: DataFrame) -> DataFrame:
    """(feed_id, file_no, field_name, number of non-null values per type): the header of every file, with map-side sums."""
    counts = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES]
    return all_cells.groupBy("feed_id", "file_no", "field_name").agg(*counts)


def _replaced(schemas: DataFrame, files: DataFrame) -> DataFrame:
    """(feed_id, file_no, field_name, n, ends): keys of files where the next one lacks them, or the one before did, with their filled values.

    ``ends`` has for each such change the file that made it (``at``) and whether the key came with it; only files that
    both drop and bring keys are among them, as others have no rename.
    """
    at = schemas.select("feed_id", "file_no", "field_name", sum((F.col(f"n_{t}") for t in TYPES), F.lit(0)).alias("n")).join(shuffled(files), ["feed_id", "file_no"])
    over_files = Window.partitionBy("feed_id", "field_name").orderBy("file_no")
    at = at.withColumns({"had": F.lag("file_no").over(over_files), "has": F.lead("file_no").over(over_files)})
    came = F.when(F.col("prev_no").isNotNull() & ~F.col("had").eqNullSafe(F.col("prev_no")), F.struct(F.col("file_no").alias("at"), F.lit(True).alias("came")))
    gone = F.when(F.col("next_no").isNotNull() & ~F.col("has").eqNullSafe(F.col("next_no")), F.struct(F.col("next_no").alias("at"), F.lit(False).alias("came")))
    change = at.select("feed_id", "file_no", "field_name", "n", F.explode(F.filter(F.array(came, gone), lambda x: x.isNotNull())).alias("e"))
    one_file = Window.partitionBy("feed_id", "e.at")
    both = change.withColumns({"brings": F.max("e.came").over(one_file), "keeps": F.min("e.came").over(one_file)}).filter("brings and not keeps")
    return both.groupBy("feed_id", "file_no", "field_name").agg(F.max("n").alias("n"), F.collect_list("e").alias("ends"))


def _rename_evidence(all_cells: DataFrame, schemas: DataFrame, files: DataFrame) -> DataFrame:
    """For each removed and added key of neighbouring files: records filled in both, how many agree, and by chance."""
    keys = cut(_replaced(schemas, files))
    filled = all_cells.filter("content is not null and feed_record is not null").select("feed_id", "file_no", "feed_record", "field_name", "raw_id", "content")
    hits = lookup_join(filled, keys, ["feed_id", "file_no", "field_name"], "inner", counts="n", size=counted(keys)).withColumn("e", F.explode("ends"))
    one = cut(hits.groupBy("feed_id", F.col("e.at").alias("file_no"), F.col("e.came").alias("came"), "feed_record", "field_name").agg(F.max_by("content", "raw_id").alias("content")))
    a = one.filter("not came").select("feed_id", "file_no", "feed_record", F.col("field_name").alias("old_name"), F.col("content").alias("old_content"))
    b = one.filter("came").select("feed_id", "file_no", "feed_record", F.col("field_name").alias("new_name"), F.col("content").alias("new_content"))
    agree = a.join(shuffled(b), ["feed_id", "file_no", "feed_record"]).groupBy("feed_id", "file_no", "old_name", "new_name").agg(F.count(F.lit(1)).alias("n_both"), F.count_if(F.col("old_content") == F.col("new_content")).alias("n_same"))
    fa = a.groupBy("feed_id", "file_no", "old_name", F.col("old_content").alias("content")).agg(F.count(F.lit(1)).alias("x"))
    fb = b.groupBy("feed_id", "file_no", "new_name", F.col("new_content").alias("content")).agg(F.count(F.lit(1)).alias("y"))
    ta, tb = fa.groupBy("feed_id", "file_no", "old_name").agg(F.sum("x").alias("tx")), fb.groupBy("feed_id", "file_no", "new_name").agg(F.sum("y").alias("ty"))
    chance = fa.join(shuffled(fb), ["feed_id", "file_no", "content"]).groupBy("feed_id", "file_no", "old_name", "new_name").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    out = agree.join(shuffled(chance), ["feed_id", "file_no", "old_name", "new_name"], "left").join(shuffled(ta), ["feed_id", "file_no", "old_name"]).join(shuffled(tb), ["feed_id", "file_no", "new_name"])
    return cut(out.select("feed_id", "file_no", "old_name", "new_name", (F.col("n_same") / F.col("n_both")).alias("same"), F.coalesce(F.col("xy") / F.col("tx") / F.col("ty"), F.lit(0.0)).alias("chance")))


_LOG = "feed_id long, file_no int, seq int, change_kind string, field_name string, new_name string, old_type string, new_type string, lineage string, union_type string"


def _fold_feed(key: tuple, schemas: pd.DataFrame, evidence: pd.DataFrame) -> pd.DataFrame:
    """Walk the files of one feed in order; input and output are bounded by files times fields, not by rows."""
    renames: dict[int, list[tuple[float, str, str]]] = {}
    partners: dict[int, tuple[set[str], set[str]]] = {}
    for file_no, old, new in zip(evidence["file_no"], evidence["old_name"], evidence["new_name"], strict=True):
        before, after = partners.setdefault(int(file_no), (set(), set()))
        before.add(old)
        after.add(new)

    def only_pair(file_no: int, old: str, new: str) -> bool:
        return partners[file_no] == ({old}, {new})

    for file_no, old, new, same, chance in zip(evidence["file_no"], evidence["old_name"], evidence["new_name"], evidence["same"], evidence["chance"], strict=True):
        beyond = (same - chance) / (1 - chance) if chance < 1 else 0.0
        if chance >= 1 and same >= 1 and only_pair(int(file_no), old, new):
            beyond = 1.0  # one value throughout tells nothing, but no other key is left for it
        if same >= SAME_CONTENT and beyond >= BEYOND_CHANCE:
            renames.setdefault(int(file_no), []).append((float(same), old, new))
    columns = [f"n_{t}" for t in TYPES]
    files: dict[int, dict[str, str | None]] = {}
    for row in schemas.sort_values(["file_no", "field_name"], kind="stable").itertuples(index=False):
        counts = [getattr(row, c) for c in columns]
        most = max(counts)
        own = files.setdefault(int(row.file_no), {})
        if isinstance(row.field_name, str):
            own[row.field_name] = TYPES[counts.index(most)] if most > 0 else None
    log: list[tuple] = []
    fields: list[tuple] = []
    live: dict[str, int] = {}  # name in the file before -> lineage
    last_type: dict[int, str | None] = {}
    name_of: dict[int, str] = {}
    union: dict[int, str | None] = {}
    first = True
    for file_no in sorted(files):
        now = files[file_no]
        changes: list[tuple] = []
        gone, came = set(live) - set(now), set(now) - set(live)
        moved: dict[str, str] = {}
        for _, old, new in sorted(renames.get(file_no, []), key=lambda r: (-r[0], r[1], r[2])):
            if old in gone and new in came:
                gone.discard(old)
                came.discard(new)
                moved[new] = old
                changes.append(("renamed", old, new, None, None))
        changes += [("removed", f, "", last_type.get(live[f]), None) for f in gone]
        changes += [("added", f, "", None, now[f]) for f in came] if not first else []
        nxt: dict[str, int] = {}
        for f, kind in now.items():
            line = live[moved[f]] if f in moved else live[f] if f in live else len(name_of)
            if f in came:
                line = len(name_of)
            name_of[line] = f
            nxt[f] = line
            before = last_type.get(line)
            if kind is not None:
                if before is not None and before != kind:
                    changes.append(("retyped", f, "", before, kind))
                last_type[line] = kind
            union[line] = promote(union.get(line), kind)
            fields.append((file_no, f, line))
        for i, (kind_of, a, b, x, y) in enumerate(sorted(changes, key=lambda c: (c[0], c[1]))):
            log.append((key[0], file_no, i, kind_of, a, b, x, y, None, None))
        live, first = nxt, False
    for i, (file_no, f, line) in enumerate(fields):
        log.append((key[0], file_no, i, "field", f, name_of[line], None, None, f"{name_of[line]}#{line}", union[line] or "text"))
    return pd.DataFrame(log, columns=[c.split()[0] for c in _LOG.split(", ")])


def fold_schemas(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, folded schemas) of ``raw`` (raw_id, feed_id, file_no, feed_record, line_no, raw_attributes).

    The folded frame has one row per change (``change_kind`` added, removed, renamed, retyped) in order, and one row
    ``field`` per field of each file with its latest name and the promoted type. Rows without feed_id or file_no
    belong to no file and are passed over; lines sent twice count twice in type majorities, ties go to the type lowest
    in the lattice; an empty table gives an empty log.
    """
    rows = raw.filter("feed_id is not null and file_no is not null")
    found = cut(cells(rows))  # every value is read from its JSON text once
    schemas = cut(file_schemas(found))
    every = rows.select(F.col("feed_id"), F.col("file_no")).distinct()
    files = cut(every.selectExpr("feed_id", "file_no", "lag(file_no) over (partition by feed_id order by file_no) as prev_no", "lead(file_no) over (partition by feed_id order by file_no) as next_no"))
    evidence = _rename_evidence(found, schemas, files).toDF("feed", "file_no", "old_name", "new_name", "same", "chance")
    marks = files.select("feed_id", "file_no", F.lit(None).cast("string").alias("field_name"), *[F.lit(0).cast("long").alias(f"n_{t}") for t in TYPES])
    folded = schemas.unionByName(marks).groupBy("feed_id").cogroup(evidence.groupBy("feed")).applyInPandas(_fold_feed, _LOG)
    return found, cut(folded)


def schema_changes(raw: DataFrame) -> DataFrame:
    """(feed_id, file_no, change_kind, field_name, new_name): every change of a file against the file before it."""
    return fold_schemas(raw)[1].filter("change_kind <> 'field'").select("feed_id", "file_no", "change_kind", "field_name", "new_name")


def unified_table(raw: DataFrame) -> DataFrame:
    """All rows in one consistent long table: (raw_id, feed_id, file_no, feed_record, field_name, type, number, truth, value).

    ``field_name`` is the latest name the field goes by in its feed and ``type`` the lattice's type for all its files.
    Every value is cast to that type: ``number`` (double) and ``truth`` (boolean) hold the values of such fields, ``value``
    the text of every field in the spelling of its type (numbers as 12.5, booleans as true and false, lists and objects
    beside other types as their content). What cannot be cast is null, and null values stay as rows.
    """
    found, folded = fold_schemas(raw)
    names = folded.filter("change_kind = 'field'").select("feed_id", "file_no", "field_name", F.col("new_name").alias("latest"), "union_type")
    joined = lookup_join(found, names, ["feed_id", "file_no", "field_name"], "inner")
    number = F.when(F.col("union_type") == "number", F.col("text").try_cast("double"))
    truth = F.when(F.col("union_type") == "boolean", F.col("text").try_cast("boolean"))
    value = F.when(F.col("union_type") == "number", number.cast("string")).when(F.col("union_type") == "boolean", truth.cast("string")).otherwise(F.col("text"))
    return joined.select("raw_id", "feed_id", "file_no", "feed_record", F.col("latest").alias("field_name"), F.col("union_type").alias("type"), number.alias("number"), truth.alias("truth"), value.alias("value"))


def footer_schemas(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, ordinal, field_name, type) from Parquet footers, read in parallel; file content is not touched."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for pdf in batches:
            for path in pdf["path"]:
                schema = pq.read_schema(path)
                yield pd.DataFrame({"path": path, "ordinal": range(len(schema)), "field_name": schema.names, "type": [str(t) for t in schema.types]})

    frame = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 256)))
    return frame.mapInPandas(read, "path string, ordinal long, field_name string, type string")
