"""Queries of the problems tagged llm, with SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.llm.consolidate import consolidate
from landweave.llm.leakage import leaked_items, reparameterised_items
from landweave.llm.matching import match_records
from landweave.llm.packing import count_tokens, pack
from landweave.llm.residue import residue
from landweave.llm.survivor import Field, survivor_votes, survivors, usable_area, usable_parcel_type, usable_ulpin
from landweave.operators.timestamps import normalise_timestamps
from landweave.operators.units import normalise_areas
from landweave.session import cut, maybe_broadcast, spread

#: Folder of public tokenizer files and the file used; parameters, never copied into the repository.
TOKENIZER = os.environ.get("LANDWEAVE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
CAPACITY = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of different sources that describe one parcel, with score and confidence."""
    records = table(spark, sf_dir, "source_records").select("row_ix", "source_record_id", "source_system", "district", "tehsil_code", "village", "khasra", "area", "area_unit", "area_raw", "geometry", "crs")
    measured = normalise_areas(records, table(spark, sf_dir, "sources"), table(spark, sf_dir, "area_units"))
    return match_records(measured.select(F.col("source_record_id").alias("record_id"), F.col("source_system").alias("source"), F.col("tehsil_code").alias("tehsil"), "village", "khasra", "area_sqm", "geometry", "crs", F.col("row_ix").alias("row")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_matches(spark, sf_dir).select("left_record_id", "right_record_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id on a matching edge with the smallest id connected to it."""
    edges = table(spark, sf_dir, "link_edges").filter("decision = 'match'").select("left_id", "right_id")
    return consolidate(edges, "left_id", "right_id")


def _parcel_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Field]]:
    sources = table(spark, sf_dir, "sources")
    rows = table(spark, sf_dir, "canonical_parcels").select("parcel_id", "row_id", "source_name", "ulpin", "area", "parcel_type", "source_timestamp")
    dated = normalise_timestamps(rows, "source_timestamp", "source_name", sources)
    trust = sources.select(F.col("source_system").alias("source_name"), "trust").dropDuplicates(["source_name"])
    dated = dated.join(maybe_broadcast(trust), "source_name", "left")
    return dated, [Field("ulpin", usable_ulpin(F.col("ulpin"))), Field("area", usable_area(F.col("area"))), Field("parcel_type", usable_parcel_type(F.col("parcel_type")))]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that supplies each surviving field of every parcel with several rows."""
    rows, fields = _parcel_versions(spark, sf_dir)
    return survivor_votes(rows, "parcel_id", "row_id", "trust", "instant_micros", fields).select(F.col("group_id").alias("parcel_id"), "field_name", "row_id")


def p5_voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that trust-and-recency votes choose, with the winner's share of the votes."""
    rows, fields = _parcel_versions(spark, sf_dir)
    voted = survivor_votes(rows, "parcel_id", "row_id", "trust", "instant_micros", fields, by_votes=True)
    return voted.select(F.col("group_id").alias("parcel_id"), "field_name", "row_id", F.round("support", 6).alias("support"))


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record per parcel with several rows."""
    rows, fields = _parcel_versions(spark, sf_dir)
    return survivors(rows, "parcel_id", "row_id", "trust", "instant_micros", fields).withColumnRenamed("group_id", "parcel_id")


def _document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", TOKENIZER).select("doc_id", "n_tokens")


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every document, or piece of a document beyond the capacity, in tokens of a public tokenizer."""
    packed = pack(_document_tokens(spark, sf_dir), "doc_id", "n_tokens", CAPACITY)
    return packed.select(F.col("item_key").cast("long").alias("doc_id"), "piece_no", "token_start", "token_end", "pack_group", "container")


def p8_pack_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every packing (sizes in characters here, so that SQL can say it): each item is placed once and whole, in the least number of pieces, and no container is above its capacity."""
    documents = table(spark, sf_dir, "documents")
    packed = cut(pack(documents, "doc_id", "n_chars", CAPACITY))
    held = packed.groupBy("pack_group", "container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("held"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("token_end") - F.col("token_start")).alias("largest"))
    over = held.agg(F.count_if(F.col("held") > CAPACITY), F.count_if((F.col("largest") == CAPACITY) & (F.col("held") > CAPACITY))).first()
    items = packed.groupBy("item_key").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum(F.col("token_end") - F.col("token_start")).alias("placed"), F.max("token_end").alias("reach"))
    return items.select(F.col("item_key").cast("long").alias("doc_id"), "n_pieces", "placed", "reach", F.lit(over[0]).alias("containers_over"), F.lit(over[1]).alias("full_containers_shared"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain twelve consecutive words of an evaluation passage, with the item."""
    found = leaked_items(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage")
    return found.select(F.col("doc_key").cast("long").alias("doc_id"), F.col("item_key").cast("long").alias("item_id"))


def p9_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items that share a template, with whether their slot values map one to one."""
    found = reparameterised_items(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage")
    return found.select(F.col("doc_key").cast("long").alias("doc_id"), F.col("item_key").cast("long").alias("item_id"), "n_windows", "n_same", "consistent")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with unfilled slots, filler, error-page messages or script notices."""
    return residue(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").select(F.col("doc_key").alias("doc_id"))


QUERIES = {"p1_found": p1_found, "p1_matches": p1_matches, "p9_found": p9_found, "p9_reparameterised": p9_reparameterised, "p10_found": p10_found, "p3_found": p3_found, "p5_found": p5_found, "p5_voted": p5_voted, "p5_survivors": p5_survivors, "p8_pack": p8_pack, "p8_pack_chars": p8_pack_chars}

SQL = {
    "p8_pack_chars": f"SELECT doc_id, greatest(1, ceil(n_chars / {CAPACITY}.0))::BIGINT AS n_pieces, n_chars::BIGINT AS placed, n_chars::BIGINT AS reach, 0::BIGINT AS containers_over, 0::BIGINT AS full_containers_shared FROM documents WHERE doc_id IS NOT NULL AND n_chars IS NOT NULL",
    "p9_found": """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
  v AS (SELECT item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
  dw AS (SELECT doc_id, w[i:i + 11] AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM w)),
  vw AS (SELECT item_id, w[i:i + 11] AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM v))
SELECT DISTINCT doc_id, item_id FROM dw JOIN vw USING (run)""",
    "p3_found": """
WITH RECURSIVE e AS (SELECT left_id AS u, right_id AS v FROM link_edges WHERE decision = 'match' AND left_id IS NOT NULL AND right_id IS NOT NULL
             UNION SELECT right_id, left_id FROM link_edges WHERE decision = 'match' AND left_id IS NOT NULL AND right_id IS NOT NULL),
  reach(a, b) AS (SELECT u, u FROM e UNION SELECT reach.a, e.v FROM reach JOIN e ON reach.b = e.u)
SELECT a AS member_id, min(b) AS group_id FROM reach GROUP BY a""",
}
