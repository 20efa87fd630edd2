"""From delivered features to canonical records: keys, values, flags, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.functions.text import falsy_to_null, first_present, norm_key, parse_time
from landweave.types import CANONICAL_KEYS, EXPECTED_FIELDS, OPTIONAL_FIELDS

#: Fields in which zero, empty and false count as missing; ulpin and confidence are exempt.
_FALSY_EXEMPT = ("ulpin", "confidence")


def normal_map(properties: Column) -> Column:
    """Property map with normalised keys; of keys that fall together the last one counts."""
    pairs = F.transform(F.map_entries(properties), lambda e: F.struct(norm_key(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def record_id(properties: Column, name: Column, position: Column) -> Column:
    """First of id, source_id, parcel_id that is not empty, else the source's name and the row's position."""
    some = [F.when(~F.coalesce(F.try_element_at(properties, F.lit(k)).isin("", "0"), F.lit(True)), F.try_element_at(properties, F.lit(k))) for k in ("id", "source_id", "parcel_id")]
    return F.coalesce(*some, F.concat_ws("-", name, position.cast("string")))


def canonicalise(features: DataFrame) -> DataFrame:
    """Canonical records of features (source_id, source_name, source_type, row_ix, properties map, geometry, geometry_type, crs)."""
    m = F.col("attributes")
    df = features.withColumn("attributes", normal_map(F.col("properties")))

    def field(name: str) -> Column:
        value = first_present(m, *CANONICAL_KEYS[name])
        return value if name in _FALSY_EXEMPT else falsy_to_null(value)

    columns = {name: field(name) for name in CANONICAL_KEYS}
    columns["ulpin"] = F.nullif(F.trim(columns["ulpin"]), F.lit(""))
    columns["area_raw"] = columns["area"]
    columns["area"] = columns["area"].try_cast("double")
    columns["confidence"] = columns["confidence"].try_cast("double")
    columns["source_timestamp"] = parse_time(columns["source_timestamp"])
    base = df.select("source_id", "source_name", "source_type", "row_ix", record_id(m, F.col("source_name"), F.col("row_ix")).alias("record_id"), "geometry", "geometry_type", "crs", *[c.alias(n) for n, c in columns.items()], F.col("attributes").alias("raw_attributes"))
    flags = missing_fields()
    return base.withColumns({
        "internal_id": F.sha2(F.concat_ws("|", "source_name", F.col("row_ix").cast("string")), 256),
        "missing_fields": flags,
        "quality_flags": F.when(F.size(flags) > 0, F.array(F.lit("missing_optional_fields"))).otherwise(F.array().cast("array<string>")),
        "source_fields": F.array_sort(F.map_keys("raw_attributes")),
        "provenance": F.struct("source_id", "source_name", F.col("row_ix").alias("position"), F.array(F.lit("ingest"), F.lit("canonicalise")).alias("steps")),
    })


def missing_fields(fields: tuple[str, ...] = OPTIONAL_FIELDS) -> Column:
    """Names of the fields that are null (or NaN), in order."""
    return F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))


def ingest_statistics(features: DataFrame) -> DataFrame:
    """Per source: rows, valid and invalid rows, geometry types, detected and missing expected fields (all sorted)."""
    stats = features.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if("valid").alias("valid_records"), F.count_if(~F.col("valid")).alias("invalid_records"), F.array_sort(F.collect_set("geometry_type")).alias("geometry_types"))
    keys = features.select("source_id", F.explode(F.map_keys("properties")).alias("k")).distinct().groupBy("source_id").agg(F.array_sort(F.collect_list("k")).alias("detected_fields"))
    out = stats.join(keys, "source_id", "left").withColumn("detected_fields", F.coalesce("detected_fields", F.array().cast("array<string>")))
    return out.withColumn("missing_expected_fields", F.array_except(F.array(*[F.lit(f) for f in EXPECTED_FIELDS]), "detected_fields"))


def ordered_warnings(messages: DataFrame) -> DataFrame:
    """(source_id, warnings): distinct messages of (source_id, row_ix, message) in the order of their first row."""
    first = messages.groupBy("source_id", "message").agg(F.min("row_ix").alias("at"))
    return first.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "message"))), lambda x: x["message"]).alias("warnings"))


def flatten_attributes(core: list[str], extra: str) -> Column:
    """Non-null core columns and the extra map as one map; core wins."""
    own = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))) for c in core])))
    rest = F.map_filter(F.coalesce(F.col(extra), F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(own), k))
    return F.map_concat(own, rest)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Records of several sources in the order asked for, with ``source_ix``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("source_ix", F.lit(i)) for i, f in enumerate(frames)])
