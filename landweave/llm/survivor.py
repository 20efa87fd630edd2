"""Best representative of each duplicate group, field by field."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stand-ins that are written where a value is missing.
STAND_INS = ("null", "none", "nan", "nil", "na", "n/a", "n.a.", "-", "--", "?", "unknown", "not specified", "tbd", "pending", "to be allotted", "अज्ञात")
PARCEL_TYPES = ("agricultural", "residential", "commercial", "abadi", "grove", "pond", "pasture", "road", "institutional")


@dataclass(frozen=True)
class Field:
    """A field to choose: its column and the normal form of a usable value (null where the value is not usable)."""

    name: str
    normal: Column


def usable_ulpin(c: Column) -> Column:
    """14 letters or digits once case, blanks and hyphens are ignored; no single repeated sign and no counting row."""
    plain = F.upper(F.regexp_replace(c, r"[\s-]+", ""))
    counting = F.lit("12345678901234567890" * 2).contains(plain) | F.lit("98765432109876543210" * 2).contains(plain)
    return F.when(plain.rlike(r"^[A-Z0-9]{14}$") & ~plain.rlike(r"^(.)\1{13}$") & ~counting, plain)


def usable_area(c: Column, most: float = 50_000.0) -> Column:
    x = c.cast("double")
    return F.when(~F.isnan(x) & (x > 0) & (x <= most), x.cast("string"))


def usable_parcel_type(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*PARCEL_TYPES), low)


def usable_text(c: Column) -> Column:
    low = F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    return F.when((low != "") & ~low.isin(*STAND_INS), low)


#: The instant at which a vote has the weight of its trust alone; only the ratio of votes counts, so any fixed one serves.
EPOCH_MICROS = 1_577_836_800_000_000


def survivor_votes(df: DataFrame, group: str, row: str, trust: str, micros: str, fields: list[Field], half_life_days: float = 365.0, by_votes: bool = False) -> DataFrame:
    """(group_id, field_name, row_id, value, support, votes): the chosen row of every field of every group.

    Fields are unpivoted to long rows, unusable values dropped. Each normalised value collects votes of trust times
    a recency decay that halves every ``half_life_days``; ``support`` is the winner's share of all votes. The winner is
    taken by max_by over (trust, instant, lowest row): the stated precedence, which sums of votes cannot give. With
    ``by_votes`` the value with most votes wins instead (ties by the same precedence), supplied by its best row.
    Null trust counts lowest, a null instant oldest; groups with a null key and groups of one row have no result; two
    usable values never tie as row ids differ. Partial sums are combined before the shuffle, so no group is gathered in one task.
    """
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(row).cast("long").alias("r"), F.coalesce(F.col(trust).cast("double"), F.lit(float("-inf"))).alias("t"), F.coalesce(F.col(micros).cast("long"), F.lit(-(2**63) + 1)).alias("at"), *[f.normal.alias(f"v{i}") for i, f in enumerate(fields)]).filter("g is not null")
    cells = F.array(*[F.struct(F.lit(f.name).alias("field_name"), F.col(f"v{i}").alias("value")) for i, f in enumerate(fields)])
    long = rows.select("g", "r", "t", "at", F.explode(F.filter(cells, lambda x: x["value"].isNotNull())).alias("c")).select("g", "r", "t", "at", "c.field_name", "c.value")
    rank = F.struct("t", "at", (-F.col("r")).alias("low"))
    age = (F.lit(float(EPOCH_MICROS)) - F.col("at").cast("double")) / 86_400e6
    vote = F.greatest(F.col("t"), F.lit(0.0)) * F.pow(F.lit(0.5), F.greatest(F.lit(-60.0), F.least(age / half_life_days, F.lit(60.0))))
    per_value = long.groupBy("g", "field_name", "value").agg(F.sum(vote).alias("votes"), F.max(rank).alias("best"))
    chosen = per_value.groupBy("g", "field_name").agg(F.max_by(F.struct("value", "votes", "best"), F.struct("votes", "best") if by_votes else F.col("best")).alias("w"), F.sum("votes").alias("all_votes"))
    several = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("g")
    out = chosen.join(several, "g", "left_semi")
    return out.select(F.col("g").alias("group_id"), "field_name", (-F.col("w.best.low")).alias("row_id"), F.col("w.value").alias("value"), F.try_divide("w.votes", "all_votes").alias("support"), F.col("w.votes").alias("votes"))


def survivors(df: DataFrame, group: str, row: str, trust: str, micros: str, fields: list[Field]) -> DataFrame:
    """One surviving record per group: the chosen values pivoted back to columns, with the row each came from."""
    long = survivor_votes(df, group, row, trust, micros, fields)
    picks = [F.max(F.when(F.col("field_name") == f.name, F.col(c))).alias(n) for f in fields for c, n in (("value", f.name), ("row_id", f"{f.name}_row_id"))]
    return long.groupBy("group_id").agg(*picks)


