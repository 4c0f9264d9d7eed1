"""Comparison of the two sides of a slot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import COMPARED, JOIN_KEYS, MONEY, MONEY_FIELDS, TOLERANCE


def with_key(side: DataFrame, keys: Sequence[str] = JOIN_KEYS) -> DataFrame:
    return side.withColumn("join_key", F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)))


def last_per_key(side: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per join_key: the last in ``order``, which should be total."""
    rank = F.row_number().over(Window.partitionBy("join_key").orderBy(*(F.col(c).desc_nulls_last() for c in order)))
    return side.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def breaks(side_1: DataFrame, side_2: DataFrame, compared: Sequence[str] = COMPARED) -> DataFrame:
    """(kind, join_key, field_name, side_1_value, side_2_value) of sides with one row per join_key.

    One full outer join; matched rows are unpivoted to their fields. Numbers
    differ beyond the tolerance, other values as text with null as empty; two
    nulls are equal, and null isn't zero.
    """
    a = side_1.select("join_key", F.struct(*compared).alias("a"))
    b = side_2.select(F.col("join_key").alias("key_2"), F.struct(*compared).alias("b"))
    both = a.join(b, F.col("join_key") == F.col("key_2"), "full_outer")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def compare(name: str):
        x, y = F.col(f"a.{name}"), F.col(f"b.{name}")
        differ = text(x) != text(y)
        if name in MONEY_FIELDS:
            far = F.abs(x.cast(MONEY) - y.cast(MONEY)) > F.lit(TOLERANCE).cast("decimal(28,8)")
            differ = F.when(x.isNotNull() & y.isNotNull(), far).otherwise(differ)
        row = F.struct(
            F.lit("VALUE_MISMATCH").alias("kind"), F.lit(name).alias("field_name"), text(x).alias("side_1_value"), text(y).alias("side_2_value")
        )
        return F.when(differ, row)

    missing = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), *(F.lit("").alias(c) for c in ("field_name", "side_1_value", "side_2_value"))))
    found = (
        F.when(F.col("key_2").isNull(), missing("MISSING_SIDE_2"))
        .when(F.col("join_key").isNull(), missing("MISSING_SIDE_1"))
        .otherwise(F.array_compact(F.array(*(compare(c) for c in compared))))
    )
    return both.select(F.coalesce("join_key", "key_2").alias("join_key"), F.inline(found)).select(
        "kind", "join_key", "field_name", "side_1_value", "side_2_value"
    )


def missing_sides(side_1: DataFrame, side_2: DataFrame) -> DataFrame:
    """(kind, join_key) of keys that only one side has."""
    a, b = side_1.select("join_key").distinct(), side_2.select("join_key").distinct()
    return (
        a.join(b, "join_key", "left_anti").select(F.lit("MISSING_SIDE_2").alias("kind"), "join_key")
        .unionByName(b.join(a, "join_key", "left_anti").select(F.lit("MISSING_SIDE_1").alias("kind"), "join_key"))
    )


def matched(side_1: DataFrame, side_2: DataFrame) -> DataFrame:
    """How many keys both sides have."""
    return side_1.select("join_key").intersect(side_2.select("join_key")).agg(F.count("*").alias("matched"))


def report(found: DataFrame, limit: int = 500) -> DataFrame:
    """break_count and the first ``limit`` breaks by key and field, as one row (the report's own limit)."""
    first = found.orderBy("join_key", "field_name", "kind").limit(limit).agg(F.array_sort(F.collect_list(F.struct("join_key", "field_name", "kind"))).alias("breaks"))
    return found.agg(F.count("*").alias("break_count")).crossJoin(F.broadcast(first))
