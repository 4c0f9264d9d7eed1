"""Read models: lists, summary, posture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RATE_TARGET


def list_limit(n: int, default: int = 200, most: int = 1000) -> int:
    return n if 0 < n <= most else default


def arrivals(df: DataFrame, limit: int = 200, tie: str = "arrival_id", since: str | None = None, **equal: str) -> DataFrame:
    """The latest arrivals, by when they were classified or else detected; equal-value filters are ANDed."""
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    if since:
        df = df.where(F.col("detected_at") >= F.to_timestamp(F.lit(since)))
    return df.orderBy(F.coalesce("classified_at", "detected_at").desc(), tie).limit(list_limit(limit))


def review_queue(df: DataFrame, reviews: DataFrame) -> DataFrame:
    """Held arrivals without a review, the longest classified first, unclassified ones last."""
    open_ = df.where(F.col("disposition").isin("QUARANTINED", "REJECTED")).join(reviews, "arrival_id", "left_anti")
    return open_.orderBy(F.col("classified_at").asc_nulls_last(), "arrival_id")


def slots(df: DataFrame, state: str | None = None, value_date: str | None = None) -> DataFrame:
    if state:
        df = df.where(F.col("state") == state)
    if value_date:
        df = df.where(F.col("value_date") == F.to_date(F.lit(value_date)))
    return df.orderBy(F.col("value_date").desc(), "client_id", "domain")


def alerts(df: DataFrame, tie: str = "alert_id", limit: int = 500) -> DataFrame:
    """Open alerts first, then the latest."""
    return df.orderBy(F.col("acknowledged_at").asc_nulls_first(), F.col("emitted_at").desc(), tie).limit(limit)


def summary(df: DataFrame, assignments: DataFrame, alert_rows: DataFrame) -> DataFrame:
    """One row of counts: one aggregate for each table."""
    state = F.col("disposition")
    by = df.agg(
        F.count("*").alias("arrivals"), F.count_if(state == "DISPATCHED").alias("dispatched"), F.count_if(state == "QUARANTINED").alias("quarantined"),
        F.count_if(state == "REJECTED").alias("rejected"), F.count_if("mismatch").alias("mismatches"),
    )
    live = assignments.agg(F.count_if(F.col("voided_at").isNull()).alias("assignments"))
    open_ = alert_rows.agg(F.count_if(F.col("acknowledged_at").isNull()).alias("open_alerts"))
    out = by.crossJoin(F.broadcast(live)).crossJoin(F.broadcast(open_))  # one row each
    total = F.col("dispatched") + F.col("quarantined") + F.col("rejected")
    return out.withColumn("quarantine_rate", F.coalesce(F.try_divide("quarantined", total), F.lit(0.0)))


def posture(df: DataFrame) -> DataFrame:
    """A summary with level and rationale: what an operator should look at next."""
    rate = F.col("quarantine_rate")
    level = (
        F.when(F.col("open_alerts") > 0, "INCIDENT")
        .when((rate > RATE_TARGET) | (F.col("quarantined") > 0) | (F.col("rejected") > 0) | (F.col("mismatches") > 0), "ATTENTION")
        .otherwise("CLEAR")
    )
    said = lambda c, text: F.when(F.col(c) > 0, F.concat(F.lit(text), F.col(c).cast("string")))
    why = F.array_compact(
        F.array(said("open_alerts", "open alerts: "), said("quarantined", "in review: "), said("rejected", "rejected: "), said("mismatches", "date disagreements: "))
    )
    return df.withColumn("level", level).withColumn("rationale", F.when(F.size(why) == 0, F.array(F.lit("nothing is open"))).otherwise(why))


def first_wins(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key, the earliest: insert-if-absent, single acknowledgement, first review."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def coalesce_upsert(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per key: each column's latest value that isn't null."""
    return df.groupBy(*key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def project_update(raw: DataFrame, classified: DataFrame, order: str) -> DataFrame:
    """Arrivals with their latest classification; classifications of unknown arrivals fall out."""
    last = classified.groupBy("arrival_id").agg(F.max_by(F.struct(*classified.columns), order).alias("c"))
    return raw.join(last.select("arrival_id", "c.*") if "arrival_id" not in classified.columns else last.select("c.*"), "arrival_id", "left")


def mapping_view(df: DataFrame) -> DataFrame:
    """A file's mappings unpacked from its payload (array of structs), resolved ones first, in their order."""
    rows = df.select("arrival_id", F.posexplode("mappings").alias("pos", "m")).select("arrival_id", "pos", "m.*")
    return rows.orderBy("arrival_id", F.col("canonical_field").isNull(), "pos")
