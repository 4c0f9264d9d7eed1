"""Duplicate verdicts, write completion and queue ingress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import queue_name


def dedupe_verdicts(arrivals: DataFrame, digest: str, name: str, order: list[str]) -> DataFrame:
    """``arrivals`` with verdict and seen_count.

    The first arrival of a content is NEW; a later one is a DUPLICATE if it has
    the first one's name and else a REDELIVERY. Only the first is ever recorded.
    """
    first = arrivals.groupBy(digest).agg(
        F.min(F.struct(*order)).alias("_first"), F.min_by(name, F.struct(*order)).alias("_first_name")
    )
    mine = F.struct(*order)
    verdict = F.when(mine == F.col("_first"), "NEW").when(F.col(name).eqNullSafe(F.col("_first_name")), "DUPLICATE").otherwise("REDELIVERY")
    return (
        arrivals.join(first, digest)
        .withColumn("verdict", verdict)
        .withColumn("seen_count", F.when(F.col("verdict") == "NEW", 1).otherwise(2))
        .drop("_first", "_first_name")
    )


def quiescent(scans: DataFrame, path: str, seq: str, state: list[str], interval: int, quiet: int, sentinel: str | None = None) -> DataFrame:
    """(path, seq): the scan at which each file counts as completely written, once for each appearance of it.

    A file is complete when its state (size, time) stayed the same for ``quiet``
    seconds of scans ``interval`` apart, or at its first unchanged scan if its
    ``sentinel`` exists. A file that is absent from a scan and comes back is new.
    """
    by = Window.partitionBy(path).orderBy(seq)
    same = F.lit(True)
    for c in state:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(by))
    back = F.coalesce(F.col(seq) != F.lag(seq).over(by) + 1, F.lit(True))
    runs = scans.withColumns({"_back": back, "_change": back | ~same})
    runs = runs.withColumns({"_life": F.sum(F.col("_back").cast("int")).over(by), "_run": F.sum(F.col("_change").cast("int")).over(by)})
    kept = Window.partitionBy(path, "_run").orderBy(seq)
    runs = runs.withColumn("_still", F.row_number().over(kept) - 1)
    done = F.col("_still") * interval >= quiet
    if sentinel:
        done = done | F.col(sentinel) & (F.col("_still") >= 1)
    return runs.where(done & (F.col("_still") >= 1)).groupBy(path, "_life").agg(F.min(seq).alias(seq)).select(path, seq)


def queue_arrivals(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Good and malformed queue messages: ``{messageId, source, payload}`` envelopes become named arrivals."""
    parsed = messages.withColumn("_v", F.try_parse_json(value))
    get = lambda path: F.try_variant_get("_v", path, "string")
    good = parsed.where(F.col("_v").isNotNull()).select(
        queue_name(get("$.source"), get("$.messageId"), F.col("topic"), F.col("partition"), F.col("offset")).alias("name"),
        F.coalesce(get("$.payload"), F.col(value)).alias("content"),
    )
    return good.withColumn("sha256", F.sha2("content", 256)), parsed.where("_v IS NULL").drop("_v")
