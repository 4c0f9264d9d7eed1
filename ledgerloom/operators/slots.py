"""Slots: pairing of the two sides, supersession, deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendars import add_business_days

KEY = ("client_id", "domain", "value_date")
GL, CLIENT = "INTERNAL_GL", "EXTERNAL_CLIENT"


def fold(arrivals: DataFrame) -> DataFrame:
    """Each arrival's outcome in its slot: side_1, side_2, state, assignment_id, supersedes.

    ``arrivals`` has the key, arrival_id, side and seq (a total order within a slot).
    A side's latest arrival counts. A complete slot assigns, and each arrival
    after that assigns anew and supersedes the assignment before it. Assignment
    ids are named after the arrival that caused them.
    """
    by = Window.partitionBy(*KEY).orderBy("seq")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = lambda side: F.last(F.when(F.col("side") == side, F.col("arrival_id")), True).over(upto)
    sides = arrivals.withColumns({"side_1": latest(GL), "side_2": latest(CLIENT)})
    complete = F.col("side_1").isNotNull() & F.col("side_2").isNotNull()
    assigned = sides.withColumn("assignment_id", F.when(complete, F.concat(F.lit("asg-"), F.col("arrival_id").cast("string"))))
    return assigned.withColumns(
        {
            "supersedes": F.when(complete, F.lag("assignment_id").over(by)),
            "state": F.when(complete, "ASSIGNED").otherwise("PARTIAL"),
        }
    )


def current(outcomes: DataFrame) -> DataFrame:
    """Each slot as its last outcome left it."""
    last = F.max_by(F.struct("side_1", "side_2", "state", "assignment_id"), "seq").alias("s")
    return outcomes.groupBy(*KEY).agg(last, F.min("seq").alias("opened_seq")).select(*KEY, "s.*", "opened_seq")


def voids(outcomes: DataFrame) -> DataFrame:
    """(assignment_id, voided_by) of every superseded assignment."""
    return outcomes.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("assignment_id"), F.col("assignment_id").alias("voided_by"))


def accepted(arrivals: DataFrame, days: DataFrame, as_of: str, window: Column | int = 2) -> DataFrame:
    """``arrivals`` with accepted: whether value_date lies within ``window`` business days of ``as_of``, both ends included."""
    n = F.lit(window) if isinstance(window, int) else window
    df = arrivals.withColumn("_now", F.to_date(F.lit(as_of))).withColumn("_n", n)
    cal = df.select("calendar_id", "_now", "_n").distinct()
    edges = add_business_days(cal.withColumn("_m", -F.col("_n")).withColumnRenamed("_n", "_k"), days, "calendar_id", "_now", F.col("_m"), "_from")
    edges = add_business_days(edges, days, "calendar_id", "_now", F.col("_k"), "_upto").select("calendar_id", F.col("_k"), "_from", "_upto")
    df = df.join(F.broadcast(edges.withColumnRenamed("calendar_id", "_cal")), (F.col("calendar_id") == F.col("_cal")) & (F.col("_n") == F.col("_k")), "left")
    ok = F.coalesce(F.col("value_date").between(F.col("_from"), F.col("_upto")), F.lit(False))
    return df.withColumn("accepted", ok).drop("_now", "_n", "_k", "_cal", "_from", "_upto")


def deadlines(slots: DataFrame, days: DataFrame, window: Column | int = 2) -> DataFrame:
    """``slots`` with deadline: 23:59 of the business day that ends the window after value_date."""
    df = add_business_days(slots, days, "calendar_id", "value_date", window, "_day")
    return df.withColumn("deadline", F.col("_day").cast("timestamp") + F.expr("interval 23 hours 59 minutes")).drop("_day")


def overdue(slots: DataFrame, as_of: str) -> DataFrame:
    """Slots past their deadline that aren't assigned, with the side that is missing (the ledger first)."""
    late = slots.where((F.col("deadline") < F.to_timestamp(F.lit(as_of))) & ~F.col("state").isin("ASSIGNED", "MISSING"))
    return late.withColumn("missing_side", F.when(F.col("side_1").isNull(), GL).otherwise(CLIENT))


def silent_expectations(expected: DataFrame, slots: DataFrame) -> DataFrame:
    """Expected (client, domain, value_date) for which no side ever came, so that no slot was opened."""
    return expected.join(slots.select(*KEY).distinct(), list(KEY), "left_anti")
