"""Rows of files as canonical records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bare_number, normalise_side, signed_number
from ..schema import CANONICAL_FIELDS, MONEY, MONEY_FIELDS, STAMPED


def project(rows: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Canonical records of ``rows``: cells (map of header to text), mapping (map of field to header) and the stamped columns.

    A field is read from its mapped column only; stamped fields never come from
    cells. Blank cells and unreadable numbers are null. Blank account names
    come from ``accounts`` (account_id, account_name), which is configuration.
    """

    read = [f for f in CANONICAL_FIELDS if f not in STAMPED]
    cell = lambda f: F.trim(F.try_element_at("cells", F.try_element_at("mapping", F.lit(f))))
    # one projection for each step, so that no cell is looked up or cleaned twice
    texts = rows.select(*(F.col(f).cast("string").alias(f) for f in STAMPED), *(cell(f).alias(f) for f in read))
    bare = texts.select(*(bare_number(F.col(f)).alias(f) if f in MONEY_FIELDS else F.col(f) for f in texts.columns))

    def field(name: str):
        if name in MONEY_FIELDS:
            return signed_number(F.col(name)).cast(MONEY)
        return normalise_side(F.col(name)) if name == "side" else F.when(F.col(name) != "", F.col(name))

    out = bare.select(*((F.col(f) if f in STAMPED else field(f)).alias(f) for f in CANONICAL_FIELDS))
    if accounts is None:
        return out
    known = accounts.select("account_id", F.col("account_name").alias("_name"))
    named = out.join(known, "account_id", "left").withColumn("account_name", F.coalesce("account_name", "_name"))
    return named.select(*CANONICAL_FIELDS)


def route_topics(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dispatched rows, and the others."""
    ok = F.col("disposition") == "DISPATCHED"
    return classified.where(ok), classified.where(~ok)


def write_canonical(records: DataFrame, path: str) -> None:
    """Parquet by client and value date."""
    records.write.mode("append").partitionBy("client_id", "value_date").parquet(path)
