"""The tamper-evident decision log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import record_hash

#: Hashed fields besides the previous hash, in order; ``at`` is RFC 3339 text.
FIELDS = ("record_id", "arrival_id", "at", "component", "decision_type", "inputs_json", "outcome_json", "actor")
MARK = "\x1f"


def hashed_text() -> Column:
    """What a record's hash is taken of, but for the hash before it."""
    return F.concat(*(x for f in FIELDS for x in (F.coalesce(F.col(f), F.lit("")), F.lit(MARK))))


def linked(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` of ``rows`` with prev_hash and record_hash; the rows have _text and _head, and lie, arrival by arrival, in their chains' order.

    Rows stream through; only the last hash is carried, so memory doesn't grow with a chain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrival, last = None, None
        for batch in batches:
            before, own = [], []
            for a, text, head in zip(*(batch.column(c).to_pylist() for c in ("arrival_id", "_text", "_head")), strict=True):
                if last is None or a != arrival:
                    arrival, last = a, head or ""
                before.append(last)
                last = hashlib.sha256(f"{text}{last}{MARK}".encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(before, pa.string()), pa.array(own, pa.string())], [*keep, "prev_hash", "record_hash"])

    kinds = StructType([*(rows.schema[c] for c in keep), StructField("prev_hash", StringType()), StructField("record_hash", StringType())])
    return rows.select(*keep, "_text", "_head").mapInArrow(run, kinds)


def chain_links(records: DataFrame) -> DataFrame:
    """arrival_id, record_id, prev_hash and record_hash of each record, along its arrival's chain in order (at, record_id)."""
    rows = records.select("arrival_id", "at", "record_id", hashed_text().alias("_text"), F.lit("").alias("_head"))
    return linked(rows.repartition("arrival_id").sortWithinPartitions("arrival_id", "at", "record_id", "_text"), ["arrival_id", "record_id"])


def extend(stored: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What new ``records`` add to ``stored`` chains: them with prev_hash and record_hash, and those that come too late.

    Records that are stored already (by arrival_id and record_id; two without an id are the same), or given twice (the first by time counts), add
    nothing, so that a batch may be played again. A chain goes on from its last stored record; what would stand before that one (by at and
    record_id) can't be linked any more. Chains and batch are shuffled once, by arrival.
    """
    names = ["arrival_id", "record_id", *(c for c in records.columns if c not in ("arrival_id", "record_id"))]
    old = stored.select("arrival_id", "record_id", "at", "record_hash", F.lit(False).alias("_new"))
    both = records.select(*names, hashed_text().alias("_text"), F.lit(True).alias("_new")).unionByName(old, allowMissingColumns=True).repartition("arrival_id")
    seen = F.row_number().over(Window.partitionBy("arrival_id", "record_id").orderBy("_new", "at", "_text"))
    # stored records come first, so that each new one sees the last of all of them
    so_far = Window.partitionBy("arrival_id").orderBy("_new", "at", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(~F.col("_new"), F.struct("at", "record_id", "record_hash"))).over(so_far)
    fresh = both.withColumn("_seen", seen).withColumn("_last", last).where("_new AND _seen = 1")
    late = F.coalesce(F.struct("at", "record_id") < F.struct(F.col("_last.at").alias("at"), F.col("_last.record_id").alias("record_id")), F.lit(False))
    good = fresh.where(~late).select(*names, "_text", F.coalesce("_last.record_hash", F.lit("")).alias("_head"))
    return linked(good.sortWithinPartitions("arrival_id", "at", "record_id", "_text"), names), fresh.where(late).select(*names)


def verify(records: DataFrame) -> DataFrame:
    """(arrival_id, position, record_id, reason) of the first break of each broken chain; positions count from 1.

    A record whose prev_hash isn't its predecessor's hash is a broken link; one whose
    own hash doesn't fit its fields was edited. The link is tested first.
    """
    by = Window.partitionBy("arrival_id").orderBy("at", "record_id")
    seen = records.withColumns(
        {
            "position": F.row_number().over(by),
            "_link": F.coalesce(F.lag("record_hash").over(by), F.lit("")),
            "_own": record_hash([F.col(c) for c in (*FIELDS, "prev_hash")]),
        }
    )
    reason = F.when(F.col("prev_hash") != F.col("_link"), "link").when(F.col("record_hash") != F.col("_own"), "content")
    broken = seen.withColumn("reason", reason).where("reason IS NOT NULL")
    return broken.groupBy("arrival_id").agg(F.min_by(F.struct("position", "record_id", "reason"), "position").alias("b")).select("arrival_id", "b.*")


def verify_all(records: DataFrame) -> DataFrame:
    """(arrival_id, records, position, record_id, reason) of every chain: how long it is, and its first break (nulls where it is whole)."""
    chains = records.groupBy("arrival_id").agg(F.count("*").alias("records"))
    return chains.join(verify(records), "arrival_id", "left")


def previous_hash(records: DataFrame) -> DataFrame:
    """(arrival_id, record_hash): the latest record's hash."""
    return records.groupBy("arrival_id").agg(F.max_by("record_hash", F.struct("at", "record_id")).alias("record_hash"))
