"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected onto a few axes; each of several Hilbert orderings is of other
axes and another shift. Spark range-partitions all orderings by key; a row's place in its partition and the counts of
the partitions before it give its rank in each ordering, and ranks are cut into ranges of equally many vectors.
A query's candidates are the rows that stand in its own range or one of the neighbouring ones in any ordering.

Each vector moves once, to the group of its range in the first ordering. A query goes to the groups of
its window there, and to those where some row stands in its window of another ordering, as the groups' summaries tell;
the rows' range numbers decide which are candidates, so that each pair is scored once. The groups' best
are merged, and all scores are exact inner products of the original vectors in double precision.

The windows are a share of the ordering, not a number of rows, so that recall
doesn't fall as the table grows. Groups with many vectors are dealt out in
blocks; no row is left out of the index.

Defined cases: null, zero or non-finite vectors, those of another
length than most, and rows without an id take no part; equal vectors share
one place, equal scores go to the smaller id; rows that repeat an id and
vector count once, and an id with several vectors is a candidate, and a query, by its best one; fewer candidates than k give all;
other columns, whatever they are called, play no part; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .hilbert import hilbert_keys
from .vectors import distinct_vectors, matrix, search_groups, top_k, usable_vectors

CURVES, AXES, BITS = 6, 4, 10
#: Ranges of an ordering (fewer where one would hold less than 2 (k + 1) vectors), and how many on either side of its own are a query's window.
RANGES, REACH = 32, 4
#: Vectors of which the axes' middles and scales are fitted (a bound), vectors in a block of a group, and rows of an ordering in a partition.
SAMPLE, BLOCK, PART = 20_000, 4_096, 100_000


class Curves:
    """Projections and shifts; the axes' middles and scales are fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        turn = [np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(-(-CURVES * AXES // dims))]
        axes = np.concatenate(turn, axis=1)[:, : CURVES * AXES]
        self.axes = axes
        placed = sample @ axes
        self.middle, self.scale = placed.mean(axis=0), np.maximum(placed.std(axis=0), 1e-12)
        self.shift = rng.random(axes.shape[1]) / 4

    def keys(self, x: np.ndarray) -> np.ndarray:
        """vectors x curves: each curve's key of each vector."""
        z = (x @ self.axes - self.middle) / self.scale
        unit = 0.75 / (1 + np.exp(-1.7 * np.clip(z, -30, 30))) + self.shift
        grid = np.clip((unit * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        return np.stack([hilbert_keys(grid[:, c * AXES : (c + 1) * AXES], BITS) for c in range(CURVES)], axis=1)


def lists(values: np.ndarray) -> pa.ListArray:
    """A list column of the rows of a matrix."""
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel()))


def ranked(keyed: DataFrame, n: int, n_ranges: int) -> DataFrame:
    """no and ranges (of every ordering) of each row of (no, keys), by partitions of ranges of keys."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(CURVES, np.int64)
        for batch in batches:
            curve = batch.column("curve").to_numpy()
            at = np.zeros(len(curve), np.int64)
            for c in np.unique(curve):
                own = curve == c
                at[own] = seen[c] + np.arange(own.sum())
                seen[c] += own.sum()
            yield pa.RecordBatch.from_arrays(
                [batch.column("no"), batch.column("curve"), pa.array(np.full(len(curve), part)), pa.array(at)], ["no", "curve", "part", "at"]
            )

    long = keyed.select("no", F.posexplode("keys").alias("curve", "key"))
    parts = max(2 * CURVES, CURVES * n // PART)
    placed = long.repartitionByRange(parts, "curve", "key").sortWithinPartitions("curve", "key", "no")
    placed = materialize(placed.select("no", "curve").mapInArrow(place, "no long, curve int, part long, at long"), "placed")
    sizes = placed.groupBy("curve", "part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranks = placed.join(sizes.select("curve", "part", F.coalesce(before, F.lit(0)).alias("before")), ["curve", "part"])
    number = (F.expr("before + at") * n_ranges / n).cast("int")
    one = [F.max(F.when(F.col("curve") == c, number)) for c in range(CURVES)]
    return ranks.groupBy("no").agg(F.array(*one).alias("ranges"))


def in_window(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """queries x rows: whether the row stands in the query's window of any ordering, by their range numbers."""
    out = np.zeros((len(queries), len(rows)), bool)
    for c in range(rows.shape[1]):
        out |= np.abs(rows[:, c][None, :] - queries[:, c][:, None]) <= REACH
    return out


def nearest(embeddings: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for the rows where ``is_query`` holds."""
    spark = embeddings.sparkSession
    usable = materialize(usable_vectors(embeddings, drop_zero=True), "vectors")
    distinct = materialize(distinct_vectors(usable, k + 1), "distinct-vectors").withColumn("no", F.monotonically_increasing_id())
    n = distinct.count()
    draw = F.pmod(F.xxhash64("vec"), F.lit(1_000_003)) / 1_000_003
    sample = distinct.where(draw < min(1.0, SAMPLE / max(1, n))).select("vec").limit(2 * SAMPLE).toArrow()
    x = matrix(sample["vec"].combine_chunks())
    n_ranges = min(RANGES, max(1, n // (2 * (k + 1))))
    curves = spark.sparkContext.broadcast(Curves(x if len(x) else np.zeros((1, 1))))
    blocks = max(1, -(-n // (n_ranges * BLOCK)))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("no"), lists(curves.value.keys(matrix(batch.column("vec"))))], ["no", "keys"])

    ranges = ranked(distinct.select("no", "vec").mapInArrow(keys, "no long, keys array<long>"), n, n_ranges)
    data = materialize(distinct.join(ranges, "no"), "ranked-vectors")
    # which range numbers of each ordering a group's rows have: RANGES x CURVES x RANGES bits
    present = np.zeros((n_ranges, CURVES, n_ranges), bool)
    for r in data.select(F.element_at("ranges", 1).alias("group"), F.posexplode("ranges").alias("curve", "range")).distinct().collect():
        present[r.group, r.curve, r.range] = True

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.array(batch.column("ranges").to_pylist())
            near = np.abs(np.arange(n_ranges)[None, None, :] - own[:, :, None]) <= REACH
            at, group = np.nonzero(np.einsum("qcr,gcr->qg", near.astype(np.int32), present.astype(np.int32)) > 0)
            for block in range(blocks):
                some = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(group), pa.array(np.full(len(at), block)), some.column("vec_id"), some.column("vec"),
                        pa.nulls(len(at), pa.list_(pa.int64())), some.column("ranges"),
                    ],
                    ["group", "block", "query_id", "vec", "ids", "ranges"],
                )

    shape = "group long, block long, query_id long, vec binary, ids array<long>, ranges array<int>"
    queries = usable.where(is_query).distinct().join(data.select("vec", "ranges"), "vec")
    asked = queries.select("vec_id", "vec", "ranges").mapInArrow(ask, shape)
    homes = data.select(
        F.element_at("ranges", 1).cast("long").alias("group"), F.pmod(F.xxhash64("no"), F.lit(blocks)).alias("block"),
        F.lit(None).cast("long").alias("query_id"), "vec", "ids", "ranges",
    )
    return top_k(search_groups(homes.union(asked), k, ["group", "block"], in_window), k)
