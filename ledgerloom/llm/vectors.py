"""What both vector searches share: usable distinct vectors, their queries, and merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable_vectors(df: DataFrame, drop_zero: bool, floor_scale: float | None = None) -> DataFrame:
    """vec_id and vec (components as little-endian doubles) of the rows that take part.

    Rows with a null id, a null vector, or null or non-finite components take no
    part, nor do zero vectors if ``drop_zero``, nor vectors that are not of
    the table's most common length (of equally common ones the longest).
    ``floor_scale`` turns each component x into floor(scale * x).
    """
    sizes = df.where("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy(F.size("embedding").alias("d"))
    common = sizes.agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dims = common.d if common else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("embedding").flatten().cast(pa.float64())
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            if floor_scale is not None:
                x = np.floor(floor_scale * x)
            ok = np.isfinite(x).all(axis=1)
            if drop_zero:
                ok &= (x != 0).any(axis=1)
            rows = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(8 * max(1, dims)), int(ok.sum()), [None, pa.py_buffer(np.ascontiguousarray(x[ok], "<f8").tobytes())]
            )
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(ok)), rows.cast(pa.binary())], ["vec_id", "vec"])

    sized = df.where(F.size("embedding") == dims) if dims else df.where(F.lit(False))
    return sized.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(
        pack, "vec_id long, vec binary"
    )


def distinct_vectors(usable: DataFrame, keep: int) -> DataFrame:
    """vec and ids: each distinct vector with its ``keep`` smallest ids.

    Rows of one vector tie in every search, and ties go to smaller ids, so no more than
    ``keep`` of them can be in a result; Spark limits each group before it shuffles.
    """
    rank = F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id"))
    return (
        usable.withColumn("rank", rank).where(F.col("rank") <= keep).groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    )


def spread(ids: list[list[int]], blocks: np.ndarray | int) -> np.ndarray:
    """A block for each list of ids, by a hash of its first."""
    first = np.array([x[0] for x in ids], np.int64).view(np.uint64)
    return ((first * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles of a binary column."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1) if rows else np.zeros((0, 1))


def best_of(scores: np.ndarray, ids: list[list[int]], own: int, k: int) -> tuple[list[int], list[float]]:
    """The k best (id, score) of distinct vectors' scores; ``own`` is left out and ties go to smaller ids."""
    least = np.partition(scores, -k - 1)[-k - 1] if len(scores) > k else -np.inf  # one more, as one may be the query itself
    near = np.flatnonzero((scores >= least) & (scores > -np.inf))
    found = sorted((-scores[i], x) for i in near.tolist() for x in ids[i] if x != own)[:k]
    return [x for _, x in found], [-s for s, _ in found]


def search_groups(rows: DataFrame, k: int, keys: list[str], candidates: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """query_id, vec_id and score: the k best of each query within each group.

    ``rows`` has the keys, query_id (null for data), vec, ids. A task streams
    its groups: a group's data come first and stay, its queries pass by in batches.
    With ``candidates`` they also have ranges (an array of numbers), and it tells from those of
    data and queries which pairs count.
    """
    more = ["ranges"] if candidates else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vecs, ids, data, marks = None, [], [], None, []
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            query, vec = batch.column("query_id").to_pylist(), batch.column("vec")
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if names[a] != now:
                    now, vecs, ids, data, marks = names[a], [], [], None, []
                middle = a
                while middle < b and query[middle] is None:
                    middle += 1
                if middle > a:
                    vecs.append(matrix(vec.slice(a, middle - a)))
                    ids += batch.column("ids").slice(a, middle - a).to_pylist()
                    marks += batch.column("ranges").slice(a, middle - a).to_pylist() if candidates else []
                if middle < b and ids:
                    data = np.concatenate(vecs) if data is None else data
                    for first in range(middle, b, 256):
                        last = min(b, first + 256)
                        scores = matrix(vec.slice(first, last - first)) @ data.T
                        if candidates:
                            asked = np.array(batch.column("ranges").slice(first, last - first).to_pylist(), np.int16)
                            scores[~candidates(np.array(marks, np.int16), asked)] = -np.inf
                        for q, s in zip(query[first:last], scores, strict=True):
                            found, value = best_of(s, ids, q, k)
                            out[0].extend([q] * len(found))
                            out[1].extend(found)
                            out[2].extend(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"]
            )

    placed = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("query_id").asc_nulls_first())
    return placed.select(*keys, "query_id", "vec", "ids", *more).mapInArrow(run, "query_id long, vec_id long, score double")


def top_k(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best, found in any group."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
