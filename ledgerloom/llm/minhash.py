"""Near copies by the words they share: texts whose sets of five-word shingles have a Jaccard of 0.8 or more.

MinHash bands propose buckets; buckets with the same members count once, and those whose members are all
known to belong together not at all. Inside a bucket every link is decided by the exact Jaccard of the whole shingle sets. A
bucket of more than BLOCK shingles is searched by pairs of blocks, so that a
task's memory doesn't grow with it. A pair of exactly 0.8 shares no band, and is
missed, with a chance of (1 - 0.8 ** ROWS) ** BANDS, about 3 in 100,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, tidy_group

SHINGLE, SEED = 5, 43
#: The least Jaccard of a link, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 20, 4
#: Shingles of a bucket that one block holds.
BLOCK = 2_000_000
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, one without a word has none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first = (end - size)[: len(words) - SHINGLE + 1].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(first, end[SHINGLE - 1 :].tolist(), strict=True)], np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """The buckets of a shingle set, as signed longs; none for an empty set."""
    if not len(found):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        low = np.minimum(low, (found[at : at + 4096, None] * _TIMES + _PLUS).min(axis=0))
    data = low.tobytes()
    keys = [xxhash.xxh64_intdigest(data[k * ROWS * 8 : (k + 1) * ROWS * 8], k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def stars(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(member, first member of its component) by index, the components being those of all links among ``sets``."""
    size = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(code.max() + 1, np.int64)
    left, left_code, left_size = np.arange(len(sets)), code, size
    over, under = LEAST
    members, roots = [], []
    while len(left) > 1:
        root, queue = left[0], [left[0]]
        left, left_code, left_size = left[1:], left_code[left_size[0] :], left_size[1:]
        while queue and len(left):
            x = queue.pop()
            own = code[at[x] : at[x + 1]]
            mark[own] = 1
            both = np.add.reduceat(mark[left_code], np.cumsum(left_size) - left_size)
            mark[own] = 0
            linked = under * both >= over * (size[x] + left_size - both)
            if linked.any():
                members.append(left[linked])
                roots.append(np.full(linked.sum(), root))
                queue += left[linked].tolist()
                left, left_code, left_size = left[~linked], left_code[np.repeat(~linked, left_size)], left_size[~linked]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *members]), np.concatenate([none, *roots])


def jaccard_links(texts: DataFrame, sketches: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(a, b): stars of nodes whose union has the components of all confirmed links.

    ``texts`` has node and text, ``sketches`` node, size (of its shingle set), bands and root (equal for nodes that are known to belong together),
    one row for each distinct set. Links between nodes of one root may be left out. Up to ``broadcast_rows`` nodes are broadcast to the texts
    whose shingles are wanted; more are joined by a shuffle.
    """
    placed = sketches.select("node", "size", "root", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        (F.min("root") != F.max("root")).alias("apart"),
    )
    # near copies share most of their bands: one bucket of the same members is enough
    once = shared.where("apart").groupBy("n", "total", "x", "y").agg(F.min("bucket").alias("bucket"))
    blocks = F.ceil(F.col("total") / F.lit(BLOCK)).cast("long")
    members = materialize(placed.join(once.select("bucket", blocks.alias("blocks")), "bucket").select("bucket", "node", "blocks"), "shared-buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in chunks(batches, "text"):
            sets = [shingles(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    wanted = materialize(members.select("node").distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    sets = materialize(texts.join(wanted, "node", "left_semi").select("node", "text").mapInArrow(run, "node long, shingles binary"), "shingle-sets")

    def solve(group: pa.Table) -> pa.Table:
        node = group["node"].to_numpy()
        member, root = stars([np.frombuffer(s.as_buffer(), np.uint64) for s in group["shingles"]])
        return pa.table({"a": node[member], "b": node[root]})

    block = F.pmod(F.xxhash64("node", "bucket"), F.col("blocks"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("block"))
    )
    dealt = members.withColumn("block", block).withColumn("other", F.explode(others))
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node")
    return dealt.join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(tidy_group(solve), "a long, b long")
