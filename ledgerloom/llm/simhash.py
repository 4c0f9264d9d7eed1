"""SimHash near-duplicates: fingerprints, exact links and components.

Distinct fingerprints are partitioned by a vantage-point tree over a bounded
sample; each goes to its own shard and, as a query, to those shards whose
boundary is within reach. Shards are searched exactly by trees of their own and
give stars (value, smallest linked value) instead of pairs. Rounds of
large-star and small-star joins then merge the stars into components.

Defined cases: a null text, or one without a word, has fingerprint 0 and links
like any other; a text of any length is read whole; repeated rows share a fingerprint and a component; a null
doc_id never is a component's id unless the component has no other; other columns, whatever they are called,
play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash, vptree
from .common import chunks, drop_materialized, materialize, tidy_group

SHINGLE, SEED, REACH = 3, 42, 3
#: Fingerprints of which the shards' tree is built: so many, or SAMPLE_ROOT times the square root of all, so that shards can grow in number.
SAMPLE, SAMPLE_ROOT = 65_536, 4
#: A shard should hold this many times the square root of all distinct fingerprints: queries visit
#: a share of the shards, so that fewer, larger ones keep the rows sent near to proportion with the input.
SHARD = 8
#: A shard with more fingerprints of its own than this (a dense ball that no tree can part), or more queries, is searched in blocks of both.
BLOCK = 262_144
#: Up to this many row numbers (of 8 bytes) are broadcast to the texts; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(joined, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        first = (end - size)[: len(words) - SHINGLE + 1].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first, end[SHINGLE - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in chunks(batches, "text"):
            fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def shard_tree(distinct: DataFrame, total: int) -> tuple[vptree.Node, int]:
    """The shards' tree, from a sample of the fingerprints chosen by hash."""
    size = max(SAMPLE, int(SAMPLE_ROOT * total**0.5))
    share = min(1.0, size / max(1, total))
    draw = F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1_000_003)) / 1_000_003
    sample = distinct.where(draw < share).select("fp").limit(2 * size).toArrow()["fp"].to_numpy()
    return vptree.build(np.sort(sample.view(np.uint64)), max(16, int(SHARD * total**0.5 * share)))


def star_links(distinct: DataFrame) -> DataFrame:
    """(a, b) with b < a: stars of the components within each shard, whose union has all links' components."""
    spark = distinct.sparkSession
    root, leaves = shard_tree(distinct, distinct.count())
    tree = spark.sparkContext.broadcast(root)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, asked = np.zeros(leaves, np.int64), np.zeros(leaves, np.int64)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            n += np.bincount(vptree.home_leaves(tree.value, fp), minlength=leaves)
            asked += np.bincount(vptree.visits(tree.value, fp, REACH)[1], minlength=leaves)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(leaves)), pa.array(n), pa.array(asked)], ["leaf", "n", "asked"])

    counts = distinct.select("fp").mapInArrow(count, "leaf long, n long, asked long").groupBy("leaf")
    blocks, turns = np.ones(leaves, np.int64), np.ones(leaves, np.int64)
    for r in counts.agg(F.sum("n").alias("n"), F.sum("asked").alias("asked")).collect():
        blocks[r.leaf] = max(1, -(-r.n // BLOCK))
        turns[r.leaf] = max(1, -(-(r.asked + r.n * (blocks[r.leaf] > 1)) // BLOCK))

    def dealt(fp: np.ndarray, parts: np.ndarray, times: int) -> np.ndarray:
        """One of so many parts for each fingerprint; near ones don't go together."""
        return ((fp * np.uint64(times) >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)

    def each(parts: np.ndarray) -> np.ndarray:
        """0, 1 ... up to each number of parts."""
        return np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            leaf = vptree.home_leaves(tree.value, fp)
            block = dealt(fp, blocks[leaf], 0x9E3779B97F4A7C15)
            # a value's own block is searched once for each of its shard's turns of queries
            home = np.repeat(np.arange(len(fp)), turns[leaf])
            at, to = vptree.visits(tree.value, fp, REACH)
            # a query visits all blocks of a shard; a value of a shard in blocks visits those after its own
            more = np.repeat(np.arange(len(at)), blocks[to])
            later = blocks[leaf] - 1 - block
            own = np.repeat(np.arange(len(fp)), later)
            query = np.concatenate([at[more], own])
            to_leaf = np.concatenate([to[more], leaf[own]])
            to_block = np.concatenate([each(blocks[to]), block[own] + 1 + each(later)])
            turn = dealt(fp[query], turns[to_leaf], 0xD6E8FEB86659FD93)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([leaf[home], to_leaf])),
                    pa.array(np.concatenate([block[home], to_block])),
                    pa.array(np.concatenate([each(turns[leaf]), turn])),
                    pa.array(np.concatenate([fp[home], fp[query]]).view(np.int64)),
                    pa.array(np.arange(len(home) + len(query)) < len(home)),
                ],
                ["leaf", "block", "turn", "fp", "home"],
            )

    def solve(group: pa.Table) -> pa.Table:
        home = group["home"].to_numpy()
        fp = group["fp"].to_numpy().view(np.uint64)
        a, b = vptree.local_stars(fp[home], fp[~home], REACH)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = distinct.select("fp").mapInArrow(send, "leaf long, block long, turn long, fp long, home boolean")
    return sent.groupBy("leaf", "block", "turn").applyInArrow(tidy_group(solve), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(a, b): every linked value with the smallest value of its component (as signed longs); the smallest itself is left out.

    Large-star and small-star rounds, each written to the shared folder, until nothing changes.
    """
    order = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    edges = materialize(links.select(*order("a", "b")).where("a != b").distinct(), "links")
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    before = mark(edges)
    while before.n:
        # large star: every larger neighbour of a value goes to the smallest of its neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: a value and its smaller neighbours go to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        now = mark(after)
        drop_materialized(edges)
        edges = after
        if now == before:
            break
        before = now
    return edges


def label_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of each document."""
    of_doc = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(of_doc.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    root = components(star_links(distinct))
    rooted = distinct.join(root, distinct.fp == root.a, "left").select("fp", "least", F.coalesce("b", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return of_doc.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketches(docs: DataFrame) -> DataFrame:
    """row_no, doc_id, fp, words (digest of the set of five-word shingles), its size and its MinHash bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in chunks(batches, "text"):
            texts = batch.column("text").to_pylist()
            fp = np.array([fingerprint(t) for t in texts], np.uint64)
            words, size, bands = [], [], []
            for t in texts:
                found = minhash.shingles(t)
                words.append(xxhash.xxh3_128_digest(found.tobytes()))
                size.append(len(found))
                bands.append(minhash.bands(found))
            columns = [batch.column("row_no"), batch.column("doc_id"), pa.array(fp.view(np.int64)), pa.array(words, pa.binary()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row_no", "doc_id", "fp", "words", "size", "bands"])

    shape = "row_no long, doc_id long, fp long, words binary, size long, bands array<long>"
    return docs.select("row_no", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, shape)


def near_components(docs: DataFrame) -> DataFrame:
    """row_no, doc_id, fp, words and root of each row: rows within REACH bits, or of a five-word Jaccard of 0.8 or more, share a root."""
    of_row = materialize(sketches(docs), "sketches")
    nodes = materialize(of_row.groupBy("fp", "words").agg(F.min("row_no").alias("node")), "distinct-texts")
    of_fp = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least")), "distinct-fingerprints")
    of_words = materialize(nodes.groupBy("words").agg(F.min("node").alias("least")), "distinct-sets")
    star = star_links(of_fp)
    star = star.join(of_fp.toDF("a", "_a"), "a").join(of_fp.toDF("b", "_b"), "b").select("_a", "_b")
    same = [nodes.join(x, on).where("node != least").select("node", "least") for x, on in ((of_fp, "fp"), (of_words, "words"))]
    first = components(star.union(same[0]).union(same[1]).toDF("a", "b"))
    # most near copies are together by now: only buckets that hold several of these components can add links
    one = of_row.withColumnRenamed("row_no", "node").join(of_words.select(F.col("least").alias("node")), "node", "left_semi")
    one = one.join(first, one.node == first.a, "left").select("node", "size", "bands", F.coalesce("b", "node").alias("root"))
    near = minhash.jaccard_links(docs.select(F.col("row_no").alias("node"), "text"), one, BROADCAST_ROWS)
    root = components(first.union(near))
    rooted = nodes.join(root, nodes.node == root.a, "left").select("fp", "words", F.coalesce("b", "node").alias("root"))
    return of_row.select("row_no", "doc_id", "fp", "words").join(rooted, ["fp", "words"])


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near copies, one of its smallest doc_id, all columns as they were.

    Near copies are those of ``near_components``, which reach further than the labels'. ``docs``
    must give the same rows in the same places each time, as files do. Rows are told apart by
    their places, so that texts of one doc_id in different groups all stay; of a group's rows that share
    its smallest doc_id, the text decides. A row without a doc_id stays.
    """
    names = docs.columns
    inner = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)]  # no name of the input can clash
    rows = docs.toDF(*inner).withColumn("row_no", F.monotonically_increasing_id())
    groups = materialize(near_components(rows.select("row_no", "doc_id", "text")), "near-groups")
    first = groups.where("doc_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "fp", "words", "row_no")).alias("least")).select("least.row_no")
    kept = first.union(groups.where("doc_id IS NULL").select("row_no"))
    gone = materialize(groups.select("row_no").join(kept, "row_no", "left_anti"), "gone")
    # texts needn't move where the rows that leave are few enough to be sent to them
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(gone, "row_no", "left_anti").select(*inner).toDF(*names)
