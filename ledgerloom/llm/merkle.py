"""A Merkle manifest of a dataset: one tree per source, and one over the sources' roots.

A row becomes a leaf: the digest of its fields, each with its length. The leaves of a source, in the order of
their ids, are the bottom of a tree: every ``FANOUT`` consecutive nodes become one, and a last run of fewer (even of
one) becomes one too, without padding. The tree's size is thus known from the number of its leaves alone.

How the work is shared out:

* rows are reduced to digests where they are read; only digests move. A range partitioning by source and id, and the
  number of rows of each (partition, source), tell each leaf its index, without a task that sees a whole source;
* a segment is what lies both in one partition and in one aligned block of ``FANOUT ** LEVELS`` leaves. Its leaves
  go through a mountain-range stack (``Mountain``): a carry turns a full run on top of the stack into its parent. Completed nodes are
  emitted as records; those whose family isn't wholly in the segment stay as peaks (``FANOUT - 1`` a level and edge at most);
* the peaks of each aligned block go through the same stack in the order of their leaves, which mends the edges that
  partitions cut, and leave one node of level ``LEVELS``; ``FANOUT ** LEVELS`` such nodes make one of twice that level, and so on up to the
  roots, in as many rounds as the largest source needs (two up to 387 million leaves, three beyond);
* the same rounds, downwards, tell each peak its siblings up to the root, and each segment its leaves' proofs.

Defined cases: a null field is ``-``; an empty text is ``0:``; a row without a source belongs to a source of its own that
comes first, one without an id comes first in its source; rows of equal id stand in the order of their digests, and equal rows
are separate leaves; texts of any length are hashed whole, where they are read; a lone leaf is its source's root, and a lone
source's root the root; an empty table has no leaves and gives an empty result; other columns, whatever they are called, play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import crc32_mod, materialize

FANOUT = 3
#: Levels that one block's stack spans.
LEVELS = 9
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "grp string, n long, part int, block long, level int, index long, digest string, made boolean, peak boolean"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def sizes(n: int, fanout: int = FANOUT) -> list[int]:
    """Number of nodes of each level over ``n`` leaves, the root's last."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Mountain:
    """The mountain-range stack over a stretch of one tree of ``n`` leaves.

    Nodes are pushed in the order of their leaves; ``stack`` holds the peaks, ``families`` each completed node's
    children in order of completion. No node above level ``top`` is made.
    """

    def __init__(self, n: int, top: int = 63, fanout: int = FANOUT):
        self.counts = sizes(n, fanout)
        self.top = min(top, len(self.counts) - 1)
        self.fanout = fanout
        self.stack: list[tuple[int, int, str]] = []
        self.families: dict[tuple[int, int], tuple[str, ...]] = {}
        self.digests: dict[tuple[int, int], str] = {}

    def push(self, level: int, index: int, value: str) -> None:
        stack, fanout = self.stack, self.fanout
        stack.append((level, index, value))
        while level < self.top:
            place = index % fanout
            if place != fanout - 1 and index != self.counts[level] - 1:
                return
            if place >= len(stack) or stack[-1 - place][:2] != (level, index - place):
                return  # the run begins before this stretch
            family = tuple(x[2] for x in stack[-1 - place :])
            del stack[-1 - place :]
            level, index, value = level + 1, index // fanout, digest("".join(family))
            self.families[level, index], self.digests[level, index] = family, value
            stack.append((level, index, value))

    def descend(self, above: dict[tuple[int, int], tuple[str, ...]]) -> dict[tuple[int, int], tuple[str, ...]]:
        """The path of every node below those in ``above``, whose paths are given.

        A path has two texts a level, upwards: the digests of the run's nodes to the left, and of those to the right.
        """
        paths = dict(above)
        for (level, index), family in reversed(self.families.items()):
            up, first = paths[level, index], index * self.fanout
            for k in range(len(family)):
                paths[level - 1, first + k] = ("".join(family[:k]), "".join(family[k + 1 :]), *up)
        return paths


def fold(value: str, path: Sequence[str]) -> str:
    """The root that a leaf and its path give."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        value = digest(left + value + right)
    return value


def leaf_digest(values: dict[str, Column]) -> Column:
    """Digest of a row's fields in the order given: ``-``, or the number of UTF-8 bytes, a colon and the value."""

    def coded(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(coded, values.values())), 256)


def number(rows: DataFrame, order: Sequence[str], block: int) -> DataFrame:
    """``rows`` with their index among those of the same ``grp`` (from 0), the number of those (n), their partition and block.

    The rows are range-partitioned, so that a large group is spread over partitions; what is then summed up by group has one row
    for each partition that holds some of it.
    """
    keys = [F.col("grp"), *(F.col(c).asc_nulls_first() for c in order)]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("part", F.spark_partition_id()), "placed")
    parts = placed.groupBy("grp", "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("grp", "part", (F.col("first") - before).alias("shift"), F.sum("rows").over(group).alias("n"))
    found = placed.join(parts, ["grp", "part"]).withColumn("index", F.col("place") - F.col("shift")).drop("place", "shift")
    return found.withColumn("block", F.expr(f"index div {block}"))


def table_rows(nodes: pa.Table, *columns: str) -> list[tuple]:
    return list(zip(*(nodes.column(c).to_pylist() for c in columns), strict=True))


def climb(nodes: pa.Table, top: int, fanout: int) -> Mountain:
    """A stack after all nodes of a stretch, which are pushed in the order of their leaves."""
    mountain = Mountain(nodes.column("n")[0].as_py(), top, fanout)
    for level, index, value in sorted(table_rows(nodes, "level", "index", "digest"), key=lambda x: x[1] * fanout ** x[0]):
        mountain.push(level, index, value)
    return mountain


def records(mountain: Mountain) -> list[tuple[int, int, str, bool, bool]]:
    """What a stack leaves: level, index and digest of each node that it made, and of each peak."""
    peaks = {x[:2] for x in mountain.stack}
    made = [(*k, v, True, k in peaks) for k, v in mountain.digests.items()]
    return made + [(*x, False, True) for x in mountain.stack if x[:2] not in mountain.digests]


@dataclass
class Forest:
    """A tree for each grp over numbered leaves, and what each round of stacks left."""

    leaves: DataFrame  # grp, part, block, n, index, digest and whatever goes along
    rounds: list[DataFrame]  # records; round 0 is that of the segments
    fanout: int
    levels: int

    def height(self) -> str:
        """SQL for the level of the root over n leaves: how many powers of the fanout are below n."""
        return f"({' + '.join(f'CAST(n > {x} AS INT)' for x in self.powers())})"

    def powers(self) -> list[int]:
        return [self.fanout**k for k in range(63) if self.fanout**k < 1 << 62]

    def open_peaks(self, turn: int) -> DataFrame:
        """Peaks of the round before ``turn`` that aren't roots, with the aligned block that mends them; its part is -turn."""
        first = F.col("index") * F.element_at(F.array(*map(F.lit, self.powers())), F.col("level") + 1)
        found = self.rounds[turn - 1].where(f"peak AND level < {self.height()}").withColumn("first", first)
        block = F.expr(f"first div {self.fanout ** (self.levels * turn)}")
        return found.select("grp", F.lit(-turn).alias("part"), block.alias("block"), "n", "level", "index", "digest")

    def root_records(self) -> DataFrame:
        found = [made.where(f"peak AND level = {self.height()}").select("grp", "n", "level", "index", "digest") for made in self.rounds]
        out = found[0]
        for other in found[1:]:
            out = out.unionByName(other)
        return out

    def nodes(self) -> DataFrame:
        """Every node above the leaves: grp, n, level, index, digest."""
        found = [made.where("made").select("grp", "n", "level", "index", "digest") for made in self.rounds]
        out = found[0]
        for other in found[1:]:
            out = out.unionByName(other)
        return out

    def prove(self, above: DataFrame, finish: Callable[[dict, Sequence[str]], dict], schema: str, needs: Sequence[str]) -> DataFrame:
        """``finish(row, path)`` of every leaf: of its columns ``needs``, and of its path to the root and on by what ``above`` (grp, path) says of its tree.

        Downwards, each round tells the peaks under its blocks' nodes their paths, and the segments tell their leaves.
        """
        fanout, levels = self.fanout, self.levels
        told = "grp string, level int, index long, path array<string>"
        told_arrow, out = to_arrow_schema(StructType.fromDDL(told)), to_arrow_schema(StructType.fromDDL(schema))

        def paths_of(nodes: pa.Table, given: pa.Table, top: int) -> dict[tuple[int, int], tuple[str, ...]]:
            return climb(nodes, top, fanout).descend({(k, i): tuple(p) for k, i, p in table_rows(given, "level", "index", "path")})

        def down(nodes: pa.Table, given: pa.Table) -> pa.Table:
            found = paths_of(nodes, given, -levels * nodes.column("part")[0].as_py())
            rows = [{"grp": g, "level": k, "index": i, "path": found[k, i]} for g, k, i in table_rows(nodes, "grp", "level", "index")]
            return pa.Table.from_pylist(rows, told_arrow)

        def last(nodes: pa.Table, given: pa.Table) -> pa.Table:
            found = paths_of(nodes, given, levels)
            rows = [finish(dict(zip(needs, row, strict=True)), found[0, i]) for i, *row in table_rows(nodes, "index", *needs)]
            return pa.Table.from_pylist(rows, out)

        keys, node = ["grp", "part", "block"], ["grp", "level", "index"]
        roots = self.root_records().join(above, "grp").select(*node, "path")
        given = roots
        for turn in range(len(self.rounds) - 1, 0, -1):
            tops = self.rounds[turn].where("peak").select(*keys, "level", "index").join(given, node)
            got = self.open_peaks(turn).groupBy(*keys).cogroup(tops.groupBy(*keys)).applyInArrow(down, told)
            given = materialize(got.unionByName(roots), "paths")
        ends = self.rounds[0].where("peak").select(*keys, "level", "index").join(given, node)
        extra = [c for c in needs if c not in ("grp", "digest")]
        below = self.leaves.select(*keys, "n", F.lit(0).alias("level"), "index", "digest", *extra)
        return below.groupBy(*keys).cogroup(ends.groupBy(*keys)).applyInArrow(last, schema)


def forest(rows: DataFrame, order: Sequence[str], fanout: int = FANOUT, levels: int = LEVELS) -> Forest:
    """Trees over ``rows`` (grp, digest, and what orders them within grp), one for each grp."""
    leaves = materialize(number(rows, order, fanout**levels), "leaves")
    names = [x.split()[0] for x in NODES.split(", ")]
    kinds = to_arrow_schema(StructType.fromDDL(NODES))

    def stack(nodes: pa.Table) -> pa.Table:
        same = [nodes.column(c)[0].as_py() for c in ("grp", "n", "part", "block")]
        found = records(climb(nodes, levels * max(1, -same[2]), fanout))
        return pa.Table.from_pylist([dict(zip(names, [*same, *x], strict=True)) for x in found], kinds)

    def climbed(nodes: DataFrame, label: str) -> DataFrame:
        return materialize(nodes.groupBy("grp", "part", "block").applyInArrow(stack, NODES), label)

    largest = leaves.agg(F.max("n")).first()[0] or 0
    bottom = leaves.select("grp", "part", "block", "n", F.lit(0).alias("level"), "index", "digest")
    found = Forest(leaves, [climbed(bottom, "peaks")], fanout, levels)
    while len(found.rounds) == 1 or fanout ** (levels * (len(found.rounds) - 1)) < largest:
        turn = len(found.rounds)
        found.rounds.append(climbed(found.open_peaks(turn), f"peaks-{turn}"))
    return found


@dataclass
class Manifest:
    """A dataset's trees: ``sources`` over its rows, ``top`` over the sources' roots."""

    sources: Forest
    top: Forest

    def nodes(self) -> DataFrame:
        """Every node above the leaves: tree (rows or sources), source, level, index, digest."""
        source = F.when(F.col("grp") != "", F.expr("substring(grp, 2)"))
        below = self.sources.nodes().select(F.lit("rows").alias("tree"), source.alias("source"), "level", "index", "digest")
        none = F.lit(None).cast("string")
        return below.unionByName(self.top.nodes().select(F.lit("sources").alias("tree"), none.alias("source"), "level", "index", "digest"))

    def root(self) -> DataFrame:
        """The dataset's root and its number of sources; no row for an empty one."""
        return self.top.root_records().select("digest", F.col("n").alias("sources"))

    def prove(self, finish: Callable[[dict, Sequence[str], str], dict], schema: str, needs: Sequence[str]) -> DataFrame:
        """``finish(row, path, subroot)`` of every row: of those of its columns ``needs`` that ``build`` was told to keep, and its siblings up to the root."""

        def on_top(row: dict, path: Sequence[str]) -> dict:
            return {"grp": row["source_grp"], "path": [*path, row["digest"]]}  # a source's path ends with its subroot

        no_path = self.top.leaves.select("grp").distinct().withColumn("path", F.array().cast("array<string>"))
        above = self.top.prove(no_path, on_top, "grp string, path array<string>", ["source_grp", "digest"])
        return self.sources.prove(materialize(above, "above"), lambda row, path: finish(row, path[:-1], path[-1]), schema, needs)


def build(rows: DataFrame, source: str, order: str, leaf: Column, keep: dict[str, Column], fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """The manifest of ``rows``: leaves of digest ``leaf``, by ``source``, in the order of ``order`` and digest; ``keep`` goes along with each leaf."""
    grp = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))  # a null source comes first
    leaves = rows.select(grp.alias("grp"), F.col(order).alias("ordered"), leaf.alias("digest"), *(v.alias(k) for k, v in keep.items()))
    sources = forest(materialize(leaves, "digests"), ["ordered", "digest"], fanout, levels)
    roots = sources.root_records().select(F.lit("").alias("grp"), F.col("grp").alias("source_grp"), "digest")
    return Manifest(sources, forest(materialize(roots, "subroots"), ["source_grp"], fanout, levels))


def without_breaks() -> Column:
    """The tampering that ``verify_documents`` tries: line breaks are lost where 2 divides the id's CRC-32."""
    return F.when(crc32_mod("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def document_manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """The manifest of ``documents``; each leaf keeps its doc_id and, as ``now``, its digest with the text ``tampered``."""
    as_is = {c: F.col(c) for c in FIELDS}
    now = leaf_digest(as_is | {"text": without_breaks() if tampered is None else tampered})
    return build(docs, "source", "doc_id", leaf_digest(as_is), {"doc_id": F.col("doc_id").cast("long"), "now": now}, fanout, levels)


def prove_documents(manifest: Manifest) -> DataFrame:
    """Per document: doc_id, leaf and proof (two texts a level: the siblings' digests to the left, and those to the right)."""
    return manifest.prove(
        lambda row, path, _: {"doc_id": row["doc_id"], "leaf": row["digest"], "proof": path}, "doc_id long, leaf string, proof array<string>",
        ["doc_id", "digest"],
    )


def verify_documents(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Per document: leaf, subroot, root, digest of its proof, the root that the tampered text's leaf and the proof give, and whether that is the root."""

    def finish(row: dict, path: Sequence[str], subroot: str) -> dict:
        root, folded = fold(row["digest"], path), fold(row["now"], path)
        return {
            "doc_id": row["doc_id"], "leaf": row["digest"], "subroot": subroot, "root": root, "proof_sha256": digest("".join(path)),
            "folded_root": folded, "verified": folded == root,
        }

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return document_manifest(docs, tampered, fanout, levels).prove(finish, schema, ["doc_id", "digest", "now"])


def oracle() -> str:
    """SQL for ``verify_documents``: a recursive query a tree, a level a turn, and one that folds all leaves along their proofs."""
    coded = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    fields = " || ".join(coded.format(c) for c in FIELDS[:-1])
    crc = (
        "list_reduce([4294967295] || list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda ch: ascii(ch)::BIGINT), "
        "lambda c, b: list_reduce([xor(c, b)] || range(8), lambda v, i: xor(v // 2, 3988292384 * (v % 2))))"
    )
    return f"""
WITH RECURSIVE leaf AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, doc_id, source, sha256({fields} || {coded.format("text")}) AS h,
         sha256({fields} || {coded.format(f"(CASE WHEN ({crc}) % 2 = 1 THEN replace(text, chr(10), '') ELSE text END)")}) AS now
  FROM documents),
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaf),
tree AS (
  SELECT source, 0 AS lvl, idx, n, h FROM numbered
  UNION ALL
  SELECT source, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY source, lvl, idx // 3, n),
subroot AS MATERIALIZED (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, idx, n, h FROM subroot
  UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 3, n),
below AS (
  SELECT row_id, source, 0 AS lvl, idx, n, now AS v, '' AS proof FROM numbered
  UNION ALL
  SELECT b.row_id, b.source, b.lvl + 1, b.idx // 3, (b.n + 2) // 3,
         sha256(coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx < b.idx), '') || b.v || coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx > b.idx), '')),
         b.proof || coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx <> b.idx), '')
  FROM below b JOIN tree t ON t.source IS NOT DISTINCT FROM b.source AND t.lvl = b.lvl AND t.idx // 3 = b.idx // 3
  WHERE b.n > 1 GROUP BY b.row_id, b.source, b.lvl, b.idx, b.n, b.v, b.proof),
above AS (
  SELECT b.row_id, 0 AS lvl, s.idx, s.n, b.v, b.proof FROM below b JOIN subroot s ON s.source IS NOT DISTINCT FROM b.source WHERE b.n = 1
  UNION ALL
  SELECT b.row_id, b.lvl + 1, b.idx // 3, (b.n + 2) // 3,
         sha256(coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx < b.idx), '') || b.v || coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx > b.idx), '')),
         b.proof || coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx <> b.idx), '')
  FROM above b JOIN top t ON t.lvl = b.lvl AND t.idx // 3 = b.idx // 3
  WHERE b.n > 1 GROUP BY b.row_id, b.lvl, b.idx, b.n, b.v, b.proof)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(a.proof) AS proof_sha256, a.v AS folded_root, a.v = r.h AS verified
FROM leaf l JOIN above a ON a.row_id = l.row_id AND a.n = 1 JOIN subroot s ON s.source IS NOT DISTINCT FROM l.source
CROSS JOIN (SELECT h FROM top WHERE n = 1) r
"""
