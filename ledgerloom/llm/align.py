"""Alignment of two tokenizers: which of their ids stand for the same bytes, over a whole corpus.

A is a byte-level BPE of the tokenizers library, B a SentencePiece model. Both encode a space and the text (B adds
that space itself). Where tokens of both end at the same byte, the text is cut into groups of A ids and B ids; two tokens are linked if they
share a byte. An id pair's count is the number of its links in the corpus, and a pair is the best of its B id if no other pair of that id has a
larger count.

The work is done on distinct groups:

* documents are encoded in blocks of about ``BLOCK_BYTES`` of text. A text is cut into cells where both tokenizers always begin anew (at a
  single space or line break between other characters); each distinct cell is encoded and grouped once. A block writes
  its own dictionary of groups, with frequencies and numbers of documents, and each document's groups as numbers in it;
* the blocks' dictionaries are merged into one row for each distinct group; its links are expanded once, and multiplied by the group's
  frequency (or by the documents that hold it) to count pairs;
* each distinct group's sums go back to the blocks whose dictionaries hold it, and from there to their documents, without
  one row for each group of each document.

Defined cases: null and empty texts, and texts whose tokens of A or B don't spell the bytes of the space and the text (the marker U+2581 in a text is
read as a space, for one), have no tokens, and zeros; strings of special tokens inside texts are plain text; texts of any length are encoded whole; repeated
rows count each; of B ids with several best pairs all are best; other columns, whatever they are called, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, materialize
from .packing import ByteBpe
from .spm import BYTE, MARK, marks_lead, read_model

#: Bytes of text whose documents share a dictionary.
BLOCK_BYTES = 12_000_000
#: Distinct cells of a generation (no longer ones than LONGEST): a worker remembers two.
REMEMBERED, LONGEST = 400_000, 40
#: Texts that must be cut with care: other white space, or several in a row.
ODD = re.compile("[\\s᠎​﻿]{2}|^\\s|\\s$|\x00")
SAFE = re.compile("(?<=[^\\s᠎​﻿]) (?=[^\\s᠎​﻿])")


def byte_letters() -> dict[str, int]:
    """The bytes that a byte-level vocabulary's letters stand for: printable ones for themselves, the others in order from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.cache
def token_bytes(path_a: str, path_b: str) -> tuple[list[bytes], list[bytes]]:
    """The bytes of each id of A, and of each id of B."""
    letters = byte_letters()
    coder = ByteBpe(path_a)
    a = [b""] * coder.n_ids
    for entry, i in coder.whole.get_vocab().items():
        a[i] = entry.encode() if entry in coder.special else bytes(map(letters.__getitem__, entry))
    model = read_model(path_b)
    b = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
    return a, b


def cut_groups(a: list[list[int]], b: list[list[int]], size_a: np.ndarray, size_b: np.ndarray) -> list[str]:
    """The groups of each pair of token sequences over the same bytes, as ``a1,a2|b1;a3|b2``; all pairs at once."""
    flat_a, flat_b = list(itertools.chain.from_iterable(a)), list(itertools.chain.from_iterable(b))
    end_a, end_b = np.cumsum(size_a[flat_a]), np.cumsum(size_b[flat_b])
    both = np.intersect1d(end_a, end_b, assume_unique=True)
    to_a, to_b = ((np.searchsorted(end, both) + 1).tolist() for end in (end_a, end_b))
    last = np.cumsum([len(x) for x in a]).tolist()
    said_a, said_b = list(map(str, flat_a)), list(map(str, flat_b))
    out, groups, i, j, k = [], [], 0, 0, 0
    for x, y in zip(to_a, to_b, strict=True):
        groups.append(f"{said_a[i]}|{said_b[j]}" if x == i + 1 and y == j + 1 else f"{','.join(said_a[i:x])}|{','.join(said_b[j:y])}")
        i, j = x, y
        if i == last[k]:
            out.append(";".join(groups))
            groups, k = [], k + 1
    return out


def links_of(group: str, size_a: list[int], size_b: list[int]) -> dict[tuple[int, int], int]:
    """How many links a group has of each id pair: tokens that share a byte."""
    a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
    out: dict[tuple[int, int], int] = {}
    i = j = 0
    end_a, end_b = size_a[a[0]], size_b[b[0]]
    while True:
        pair = a[i], b[j]
        out[pair] = out.get(pair, 0) + 1
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a:
            i += 1
        if step_b:
            j += 1
        if i == len(a):  # both sequences end at the group's end
            return out
        if step_a:
            end_a += size_a[a[i]]
        if step_b:
            end_b += size_b[b[j]]


#: A cell's groups as text, and how many tokens of A and B it has.
Cell = tuple[str, int, int]


class Aligner:
    """Texts to groups; a worker keeps one for each pair of vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side; threads of small batches mostly wait
        coder = ByteBpe(path_a)
        self.a = coder.whole
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = token_bytes(path_a, path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b))
        model = read_model(path_b)
        plain = not model.charsmap and not model.drop_extra_spaces and model.dummy_prefix and model.escape_spaces
        self.in_cells = coder.in_parts and plain and marks_lead(model)
        self.breaks_alone = not any("\n" in p for p in model.pieces)
        self.cells: dict[str, Cell | None] = {}
        self.older: dict[str, Cell | None] = {}

    def cut(self, text: str) -> list[str]:
        """Keys of a text's cells: a cell after a space without it, one after a line break with it, and after \\0 what stands behind a space as it is."""
        if not self.in_cells or not self.breaks_alone or "\x00" in text:
            return ["\x00" + text]
        if not ODD.search(text):
            return text.replace("\n", " \n").split(" ")
        first, *others = SAFE.split(text)
        return ["\x00" + first, *others]

    def spells(self, a: list[list[int]], b: list[list[int]], raw: list[bytes]) -> bool:
        """Whether both sequences of every pair spell their bytes."""
        whole, size = b"".join(raw), np.array([len(x) for x in raw])
        for ids, table, sizes in ((a, self.bytes_a, self.size_a), (b, self.bytes_b, self.size_b)):
            flat = list(itertools.chain.from_iterable(ids))
            ends = np.concatenate([[0], np.cumsum(sizes[flat])])[np.cumsum([len(x) for x in ids])]
            if not np.array_equal(ends, np.cumsum(size)) or b"".join([table[i] for i in flat]) != whole:
                return False
        return True

    def encode(self, keys: list[str]) -> list[Cell | None]:
        """Cells of these keys, in a batch of both libraries; None where one doesn't spell the bytes."""
        inner = [k if k[:1] == "\n" else " " + k.removeprefix("\x00") for k in keys]
        a = [e.ids for e in self.a.encode_batch_fast(inner, add_special_tokens=False)]
        b = self.b.encode([k.removeprefix("\x00") for k in keys], num_threads=1)
        # B puts a space before the line break, too, as a piece of its own
        b = [y[1:] if k[:1] == "\n" else y for k, y in zip(keys, b, strict=True)]
        raw = [x.encode() for x in inner]
        good = range(len(keys)) if self.spells(a, b, raw) else [i for i in range(len(keys)) if self.spells(a[i : i + 1], b[i : i + 1], raw[i : i + 1])]
        out: list[Cell | None] = [None] * len(keys)
        for i, text in zip(good, cut_groups([a[i] for i in good], [b[i] for i in good], self.size_a, self.size_b), strict=True):
            out[i] = text, len(a[i]), len(b[i])
        return out

    def learn(self, keys: list[str]) -> list[Cell | None]:
        """The cells of distinct keys: those remembered, and new ones."""
        if len(self.cells) > REMEMBERED:  # the generation before goes, but for what is still in use
            self.cells, self.older = {}, self.cells
        cells, older = self.cells, self.older
        new = [k for k in keys if k not in cells and k not in older]
        found: dict[str, Cell | None] = {}
        for at in range(0, len(new), 4_000):
            some = new[at : at + 4_000]
            found.update(zip(some, self.encode(some), strict=True))
        out = [found[k] if k in found else cells[k] if k in cells else older[k] for k in keys]
        cells.update((k, c) for k, c in zip(keys, out, strict=True) if len(k) <= LONGEST)
        return out


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


CODED = (
    "block long, entry int, grp string, times long, docs long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
    "entries array<int>, counts array<long>"
)
CODED_ARROW = pa.schema(
    [("block", pa.int64()), ("entry", pa.int32()), ("grp", pa.string()), ("times", pa.int64()), ("docs", pa.int64())]
    + [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string())]
    + [("entries", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]
)


class Numbers(dict):
    """Keys to the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class Block:
    """Documents that share a dictionary of groups."""

    def __init__(self, number: int, coder: Aligner):
        self.number, self.coder = number, coder
        self.entry: dict[str, int] = Numbers()
        self.cell: dict[str, int] = Numbers()
        self.texts: list[str | None] = []  # of the cells in order; None: the whole text must be looked at
        self.n_a, self.n_b = array("q"), array("q")
        self.entries, self.first = array("i"), array("q", [0])
        self.docs: list[tuple] = []
        self.size = 0

    def learn(self) -> None:
        """Whatever is new among the cells."""
        new = list(itertools.islice(self.cell, len(self.texts), None))
        for cell in self.coder.learn(new):
            text, n_a, n_b = cell or (None, 0, 0)
            self.texts.append(text)
            self.n_a.append(n_a)
            self.n_b.append(n_b)
            if text is not None:
                self.entries.extend(map(self.entry.__getitem__, text.split(";")))
            self.first.append(len(self.entries))

    def add(self, doc_ids: list[int | None], texts: list[str | None]) -> None:
        """Some documents; their new cells are encoded together."""
        number = self.cell.__getitem__
        cut = [list(map(number, self.coder.cut(t))) if t else [] for t in texts]
        self.learn()
        for k, cells in enumerate(cut):
            if None in map(self.texts.__getitem__, cells):  # only the whole text can tell whether all its bytes are spelled
                cut[k] = [number("\x00" + texts[k])]
        self.learn()
        said = [list(map(self.texts.__getitem__, cells)) for cells in cut]
        cut = [cells if x and x[0] is not None else [] for cells, x in zip(cut, said, strict=True)]
        n_a, n_b, first, entries = (np.array(x) for x in (self.n_a, self.n_b, self.first, self.entries))
        # all documents at once: each one's distinct cells, and of these its distinct groups, with their counts
        doc = np.repeat(np.arange(len(cut)), [len(cells) for cells in cut])
        pair, times = np.unique(doc * max(1, len(n_a)) + np.fromiter(itertools.chain.from_iterable(cut), np.int64, len(doc)), return_counts=True)
        doc, cell = np.divmod(pair, max(1, len(n_a)))
        size = first[cell + 1] - first[cell]
        at = np.arange(size.sum()) + np.repeat(first[cell] - np.cumsum(size) + size, size)
        pair, place = np.unique(np.repeat(doc, size) * max(1, len(self.entry)) + entries[at], return_inverse=True)
        counts = np.bincount(place, np.repeat(times, size), len(pair)).astype(np.int64)
        total_a, total_b, groups = (np.bincount(doc, x * times, len(cut)).astype(np.int64).tolist() for x in (n_a[cell], n_b[cell], size))
        of, distinct = np.divmod(pair, max(1, len(self.entry)))
        distinct, cuts = distinct.astype(np.int32), np.searchsorted(of, np.arange(len(cut) + 1)).tolist()
        for k, doc_id in enumerate(doc_ids):
            digest = hashlib.sha256(";".join(said[k]).encode()).hexdigest() if cut[k] else ""
            low, high = cuts[k], cuts[k + 1]
            self.docs.append((doc_id, total_a[k], total_b[k], groups[k], digest, distinct[low:high], counts[low:high]))

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The dictionary's rows, then the documents'."""
        times, docs = np.zeros(len(self.entry), np.int64), np.zeros(len(self.entry), np.int64)
        for *_, distinct, counts in self.docs:
            times[distinct] += counts
            docs[distinct] += 1

        def made(rows: int, given: dict[str, pa.Array]) -> pa.RecordBatch:
            given["block"] = pa.array(np.full(rows, self.number, np.int64))
            return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(rows, f.type) for f in CODED_ARROW], schema=CODED_ARROW)

        held = np.flatnonzero(times)  # not those of texts that turned out to have no tokens
        if len(held):
            names = np.array(list(self.entry), object)[held]
            given = {"entry": pa.array(held.astype(np.int32)), "grp": pa.array(names, pa.string()), "times": pa.array(times[held]), "docs": pa.array(docs[held])}
            yield made(len(held), given)
        for first in range(0, len(self.docs), 5_000):
            some = self.docs[first : first + 5_000]
            columns = dict(zip(("doc_id", "n_a", "n_b", "n_groups", "groups_sha256"), zip(*(d[:5] for d in some), strict=True), strict=True))
            given = {k: pa.array(v, CODED_ARROW.field(k).type) for k, v in columns.items()}
            at = pa.array(np.cumsum([0, *(len(d[5]) for d in some)]).astype(np.int32))
            given["entries"] = pa.ListArray.from_arrays(at, pa.array(np.concatenate([d[5] for d in some])))
            given["counts"] = pa.ListArray.from_arrays(at, pa.array(np.concatenate([d[6] for d in some]).astype(np.int64)))
            yield made(len(some), given)


def code_blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of the blocks' dictionaries (entry isn't null), and of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = aligner(path_a, path_b)
        block = Block(TaskContext.get().partitionId() << 32, coder)
        for batch, data, _ in chunks(batches, "text"):
            block.add(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            block.size += len(data)
            if block.size >= BLOCK_BYTES:
                yield from block.batches()
                block = Block(block.number + 1, coder)
        yield from block.batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CODED)


@dataclass
class Alignment:
    """What an alignment has gathered: ``coded`` documents, ``links`` of distinct groups (grp, a, b, times), and ``pairs`` (a, b, n, best)."""

    coded: DataFrame
    links: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, path_a: str, path_b: str, by: str = "times") -> Alignment:
    """Aligns all documents. A pair's count n is that of its links; by ``docs``, a link counts once for each document that holds its group."""
    coded = materialize(code_blocks(docs, path_a, path_b), "coded")
    groups = coded.where("entry IS NOT NULL").groupBy("grp").agg(F.sum(by).alias("n"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, size_b = ([len(x) for x in table] for table in token_bytes(path_a, path_b))
        for batch in batches:
            rows = [(g, n, *pair, t) for g, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) for pair, t in links_of(g, size_a, size_b).items()]
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["grp", "n", "a", "b", "times"])

    links = materialize(groups.select("grp", "n").mapInArrow(expand, "grp string, n long, a int, b int, times long"), "links")
    counted = links.groupBy("a", "b").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    # a B id has no more pairs than A has ids
    pairs = counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))
    return Alignment(coded, links.select("grp", "a", "b", "times"), materialize(pairs, "pairs"))


def describe(found: Alignment) -> DataFrame:
    """Per document: numbers of tokens, groups and links, of best links, the sum of its links' counts, and the digest of its groups."""
    of_links = found.links.join(found.pairs, ["a", "b"])
    sums = of_links.groupBy("grp").agg(
        F.sum("times").alias("links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n")).alias("counted")
    )
    entries = found.coded.where("entry IS NOT NULL").select("block", "entry", "grp").join(sums, "grp").select("block", "entry", "links", "best", "counted")
    given = ("doc_id", "n_a", "n_b", "n_groups")
    documents = found.coded.where("entry IS NULL").select(F.col("block").alias("of_block"), *given, "groups_sha256", "entries", "counts")

    def back(docs: pa.Table, values: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        entry = values["entry"].to_numpy()
        at = np.cumsum([0, *docs["entries"].combine_chunks().value_lengths().to_pylist()])
        numbers, times = (docs[c].combine_chunks().flatten().to_numpy() for c in ("entries", "counts"))
        out = {c: docs[c] for c in given}
        for name, column in (("n_links", "links"), ("n_best", "best"), ("count_sum", "counted")):
            value = np.zeros(entry.max(initial=-1) + 1, np.int64)
            value[entry] = values[column].to_numpy()
            total = np.concatenate([[0], np.cumsum(value[numbers] * times)])
            out[name] = pa.array(total[at[1:]] - total[at[:-1]], pa.int64())
        return pa.table(out | {"groups_sha256": docs["groups_sha256"]})

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return documents.groupBy("of_block").cogroup(entries.groupBy("block")).applyInArrow(back, schema)


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    return describe(align(docs, path_a, path_b))
