"""Packing documents into sequences, in order, by dynamic programming.

Documents become token ids in the order in which they stand in the input.
Sequences are cut at document ends, sentence ends or, where neither is near,
inside a sentence. Of all such cuts dynamic programming finds those
with the least padding plus penalties for truncated documents and sentences; a
monotone queue keeps the best earlier cut within one sequence's reach, so that
the work is linear in the number of possible cuts.

Each task packs the documents of its own partition, a segment of about a
million tokens at a time; the last, unfilled part of a segment is carried into the
next one. Nothing is shuffled, and tasks give their sequences ids of their own.

Defined cases: a null or empty text is the closing id alone; documents longer
than a sequence are cut, and a text of any length is encoded whole; a stretch of more than a sequence without a sentence's
end is cut after each full sequence; repeated rows and null doc_ids are packed like others; of equally
cheap cuts ``best_cuts`` says which win; other columns, whatever they are called, play no part;
an empty table gives an empty result. Each task leaves one unfilled sequence, so that the padding depends a little
on the number of splits.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import string
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8

WINDOW = 2_048
END_ID = 1
#: Costs in tokens of padding: of any sequence, of a cut at a sentence's end, and of one inside a sentence.
PER_SEQUENCE, SENTENCE_CUT, HARD_CUT = 4, 8, 96
SEGMENT = 1 << 20
#: Lengths below WINDOW that need no padding, longest first.
POWERS = tuple(1 << i for i in reversed(range(WINDOW.bit_length() - 1)))
#: Distinct words that an encoder remembers at most; beyond, it keeps the half that was used last.
REMEMBERED = 400_000
#: New words that go to the library as one text.
JOINED = 30
#: Bytes of text that an encoder cuts into words at once.
ENCODED = 4_000_000
ASCII_LETTERS = np.frombuffer(string.ascii_letters.encode(), np.uint8)
#: Places whose earlier places at a power of two are looked up at once.
LOOKED_UP = 1 << 16


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes several times as long


class ByteBpe:
    """Ids of texts by a tokenizers file.

    Of a byte-level BPE with the usual split of texts and no normaliser, a single space with other
    characters on both sides always starts a new part of the text, and so does a single line break; ASCII punctuation after
    a letter always starts a piece, so that a part's stem and the punctuation at its end have ids of their own;
    each distinct stem is encoded once and its ids remembered. New ones without white space go to the library
    as texts of many, whose ids are cut where a piece starts with the space. Texts with other white space
    are cut where it is safe. Texts that hold a special token's string, and all texts
    under other settings, go to the library whole.
    """

    rare = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
    odd = re.compile("[\\s᠎​﻿]{2}|^\\s|\\s$|\x00")
    safe = re.compile("(?<=[^\\s᠎​﻿]) (?=[^\\s᠎​﻿])")
    space = re.compile("[\\s᠎​﻿\x00]")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side; threads of small batches mostly wait
        from tokenizers import Tokenizer

        self.known, self.known_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.used, self.calls = np.zeros(0, np.int64), 0  # the call that last had a known part
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.n_ids = self.whole.get_vocab_size()
        settings = json.loads(self.whole.to_str())
        split = settings["pre_tokenizer"] or {}
        self.in_parts = (
            settings["normalizer"] is None and settings["model"]["type"] == "BPE" and not settings["model"].get("dropout")
            and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        )

        self.leads = np.zeros(max(self.n_ids, 1 + max(self.whole.get_vocab().values(), default=0)), bool)
        self.leads[[i for piece, i in self.whole.get_vocab().items() if piece[:1] == "Ġ"]] = True

    def ids(self, texts: list[str]) -> list[bytes]:
        got = self.whole.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in got]

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with a space before it: of texts of many words, cut where a piece starts with the space."""
        joined = [" " + " ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        ids = np.frombuffer(b"".join(self.ids(joined)), "<u4")
        at = [*np.flatnonzero(self.leads[ids]).tolist(), len(ids)]
        if len(at) != len(words) + 1:  # a vocabulary of other pieces
            return self.ids([" " + w for w in words])
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in itertools.pairwise(at)]

    def learn(self, parts: pa.Array) -> pa.Array:
        """Ids of distinct parts; new ones go to the library in batches, and the last used are remembered.

        A part has a space before it, but for one with a line break at its start and one after a \\0, which is no part of it.
        """
        at = pc.index_in(parts, value_set=self.known)
        is_new = at.is_null().to_numpy(zero_copy_only=False)
        more = parts.filter(at.is_null())
        new = strings(more)
        is_word = [p.isalpha() or not self.space.search(p) for p in new]
        words = iter(self.word_ids([p for p, yes in zip(new, is_word, strict=True) if yes]))
        spelled = [p[1:] if p[0] == "\x00" else p if p[0] == "\n" else " " + p for p, yes in zip(new, is_word, strict=True) if not yes]
        others = itertools.chain.from_iterable(self.ids(spelled[i : i + 4_000]) for i in range(0, len(spelled), 4_000))
        ids = pa.array([next(words) if yes else next(others) for yes in is_word], pa.large_binary())
        number = at.fill_null(0).to_numpy().astype(np.int64)
        number[is_new] = np.arange(len(new)) + len(self.known)
        self.known, self.known_ids = pa.concat_arrays([self.known, more]), pa.concat_arrays([self.known_ids, ids])
        self.calls += 1
        self.used = np.append(self.used, np.zeros(len(new), np.int64))
        self.used[number] = self.calls
        found = self.known_ids.take(pa.array(number))
        if len(self.used) > REMEMBERED:
            stay = np.argsort(-self.used, kind="stable")[: REMEMBERED // 2]
            self.known, self.known_ids, self.used = self.known.take(pa.array(stay)), self.known_ids.take(pa.array(stay)), self.used[stay]
        return found

    def part_ids(self, parts: pa.Array) -> pa.Array:
        """Each part's ids: its stem's, and those of the punctuation after the stem's last letter."""
        coded = parts.dictionary_encode()
        distinct = coded.dictionary
        stem = pc.utf8_rtrim(distinct, string.punctuation)
        data, at = utf8(stem)
        data = np.concatenate([np.zeros(2, np.uint8), data])
        last, before = data[at[1:] + 1], data[at[1:]]
        letter = np.isin(last, ASCII_LETTERS) | (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)  # to ÿ, without × and ÷
        has_tail = letter & (np.diff(at) > 0) & (np.diff(at) < np.diff(utf8(distinct)[1]))
        keep = pa.array(has_tail)
        tails = ["\x00" + p[len(s) :] for p, s in zip(strings(distinct.filter(keep)), strings(stem.filter(keep)), strict=True)]
        units = pa.concat_arrays([pc.if_else(keep, stem, distinct), pa.array(tails, pa.large_string())]).dictionary_encode()
        ids = self.learn(units.dictionary).take(units.indices)
        tail = np.full(len(distinct), -1)
        tail[has_tail] = np.arange(len(tails)) + len(distinct)
        after = ids.take(pa.array(tail, mask=~has_tail)).fill_null(b"")
        return pc.binary_join_element_wise(ids[: len(distinct)], after, pa.scalar(b"", pa.large_binary())).take(coded.indices)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        out = [b""] * len(texts)
        whole, lines, cut = [], {}, {}
        for i, text in enumerate(texts):
            if not self.in_parts or "\x00" in text or any(s[0] in text and s in text for s in self.special):
                whole.append(i)
            elif text:
                line = text.replace("\n", " \n")
                doubtful = line[0] == " " or line[-1] in " \n" or "  " in line or "\n " in line or self.rare.search(text)
                if doubtful and self.odd.search(text):
                    cut[i] = self.safe.split(text)
                    cut[i][0] = "\x00" + cut[i][0]
                else:
                    lines[i] = "\x00" + line
        spaced = pc.split_pattern(pa.array([*lines.values()], pa.large_string()), " ")
        for numbers, lists in ((lines, spaced), (cut, pa.array([*cut.values()], pa.list_(pa.large_string())))):
            if not numbers:
                continue
            _, at, raw = self.part_ids(lists.values).buffers()
            at = np.frombuffer(at, np.int64)[lists.offsets.to_numpy()].tolist()
            for i, (a, b) in zip(numbers, itertools.pairwise(at), strict=True):
                out[i] = raw[a:b].to_pybytes()
        for i, ids in zip(whole, self.ids([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out

    def sentence_ends(self) -> np.ndarray:
        """For each id whether its piece ends a sentence or a line."""
        out = np.zeros(self.n_ids, bool)
        for piece, i in self.whole.get_vocab().items():
            bare = piece.rstrip("\"')]}»”")
            out[i] = "Ċ" in piece or bare[-1:] in tuple(".!?…") and piece not in self.special
        return out


@functools.cache
def byte_bpe(path: str) -> tuple[ByteBpe, np.ndarray]:
    """One encoder per Python worker and vocabulary."""
    coder = ByteBpe(path)
    return coder, coder.sentence_ends()


def padding(length: int) -> int:
    """Tokens of padding of a sequence: up to WINDOW, but none at a power of two."""
    return 0 if length & (length - 1) == 0 else WINDOW - length


def powers_before(places: list[int]) -> Iterator[list[int]]:
    """For each place the numbers of those that lie a power of two before it, the longest first."""
    at = np.array(places)
    number = np.full(at[-1] + 1, -1)
    number[at] = np.arange(len(at))
    back = np.array(POWERS)
    for first in range(0, len(at), LOOKED_UP):
        to = at[first : first + LOOKED_UP, None] - back
        found = np.where(to < 0, -1, number[np.maximum(to, 0)])
        bounds = np.cumsum([0, *(found >= 0).sum(axis=1).tolist()]).tolist()
        flat = found[found >= 0].tolist()
        for a, b in itertools.pairwise(bounds):
            yield flat[a:b]


def best_cuts(places: list[int], penalty: list[int], last: bool) -> list[int]:
    """The cheapest cuts of one segment. Of equal costs the padded sequence wins, the longer one first, then the longer power of two.

    ``places`` are where cuts may be, ascending from 0, neighbours at most
    WINDOW apart; ``penalty`` is what a cut there costs. A segment that isn't the
    ``last`` may end at whichever cut of its last window is cheapest, the latest of equal ones.
    """
    n = len(places)
    cost, back, level = [0] * n, [0] * n, [0] * n  # level: cost + place
    queue: deque[int] = deque([0])  # earlier cuts within reach, level rising
    first = np.searchsorted(places, np.array(places) - WINDOW).tolist()
    for i, p, more, low, near in zip(itertools.count(), places, penalty, first, powers_before(places)):
        if not i:
            continue
        while queue[0] < low:
            queue.popleft()
        j = queue[0]
        best = level[j] + WINDOW - p
        # powers of two need no padding
        for k in near:
            if cost[k] < best:
                best, j = cost[k], k
        cost[i], back[i] = best + PER_SEQUENCE + more, j
        level[i] = value = cost[i] + p
        while queue and level[queue[-1]] > value:
            queue.pop()
        queue.append(i)
    i = n - 1
    if not last:
        i = min((k for k in range(n) if places[k] > places[-1] - WINDOW), key=lambda k: (cost[k], -k))
    cuts = [places[i]]
    while i:
        i = back[i]
        cuts.append(places[i])
    return cuts[::-1]


@dataclass
class Piece:
    """A document, or what of it is not yet in a sequence."""

    doc_id: int | None
    ids: np.ndarray
    start: int
    doc_tokens: int


def pack_segment(pieces: list[Piece], ends: np.ndarray, last: bool) -> tuple[dict[str, list | np.ndarray], int, list[Piece]]:
    """Rows of the segment's sequences (numbered from 0), how many they are, and what is carried over."""
    ids = np.concatenate([p.ids for p in pieces])
    starts = np.cumsum([0, *(len(p.ids) for p in pieces)])
    cut_cost = np.full(len(ids) + 1, HARD_CUT)
    cut_cost[np.flatnonzero(ends[ids]) + 1] = SENTENCE_CUT
    cut_cost[starts] = 0
    allowed = np.flatnonzero(cut_cost < HARD_CUT)
    # hard cuts fill gaps that are wider than a sequence
    wide = np.flatnonzero(np.diff(allowed) > WINDOW)
    more = [np.arange(allowed[i] + WINDOW, allowed[i + 1], WINDOW) for i in wide]
    places = np.unique(np.concatenate([allowed, *more]))
    cuts = np.array(best_cuts(places.tolist(), cut_cost[places].tolist(), last))
    stop = cuts[-1]
    bounds = np.unique(np.concatenate([cuts, starts[starts < stop]]))
    begin, length = bounds[:-1], np.diff(bounds)
    doc = np.searchsorted(starts, begin, "right") - 1
    sequence = np.searchsorted(cuts, begin, "right") - 1
    view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    rows = {
        "doc_id": [pieces[d].doc_id for d in doc],
        "start": np.array([pieces[d].start for d in doc], np.int64) + begin - starts[doc],
        "length": length,
        "ids_crc32": [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)],
        "doc_tokens": [pieces[d].doc_tokens for d in doc],
        "sequence_id": sequence,
        "offset": begin - cuts[sequence],
    }
    carried = []
    for p, a, b in zip(pieces, starts[:-1], starts[1:], strict=True):
        if b > stop:
            skip = max(0, stop - a)
            carried.append(Piece(p.doc_id, p.ids[skip:], p.start + int(skip), p.doc_tokens))
    return rows, len(cuts) - 1, carried


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and its offset there."""

    def batch_of(rows: dict, first: int) -> pa.RecordBatch:
        rows["sequence_id"] = rows["sequence_id"] + first
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in rows.values()], list(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, ends = byte_bpe(path)
        first = TaskContext.get().partitionId() << 33
        waiting: list[Piece] = []
        tokens = 0
        close = array("I", [END_ID]).tobytes()
        for batch, _, _ in chunks(batches, "text", ENCODED):
            coded = coder.encode([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                ids = np.frombuffer(raw + close, "<u4")
                waiting.append(Piece(doc_id, ids, 0, len(ids)))
                tokens += len(ids)
                if tokens >= SEGMENT:
                    rows, n, waiting = pack_segment(waiting, ends, False)
                    yield batch_of(rows, first)
                    first += n
                    tokens = sum(len(p.ids) for p in waiting)
        if waiting:
            rows, n, _ = pack_segment(waiting, ends, True)
            yield batch_of(rows, first)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACKED)
