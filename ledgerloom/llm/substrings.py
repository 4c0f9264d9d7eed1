"""Removal of word passages that occur more than once, with repeated-phrase automata.

1. Every window of 35 words is represented by one phrase of it (its anchor), so that
   equal windows have equal anchors. Anchors are counted; stretches of documents under
   windows whose anchors recur are routed to the shard of the first row that has the anchor.
2. A shard confirms which windows recur. Shards that hold much more than
   the others are dealt out in blocks, whose windows are counted across them in Spark.
3. All documents are dealt into blocks, and a shard writes for each block of documents the passages
   that recurring windows form there, each distinct window once: never more than what stands in the documents.
   The block compiles them into Aho-Corasick automata and streams its whole
   documents through: a hit is a window, word for word, and the hits are the result.

The automata's letters are phrases of seven words, each phrase with an exact number of two digits,
so that a window is five phrases and a node has few branches. A text is read in seven phases,
which begin at its first seven words.

Words are ``[^\\x20\\x09-\\x0D]+`` as they stand. Windows are judged on the input.

Defined cases: a null text has no words; texts shorter than a window lose
nothing; a text of any length is read whole, by one task; a passage that overlaps itself or stands
twice in one text is a repeat like any other; repeated rows repeat each other's windows and lose them; rows are
told apart by their place in the input, so ids may be null or repeat; other columns
may have any names; an empty table gives an empty result. The input is read more than once and must
give the same rows in the same places each time, as files do; rows would lose
words of others otherwise, so write other inputs with ``materialize`` first.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, materialize, tidy_group, tidy_pair, utf8
from .words import WORD_BASE, break_table, run_hashes, window_anchors, word_spans

WINDOW, ANCHOR = 35, 12
#: Words of a phrase, an automaton's letter; a window is a whole number of them.
PHRASE = 7
#: Windows that one automaton holds.
PATTERNS = 65_536
#: Bytes of text that a shard of stretches and a block of documents should hold, and the fewest shards.
SHARD_BYTES, BLOCK_BYTES, MIN_SHARDS = 2_000_000, 2_000_000, 64
#: Up to this many shards that are dealt out in blocks are broadcast; more are joined.
BROADCAST_SHARDS = 100_000
#: Anchors with more than a HOT_ANCHORS-th of all recurring places, and HOT_PLACES at least, are broadcast: they are fewer than HOT_ANCHORS.
HOT_ANCHORS, HOT_PLACES = 10_000, 1_000


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, from its place."""
    return docs.withColumn("row_no", F.monotonically_increasing_id())


def anchors(rows: DataFrame) -> DataFrame:
    """(gram, row_no, place): each row's anchors, place being the word at which one starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches, "text"):
            _, _, first, grams, anchor = window_anchors(data, at, WINDOW, ANCHOR)
            found = np.unique(anchor[anchor >= 0])
            doc = np.searchsorted(first, found, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grams[found].view(np.int64)),
                    batch.column("row_no").take(pa.array(doc)),
                    pa.array((found - first[doc]).astype(np.int32)),
                ],
                ["gram", "row_no", "place"],
            )

    return rows.select("row_no", "text").mapInArrow(run, "gram long, row_no long, place int")


def stretches(rows: DataFrame) -> DataFrame:
    """(home, row_no, words): stretches under windows whose anchors recur, home being the anchor's first row."""
    found = anchors(rows)
    counts = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("row_no").alias("home"))
    recurring = materialize(counts.where("n > 1"), "anchors")
    total = recurring.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(HOT_PLACES, total // HOT_ANCHORS)
    # places of hot anchors are told their home at once and go anywhere; the others meet theirs by anchor
    told = found.join(F.broadcast(recurring.where(hot).select("gram", F.col("home").alias("hot_home"))), "gram", "left")
    told = told.withColumn("key", F.when(F.col("hot_home").isNull(), F.col("gram")).otherwise(F.xxhash64("row_no", "place")))
    others = recurring.where(~hot).select(F.col("gram").alias("key"), "home")
    met = told.join(others, "key", "left").withColumn("home", F.coalesce("hot_home", "home"))
    marks = met.where("home IS NOT NULL").groupBy("row_no").agg(F.collect_list(F.struct("place", "home")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches, "text"):
            starts, ends, first, _, anchor = window_anchors(data, at, WINDOW, ANCHOR)
            marks = batch.column("marks")
            per_row = np.diff(marks.offsets.to_numpy())
            flat = marks.flatten()
            word = np.repeat(first[:-1], per_row) + flat.field("place").to_numpy()
            home_of = np.full(len(starts) + 1, -1)  # the last place answers for windows without an anchor
            home_of[word] = flat.field("home").to_numpy()
            home = home_of[anchor]
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            new = np.ones(len(home), bool)
            new[1:] = (home[1:] != home[:-1]) | (doc[1:] != doc[:-1])
            begin = np.flatnonzero(new)
            last = np.append(begin[1:], len(home)) - 1
            begin, last = begin[home[begin] >= 0], last[home[begin] >= 0]
            text = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(home[begin]),
                    batch.column("row_no").take(pa.array(doc[begin])),
                    pa.array([text[a:b] for a, b in zip(starts[begin].tolist(), ends[last + WINDOW - 1].tolist(), strict=True)], pa.binary()),
                ],
                ["home", "row_no", "words"],
            )

    return rows.select("row_no", "text").join(marks, "row_no").mapInArrow(run, "home long, row_no long, words binary")


KEY = np.dtype([("a", np.uint64), ("b", np.uint64)])


class Texts:
    """Some texts' bytes and the spans of their words; ``first`` has each text's first word, with one more for the end."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        self.starts, self.ends, self.first = word_spans(data, at)

    @classmethod
    def of(cls, texts: list[bytes]) -> Texts:
        return cls(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))

    def letters(self) -> np.ndarray:
        """The words' bytes, one after another."""
        return self.data[~break_table()[self.data]]

    def windows(self) -> np.ndarray:
        """The words at which windows start."""
        ends = np.repeat(self.first[1:], np.diff(self.first))
        return np.flatnonzero(np.arange(len(self.starts)) + WINDOW <= ends)


def word_codes(*some: Texts) -> list[np.ndarray]:
    """Exact numbers of the words, from 0 in the order in which they first occur."""
    at = np.concatenate([[0], *(t.ends - t.starts for t in some)]).cumsum()
    letters = np.concatenate([t.letters() for t in some])
    words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(letters)])
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    return np.split(code, np.cumsum([len(t.starts) for t in some])[:-1])


def window_keys(texts: Texts) -> np.ndarray:
    """Two 64-bit hashes of each window (the same in every task)."""
    keys = []
    low = 0
    while low < len(texts.at) - 1:  # some texts at a time
        high = max(low + 1, int(np.searchsorted(texts.at, texts.at[low] + CHUNK_BYTES, "right")) - 1)
        some = Texts(texts.data[texts.at[low] : texts.at[high]], texts.at[low : high + 1] - texts.at[low])
        low = high
        h = run_hashes(some.data, some.starts, some.ends, 0xA0761D6478BD642F)
        n = some.windows()
        one, two = np.zeros(len(n), KEY), h ^ (h >> np.uint64(7))
        one["a"] = run_hashes(h, n, n + WINDOW, WORD_BASE)
        one["b"] = run_hashes(two, n, n + WINDOW, 0xE7037ED1A0B428DB)
        keys.append(one)
    return np.concatenate(keys)


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key occurs first, and each key's number among them."""
    _, first, same = np.unique(keys["a"], return_index=True, return_inverse=True)
    if (keys["b"] != keys["b"][first[same]]).any():  # one half of a key alone clashes: not seen in practice
        _, first, same = np.unique(keys, return_index=True, return_inverse=True)
    return first, same


def runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the runs of equal non-negative numbers; negative ones are in none."""
    new = np.ones(len(member), bool)
    new[1:] = member[1:] != member[:-1]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(member))
    real = member[begin] >= 0
    return begin[real], end[real]


def block_windows(table: pa.Table) -> pa.Table:
    """Keys of a block's distinct windows, with how often they occur there."""
    keys = window_keys(Texts.of(table["words"].to_pylist()))
    first, same = distinct_keys(keys)
    own = keys[first]
    return pa.table(
        {
            "shard": np.full(len(own), table["shard"][0].as_py(), np.int32), "block": np.full(len(own), table["block"][0].as_py(), np.int32),
            "a": own["a"].view(np.int64), "b": own["b"].view(np.int64), "n": np.bincount(same, minlength=len(own)),
        }
    )


PASSAGES = pa.schema([("block", pa.int32()), ("words", pa.binary())])


def confirm(table: pa.Table, assigned: pa.Table) -> pa.Table:
    """(block, words): for each block of documents the passages that a shard's recurring windows form in its rows, each distinct window once.

    A shard of one block counts its windows itself, word for word. Of a shard in several, ``assigned`` has the keys
    of the windows of this block that recur in the shard.
    """
    if not table.num_rows:
        return PASSAGES.empty_table()
    texts = Texts.of(table["words"].to_pylist())
    keys, place = window_keys(texts), texts.windows()
    first, same = distinct_keys(keys)
    if table["blocks"][0].as_py() > 1:
        given = np.empty(assigned.num_rows, KEY)
        given["a"], given["b"] = assigned["a"].to_numpy().view(np.uint64), assigned["b"].to_numpy().view(np.uint64)
        recurs = np.isin(keys[first], given)[same]
    else:
        (code,) = word_codes(texts)
        view = np.lib.stride_tricks.sliding_window_view(code, WINDOW)
        like = place[first[same]]
        # word for word: whole windows where a run of them begins, and the last word of all others
        head = np.ones(len(place), bool)
        head[1:] = (np.diff(place) != 1) | (np.diff(like) != 1)
        equal = code[place + WINDOW - 1] == code[like + WINDOW - 1]
        equal[head] &= (view[place[head]] == view[like[head]]).all(axis=1)
        if not equal.all():  # keys that clash: not seen in practice
            equal = np.array([(view[a] == view[b]).all() for a, b in zip(place.tolist(), like.tolist(), strict=True)])
        recurs = equal & (np.bincount(same[equal], minlength=len(first)) > 1)[same]
    at = np.flatnonzero(recurs)
    stretch = texts.text_of_words()[place]
    goes_to = table["goes_to"].to_numpy()[stretch]
    _, once = np.unique(goes_to[at].astype(np.int64) * len(first) + same[at], return_index=True)
    member = np.full(len(place), -1)
    member[at[once]] = stretch[at[once]]
    begin, end = runs(member)
    raw = texts.data.tobytes()
    words = [raw[a:b] for a, b in zip(texts.starts[place[begin]].tolist(), texts.ends[place[end - 1] + WINDOW - 1].tolist(), strict=True)]
    return pa.table({"block": goes_to[begin], "words": words}, schema=PASSAGES)


def passages(found: DataFrame, block: Column) -> DataFrame:
    """(block, words): the recurring passages of some stretches, for each block of documents those of its rows."""
    total = found.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(MIN_SHARDS, total // SHARD_BYTES)
    most = 2 * max(1, total // shards)
    sharded = found.withColumn("shard", F.pmod(F.xxhash64("home"), F.lit(shards)).cast("int")).withColumn("goes_to", block)
    sizes = materialize(sharded.groupBy("shard").agg(F.ceil(F.sum(F.length("words")) / most).cast("int").alias("blocks")).where("blocks > 1"), "shards")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_SHARDS else sizes
    placed = sharded.join(sizes, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("row_no"), F.col("blocks")).cast("int")).select("shard", "block", "blocks", "goes_to", "words")
    assigned = (
        placed.where("blocks > 1").groupBy("shard", "block")
        .applyInArrow(tidy_group(block_windows), "shard int, block int, a long, b long, n long")
        .groupBy("shard", "a", "b").agg(F.sum("n").alias("n"), F.collect_list("block").alias("in"))
        .where("n > 1").select("shard", F.explode("in").alias("block"), "a", "b")
    )
    return placed.groupBy("shard", "block").cogroup(assigned.groupBy("shard", "block")).applyInArrow(tidy_pair(confirm), "block int, words binary")


class Phrases:
    """Exact numbers, from 1, of the phrases of some pieces; 0 stands for any other phrase.

    Words are joined to pairs, pairs to fours, fours to runs of PHRASE words that overlap in one.
    """

    def __init__(self, pieces: Texts, texts: Texts):
        own, other = word_codes(pieces, texts)
        self.n_words = own.max(initial=-1) + 1
        self.names: list[np.ndarray] = []
        code, self.first, _ = self.codes(pieces, own)
        self.own = self.numbers(code)
        code, _, self.place = self.codes(texts, other)
        self.others = self.numbers(code)

    def codes(self, texts: Texts, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' words by number (0: in no piece), a 0 after each text; each text's first place, and each word's."""
        place = np.arange(len(code)) + texts.text_of_words()
        out = np.zeros(len(code) + len(texts.at) - 1, np.int64)
        out[place] = np.where(code < self.n_words, code + 1, 0)
        return out, texts.first + np.arange(len(texts.at)), place

    def numbers(self, code: np.ndarray) -> np.ndarray:
        """The number of the phrase at each place; those of the pieces, which come first, are made, others looked up."""
        made, level = bool(self.names), 0

        def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            nonlocal level
            at = np.flatnonzero((left > 0) & (right > 0))
            key = left[at] << 32 | right[at]
            out = np.zeros(len(left), np.int64)
            if not made:
                names, number = np.unique(key, return_inverse=True)
                self.names.append(names)
                out[at] = number + 1
            elif len(self.names[level]):
                names = self.names[level]
                number = np.minimum(np.searchsorted(names, key), len(names) - 1)
                out[at] = np.where(names[number] == key, number + 1, 0)
            level += 1
            return out

        padded = np.append(code, np.zeros(PHRASE - 1, np.int64))
        two = join(padded[:-1], padded[1:])
        four = join(two[:-2], two[2:])
        return join(four[: len(code)], four[PHRASE - 4 : PHRASE - 4 + len(code)])

    def stream(self, number: np.ndarray) -> tuple[str, np.ndarray]:
        """The phrases in their phases, one after another and two digits each, and each one's place; of a row of unknown phrases one stands."""
        steps = -(-len(number) // PHRASE) + 1  # at least one unknown phrase parts the phases
        padded = np.append(number, np.zeros(steps * PHRASE - len(number), np.int64)).reshape(steps, PHRASE)
        phases, place = padded.T.ravel(), np.arange(steps * PHRASE).reshape(steps, PHRASE).T.ravel()
        keep = phases > 0
        keep[1:] |= keep[:-1]
        phases, place = phases[keep], place[keep]
        base = math.isqrt(len(self.names[-1])) + 1
        digits = np.stack([1 + phases // base, 2 + base + phases % base], axis=1)
        digits[phases == 0] = 0
        digits[digits >= 0xD800] += 0x800  # these are no characters
        return digits.ravel().astype("<u4").tobytes().decode("utf-32-le"), place


def covered(pieces: Texts, texts: Texts) -> np.ndarray:
    """For each word of the texts whether the automata's hits cover it."""
    phrases = Phrases(pieces, texts)
    letters = WINDOW // PHRASE
    written, place = phrases.stream(phrases.own)
    starts = np.zeros(len(phrases.own), bool)  # a piece's windows begin where whole ones do
    starts[np.concatenate([np.arange(a, b - WINDOW) for a, b in itertools.pairwise(phrases.first)])] = True
    inside = place < len(starts)
    inside[inside] = starts[place[inside]]
    patterns = sorted({written[x : x + 2 * letters] for x in (2 * np.flatnonzero(inside)).tolist()})
    text, place = phrases.stream(phrases.others)
    cover = np.zeros(len(phrases.others) + 1, np.int64)
    for at in range(0, len(patterns), PATTERNS):
        windows = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in patterns[at : at + PATTERNS]:
            windows.add_word(p, 1)
        windows.make_automaton()
        hit = place[np.fromiter((end for end, _ in windows.iter(text)), np.int64) // 2 - (letters - 1)]
        np.add.at(cover, hit, 1)
        np.add.at(cover, np.minimum(hit + WINDOW, len(cover) - 1), -1)
    return np.cumsum(cover[:-1])[phrases.place] > 0


def locate(pieces: list[bytes], texts: list[list[bytes]]) -> list[np.ndarray | None]:
    """For each text (as words) which of its words the automata's hits cover; None for none."""
    some = Texts.of([b" ".join(t) for t in texts])
    found = covered(Texts.of(pieces), some)
    parts = [found[a:b] for a, b in itertools.pairwise(some.first.tolist())]
    return [p if p.any() else None for p in parts]


def kept(texts: Texts, gone: np.ndarray) -> list[bytes]:
    """Each text's words that aren't gone, joined by one space."""
    size = texts.ends - texts.starts
    letters = texts.letters()[np.repeat(~gone, size)]
    ends = np.cumsum(size[~gone] + 1)
    out = np.full(ends[-1] if len(ends) else 0, ord(" "), np.uint8)
    is_letter = np.ones(len(out), bool)
    is_letter[ends - 1] = False
    out[is_letter] = letters
    raw, bounds = out.tobytes(), np.append(0, ends)[np.append(0, np.cumsum(~gone))[texts.first]].tolist()
    return [raw[a : max(a, b - 1)] for a, b in itertools.pairwise(bounds)]


def scan(docs: DataFrame, result: Callable[[pa.Table, np.ndarray, np.ndarray, list[bytes]], pa.Table], shape: str) -> DataFrame:
    """Every document through the automata of its block; ``result`` makes rows of a block's table, its texts' words and removed words, and what is kept.

    ``docs`` has a text and any other columns but row_no and block.
    """
    rows = with_rows(docs)
    blocks = max(1, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("row_no"), F.lit(blocks)).cast("int")
    found = materialize(stretches(rows), "stretches")
    pieces = materialize(passages(found, block), "passages")

    def one_block(table: pa.Table, some: pa.Table) -> pa.Table:
        texts = Texts(*utf8(pa.concat_arrays(table["text"].cast(pa.large_string()).chunks)))
        gone = covered(Texts.of(some["words"].to_pylist()), texts) if some.num_rows else np.zeros(len(texts.starts), bool)
        total = np.append(0, np.cumsum(gone))
        return result(table, np.diff(texts.first), np.diff(total[texts.first]), kept(texts, gone))

    dealt = rows.select(*docs.columns, block.alias("block"))
    return dealt.groupBy("block").cogroup(pieces.groupBy("block")).applyInArrow(tidy_pair(one_block), shape)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""

    def result(table: pa.Table, n_words: np.ndarray, n_removed: np.ndarray, left: list[bytes]) -> pa.Table:
        sums = [hashlib.sha256(x).hexdigest() for x in left]
        return pa.table({"doc_id": table["doc_id"], "n_words": n_words, "n_removed": n_removed, "kept_sha256": sums})

    return scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), result, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words gone from their texts (kept words joined by one space) and n_chars, if there, as it then is.

    Texts that lose nothing stay as they were.
    """
    names = docs.columns
    inner = ["text" if c == "text" else f"c{i}" for i, c in enumerate(names)]  # no name of the input can clash

    def result(table: pa.Table, n_words: np.ndarray, n_removed: np.ndarray, left: list[bytes]) -> pa.Table:
        texts = table["text"].to_pylist()
        new = [x.decode() if n else t for t, n, x in zip(texts, n_removed.tolist(), left, strict=True)]
        out = [table[c] for c in inner]
        out[names.index("text")] = pa.array(new, table["text"].type)
        if "n_chars" in names:
            old = table[inner[names.index("n_chars")]]
            n = [len(t) if n else o for t, n, o in zip(new, n_removed.tolist(), old.to_pylist(), strict=True)]
            out[names.index("n_chars")] = pa.array(n, old.type)
        return pa.table(out, names)

    return scan(docs.toDF(*inner), result, docs.schema)
