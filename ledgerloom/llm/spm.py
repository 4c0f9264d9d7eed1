"""SentencePiece encoding, decoding and counting without the sentencepiece library.

``read_model`` parses a model's protobuf. ``build_tokenizer`` rebuilds it for
the tokenizers library: normaliser, metaspace marker, byte fallback, and either
unigram scores or the merges that a BPE model's scores stand for.
``SpmEncoder`` encodes and decodes batches: the rebuilt normaliser's texts are cut where no piece of the vocabulary can
span, and each distinct part is encoded, and decoded, once, in multithreaded batches, and
remembered. ``code_digest`` encodes and decodes each row whole by the rebuilt tokenizer and by
the sentencepiece library, to verify parity. ``UnigramCounter`` counts pieces only: an Aho-Corasick
automaton enumerates the vocabulary's matches and dynamic programming carries
best score and piece count, with the tokenizer's tie rule (of equal scores the
longer last piece stays).

Defined cases: null and empty texts have no pieces; repeated rows are encoded
each; texts of any length are encoded whole; of BPE merges that tie in score the one of the
smaller piece numbers comes first, as their ranks say, and of unigram segmentations of equal score the longer last piece stays;
other columns, whatever they are called, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from .common import chunks

MARK = "▁"
#: Fixed values of the model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNK_PENALTY = 10.0
#: Distinct parts that an encoder or counter remembers; others are worked out anew each time.
REMEMBERED = 250_000
#: One row in so many has its parity verified: every one.
PARITY = 1


@dataclass(frozen=True)
class SpmModel:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    model_type: int
    byte_fallback: bool
    unk_id: int
    charsmap: bytes
    dummy_prefix: bool
    drop_extra_spaces: bool
    escape_spaces: bool


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-size values as their bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def parse_model(data: bytes, model_type: int | None = None) -> SpmModel:
    """The model of a protobuf; ``model_type`` reads the same pieces and scores as another kind."""
    pieces, scores, kinds = [], [], []
    trainer: dict = {}
    normal: dict = {}
    for number, value in fields(data):
        if number == 1:
            one = dict(fields(value))
            pieces.append(one[1].decode())
            scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
            kinds.append(one.get(3, NORMAL))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normal = dict(fields(value))
    unk = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
    return SpmModel(
        tuple(pieces), tuple(scores), tuple(kinds), model_type or trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), unk,
        normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1)),
    )


@functools.cache
def read_model(path: str, model_type: int | None = None) -> SpmModel:
    with open(path, "rb") as f:
        return parse_model(f.read(), model_type)


def merges_of(model: SpmModel) -> list[tuple[str, str]]:
    """The merges that a BPE model's pieces stand for, best piece first."""
    rank = {p: -s for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True) if k in (NORMAL, USER_DEFINED)}
    number = {p: i for i, p in enumerate(model.pieces)}
    out = []
    for piece, r in rank.items():
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if a in rank and b in rank:
                out.append((r, number[a], number[b], a, b))
    return [(a, b) for *_, a, b in sorted(out)]


def normaliser(model: SpmModel) -> normalizers.Normalizer:
    """The model's character map, extra spaces, space in front and space markers."""
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.drop_extra_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(r"\A +| +\z"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def normaliser_of_texts(model: SpmModel) -> Callable[[str], str]:
    """``normaliser`` for one text; without a character map and rules for extra spaces two string operations are all of it."""
    if model.charsmap or model.drop_extra_spaces:
        return normaliser(model).normalize_str
    lead = " " if model.dummy_prefix else ""
    if model.escape_spaces:
        return lambda text: text and (lead + text).replace(" ", MARK)
    return lambda text: text and lead + text


def build_tokenizer(model: SpmModel, normalise: bool = True) -> Tokenizer:
    """The tokenizers-library equal of a SentencePiece model; without ``normalise`` it takes normalised parts."""
    unk = model.pieces[model.unk_id]
    if model.model_type == BPE:
        core = models.BPE(
            {p: i for i, p in enumerate(model.pieces)}, merges_of(model), unk_token=unk, fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        # the library would also match control pieces in plain text: make that impossible, and byte pieces unlikely
        names = [p if k in (NORMAL, USER_DEFINED, BYTE) else f"\U0010fffd{p}" for p, k in zip(model.pieces, model.kinds, strict=True)]
        least = min((s for s, k in zip(model.scores, model.kinds, strict=True) if k == NORMAL), default=0.0)
        scores = [least if k not in (NORMAL, USER_DEFINED) else s for s, k in zip(model.scores, model.kinds, strict=True)]
        core = models.Unigram(list(zip(names, scores, strict=True)), unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    if normalise:
        out.normalizer = normaliser(model)
        if marks_lead(model):
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    users = [p for p, k in zip(model.pieces, model.kinds, strict=True) if k == USER_DEFINED]
    if users:
        out.add_tokens([AddedToken(p, normalized=True) for p in users])
    out.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])]
    )
    return out


def marks_lead(model: SpmModel) -> bool:
    """Whether no piece has the marker after another character, so that none spans two words."""
    return not any(MARK in p.lstrip(MARK) for p, k in zip(model.pieces, model.kinds, strict=True) if k in (NORMAL, USER_DEFINED))


class Parts:
    """Cuts normalised texts into parts that no piece spans.

    A part is a word with its marker, written without it, or a line's first
    word with the line break before it (if no piece holds a line break); texts with
    runs of spaces are cut into explicit parts instead, which start with the marker.
    """

    def __init__(self, model: SpmModel):
        self.model = model
        self.lead = marks_lead(model)
        plain = [p for p, k in zip(model.pieces, model.kinds, strict=True) if k in (NORMAL, USER_DEFINED)]
        self.break_alone = not any("\n" in p for p in plain)
        self.odd = re.compile(f"{MARK}{MARK}|{MARK}\n|{MARK}$|\n\n|^\n")
        self.runs = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.normalise = normaliser_of_texts(model)

    def of(self, normal: str) -> list[str]:
        """The parts of a normalised text; ``spell`` gives each one's characters."""
        if not normal:
            return []
        if not self.lead:
            return [f"{MARK}{normal}"]
        if normal[0] != MARK or self.odd.search(normal):
            return [f"{MARK}{x}" for x in self.runs.findall(normal)]
        if self.break_alone:
            normal = normal.replace("\n", f"{MARK}\n")
        return normal[1:].split(MARK)

    @staticmethod
    def spell(part: str) -> str:
        """A part's characters: a marker at its start says that they stand as they are."""
        return part[1:] if part[:1] == MARK else part if part[:1] == "\n" else MARK + part


class SpmEncoder(dict):
    """Part to ids (as bytes of little-endian 32-bit integers)."""

    def __init__(self, model: SpmModel):
        super().__init__()
        self.model, self.parts = model, Parts(model)
        self.inner = build_tokenizer(model, normalise=False)
        # texts that spell a byte piece out would confuse the library's unigram model
        self.spelled_out = UnigramCounter(model) if model.model_type == UNIGRAM and model.byte_fallback else None
        self.leads = np.array([p.startswith(MARK) for p in model.pieces])
        self.texts: dict[bytes, str] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids; new parts go to the tokenizers library in one batch."""
        return self.encode_normal([self.parts.normalise(t or "") for t in texts])

    def encode_normal(self, normal: list[str]) -> list[bytes]:
        """Ids of normalised texts."""
        cut = [self.parts.of(t) for t in normal]
        new = list(set().union(*cut).difference(self))
        found = {}
        for first in range(0, len(new), 20_000):
            some = new[first : first + 20_000]
            got = self.inner.encode_batch([Parts.spell(p) for p in some], add_special_tokens=False)
            found.update((p, array("I", e.ids).tobytes()) for p, e in zip(some, got, strict=True))
        if self.spelled_out is not None:
            found.update((p, array("I", self.spelled_out.ids(Parts.spell(p))).tobytes()) for p in new if "<0x" in p)
        if len(self) < REMEMBERED:
            self.update(found)
            return [b"".join(map(self.__getitem__, parts)) for parts in cut]
        return [b"".join([self[p] if p in self else found[p] for p in parts]) for parts in cut]

    def plain(self, normal: str) -> str:
        """What a normalised text says: its markers as spaces, without the one in front."""
        text = normal.replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text

    def decode(self, coded: list[bytes]) -> list[str]:
        """Each row of ids as text; new runs of ids from one leading marker to the next go to the tokenizers library in batches."""
        ids = np.frombuffer(b"".join(coded), "<i4")
        first = np.cumsum([0, *(len(x) // 4 for x in coded)])
        begins = np.append(self.leads[ids], True)
        begins[first] = True
        at = np.flatnonzero(begins)
        raw = ids.tobytes()
        parts = [raw[4 * a : 4 * b] for a, b in itertools.pairwise(at.tolist())]
        new = list(set(parts).difference(self.texts))
        found: dict[bytes, str] = {}
        for low in range(0, len(new), 20_000):
            some = new[low : low + 20_000]
            got = self.inner.decode_batch([array("I", x).tolist() for x in some], skip_special_tokens=False)
            # the decoder takes the space in front of a text; inside one it stays
            found.update((p, " " * (self.model.dummy_prefix and bool(self.leads[array("I", p[:4])[0]])) + t) for p, t in zip(some, got, strict=True))
        if len(self.texts) < REMEMBERED:
            self.texts.update(found)
            found = self.texts
        cut = np.searchsorted(at, first).tolist()
        out = []
        for a, b in itertools.pairwise(cut):
            text = "".join([found[p] if p in found else self.texts[p] for p in parts[a:b]])
            out.append(text[1:] if self.model.dummy_prefix and b > a and text[:1] == " " and self.leads[ids[at[a]]] else text)
        return out


class UnigramCounter(dict):
    """Part to its number of pieces in the best unigram segmentation."""

    def __init__(self, model: SpmModel):
        super().__init__()
        self.model, self.parts = model, Parts(model)
        self.matcher = ahocorasick.Automaton()
        plain = [s for s, k in zip(model.scores, model.kinds, strict=True) if k in (NORMAL, USER_DEFINED)]
        self.unknown = min(plain, default=0.0) - UNK_PENALTY
        self.number = {p: i for i, p in enumerate(model.pieces)}
        top = max(plain, default=0.0)
        for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True):
            if k in (NORMAL, USER_DEFINED):
                self.matcher.add_word(p, (len(p), len(p) * top - 0.1 if k == USER_DEFINED else s))
        self.matcher.make_automaton()

    def __missing__(self, part: str) -> int:
        n = self.pieces(Parts.spell(part))
        if len(self) < REMEMBERED:
            self[part] = n
        return n

    def pieces(self, s: str) -> int:
        """Pieces of a normalised string."""
        return self.walk(s)[0]

    def walk(self, s: str) -> tuple[int, list[int], list[bool]]:
        """Number of pieces, and for each end of a piece where the best one starts and whether it is unknown."""
        best, count, unk = [0.0] * (len(s) + 1), [0] * (len(s) + 1), [False] * (len(s) + 1)
        start = [0] * (len(s) + 1)
        matches = self.matcher.iter(s)
        end, (size, score) = next(matches, (len(s), (0, 0.0)))
        for i in range(len(s)):
            top, at, single = None, i, False
            while end == i:  # of equal scores the longer piece stays
                now = best[i + 1 - size] + score
                single |= size == 1
                if top is None or now > top or now == top and size > i + 1 - at:
                    top, at = now, i + 1 - size
                end, (size, score) = next(matches, (len(s), (0, 0.0)))
            if not single and (top is None or best[i] + self.unknown > top):
                best[i + 1], unk[i + 1], start[i + 1] = best[i] + self.unknown, True, i
                count[i + 1] = count[i] + (len(s[i].encode("utf-8", "replace")) if self.model.byte_fallback else not unk[i])
            else:
                best[i + 1], count[i + 1], start[i + 1] = top, count[at] + 1, at
        return count[-1], start, unk

    def ids(self, s: str) -> list[int]:
        """Ids of a normalised string under a model with byte fallback."""
        _, start, unk = self.walk(s)
        out: list[int] = []
        end = len(s)
        while end:
            piece = s[start[end] : end]
            out += [self.number[f"<0x{b:02X}>"] for b in reversed(piece.encode())] if unk[end] else [self.number[piece]]
            end = start[end]
        return out[::-1]

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.parts.of(self.parts.normalise(text or ""))))


@functools.cache
def encoder(path: str) -> SpmEncoder:
    """One encoder per Python worker and model."""
    return SpmEncoder(read_model(path))


@functools.cache
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(read_model(path, UNIGRAM))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in chunks(batches, "text"):
            got = [np.frombuffer(x, "<i4") for x in encoder(path).encode(batch.column("text").to_pylist())]
            at = np.cumsum([0, *map(len, got)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(at, np.concatenate(got))], ["doc_id", "ids"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row of ids, by the tokenizers library's decoder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = build_tokenizer(read_model(path))
        for batch in batches:
            ids = [x or [] for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tokenizer.decode_batch(ids), pa.string())], ["doc_id", "text"]
            )

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


@functools.cache
def whole_coders(path: str):
    """The rebuilt tokenizer for whole texts that are normalised, and the sentencepiece library's processor.

    A whole text goes to the model as one word: where no piece spans two words, cutting it first changes nothing and takes longer.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
    import sentencepiece

    model = read_model(path)
    tokenizer = build_tokenizer(model, normalise=False)
    if (MARK, NORMAL) in zip(model.pieces, model.kinds, strict=True):  # no text's ids spell the marker in byte pieces, so that it can go once for a text, not once for a piece
        tokenizer.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " "), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=path, num_threads=1)


@functools.cache
def decoder_of_texts(path: str) -> Callable[[list[list[int]]], list[str]]:
    """What ``whole_coders``' tokenizer decodes whole rows of ids to; where the marker is a piece, spaces take its place in the decoded text."""
    tokenizer, _ = whole_coders(path)
    model = read_model(path)
    if (MARK, NORMAL) not in zip(model.pieces, model.kinds, strict=True):
        return lambda ids: tokenizer.decode_batch(ids, skip_special_tokens=False)
    marked, plain = Tokenizer(tokenizer.model), encoder(path).plain
    marked.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
    return lambda ids: [plain(t) for t in marked.decode_batch(ids, skip_special_tokens=False)]


def compared(path: str, texts: list[str | None], coded: list[bytes] | None = None, normal: list[str] | None = None) -> Iterator[tuple[list[int], str, bool]]:
    """For each text (``normal``: normalised, if that is known) its ids (those ``coded``, else the rebuilt tokenizer's of the whole text), what they decode to, and parity.

    Parity is that the rebuilt tokenizer and the sentencepiece library give the whole text these ids, and the ids the same text.
    """
    tokenizer, reference = whole_coders(path)
    decode = decoder_of_texts(path)
    texts = [t or "" for t in texts]
    normal = [encoder(path).parts.normalise(t) for t in texts] if normal is None else normal
    own = [e.ids for e in tokenizer.encode_batch_fast(normal, add_special_tokens=False)]
    ids = own if coded is None else [array("I", x).tolist() for x in coded]
    if coded is None and encoder(path).spelled_out is not None:  # such texts confuse the library's unigram model
        ids = [array("I", encoder(path).encode([t])[0]).tolist() if "<0x" in t else x for t, x in zip(texts, own, strict=True)]
    for mine, theirs, x, text in zip(own, reference.encode(texts), ids, decode(ids), strict=True):
        yield x, text, mine == x == theirs and text == reference.decode(x)


def parity(path: str, texts: list[str | None], coded: list[bytes]) -> list[bool]:
    """Whether the rebuilt tokenizer and the sentencepiece library give whole texts the same ids and the ids the same text."""
    return [equal for _, _, equal in compared(path, texts, coded)]


def code_digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: n_pieces, ids_crc32, whether decoding gives the normalised text back, and parity (all encoded and decoded, whole, by both libraries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch, _, _ in chunks(batches, "text"):
            texts = batch.column("text").to_pylist()
            size, sums, same, equal = [], [], [], []
            normal = [coder.parts.normalise(t or "") for t in texts]
            for plain, (ids, said, parity_) in zip(map(coder.plain, normal), compared(path, texts, normal=normal), strict=True):
                size.append(len(ids))
                sums.append(zlib.crc32(array("I", ids).tobytes()))
                same.append(said == plain)
                equal.append(parity_)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_()), pa.array(equal, pa.bool_())],
                ["doc_id", "n_pieces", "ids_crc32", "round_trip", "parity"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean, parity boolean"
    )


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of each document: one pass, nothing but counts leaves the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch, _, _ in chunks(batches, "text"):
            n = [count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")
