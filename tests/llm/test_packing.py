import itertools
import json
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "a", " a", "a ", "a  b", "\n", "a\n\nb", "x\n y", "tab\tx \t y", "\x1c a \x1c b", "　wide　space", "a b",
    "don't I'll 12ab\r\nfoo", "日本語 emoji 😀 x", "<|endoftext|> x", "é ß\u180e x", "x" * 5000, "word " * 9000, "\x00 a\x00 b",
]


def test_ids_are_the_tokenizers_own():
    whole = Tokenizer.from_file(PATH)
    coder, _ = packing.byte_bpe(PATH)
    for _ in range(2):  # the second time parts are remembered
        for t, ids in zip(ODD, coder.encode([t or "" for t in ODD]), strict=True):
            assert array("I", ids).tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


SETTINGS = {
    "prefix": {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
    "no_split": {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}},
    "digits": {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Digits", "individual_digits": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}]}},
    "lower": {"normalizer": {"type": "Lowercase"}},
    "truncated": {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}},
}


@pytest.mark.parametrize("name", SETTINGS)
def test_ids_under_other_settings(name, tmp_path):
    with open(PATH) as f:
        changed = json.load(f) | SETTINGS[name]
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(changed, f)
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    texts = [t or "" for t in ODD if len(t or "") < 1000] + ["Two WORDS 12 345", "Two WORDS 12 345"]
    got = packing.ByteBpe(path).encode(texts)
    assert [array("I", x).tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def every_cost(places, penalty, last):
    """The least cost by plain dynamic programming over all pairs of places."""
    free = {1 << i for i in range(12)}
    cost = [0]
    for i in range(1, len(places)):
        pads = ((j, places[i] - places[j]) for j in range(i))
        cost.append(min((cost[j] + (0 if n in free else packing.WINDOW - n) for j, n in pads if n <= packing.WINDOW)) + packing.PER_SEQUENCE + penalty[i])
    return cost[-1] if last else min(c for c, p in zip(cost, places, strict=True) if p > places[-1] - packing.WINDOW)


@pytest.mark.parametrize("apart", [3, 40, 700, 2049])
def test_cuts_are_the_cheapest(apart):
    rng = np.random.default_rng(apart)
    for last in (True, False):
        for _ in range(40):
            n = int(rng.integers(2, 120))
            places = [0, *np.cumsum(rng.integers(1, apart, n)).tolist()]
            penalty = [0, *rng.choice([0, 8, 96], n).tolist()]
            cuts = packing.best_cuts(places, penalty, last)
            at = {p: i for i, p in enumerate(places)}
            total = sum(packing.padding(b - a) + packing.PER_SEQUENCE + penalty[at[b]] for a, b in itertools.pairwise(cuts))
            assert total == every_cost(places, penalty, last)


def test_a_short_power_of_two_is_free():
    assert packing.best_cuts([0, 1040, 2048, 2080], [0, 0, 8, 0], True) == [0, 2048, 2080]


@pytest.mark.parametrize("apart", [5, 3000])
def test_segments_are_cut_at_least_cost(apart):
    rng = np.random.default_rng(apart)
    ends = np.zeros(3, bool)
    ends[2] = True  # id 2 ends a sentence
    for _ in range(10):
        pieces = []
        for d in range(8):
            ids = np.zeros(int(rng.integers(1, 4 * apart)), "<u4")
            ids[rng.random(len(ids)) < 1 / apart] = 2
            pieces.append(packing.Piece(d, ids, 0, len(ids)))
        ids, bounds = np.concatenate([p.ids for p in pieces]), np.cumsum([0, *(len(p.ids) for p in pieces)])
        price = {int(p) + 1: packing.SENTENCE_CUT for p in np.flatnonzero(ids == 2)} | {int(b): 0 for b in bounds}
        for a, b in itertools.pairwise(sorted(price)):
            price |= {p: packing.HARD_CUT for p in range(a + packing.WINDOW, b, packing.WINDOW)}
        rows, n, carried = packing.pack_segment(pieces, ends, True)
        length = np.bincount(rows["sequence_id"], rows["length"]).astype(int)
        stop = np.cumsum(length).tolist()
        assert not carried and len(stop) == n
        places = sorted(price)
        total = sum(packing.padding(x) + packing.PER_SEQUENCE + price[p] for x, p in zip(length.tolist(), stop, strict=True))
        assert total == every_cost(places, [price[p] for p in places], True)


def check(rows, docs):
    whole = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, text in docs:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = tokens = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
        padding, tokens = padding + packing.padding(at), tokens + at
    return padding / tokens


def test_every_id_is_in_one_piece(stored, monkeypatch):
    docs = [*enumerate(ODD), (None, "no id")] + [(100 + i, f"Sentence {i}. And one more! " * (i % 90)) for i in range(400)]
    df = stored(docs, "doc_id long, text string")
    assert check(packing.pack_documents(df, PATH).collect(), docs) < 0.06
    monkeypatch.setattr(packing, "SEGMENT", 5000)
    assert check(packing.pack_documents(df, PATH).collect(), docs) < 0.06


def test_repeats_and_empty_table(stored):
    twice = packing.pack_documents(stored([(1, "a b"), (1, "a b")], "doc_id long, text string", files=1), PATH).collect()
    assert sorted(r.offset for r in twice) == [0, 3] and len({r.sequence_id for r in twice}) == 1
    assert packing.pack_documents(stored([], "doc_id long, text string", "e"), PATH).collect() == []


def test_very_long_texts_and_columns_that_clash(stored):
    docs = [(1, "A long sentence here. " * 60_000, 1, 2, 3), (2, "x" * 30_000, 4, 5, 6), (3, "end", 7, 8, 9)]
    df = stored(docs, "doc_id long, text string, start int, length long, sequence_id string")
    rows = packing.pack_documents(df, PATH).collect()
    assert check(rows, [d[:2] for d in docs]) < 0.05 and packing.pack_documents(df, PATH).columns[:4] == ["doc_id", "start", "length", "ids_crc32"]


def test_new_words_go_to_the_library_as_few_texts(monkeypatch):
    import public_tokenizers

    coder = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{i}ö,x{i % 7}" for i in range(400)), "a\nb  c\t\n d", "don't 12 3.4   x​y z", "x Ġ Ġy ĠĠ"]
    whole = coder.ids(texts)
    asked = []
    monkeypatch.setattr(coder, "ids", lambda some: asked.extend(some) or packing.ByteBpe.ids(coder, some))
    assert coder.encode(texts) == whole
    assert len(asked) < 30


def test_words_of_a_vocabulary_without_leading_spaces():
    import public_tokenizers

    coder = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    right = coder.word_ids(["some", "words"])
    coder.leads[:] = False
    assert coder.word_ids(["some", "words"]) == right == coder.ids([" some", " words"])


def test_a_stem_goes_to_the_library_once(monkeypatch):
    coder = packing.ByteBpe(PATH)
    texts = ["stem, stem. (x) stem! stem?! stem", "stem's stem\nstem;", "été, été. été", "×, ×. ÷; ª, ª."]
    whole = coder.ids(texts)
    asked = []
    monkeypatch.setattr(coder, "ids", lambda some: asked.extend(some) or packing.ByteBpe.ids(coder, some))
    assert coder.encode(texts) == whole
    words = " ".join(asked).replace("\n", " ").split(" ")  # at a text's start, after a space, after a line break
    assert words.count("stem") == 3 and not {"stem,", "stem.", "stem!", "stem?!", "stem;", "été,"} & set(words)


def test_ids_of_odd_mixtures_while_few_words_are_remembered(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    assert all(packing.ByteBpe.rare.search(c) for c in map(chr, range(0x3100)) if (c.isspace() or c in "᠎​﻿") and c not in " \n")
    rng = np.random.default_rng(5)
    bits = ["the", "Ñu", "ß", "ª", "×", "é", "日", "٣", "1", "'s", "'ll", "'", ",", ".", "!?", "%%", "_", "«", " ", " ", " ", "\n", "\t", "\xa0", " ", "​", "\x85", "Ġ", "\x01"]
    texts = ["".join(rng.choice(bits, rng.integers(1, 40))) for _ in range(1500)]
    coder = packing.ByteBpe(PATH)
    for first in range(0, len(texts), 100):
        some = texts[first : first + 100]
        assert coder.encode(some) == coder.ids(some)
        assert len(coder.known) == len(coder.known_ids) == len(coder.used) <= 40


@pytest.mark.parametrize("looked_up", [3, 1 << 16])
def test_places_at_powers_of_two(looked_up, monkeypatch):
    monkeypatch.setattr(packing, "LOOKED_UP", looked_up)
    places = [0, *np.cumsum(np.random.default_rng(2).integers(1, 9, 400)).tolist()]
    at = {p: i for i, p in enumerate(places)}
    assert list(packing.powers_before(places)) == [[at[p - power] for power in packing.POWERS if p - power in at] for p in places]
