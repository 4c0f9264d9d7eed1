import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import substrings

W = substrings.WINDOW


def brute(docs):
    seen = collections.Counter()
    words = [(i, (t or "").encode().split()) for i, t in docs]
    for _, w in words:
        seen.update(tuple(w[k : k + W]) for k in range(len(w) - W + 1))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - W + 1):
            if seen[tuple(w[k : k + W])] > 1:
                gone.update(range(k, k + W))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(docs).collect()), key=str)


def words(tag, n):
    return " ".join(f"{tag}{j}" for j in range(n))


EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (None, "a b"), (4, words("w", 34)), (5, words("w", 34)),
    (6, words("x", 35)), (7, words("x", 35) + "\r\n" + words("y", 3)), (8, "same " * 200), (9, "z " + words("long", 3000) + " z"),
    (10, words("long", 3000)), (11, words("r", 50)), (11, words("r", 50)), (12, "no\u00a0break ü\u2003x " + words("x", 36)),
]


def test_edges_match_brute_force(stored):
    assert run(stored(EDGES, "doc_id long, text string")) == brute(EDGES)


def test_hot_passage_and_near_copies(stored):
    docs = [(i, f"{words(f'h{i}_', 20)} {words('hot', 60)} {words(f't{i}_', 30)}") for i in range(150)]
    base = words("near", 120).split()
    for i in range(100):
        copy = list(base)
        copy[(7 * i) % 120] = f"edit{i}"
        docs.append((1000 + i, " ".join(copy)))
    assert run(stored(docs, "doc_id long, text string", files=4)) == brute(docs)


def test_shards_in_blocks_agree(stored, monkeypatch):
    monkeypatch.setattr(substrings, "MIN_SHARDS", 8)
    docs = [(i, f"{words('hot', 40)} {words(f't{i}_', 5)}") for i in range(300)] + EDGES
    assert run(stored(docs, "doc_id long, text string", files=4)) == brute(docs)


def test_empty_table(stored):
    assert run(stored([], "doc_id long, text string")) == []


def test_removal_keeps_columns_that_clash(stored):
    docs = [(1, words("a", 40), "p", 7, 3), (2, words("a", 40) + " tail", "q", 8, 4), (3, None, None, None, None), (4, "keep  as\nis", "r", 10, 5)]
    df = stored(docs, "doc_id long, text string, cuts string, n_chars long, row_no int")
    out = substrings.remove_repeats(df)
    assert out.schema == df.schema
    got = {r.doc_id: tuple(r) for r in out.collect()}
    assert got == {1: (1, "", "p", 0, 3), 2: (2, "tail", "q", 4, 4), 3: docs[2], 4: docs[3]}


class NoHits:
    def __init__(self, *_):
        pass

    def add_word(self, *_):
        pass

    def make_automaton(self):
        pass

    def iter(self, text):
        return iter(())


class AllHits(NoHits):
    def iter(self, text):
        return ((end, 1) for end in range(2 * W // substrings.PHRASE - 1, 33, 2))


@pytest.mark.parametrize("wrong", [NoHits, AllHits])
def test_the_automatons_hits_are_the_result(wrong, monkeypatch):
    one, two = words("p", 60).split(), words("q", 50).split()
    texts = [[x.encode() for x in t] for t in (["a", *one, "b"], [*two, *one[3:50], *two])]
    right = substrings.locate([b" ".join(texts[0][1:61])], texts)
    assert [c.sum() for c in right] == [60, 47]
    monkeypatch.setattr(substrings.ahocorasick, "Automaton", wrong)
    got = substrings.locate([b" ".join(texts[0][1:61])], texts)
    assert [0 if c is None else c.sum() for c in got] != [60, 47]


@pytest.mark.parametrize("per_automaton", [3, 1_000])
def test_locate_equals_brute_force_on_few_words(per_automaton, monkeypatch):
    monkeypatch.setattr(substrings, "PATTERNS", per_automaton)
    draw = random.Random(5)
    for _ in range(30):
        passages = [[draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randint(W, 60))] for _ in range(3)]
        texts = [[w for _ in range(draw.randint(0, 3)) for w in (*draw.choice(passages)[draw.randint(0, 9) :], b"a", b"x")] for _ in range(6)]
        known = {tuple(p[k : k + W]) for p in passages for k in range(len(p) - W + 1)}
        got = substrings.locate([b" ".join(p) for p in passages], texts)
        for t, c in zip(texts, got, strict=True):
            want = {j for k in range(len(t) - W + 1) if tuple(t[k : k + W]) in known for j in range(k, k + W)}
            assert want == (set() if c is None else set(c.nonzero()[0].tolist()))


def test_a_very_long_text_and_one_that_overlaps_itself(stored):
    docs = [(1, words("v", 400_000)), (2, words("v", 100)), (3, words("o", 20) + " " + " ".join(["u v w"] * 40)), (4, "u v w " * 30)]
    assert run(stored(docs, "doc_id long, text string")) == brute(docs)


def test_digest_with_columns_that_clash(stored):
    docs = [(1, words("a", 40), 1, 2, 3, 4), (2, words("a", 40) + " t", 5, 6, 7, 8)]
    df = stored(docs, "doc_id long, text string, block int, row_no long, piece int, words int")
    assert run(df) == brute([d[:2] for d in docs])


@pytest.mark.parametrize("n", [35, 52, 71])
def test_passages_of_any_length(stored, n):
    docs = [(1, words("p", n)), (2, "x " + words("p", n) + " y")]
    assert run(stored(docs, "doc_id long, text string")) == brute(docs)


@pytest.mark.parametrize("shards", [64, 1])  # shards in several blocks, and in one
def test_a_block_gets_the_recurring_windows_of_its_rows_and_no_other(stored, monkeypatch, shards):
    """Passages that share a phrase went to every block that holds the phrase: as many as passages times blocks."""
    monkeypatch.setattr(substrings, "MIN_SHARDS", shards)
    docs = [(i, f"{words(f'p{i % 40}_', 30)} {words('common', 14)} {words(f'q{i % 40}_', 30)}") for i in range(120)]
    docs += [(1000 + i, f"{words('common', 14)} {words(f'own{i}_', 30)}") for i in range(60)]
    rows = substrings.with_rows(stored(docs, "doc_id long, text string", files=4))
    block = F.pmod(F.xxhash64("row_no"), F.lit(16)).cast("int")
    got = collections.defaultdict(collections.Counter)
    for r in substrings.passages(substrings.stretches(rows), block).collect():
        w = bytes(r.words).split()
        got[r.block].update(tuple(w[k : k + W]) for k in range(len(w) - W + 1))
    there, seen = collections.defaultdict(collections.Counter), collections.Counter()
    for r in rows.withColumn("block", block).collect():
        w = r.text.encode().split()
        own = [tuple(w[k : k + W]) for k in range(len(w) - W + 1)]
        seen.update(own)
        there[r.block].update(own)
    want = {b: x for b, s in there.items() if (x := {k for k in s if seen[k] > 1})}
    assert {b: set(c) for b, c in got.items()} == want
    assert all(n <= (there[b][k] if shards > 1 else 1) for b, c in got.items() for k, n in c.items())


def test_keys_that_clash_by_half():
    keys = np.array([(1, 1), (1, 2), (1, 1), (3, 2), (1, 2)], substrings.KEY)
    first, same = substrings.distinct_keys(keys)
    assert first.tolist() == [0, 1, 3] and same.tolist() == [0, 1, 0, 2, 1]


def test_words_that_stay_are_joined_by_one_space():
    draw = random.Random(7)
    texts = ["", " \n", *("".join(draw.choice(["a", "bü", " ", "\t\n"]) for _ in range(draw.randint(0, 30))) for _ in range(50))]
    some = substrings.Texts.of([t.encode() for t in texts])
    gone = np.array([draw.random() < 0.5 for _ in some.starts], bool)
    flags = iter(gone.tolist())
    assert substrings.kept(some, gone) == [b" ".join([w for w in t.encode().split() if not next(flags)]) for t in texts]
