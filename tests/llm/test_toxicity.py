import collections
import math
import zlib

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import toxicity
from tests.conftest import SMALL

FINE = "the river runs along quiet fields and old stone walls number"
BAD = "you are a worthless idiot and a stupid clown number"


def tables(stored, n=240):
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        noise = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(30))
        docs.append((i, f"{BAD if toxic else FINE} {noise}", "x"))
        if i % 5:
            labels.append((i, int(toxic), 1))
    labels += [(1, 0, 1), (None, 1, 0), (9999, 1, 0), (7, None, 0)]
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "idiot " * 30000, "x"), (None, BAD, "x"), (3, FINE, "again")]
    return stored(docs, "doc_id long, text string, score string", "d"), stored(labels, "doc_id long, toxic int, quality int", "l")


def test_scores_held_out_and_edges(stored):
    docs, labels = tables(stored)
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 245
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None and r.doc_id < 1000:
            assert r.predicted == int(r.doc_id % 4 == 0), r
    by = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 1000}
    assert by[1000].predicted == by[1001].predicted == 0 and by[None].predicted == 1
    assert any(r.held_out for r in got) and any(r.evidence for r in got)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.schema == docs.schema and kept.where("text LIKE '%worthless%'").count() == 0
    assert kept.where("doc_id < 1000 AND doc_id % 4 != 0").count() == 181


def test_nothing_to_learn_and_empty_tables(stored):
    docs, labels = tables(stored, 20)
    assert {r.score for r in toxicity.score_documents(docs, labels.where("false")).collect()} == {0.0}
    assert toxicity.score_documents(docs.where("false"), labels).collect() == []


@pytest.mark.parametrize("frequent", [1, 4, 1_000])
def test_block_max_search_is_exact(monkeypatch, frequent):
    rng = np.random.default_rng(0)
    n, f = 300, 40
    counts = np.where(rng.random((n, f)) < 0.15, rng.integers(1, 5, (n, f)), 0)
    counts[:, 0] = np.maximum(counts[:, 0], 1)
    counts[17] = counts[3]  # a tie
    weights = rng.random(f) + 0.1
    doc, term = np.nonzero(counts)
    number = counts[doc, term]
    index = toxicity.build_index(np.arange(f, dtype=np.uint64), weights, doc, term, number, np.zeros(n, int), np.arange(n), np.arange(n), 0.0)
    dense = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * weights
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    row, column = np.nonzero(dense[:60])
    got = toxicity.nearest(index, row, column, dense[row, column], 60, 15, np.arange(60))
    for i, (near, score) in enumerate(got):
        every = dense @ dense[i]
        every[i] = -1
        want = np.lexsort((np.arange(n), -np.round(every, 12)))[:15]
        assert np.allclose(score, every[want]) and near.tolist() == want.tolist()


def test_blocks_that_cannot_hold_a_nearer_example_are_not_read(monkeypatch):
    counts = np.zeros((640, 12), int)
    counts[:, 0] = 1
    counts[np.arange(640), 1 + np.arange(640) // 64] = 9  # a word of its own for each block
    doc, term = np.nonzero(counts)
    index = toxicity.build_index(np.arange(12, dtype=np.uint64), np.ones(12), doc, term, counts[doc, term], np.zeros(640, int), np.arange(640), np.arange(640), 0.0)
    number, postings, maxima = index.frequent
    broken = postings.copy()
    broken[:, 5:] = np.nan  # reading these would show
    index.__dict__["frequent"] = (number, broken, maxima)
    q = np.array([0.2, 0.9])
    (near, score), = toxicity.nearest(index, np.zeros(2, int), np.array([0, 1]), q, 1, 15)
    assert near.tolist() == list(range(15)) and not np.isnan(score).any()


def brute_scores(docs, labels, by_label):
    """The query's scores by plain dictionaries over all words and all examples."""

    def terms(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        return collections.Counter([*words, *(("stem", w[:5]) for w in words if len(w) > 5)])

    counts = [(i, terms(t), t) for i, t in docs]
    may = {}
    for i, toxic, _ in labels:
        if i is not None and toxic in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1:
            may[i] = max(toxic, may.get(i, 0))
    prior = sum(may.values()) / len(may)
    every = [(c, may[i], xxhash.xxh64_intdigest(t.encode(), 42) % toxicity.FOLDS) for i, c, t in counts if i in may and c]
    df = {term: sum(term in c for _, c, _ in counts) for term in set().union(*(c for c, *_ in every))}

    def votes_of(fit):
        n, toxic = len(fit), sum(y for _, y, _ in fit)
        weight = {}
        for term in set().union(*(c for c, *_ in fit)):
            has, both = sum(term in c for c, *_ in fit), sum(term in c and y for c, y, _ in fit)
            spread = math.sqrt(has * (n - has) * toxic * (n - toxic))
            phi = abs(both * n - has * toxic) / spread if spread else 0
            weight[term] = (math.log((1 + len(counts)) / (1 + df[term])) + 1) * ((phi + 1 / n) if by_label else 1)

        def unit(c):
            w = {t: (1 + math.log(k)) * weight[t] for t, k in c.items() if t in weight}
            norm = math.sqrt(sum(x * x for x in w.values()))
            return {t: x / norm for t, x in w.items()}

        units = [unit(c) for c, *_ in fit]

        def vote(c):
            q = unit(c)
            near = sorted((-round(sum(x * u.get(t, 0) for t, x in q.items()), 12), k) for k, u in enumerate(units))[: toxicity.NEIGHBOURS]
            near = [(-s, k) for s, k in near if s < 0]
            return (sum(s * fit[k][1] for s, k in near) + prior) / (sum(s for s, _ in near) + 1)

        return vote

    without = [votes_of([x for x in every if x[2] != f]) for f in range(toxicity.FOLDS)]
    slope, level = toxicity.calibrate(np.array([without[f](c) for c, _, f in every]), np.array([y for _, y, _ in every]), prior)
    vote = votes_of(every)
    return [(i, 1 / (1 + math.exp(-slope * (math.log(v) - math.log(1 - v)) - level))) for i, v in ((i, vote(c)) for i, c, _ in counts)]


@pytest.mark.parametrize("by_label", [True, False])
def test_the_querys_scores_equal_brute_force(stored, by_label):
    docs, labels = tables(stored, 120)
    got = sorted(((r.doc_id, r.score) for r in toxicity.score_documents(docs, labels, by_label).collect()), key=str)
    want = sorted(brute_scores([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in labels.collect()], by_label), key=str)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-9)


def test_texts_with_a_known_word_have_evidence(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    got = toxicity.score_documents(docs, labels).collect()
    assert sum(not r.evidence for r in got) <= sum(not any(c.isalpha() for c in r.text or "") for r in docs.collect()) + 1
    assert len({round(r.score, 9) for r in got}) > len(got) // 2


def test_calibration_keeps_order_and_share():
    votes, labels = np.linspace(0.01, 0.99, 200), (np.linspace(0, 1, 200) > 0.6).astype(int)
    slope, level = toxicity.calibrate(votes, labels, 0.1)
    p = 1 / (1 + np.exp(-slope * toxicity.log_odds(votes) - level))
    weight = np.where(labels == 1, 0.1 / labels.sum(), 0.9 / (1 - labels).sum())
    assert slope > 0 and abs((p * weight).sum() - 0.1) < 0.02
    assert toxicity.calibrate(votes, 1 - labels, 0.1)[0] == 0.0


def test_long_texts_count_whole_and_names_may_clash(stored):
    a, b, c = [i for i in range(2, 20) if zlib.crc32(str(i).encode()) % 3 != 1][:3]  # these may be learned from
    rows = [(1, "word " * 300_000 + BAD, 1, "a"), (a, FINE, 2, "b"), (b, BAD, 3, "c"), (c, FINE + " more", 4, "d"), (0, None, None, None)]
    docs = stored(rows, "doc_id long, text string, terms long, toxic string", "d")
    labels = stored([(a, 0), (b, 1), (c, 0)], "doc_id long, toxic int", "l")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == 5 and got[1].evidence[:1] == [b] and got[1].score > got[a].score
    assert toxicity.keep_clean(docs, labels).schema == docs.schema
