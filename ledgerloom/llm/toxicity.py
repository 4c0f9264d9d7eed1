"""Toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over all words that the examples have. A word's weight is its IDF over all
documents times its relevance, the size of its correlation with the labels: words are many
and most occur once or twice, so that by IDF alone chance words decide who is near.
A block-max inverted index of a bounded set of labelled examples gives each
text its exact nearest examples by cosine. The postings of the text's rarer words are read whole; what its
frequent words can add in a block of examples is bounded by their block maxima, and their postings are read
in the blocks of the largest bounds first, then only in those that can still hold a nearer example. The neighbours vote with
their cosines as weights, beside one vote of the labels' share; votes are calibrated on the examples
themselves, cross-fitted: each one's vote comes from an index of the other folds, whose weights haven't seen its label.
By IDF alone (``by_label=False``) cosines are plain TF-IDF; README gives the quality of both.

Words are runs of letters, lower-cased; one of more than five letters also counts as a stem, its first five.

Defined cases: a null, empty or letterless text, and any text without a word of
the examples, has no evidence and scores as the labels' share does; repeated rows
and shared doc_ids are each scored by their own text; a text of any length is scored whole; cosines equal to 12 digits go to the
earlier example (smaller doc_id first); labels without a document, documents without a label and
null labels teach nothing; with no labels at all every score is 0; other columns, whatever they are called,
play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc32_mod, materialize
from .ngrams import letters
from .words import BASE, run_hashes

#: Bounds of the fit, for each label: rows that examples come from, and bytes of their texts (both on average, by a draw of a hash).
FIT_ROWS, FIT_BYTES = 2_000, 32_000_000
#: Letters of a stem.
STEM = 5
#: Nearest examples that vote, and examples in a block of the index.
NEIGHBOURS, BLOCK = 15, 64
#: Folds of the examples for calibration, by a hash of their texts, so that copies are in one.
FOLDS = 4
#: A word is frequent if one in so many examples has it; blocks that are read at first; texts that are searched at once.
FREQUENT, FIRST_BLOCKS, TOGETHER = 10, 4, 16
#: Scores from here on are predicted toxic.
TOXIC = 0.7


@dataclass(frozen=True)
class ToxicIndex:
    #: sorted hashes of the examples' words, and each one's IDF times relevance
    terms: np.ndarray
    weights: np.ndarray
    #: by word, then example: the examples that have it and its weight there (of unit vectors)
    examples: np.ndarray
    values: np.ndarray
    #: each word's first posting, and one more for the end
    first: np.ndarray
    labels: np.ndarray
    #: by example, in their order: doc_ids, and hashes of the texts
    doc_ids: np.ndarray
    keys: np.ndarray
    #: share of toxic rows among all labelled ones
    prior: float

    @functools.cached_property
    def frequent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's number among the frequent ones (-1: rarer), their postings by block (words x blocks x BLOCK), and block maxima."""
        often = np.flatnonzero(np.diff(self.first) * FREQUENT >= len(self.labels))
        number = np.full(len(self.terms), -1)
        number[often] = np.arange(len(often))
        postings = np.zeros((len(often), -(-len(self.labels) // BLOCK) * BLOCK))
        at, of = spans(self.first[often], self.first[often + 1])
        postings[of, self.examples[at]] = self.values[at]
        postings = postings.reshape(len(often), -1, BLOCK)
        return number, postings, postings.max(axis=2, initial=0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "frequent"}


def term_counts(texts: list[str | None], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, count) triples, ordered by text and word; words are hashes, or places in ``known`` where only those count."""
    points, doc, _ = letters(texts)
    real = points != 0
    start = np.flatnonzero(real[1:] & ~real[:-1]) + 1
    end = np.flatnonzero(~real[1:] & real[:-1]) + 1
    h, doc = run_hashes(points, start, end, BASE), doc[start]
    long = end - start > STEM
    h = np.append(h, ~run_hashes(points, start[long], start[long] + STEM, BASE))
    doc = np.append(doc, doc[long])
    if known is None:
        known, term = np.unique(h, return_inverse=True)
    elif len(known):
        term = np.minimum(np.searchsorted(known, h), len(known) - 1)
        found = known[term] == h
        term, doc = term[found], doc[found]
        h = known
    else:
        doc, term = doc[:0], np.zeros(0, np.int64)
    pairs, n = np.unique(doc * max(1, len(known)) + term, return_counts=True)
    doc, term = np.divmod(pairs, max(1, len(known)))
    return doc, term if h is known else known[term], n


def unit_vectors(weights: np.ndarray, doc: np.ndarray, term: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The weights of (text, word, count) triples in their texts' unit vectors."""
    w = (1 + np.log(n)) * weights[term]
    norm = np.sqrt(np.bincount(doc, w * w, minlength=size))
    return w / np.maximum(norm[doc], 1e-300)


def build_index(
    terms: np.ndarray, weights: np.ndarray, doc: np.ndarray, term: np.ndarray, n: np.ndarray,
    labels: np.ndarray, doc_ids: np.ndarray, keys: np.ndarray, prior: float,
) -> ToxicIndex:
    """The inverted index of examples given as (example, word, count) triples."""
    values = unit_vectors(weights, doc, term, n, len(labels))
    order = np.lexsort((doc, term))
    first = np.searchsorted(term[order], np.arange(len(terms) + 1))
    return ToxicIndex(terms, weights, doc[order].astype(np.int32), values[order], first, labels, doc_ids, keys, prior)


def spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [first, last), and which range each is of."""
    size = last - first
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size - first, size), of


def nearest(
    index: ToxicIndex, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, k: int, skip: np.ndarray | None = None
) -> list[tuple[np.ndarray, np.ndarray]]:
    """The exact k nearest examples of each of ``size`` vectors, given as (text, word, weight): their numbers and cosines, nearest first.

    ``skip`` has for each vector an example that doesn't count (where examples are their own queries).
    """
    number, postings, maxima = index.frequent
    n, n_blocks = len(index.labels), postings.shape[1]
    rare = np.flatnonzero(number[term] < 0)
    at, of = spans(index.first[term[rare]], index.first[term[rare] + 1])
    exact = np.bincount(
        doc[rare][of] * (n_blocks * BLOCK) + index.examples[at], weight[rare][of] * index.values[at], minlength=size * n_blocks * BLOCK
    ).reshape(size, n_blocks, BLOCK)
    often = np.zeros((size, len(postings)))
    common = np.flatnonzero(number[term] >= 0)
    often[doc[common], number[term[common]]] = weight[common]
    bound = exact.max(axis=2, initial=0) + often @ maxima
    score = np.full((size, n_blocks, BLOCK), -1.0)
    done = np.zeros((size, n_blocks), bool)

    def read(wanted: np.ndarray) -> None:
        for block in np.flatnonzero(wanted.any(axis=0)).tolist():
            some = np.flatnonzero(wanted[:, block])
            score[some, block] = exact[some, block] + often[some] @ postings[:, block]
        done[wanted] = True
        if skip is not None:
            score.reshape(size, -1)[np.arange(size), skip] = -1.0

    first = np.zeros((size, n_blocks), bool)
    np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
    read(first & (bound > 0))
    flat = score.reshape(size, -1)
    least = np.partition(flat, -k, axis=1)[:, -k] if flat.shape[1] > k else np.full(size, -1.0)
    read(~done & (bound > 0) & (bound >= least[:, None] - 1e-9))
    least = np.partition(flat, -k, axis=1)[:, -k] if flat.shape[1] > k else np.full(size, -1.0)
    out = []
    for row, low in zip(flat[:, :n], least.tolist(), strict=True):
        own = np.flatnonzero((row >= low - 1e-12) & (row > 0))
        own = own[np.lexsort((own, -np.round(row[own], 12)))][:k]
        out.append((own, row[own]))
    return out


def vote(labels: np.ndarray, score: np.ndarray, prior: float) -> float:
    """The toxic share of the neighbours, each weighing as its cosine, and one more vote of weight 1 for the prior."""
    return float((labels @ score + prior) / (score.sum() + 1))


def log_odds(votes: np.ndarray) -> np.ndarray:
    p = np.clip(votes, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def calibrate(votes: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and level of a logistic regression of the labels on the votes' log odds, rows weighing so that ``prior`` of them are toxic.

    A slight pull towards the votes themselves keeps both finite.
    """
    toxic = labels == 1
    weight = np.where(toxic, prior / max(1, toxic.sum()), (1 - prior) / max(1, (~toxic).sum())) * len(votes)
    x = np.stack([log_odds(votes), np.ones(len(votes))], axis=1)
    at, pull = np.array([1.0, 0.0]), 1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -50, 50)))
        slope = x.T @ (weight * (p - toxic)) + pull * (at - [1, 0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at = at - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(at[0])), float(at[1])


def fit_rows(docs: DataFrame, labels: DataFrame, per_label: int = FIT_ROWS) -> tuple[DataFrame, float]:
    """(doc_id, text, toxic) of a bounded number of labelled rows of each label, chosen by a hash of their ids, and the toxic share of all."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc32_mod("doc_id", 3) != 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    def drawn(rows: DataFrame, shares: dict[int, float], seed: int) -> DataFrame:
        draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
        share = F.lit(1.0)
        for label, x in shares.items():
            share = F.when(F.col("toxic") == label, F.lit(min(1.0, x))).otherwise(share)
        return rows.where(draw < share)

    # bounded by per_label, so it may be broadcast; the documents stay where they are
    some = F.broadcast(drawn(known, {label: per_label / n for label, n in sizes.items()}, 1))
    rows = materialize(docs.select("doc_id", "text").join(some, "doc_id"), "labelled")
    bytes_of = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    shares = {label: FIT_BYTES / n for label, n in bytes_of.items() if n and n > FIT_BYTES}
    return drawn(rows, shares, 2) if shares else rows, sizes.get(1, 0) / max(1, sum(sizes.values()))


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each word is, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(shared.value) + 1, np.int64), 0
        for batch, _, _ in chunks(batches, "text"):
            _, term, _ = term_counts(batch.column("text").to_pylist(), shared.value)
            df[:-1] += np.bincount(term, minlength=len(shared.value))
            n += batch.num_rows
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "n"])

    sums = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms) + 1, np.int64)
    df[sums["term"].to_numpy()] = sums["n"].to_numpy()
    return df[:-1], int(df[-1])


def relevance(doc: np.ndarray, term: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """The size of each word's correlation (phi) with the labels over the examples, and a little more, so that no word counts nothing."""
    n, toxic = max(1, len(labels)), labels.sum()
    has = np.bincount(term, minlength=size)
    both = np.bincount(term, labels[doc], minlength=size)
    spread = np.sqrt(has * (n - has) * float(toxic) * (n - toxic))
    return np.abs(both * n - has * float(toxic)) / np.maximum(spread, 1) + 1 / n


def build(docs: DataFrame, fit: DataFrame, prior: float, by_label: bool = True) -> Iterator[ToxicIndex]:
    """For each fold an index of the other folds' (doc_id, key, text, toxic) rows of ``fit``, which knows nothing of that fold's, and last the index of all; words and counts reach the driver.

    ``by_label`` as for ``learn``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in chunks(batches, "text"):
            doc, term, n = term_counts(batch.column("text").to_pylist())
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(at, pa.array(term.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(n.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "toxic")), *lists], ["doc_id", "key", "toxic", "terms", "n"])

    shape = "doc_id long, key long, toxic int, terms array<long>, n array<int>"
    rows = fit.select("doc_id", "key", "toxic", "text").mapInArrow(count, shape).where(F.size("terms") > 0).orderBy("doc_id", "key").toArrow()
    toxic, doc_ids, keys = rows["toxic"].to_numpy().astype(np.int64), rows["doc_id"].to_numpy(), rows["key"].to_numpy()
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), pa.compute.list_value_length(rows["terms"]).to_numpy())
    terms, term = np.unique(pa.compute.list_flatten(rows["terms"]).to_numpy().view(np.uint64), return_inverse=True)
    n = pa.compute.list_flatten(rows["n"]).to_numpy()
    df, n_docs = document_frequencies(docs, terms) if len(terms) else (np.zeros(0, np.int64), 0)
    idf = np.log((1 + n_docs) / (1 + df)) + 1

    def of(rows: np.ndarray) -> ToxicIndex:
        """The index of some of the examples, as if there were no others."""
        number = np.cumsum(rows) - 1
        some = rows[doc]
        own, place = np.unique(term[some], return_inverse=True)
        at, labels = number[doc[some]].astype(np.int32), toxic[rows]
        weights = idf[own] * (relevance(at, place, labels, len(own)) if by_label else 1.0)
        return build_index(terms[own], weights, at, place, n[some], labels, doc_ids[rows], keys[rows], prior)

    for f in range(FOLDS):
        yield of(keys % FOLDS != f)
    yield of(np.ones(len(keys), bool))


def found_near(index: ToxicIndex, texts: list[str | None], skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's nearest examples; ``skip`` as for ``nearest``."""
    for low in range(0, len(texts), TOGETHER):
        some = texts[low : low + TOGETHER]
        doc, term, n = term_counts(some, index.terms)
        value = unit_vectors(index.weights, doc, term, n, len(some))
        yield from nearest(index, doc, term, value, len(some), NEIGHBOURS, None if skip is None else skip[low : low + TOGETHER])


def learn(docs: DataFrame, labels: DataFrame, per_label: int = FIT_ROWS, by_label: bool = True) -> tuple[Broadcast, tuple[float, float]]:
    """The index, broadcast, and the calibration of its votes: slope and level.

    Without ``by_label`` words weigh by their IDF alone. Examples get the votes that calibrate from an index that knows neither them nor, in its weights, their labels.
    """
    fit, prior = fit_rows(docs, labels, per_label)
    fit = fit.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text", "toxic")
    context = docs.sparkSession.sparkContext
    indexes, votes = build(docs, fit, prior, by_label), []

    def left_out(index: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, _, _ in chunks(batches, "text"):
                known, texts = index.value, batch.column("text").to_pylist()
                made = [vote(known.labels[near], score, known.prior) for near, score in found_near(known, texts)] if len(known.labels) else [known.prior] * len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.float64()), batch.column("toxic")], ["vote", "toxic"])

        return run

    for f in range(FOLDS):  # one index at a time is on the executors
        without = context.broadcast(next(indexes))
        some = fit.where(F.pmod("key", F.lit(FOLDS)) == f).mapInArrow(left_out(without), "vote double, toxic int")
        votes.append(some.orderBy("vote", "toxic").toArrow())
        without.destroy()
    found = pa.concat_tables(votes)
    shared = context.broadcast(next(indexes))
    return shared, calibrate(found["vote"].to_numpy(), found["toxic"].to_numpy(), prior) if len(found) else (1.0, 0.0)


def score_texts(index: ToxicIndex, calibration: tuple[float, float], texts: list[str | None]) -> tuple[np.ndarray, list[list[int]]]:
    """Score and the nearest examples' doc_ids (the evidence) of each text."""
    if not len(index.labels):
        return np.full(len(texts), index.prior), [[] for _ in texts]
    found = list(found_near(index, texts))
    votes = np.array([vote(index.labels[near], cosine, index.prior) for near, cosine in found])
    slope, level = calibration
    score = 1 / (1 + np.exp(-np.clip(slope * log_odds(votes) + level, -50, 50)))
    return score, [index.doc_ids[near[:3]].tolist() for near, _ in found]


def score_documents(docs: DataFrame, labels: DataFrame, by_label: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (doc_ids of the nearest examples) of every document; ``by_label`` as for ``learn``."""
    shared, calibration = learn(docs, labels, by_label=by_label)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in chunks(batches, "text"):
            score, evidence = score_texts(shared.value, calibration, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array(evidence, pa.list_(pa.int64()))], ["doc_id", "score", "evidence"]
            )

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        predict, "doc_id long, score double, evidence array<long>"
    )
    return out.select(
        "doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence"
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, all columns as they were."""
    shared, calibration = learn(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in chunks(batches, "text"):
            score, _ = score_texts(shared.value, calibration, batch.column("text").to_pylist())
            yield batch.filter(pa.array(score < TOXIC))

    return docs.mapInArrow(keep, docs.schema)
