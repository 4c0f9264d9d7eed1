"""Language ID with language-bitmask n-gram filters.

Each slot of one bit-sliced Bloom filter holds a bit per language. The slots
that an n-gram's hashes name, ANDed, give at once all languages whose filter
contains the n-gram. Per-language popcounts over a text's n-grams, corrected
for each language's false-positive rate, decide.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
repeated rows and rows sharing a doc_id are each judged by their own text; ties
go to the alphabetically first language; with nothing to learn from every text
with letters is ``und`` too; an empty table gives an empty result; rows with a
null lang are judged and never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc32_mod
from .ngrams import letters, ngram_hashes

SIZES = (3, 4)
#: Learning reads about this many documents of each language (chosen by a hash of their ids); the filter then is bounded.
LEARN_PER_LANG = 2_000
#: An n-gram must occur this often in a language's sample, and with this share of its rate where it is most frequent.
MIN_COUNT, MIN_RATE = 3, 0.3
SLOTS_LOG2, PROBES = 21, 3
#: A text is in none of the learned languages if fewer of its n-grams than this are in the best one's filter.
MIN_HITS = 0.1


@dataclass(frozen=True)
class LanguageFilter:
    langs: tuple[str, ...]
    #: slots x planes of 8 languages
    table: np.ndarray

    def rates(self) -> np.ndarray:
        """Each language's false-positive rate."""
        fill = np.array([np.mean(self.table[:, i // 8] >> np.uint8(i % 8) & np.uint8(1)) for i in range(len(self.langs))])
        return fill**PROBES


def slots(h: np.ndarray, probe: int) -> np.ndarray:
    """The slot of each hash for one probe: other bits of the 64 each time."""
    return ((h >> np.uint64(21 * probe)) & np.uint64((1 << SLOTS_LOG2) - 1)).astype(np.int64)


def build_filter(langs: list[str], grams: np.ndarray, owner: np.ndarray) -> LanguageFilter:
    """A filter of (n-gram hash, language number) pairs."""
    planes = np.zeros((1 << SLOTS_LOG2, max(1, -(-len(langs) // 8))), np.uint8)
    for probe in range(PROBES):
        at = slots(grams, probe)
        np.bitwise_or.at(planes, (at, owner // 8), (1 << (owner % 8)).astype(np.uint8))
    return LanguageFilter(tuple(langs), planes)


def popcounts(model: LanguageFilter, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hits[text, language], n-grams per text, and which texts have letters."""
    points, doc, has = letters(texts)
    hits = np.zeros((len(texts), len(model.langs)), np.int64)
    total = np.zeros(len(texts), np.int64)
    for n in SIZES:
        h, of = ngram_hashes(points, doc, n)
        total += np.bincount(of, minlength=len(texts))
        at = [slots(h, probe) for probe in range(PROBES)]
        for plane in range(model.table.shape[1]):
            column = model.table[:, plane]
            mask = column[at[0]]
            for x in at[1:]:
                mask &= column[x]
            here = min(8, len(model.langs) - 8 * plane)
            # texts x masks, then each language's bit summed over the masks
            seen = np.bincount(of * 256 + mask, minlength=256 * len(texts)).reshape(len(texts), 256)
            bits = np.arange(256)[:, None] >> np.arange(here) & 1
            hits[:, 8 * plane : 8 * plane + here] += seen @ bits
    return hits, total, has


def decide(model: LanguageFilter, rates: np.ndarray, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and the best language's share of the n-grams, for each text."""
    if not texts or not model.langs:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    hits, total, has = popcounts(model, texts)
    real = np.maximum(0.0, (hits - total[:, None] * rates) / np.maximum(1e-9, 1 - rates))
    best = np.argmax(real, axis=1)
    top = real[np.arange(len(texts)), best]
    score = np.where(has, np.clip(top / np.maximum(1e-9, real.sum(axis=1)), 0, 1), 0.0)
    share = np.where(has, np.clip(top / np.maximum(1, total), 0, 1), 0.0)
    return [model.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], score, share


def learn(train: DataFrame, per_lang: int = LEARN_PER_LANG) -> LanguageFilter:
    """The filter from (doc_id, text, lang) rows.

    What reaches the driver is bounded by ``per_lang`` documents of each language.
    """
    spark = train.sparkSession
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageFilter((), np.zeros((1, 1), np.uint8))
    shares = spark.createDataFrame([(k, min(1.0, per_lang / n)) for k, n in sizes.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003
    sample = train.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in chunks(batches, "text"):
            lang = np.array(batch.column("lang").to_pylist(), object)
            points, doc, _ = letters(batch.column("text").to_pylist())
            for n in SIZES:
                h, of = ngram_hashes(points, doc, n)
                owner = lang[of]
                for name in np.unique(lang):
                    g, k = np.unique(h[owner == name], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(g)), pa.array(g.view(np.int64)), pa.array(k)], ["lang", "gram", "n"]
                    )

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= MIN_COUNT).toArrow()
    langs = sorted(sizes)
    owner = np.array([langs.index(x) for x in found["lang"].to_pylist()], np.int64)
    grams = found["gram"].to_numpy().view(np.uint64)
    n = found["n"].to_numpy().astype(float)
    if len(n):
        rate = n / np.maximum(1, np.bincount(owner, n, len(langs)))[owner]
        _, same = np.unique(grams, return_inverse=True)
        most = np.zeros(same.max() + 1)
        np.maximum.at(most, same, rate)
        keep = rate >= MIN_RATE * most[same]
        grams, owner = grams[keep], owner[keep]
    return build_filter(langs, grams, owner)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred, score and hit_share of each row of ``docs``: one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model, model.rates()))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rates = shared.value
        for batch, _, _ in chunks(batches, "text"):
            lang, score, share = decide(model, rates, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(share)],
                ["doc_id", "lang_pred", "score", "hit_share"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        predict, "doc_id long, lang_pred string, score double, hit_share double"
    )


def train_rows(docs: DataFrame) -> DataFrame:
    """What may be learned from: a language, and a crc32(doc_id) that doesn't leave 2 modulo 4."""
    return docs.where(F.col("lang").isNotNull() & (crc32_mod("doc_id", 4) != 2)).select("doc_id", "text", "lang")


def label_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and hit_share of all documents."""
    out = identify(docs, learn(train_rows(docs)))
    return out.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "hit_share")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the learned languages, all columns as they were."""
    model = learn(train_rows(docs))
    shared = docs.sparkSession.sparkContext.broadcast((model, model.rates()))
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rates = shared.value
        for batch, _, _ in chunks(batches, "text"):
            lang, _, share = decide(model, rates, batch.column("text").to_pylist())
            ok = np.array([x != "und" for x in lang]) & (share >= MIN_HITS)
            yield batch.filter(pa.array(ok))

    return docs.select(*names).mapInArrow(keep, docs.schema)
