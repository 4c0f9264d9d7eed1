import numpy as np

from ledgerloom.llm import langid
from ledgerloom.llm.ngrams import letters, ngram_hashes
from tests.conftest import SMALL


def test_ngrams_stay_within_texts_and_words():
    points, doc, has = letters(["Ab, c", None, "", "12 3", "d"])
    assert has.tolist() == [True, False, False, False, True]
    assert [(chr(p) if p else "_") for p in points] == list("_ab_c____d_")
    h, of = ngram_hashes(points, doc, 3)
    assert np.bincount(of, minlength=5).tolist() == [3, 0, 0, 0, 1]
    one, _ = ngram_hashes(*letters(["ab"])[:2], 3)
    two, _ = ngram_hashes(*letters(["x", "AB!"])[:2], 3)
    assert set(one) <= set(two)


def test_filter_returns_all_languages_of_an_ngram():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    owner = rng.integers(0, 11, 4000)
    model = langid.build_filter([f"l{i:02}" for i in range(11)], grams, owner)
    for probe in range(langid.PROBES):
        at = langid.slots(grams, probe)
        assert ((model.table[at, owner // 8] >> (owner % 8).astype(np.uint8)) & 1).all()
    assert (model.rates() < 0.01).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langid.label_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(stored):
    rows = [(i, "the thing that is with them and there", "en", 0.5) for i in range(20)] + [(100 + i, "der die das und nicht schön über", "de", 0.1) for i in range(20)]
    rows += [(201, None, "en", 0.0), (202, "", None, 0.0), (203, "12 3!", None, 0.0), (204, "the thing " * 20000, None, 0.0), (None, "über und nicht", None, 0.0), (204, "die das", None, 0.0)]
    df = stored(rows, "doc_id long, text string, lang string, score double")
    got = [(r.doc_id, r.lang_pred) for r in langid.label_languages(df).where("doc_id > 200 OR doc_id IS NULL").collect()]
    want = [(201, "und"), (202, "und"), (203, "und"), (204, "en"), (None, "de"), (204, "de")]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = langid.keep_known(df)
    assert kept.schema == df.schema and kept.count() == 43
    assert langid.label_languages(df.where("false")).collect() == []
    assert {r.lang_pred for r in langid.label_languages(df.withColumn("lang", df.lang.substr(9, 1)).where("lang > ''").union(df.where("doc_id = 204"))).collect()} == {"und"}
