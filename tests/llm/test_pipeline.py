import corpus_pipeline
from ledgerloom.llm import langid, queries, simhash, toxicity
from tests.conftest import SMALL
from tests.llm.test_substrings import W


def first_of_groups(rows):
    """The smallest doc_id of each group of near copies: every pair within 3 bits, or of a five-word Jaccard of 0.8 or more."""
    prints = [simhash.fingerprint(r.text) for r in rows]
    words = [(r.text or "").encode().lower().split() for r in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            near = (prints[i] ^ prints[j]).bit_count() <= 3
            if near or sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return set(least.values())


def test_stages_follow_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if i < 4:
            assert out.schema == docs.schema
        out.write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        before_ids, ids = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in after.select("doc_id").collect()}
        if i == 0:
            pred = {r.doc_id for r in langid.label_languages(docs).where("lang_pred != 'und'").collect()}
            assert ids <= pred and len(ids) > 0.98 * len(before_ids)
        elif i == 1:
            assert ids == {r.doc_id for r in toxicity.score_documents(docs, labels).where("predicted = 0").collect()}
        elif i == 2:
            assert ids == first_of_groups(docs.collect()) and after.count() == len(ids)
        elif i == 3:
            assert ids == before_ids
            seen = set()
            for r in docs.collect():
                w = (r.text or "").split()
                for k in range(len(w) - W + 1):
                    seen.add(tuple(w[k : k + W]))
            texts = {r.doc_id: r.text for r in after.collect()}
            assert any(texts[r.doc_id] != r.text for r in docs.collect())
        else:
            assert ids == before_ids
        docs = after


def through(spark, docs, sf_dir, tmp_path):
    """What each stage leaves, written and read again."""
    left = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert i == 4 or out.schema == docs.schema
        out.write.parquet(f"{tmp_path}/stage-{i}")
        docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/stage-{i}")
        left.append(docs.collect())
    return left


def test_edges_through_all_stages(spark, stored, tmp_path):
    real = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    base = next(t for _, t, lang in real if lang == "en" and len(t.split()) > 60)
    odd = [(9_001, None, "en"), (9_002, "", "en"), (9_003, " \n", None), (9_004, base, "en"), (9_004, base, "en"), (None, base + " tail", None),
           (9_005, "12 34 !!", None), (9_006, " ".join([base] * 300), "en"), (None, None, None)]
    rows = [(i, t, lang, "s", len(t or ""), 1, "x", i) for i, t, lang in [*real, *odd]]
    shape = "doc_id long, text string, lang string, source string, n_chars long, row_no int, cuts string, `_row_no` long"
    left = through(spark, stored(rows, shape, "clash"), SMALL, tmp_path / "a")
    assert not {9_001, 9_002, 9_003, 9_005} & {r.doc_id for r in left[0]}  # no letter: in no language
    assert sum(r.doc_id == 9_004 for r in left[1]) == 2 and sum(r.doc_id == 9_004 for r in left[2]) <= 1
    assert sum(r.doc_id is None for r in left[2]) == 1 and len(left[3]) == len(left[2])
    assert {r.doc_id for r in left[4]} == {r.doc_id for r in left[3]}
    assert all(r.n_chars == len(r.text) for r in left[3])
    none = stored([], shape, "none")
    assert through(spark, none, SMALL, tmp_path / "b") == [[]] * 5


def test_run_gives_the_last_stages_rows(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_every_operator_has_a_query():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert names == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
