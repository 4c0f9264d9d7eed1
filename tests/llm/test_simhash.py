import numpy as np
import xxhash

from ledgerloom.llm import minhash, simhash, vptree


def slow_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fp = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fp[i] ^ fp[j]).bit_count() <= 3 and root[j] < root[i]:
                    root[i] = root[j]
    ids = {}
    for (i, _), r in zip(rows, root, strict=True):
        ids.setdefault(r, []).append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fp, root, strict=True)), key=str)


TEXTS = ["One two THREE four", "one TWO three\nfour", "", None, "  ", "a", "a b", "É ß x y", "nb\u00a0sp is one", "w " * 5000]


def test_labels_match_brute_force(stored):
    base = [f"w{i}" for i in range(300)]
    rows = [(10 + i, t) for i, t in enumerate(TEXTS)] + [(10, TEXTS[0]), (None, "a"), (None, "lonely one here")]
    for i in range(40):
        copy = list(base)
        for k in range(i % 7):
            copy[(13 * i + 31 * k) % 300] = f"e{i}"
        rows.append((100 + i, " ".join(copy)))
    got = simhash.label_documents(stored(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == brute(rows)


def near_codes(n, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n // 2).astype(np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (n // 2, 4)).astype(np.uint64))
    return np.unique(np.concatenate([a, a ^ flips[:, 0] ^ flips[:, 1], a ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2] ^ flips[:, 3]]))


def roots(values, links):
    up = {v: v for v in values}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def test_sharded_search_loses_no_link():
    v = near_codes(1200)
    root, leaves = vptree.build(v, 60)
    home = vptree.home_leaves(root, v)
    at, to = vptree.visits(root, v, 3)
    links = []
    for leaf in range(leaves):
        a, b = vptree.local_stars(v[home == leaf], v[at[to == leaf]], 3)
        links += zip(a.tolist(), b.tolist(), strict=True)
    close = np.argwhere(np.bitwise_count(v[:, None] ^ v[None, :]) <= 3)
    assert roots(v.tolist(), links) == roots(v.tolist(), ((int(v[i]), int(v[j])) for i, j in close))


def test_sharded_query_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 1)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    v = near_codes(600, 5)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.star_links(df).collect()]
    close = np.argwhere(np.bitwise_count(v[:, None] ^ v[None, :]) <= 3)
    assert roots(v.tolist(), links) == roots(v.tolist(), ((int(v[i]), int(v[j])) for i, j in close))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.a: r.b for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 95: 90, 100: 90}
    assert simhash.components(links.where("false")).collect() == []


def test_one_of_each_group_stays(stored):
    rows = [(3, "same text here now", "x"), (1, "Same text here now", "y"), (1, "Same text here now", "y"), (2, "other words are these", "z"), (None, "same text here now", "n")]
    df = stored(rows, "doc_id long, text string, component_id string")
    assert sorted(map(tuple, simhash.keep_one(df).collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
    assert simhash.label_documents(df.where("false")).collect() == []


def near_texts(n=30, seed=3):
    """Texts of 60 to 120 words, each with copies of which some words are others."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = [f"v{x}" for x in rng.integers(0, 5000, rng.integers(60, 120))]
        rows.append(" ".join(base))
        for k in (1, 2, 4):
            copy = list(base)
            for p in rng.integers(0, len(copy), k):
                copy[p] = f"e{p}"
            rows.append(" ".join(copy))
    return rows


def jaccard_roots(texts):
    """Components of all links by 3 bits or by a five-word Jaccard of 0.8, by brute force."""
    split = [t.lower().split() for t in texts]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in split]
    fp = [slow_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    near = [(i, j) for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    bits = [(i, j) for i, j in pairs if (fp[i] ^ fp[j]).bit_count() <= 3]
    assert set(near) - set(bits)
    return roots(range(len(texts)), near + bits)


def test_near_copies_beyond_the_bits_leave(stored, monkeypatch):
    texts = near_texts()
    want = sorted(set(jaccard_roots(texts).values()))
    df = stored(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == want
    monkeypatch.setattr(minhash, "BLOCK", 150)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == want


def test_stars_have_the_components_of_all_links():
    sets = [minhash.shingles(t) for t in near_texts(12, 8)]
    member, root = minhash.stars(sets)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    assert links and roots(range(len(sets)), zip(member.tolist(), root.tolist(), strict=True)) == roots(range(len(sets)), links)


def test_texts_that_share_an_id_stay_in_their_own_groups(stored):
    rows = [(1, "same text here now"), (1, "other words are these"), (1, "other words are these"), (2, "Other words are these"), (3, "a third one is alone"), (None, "same text here now")]
    df = stored(rows, "doc_id long, text string")
    want = [(1, "other words are these"), (1, "same text here now"), (3, "a third one is alone"), (None, "same text here now")]
    assert sorted(map(tuple, simhash.keep_one(df).collect()), key=str) == sorted(want, key=str)
    many = stored([(7, " ".join(f"w{i}_{k}" for k in range(9))) for i in range(20)], "doc_id long, text string", "many")
    assert simhash.keep_one(many).count() == 20
