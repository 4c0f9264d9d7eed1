import random
import zlib

import duckdb
import pytest

from ledgerloom.llm import merkle
from ledgerloom.llm.merkle import Mountain, digest, fold, sizes

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def levels_of(leaves, fanout):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def brute(rows, fanout=3):
    """Rows of ``verify_documents`` by whole trees in memory."""

    def leaf(row, text):
        values = [None if v is None else str(v) for v in (*row[:4], text)]
        return digest("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))

    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row, leaf(row, row[4])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[source] = levels_of([h for _, h in groups[source]], fanout)
    top = levels_of([trees[s][-1][0] for s in order], fanout)

    def path(tree, i):
        out = []
        for level in tree[:-1]:
            first = i // fanout * fanout
            out += ["".join(level[first:i]), "".join(level[i + 1 : first + fanout])]
            i //= fanout
        return out

    out = []
    for k, source in enumerate(order):
        for i, (row, h) in enumerate(groups[source]):
            up = path(trees[source], i) + path(top, k)
            text = row[4]
            if text is not None and zlib.crc32(b"" if row[0] is None else str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            root, folded = top[-1][0], fold(leaf(row, text), up)
            out.append((row[0], h, trees[source][-1][0], root, digest("".join(up)), folded, folded == root))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_mountain_is_the_tree_level_by_level(fanout):
    for n in range(1, 60):
        leaves = [digest(str(i)) for i in range(n)]
        mountain = Mountain(n, fanout=fanout)
        for i, h in enumerate(leaves):
            mountain.push(0, i, h)
        tree = levels_of(leaves, fanout)
        assert sizes(n, fanout) == list(map(len, tree))
        assert mountain.stack == [(len(tree) - 1, 0, tree[-1][0])]
        assert mountain.digests == {(k, i): h for k, level in enumerate(tree) if k for i, h in enumerate(level)}
        paths = mountain.descend({(len(tree) - 1, 0): ()})
        assert all(fold(h, paths[0, i]) == tree[-1][0] for i, h in enumerate(leaves))


def test_stretches_cut_anywhere_leave_few_peaks_that_merge():
    rng = random.Random(3)
    for n in (1, 2, 7, 26, 27, 28, 200, 731):
        tree = levels_of([digest(str(i)) for i in range(n)], 3)
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(9))})
        whole = Mountain(n)
        for a, b in zip(cuts, cuts[1:]):
            part = Mountain(n)
            for i in range(a, b):
                part.push(0, i, tree[0][i])
            assert len(part.stack) <= 2 * 2 * len(tree)
            for peak in part.stack:
                whole.push(*peak)
        assert whole.stack == [(len(tree) - 1, 0, tree[-1][0])]


def documents(sizes_of, seed=1):
    rng = random.Random(seed)
    rows, i = [], 0
    for source, n in sizes_of.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7 % 10_007, source, rng.choice([None, "de", "en"]), rng.choice([None, 3]), f"é{i}\n" * rng.randrange(3)))
    rng.shuffle(rows)
    return rows


def test_query_equals_whole_trees(spark, stored):
    # a source with most rows, one row alone, and rows that share all but nothing; blocks of 3 ** 2 leaves need three rounds
    rows = documents({"a": 400, "b": 1, None: 5, "": 30, "ü": 28, "c": 82})
    assert found(merkle.verify_documents(stored(rows, SCHEMA, files=5), levels=2)) == brute(rows)


def test_defined_cases(spark, stored):
    rows = [
        (1, "a", "en", 3, "x\ny"), (1, "a", "en", 3, "x\ny"), (1, "a", "en", 3, "other"), (None, "a", None, None, "\n"), (None, None, None, None, None),
        (2, None, "", 0, ""), (3, "", "", 0, "long\n" * 200_000), (-5, "a", "e:1", -1, "-"),
    ]
    docs = stored(rows, SCHEMA)
    for name in ("grp", "digest", "now", "index", "path", "part"):
        docs = docs.selectExpr("*", f"'extra' AS `{name}`")
    assert found(merkle.verify_documents(docs)) == brute(rows)
    one = [(9, None, None, None, None)]
    assert found(merkle.verify_documents(stored(one, SCHEMA, "one"))) == brute(one)
    empty = stored([], SCHEMA, "none")
    assert merkle.verify_documents(empty).collect() == []
    assert merkle.document_manifest(empty).root().collect() == []


def test_nodes_and_proofs_are_those_of_the_trees(spark, stored):
    rows = documents({"a": 100, "b": 12, "c": 1, None: 4}, 2)
    manifest = merkle.document_manifest(stored(rows, SCHEMA), fanout=2, levels=3)
    expected = {r[0]: r for r in brute(rows, 2)}
    root = manifest.root().first()
    assert (root.digest, root.sources) == (next(iter(expected.values()))[3], 4)
    for row in merkle.prove_documents(manifest).collect():
        assert row.leaf == expected[row.doc_id][1]
        assert digest("".join(row.proof)) == expected[row.doc_id][4] and fold(row.leaf, row.proof) == root.digest
    nodes = manifest.nodes().collect()
    per_tree = {}
    for x in nodes:
        per_tree.setdefault((x.tree, x.source), []).append((x.level, x["index"]))
    for (tree, source), keys in per_tree.items():
        n = 4 if tree == "sources" else sum(r[1] == source for r in rows)
        assert sorted(keys) == [(k, i) for k, size in enumerate(sizes(n, 2)) if k for i in range(size)]


def test_sql_equals_whole_trees():
    rows = documents({"a": 61, "b": 1, None: 5, "": 9}) + [(4, "a", None, None, None), (4, "a", None, None, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars INT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(merkle.oracle()).fetchall(), key=repr) == brute(rows)
