from concurrent.futures import ThreadPoolExecutor

import pytest

from ledgerloom.sources import keyed_table
from ledgerloom.sources.keyed_table import KeyedTable

SCHEMA = "a string, b long, v long"


def rows(spark, *found):
    return spark.createDataFrame(list(found), SCHEMA)


def test_the_last_row_of_a_key_wins(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["a", "b"], buckets=4)
    assert t.upsert(rows(spark, ("x", 1, 1), ("x", 1, 3), ("x", 1, 2), (None, None, 7)), "v") == 1
    assert t.upsert(rows(spark, ("x", 1, 0), ("y", 2, 5))) == 2
    assert {(r.a, r.b): r.v for r in t.read().collect()} == {("x", 1): 0, (None, None): 7, ("y", 2): 5}
    assert {(r.a, r.b): r.v for r in t.read(1).collect()} == {("x", 1): 3, (None, None): 7}
    assert t.upsert(rows(spark, (None, None, 8))) == 3 and t.read().count() == 3
    assert t.upsert(rows(spark).where("false")) == 3


def test_buckets_that_nothing_touches_keep_their_files(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["b"], buckets=8)
    t.upsert(rows(spark, *(("k", i, i) for i in range(40))))
    before = t.version()[1]
    t.upsert(rows(spark, ("k", 3, 30)))
    after = t.version()[1]
    assert sum(before[b] != after[b] for b in before) == 1 and t.read().count() == 40


def test_writers_at_once_lose_nothing(spark, tmp_path):
    def write(i):
        return KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["b"], buckets=2).upsert(rows(spark, ("w", i, i), ("w", 100, i)))

    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(write, range(6)))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
    found = {r.b: r.v for r in KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["b"], buckets=2).read().collect()}
    assert found == {**{i: i for i in range(6)}, 100: numbers.index(6)}


def test_a_version_that_was_begun_and_not_ended_is_waited_for(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["b"])
    t.upsert(rows(spark, ("k", 1, 1)))
    (tmp_path / "t/versions/000000002").write_text("")
    monkeypatch.setattr(keyed_table, "PATIENCE", 0.3)
    with pytest.raises(TimeoutError):
        t.read()
