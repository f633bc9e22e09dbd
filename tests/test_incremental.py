import random

import pytest
from pyspark.sql import functions as F

from tidewrack.functions.keys import entity_key
from tidewrack.operators import incremental as I


def numbers(df):
    return {x for r in df.collect() for x in range(r.lo, r.hi + 1)}


def intervals(spark, pairs):
    return spark.createDataFrame(pairs, I.INTERVALS)


def test_interval_algebra_against_sets(spark):
    rng = random.Random(3)
    for block in (4, 7, 1000):
        a = [(x, x + rng.randrange(6)) for x in (rng.randrange(-20, 60) for _ in range(9))]
        d = [(x, x + rng.randrange(9)) for x in (rng.randrange(-20, 60) for _ in range(5))]
        fa, fd = intervals(spark, a), intervals(spark, d)
        sa, sd = {n for x, y in a for n in range(x, y + 1)}, {n for x, y in d for n in range(x, y + 1)}
        merged = I.merge_intervals(fa, block)
        assert numbers(merged) == sa
        rows = sorted((r.lo, r.hi) for r in merged.collect())
        assert all(y < p for (_, y), (p, _) in zip(rows, rows[1:]))
        assert numbers(I.subtract_intervals(merged, I.merge_intervals(fd, block), block)) == sa - sd


def test_empty_and_null_numbers(spark):
    none = spark.createDataFrame([], "n bigint, x string")
    assert I.available_intervals(none, "n").count() == 0
    some = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b")], "n bigint, x string")
    assert numbers(I.available_intervals(some, "n")) == {3}
    assert I.pending(some, intervals(spark, []), "n").count() == 2


def test_runs_take_each_row_once_through_failures_and_late_rows(spark, tmp_path):
    ledger = I.RunLedger(spark, f"{tmp_path}/ledger", block=8)
    rows = lambda ns: spark.createDataFrame([(n, f"r{n}") for n in ns], "n bigint, x string")
    ledger.run(rows([1, 2, 5, 40]), "n", lambda df: df)

    def broken(df):
        return df.withColumn("x", F.raise_error(F.lit("lost")))

    with pytest.raises(Exception, match="lost"):
        ledger.run(rows([1, 2, 3, 5, 40]), "n", broken)
    assert len(ledger.commits()) == 1
    ledger.run(rows([1, 2, 3, 4, 5, 40, 41]), "n", lambda df: df)
    ledger.run(rows([1, 2, 3, 4, 5, 40, 41]), "n", lambda df: df)
    assert sorted(r.n for r in ledger.output().collect()) == [1, 2, 3, 4, 5, 40, 41]
    assert numbers(ledger.done()) == {1, 2, 3, 4, 5, 40, 41}
    assert [c["run"] for c in ledger.commits()] == [1, 2, 3]


def test_a_commit_can_be_made_once_only(spark, tmp_path):
    ledger = I.RunLedger(spark, f"{tmp_path}/ledger")
    ledger._create(f"{tmp_path}/ledger/commits/000000001.json", "{}")
    with pytest.raises(Exception):
        ledger._create(f"{tmp_path}/ledger/commits/000000001.json", "{}")


def test_a_torn_commit_blocks_no_later_run(spark, tmp_path, monkeypatch):
    ledger = I.RunLedger(spark, f"{tmp_path}/ledger", block=8)
    rows = lambda ns: spark.createDataFrame([(n,) for n in ns], "n bigint")
    ledger.run(rows([1, 2]), "n", lambda df: df)
    # The process dies once the commit is written, before it stands in its place: it never shows.
    class Dies:
        def rename(self, *_):
            raise KeyboardInterrupt

    monkeypatch.setattr(ledger, "_files", Dies())
    with pytest.raises(KeyboardInterrupt):
        ledger.run(rows([1, 2, 3]), "n", lambda df: df)
    monkeypatch.undo()
    assert [c["run"] for c in ledger.commits()] == [1]
    # An empty file of another writer counts as none.
    (tmp_path / "ledger/commits/000000002.json").write_text("")
    assert numbers(ledger.done()) == {1, 2} and sorted(r.n for r in ledger.output().collect()) == [1, 2]
    assert ledger.run(rows([1, 2, 3]), "n", lambda df: df)["run"] == 3
    assert numbers(ledger.done()) == {1, 2, 3} and sorted(r.n for r in ledger.output().collect()) == [1, 2, 3]


def test_intervals_of_an_earlier_system(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, " A ", "w1", "2024"), (2, "a", "w9", "2025"), (3, "a", None, "2025"), (4, None, " w2 ", None), (5, " ", "", "2025"), (6, None, "w3", "2023"), (7, None, "w4", "2024-01"), (8, None, "w5", None)],
        "row_no bigint, doi string, id string, updated_date string",
    )
    state = spark.createDataFrame([("a", 1, "2024"), ("a", 1, None), ("w3", 1, "2023"), ("w4", 1, None), (None, 1, "2030")], "key string, year int, updated_date string")
    taken = I.covered_by_state(rows, state, entity_key(), "updated_date", "row_no", block=4)
    assert numbers(taken) == {1, 4, 5, 6, 8}
    ledger = I.RunLedger(spark, f"{tmp_path}/ledger", block=4)
    ledger.adopt(taken)
    ledger.run(rows, "row_no", lambda df: I.newest_per_key(df, entity_key(), "updated_date", "row_no"))
    assert sorted((r.key, r.row_no) for r in ledger.output().collect()) == [("a", 3), ("w4", 7)]
    late = spark.createDataFrame([(0, None, "w7", "2020")], rows.schema)
    ledger.run(rows.unionAll(late), "row_no", lambda df: I.newest_per_key(df, entity_key(), "updated_date", "row_no"))
    assert sorted(r.row_no for r in ledger.output().collect()) == [0, 3, 7]


def test_newer_than_state_cases(spark):
    rows = spark.createDataFrame(
        [(1, " A ", "w1", "2024"), (2, "a", "w9", "2025"), (3, "a", None, "2025"), (4, None, " w2 ", None), (5, " ", "", "2025"), (6, None, "w3", "2023"), (7, None, "w4", "2024-01")],
        "row_no bigint, doi string, id string, updated_date string",
    )
    state = spark.createDataFrame([("a", 1, "2024"), ("a", 1, None), ("w3", 1, "2023"), ("w4", 1, None), (None, 1, "2030")], "key string, year int, updated_date string")
    got = I.newer_than_state(rows, state, entity_key(), "updated_date", "row_no")
    assert sorted((r.key, r.row_no) for r in got.collect()) == [("a", 3), ("w4", 7)]
    assert I.newer_than_state(rows.limit(0), state, entity_key(), "updated_date", "row_no").count() == 0
